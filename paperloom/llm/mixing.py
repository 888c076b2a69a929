"""Mixing sources to target shares of the tokens.

Method: a time-varying curriculum. Training runs over positions t in [0, 1]; source i is drawn with the weight s_i * (1 + a_i * (2t - 1)),
a ramp about its target share s_i. Its integral, the demand up to t, is D_i(t) = B_i * (t + a_i * (t^2 - t)) with B_i the tokens that
the source is to give in all. The documents of a source stand one after the other in a stream, which is passed through `max_repeats`
times at most. A document that starts at token c of the stream stands where D_i(t) = c, a quadratic that is solved in closed form;
sorting all documents by position by range yields the training order. A source is short if the demand at t = 1 lies beyond the end of
its last pass; it then gives what it has, and what is missing isn't given to others, so that their shares rise in proportion. The
streams are prefix sums over hashed order, computed in pieces whose number follows the source's size.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.session import cut_lineage

#: A path on every machine; the file is never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents in a piece of a source's stream, about.
IN_PIECE = 50_000


def _encoding(path: str):  # noqa: ANN202
    """The tokenizer, kept for the life of the worker process."""
    kept = sys.__dict__.setdefault("_paperloom_encodings", {})
    if path not in kept:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_count(text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text; 0 for null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(x)) if x else 0 for x in texts], dtype="int64")

    return count(text)


def source_key(source: str | Column) -> Column:
    return F.trim(F.lower(source))


def with_tokens(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents whose source is among the targets; the list of sources is small and its size is left to the optimizer."""
    listed = targets.select(source_key("source").alias("source")).where("source is not null").distinct()
    own = documents.select("doc_id", source_key("source").alias("source"), "text").join(listed, "source", "left_semi")
    return own.select("doc_id", "source", token_count("text", vocabulary).alias("n_tokens"))


def supply(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: (source, target_share, max_repeats, n_tokens, n_documents, demand, given, missing, n_passes, actual_share).

    `demand` is the target share of T, the tokens of all listed sources; `given` at most max_repeats times what the source has, `missing`
    the rest. Of a source that is listed twice, the larger share and number of repeats count. A source without documents has 0 tokens.
    """
    wanted = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    wanted = wanted.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_documents"))
    rows = wanted.join(have, "source", "left").fillna(0, ["n_tokens", "n_documents"])
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row for each target
    rows = rows.withColumn("demand", F.col("target_share") * F.sum("n_tokens").over(everything))
    given = F.least("demand", (F.col("max_repeats") * F.col("n_tokens")).cast("double"))
    rows = rows.withColumns({"given": given, "missing": F.col("demand") - given})
    passes = F.when(F.col("n_tokens") > 0, F.ceil(F.col("given") / F.col("n_tokens"))).otherwise(0).cast("int")
    return rows.withColumn("n_passes", passes).withColumn("actual_share", F.try_divide("given", F.sum("given").over(everything)))


def ramps(plan: DataFrame, steepness: float = 0.8) -> DataFrame:
    """Adds `ramp`, the a_i of each source: sources that are repeated more come later. The mean of a_i by share is 0, so the weights add up to 1 at every t; |a_i| <= steepness < 1."""
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mean = F.sum(F.col("actual_share") * F.col("n_passes")).over(everything)
    off = F.col("n_passes") - mean
    return plan.withColumn("off", off).withColumn("ramp", F.coalesce(F.lit(steepness) * F.try_divide(F.col("off"), F.max(F.abs("off")).over(everything)), F.lit(0.0))).drop("off")


def demanded(t: Column, total: Column, ramp: Column) -> Column:
    """The integral of a source's weight schedule up to t, in tokens; `total` at 1."""
    return total * (t + ramp * (t * t - t))


def position(start: Column, total: Column, ramp: Column) -> Column:
    """The t in [0, 1] where demanded() reaches `start`."""
    y = F.try_divide(start, total)
    b = 1 - ramp
    root = F.try_divide(2 * y, b + F.sqrt(b * b + 4 * ramp * y))  # stable for a near 0 and of either sign
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), root)), F.lit(0.0))


def streams(sized: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(source, doc_id, n_tokens, start): where each document starts in its source's stream. Documents without tokens take no room and are left out."""
    pieces = plan.select("source", F.greatest(F.lit(1), F.ceil(F.col("n_documents") / IN_PIECE)).cast("int").alias("n_pieces"))
    rows = sized.where("n_tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).join(pieces, "source")
    rows = rows.withColumn("piece", F.pmod("h", "n_pieces").cast("int")).drop("n_pieces")
    by_piece = rows.groupBy("source", "piece").agg(F.sum("n_tokens").alias("in_piece"))
    before = F.coalesce(F.sum("in_piece").over(W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_piece = by_piece.select("source", "piece", before.alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "piece").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", inside).join(by_piece, ["source", "piece"])
    return placed.select("source", "doc_id", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def schedule(sized: DataFrame, targets: DataFrame, steepness: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The plan, one row for each target, and the streams.

    The plan has the columns of supply(), ramp, stream_end (the token after which the last pass ends), run_out (the position where a
    source that is drawn by its target share has nothing left, 1 for the others) and short (the demand at 1 lies beyond stream_end).
    """
    plan = cut_lineage(ramps(supply(sized, targets), steepness))
    placed = streams(sized, plan, seed)
    ends = placed.groupBy("source").agg(F.max(F.col("start") + F.col("n_tokens")).alias("one_pass"))
    rows = plan.join(ends, "source", "left").withColumn("stream_end", (F.col("max_repeats") * F.coalesce("one_pass", F.lit(0))).cast("double")).drop("one_pass")
    at_end = demanded(F.lit(1.0), F.col("demand"), F.col("ramp"))
    rows = rows.withColumn("short", F.coalesce(at_end > F.col("stream_end"), F.lit(False)))
    return rows.withColumn("run_out", F.when(F.col("short"), position(F.col("stream_end"), F.col("demand"), F.col("ramp"))).otherwise(1.0)), placed


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, sized: DataFrame | None = None) -> DataFrame:
    """The plan of schedule(), from documents or from (doc_id, source, n_tokens) in `sized`."""
    return schedule(sized if sized is not None else cut_lineage(with_tokens(documents, targets, vocabulary)), targets)[0]


def curriculum(documents: DataFrame, targets: DataFrame, seed: int = 0, steepness: float = 0.8, vocabulary: str = VOCABULARY, sized: DataFrame | None = None) -> DataFrame:
    """(position, source, doc_id, repeat_no, n_tokens): the documents in training order, sorted by range.

    A document is drawn where its stream's start lies before the source's given tokens; documents without tokens take no room and are
    left out. Null or unknown sources aren't drawn. Ties stand in the order of doc_id. Texts are turned into tokens once.
    """
    sized = sized if sized is not None else cut_lineage(with_tokens(documents, targets, vocabulary))
    plan, placed = schedule(sized, targets, steepness, seed)
    drawn = placed.join(plan.select("source", F.col("n_tokens").alias("have"), "given", "ramp", "n_passes"), "source").where("n_passes > 0")
    drawn = drawn.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("n_passes"))))
    drawn = drawn.withColumn("start", (F.col("repeat_no") - 1) * F.col("have") + F.col("start")).where("start < given")
    out = drawn.select(position(F.col("start"), F.col("given"), F.col("ramp")).alias("position"), "source", "doc_id", "repeat_no", "n_tokens")
    return out.orderBy("position", "source", "doc_id", "repeat_no")

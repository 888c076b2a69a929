"""Keywords in context by group and period: their contexts as vectors, nearest words by resampling, contrasts and examples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from paperloom.operators import embed


def contexts(tokens: DataFrame, key: str, word: str, by: tuple[str, ...] = (), width: int = 6) -> DataFrame:
    """(by, vec_id, context): the words within `width` places of each occurrence of the word, without it; vec_id is a number out of a hash of the document and the place."""
    rows = tokens.where(F.array_contains("tokens", word)).select(key, *by, F.posexplode("tokens").alias("i", "w"), "tokens").where(F.col("w") == word)
    low = F.greatest(F.lit(0), F.col("i") - width)
    words = F.concat(F.slice("tokens", low + 1, F.col("i") - low), F.slice("tokens", F.col("i") + 2, width))
    return rows.select(*by, F.conv(F.substring(F.md5(F.concat_ws("|", key, "i")), 1, 15), 16, 10).cast("long").alias("vec_id"), words.alias("context"))


def vocabulary(found: DataFrame, word: str) -> DataFrame:
    """(word): the words of contexts(), without the keyword itself."""
    return found.select(F.explode("context").alias("word")).where(F.col("word") != word).distinct()


def embedded(found: DataFrame, vectors: DataFrame, matrix: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, vec_id, n, embedding): the mean vector of the words of each context, times the transform matrix if there is one.

    `vectors` is (word, vector), `matrix` (row, values) of the size of a vector squared. Contexts without a known word are left out. A
    context has at most twice its width in words, so its vectors are held together.
    """
    rows = found.select(*by, "vec_id", F.explode("context").alias("word")).join(vectors.select("word", "vector"), "word")
    kinds = dict(found.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "vec_id long, n int, embedding array<double>"])
    turn = None if matrix is None else np.array([r["values"] for r in matrix.orderBy("row").collect()])

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            means = [np.mean(np.array(v.tolist()), axis=0) for v in batch["vectors"]]
            n = [len(v) for v in batch["vectors"]]
            yield batch.drop(columns=["vectors"]).assign(n=n, embedding=[(m if turn is None else turn @ m).tolist() for m in means])

    return rows.groupBy(*by, "vec_id").agg(F.collect_list("vector").alias("vectors")).mapInPandas(mean, schema)


def nearest_words(context_vectors: DataFrame, candidates: DataFrame, by: tuple[str, ...], boots: int = 20, most: int = 20, seed: int = 42) -> DataFrame:
    """(by, word, estimate, std_error, low, high, rank): for each group the words nearest to its mean context, over resamples of the contexts.

    `candidates` is (word, vector). estimate and std_error are the mean and spread of the similarity over the resamples, low and high the
    band of 1.96 errors. Both are rounded to nine places. Only the means reach the driver, one for each group and resample. All words as near as the last are kept.
    """
    sums = embed.weighted_sums(context_vectors, list(by), lambda rows, run: embed.poisson(rows["vec_id"].to_numpy(), run, seed), boots).collect()
    kinds = dict(context_vectors.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "word string, estimate double, std_error double"])
    groups: dict[tuple, list[np.ndarray]] = {}
    for r in sorted(sums, key=lambda r: r["run"]):
        groups.setdefault(tuple(r[c] for c in by), []).append(np.array(r["total"]) / np.linalg.norm(r["total"]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = embed._matrix(batch["vector"]) if len(batch) else np.zeros((0, 0))
            for group, means in groups.items() if len(batch) else ():
                s = x @ np.stack(means).T
                spread = s.std(axis=1, ddof=1) if len(means) > 1 else np.full(len(s), np.nan)
                yield pd.DataFrame({c: [v] * len(s) for c, v in zip(by, group, strict=True)} | {"word": batch["word"], "estimate": s.mean(axis=1), "std_error": spread})

    near = candidates.select("word", "vector").mapInPandas(compare, schema)
    near = near.withColumns({"estimate": F.round("estimate", 9), "std_error": F.round("std_error", 9)})
    near = near.withColumns({"low": F.col("estimate") - 1.96 * F.col("std_error"), "high": F.col("estimate") + 1.96 * F.col("std_error")})
    return embed.top_with_ties(near.where("not isnan(estimate)"), list(by), "estimate", most)


def in_both(near: DataFrame, group: str) -> DataFrame:
    """The rows of words that stand in more than one group."""
    return near.withColumn("_n", F.count("*").over(W.partitionBy("word"))).where("_n > 1").drop("_n")


def examples(found: DataFrame, context_vectors: DataFrame, by: tuple[str, ...], most: int = 5) -> DataFrame:
    """(by, vec_id, context, similarity, rank): for each group the contexts nearest to its mean context, ties by id."""
    sums = embed.weighted_sums(context_vectors, list(by), lambda rows, run: np.ones(len(rows)), 1)
    mean = sums.select(*by, F.col("total").alias("mean"))  # one row a group
    near = context_vectors.join(F.broadcast(mean), list(by)).select(*by, "vec_id", F.round(embed.cosine(F.col("embedding"), F.col("mean")), 9).alias("similarity"))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last("similarity"), "vec_id"))).where(F.col("rank") <= most)
    return near.join(found.select("vec_id", F.array_join("context", " ").alias("context")), "vec_id").select(*by, "vec_id", "context", "similarity", "rank")

"""Words in context: windows, co-occurrence, weights of terms, and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.functions.stats import with_totals
from paperloom.session import cut_lineage

#: Query vectors of a block; each block is broadcast and compared with all vectors, so any number of queries can be asked.
MAX_QUERIES = 20_000
#: Vectors that are compared with a block of queries at once.
CHUNK = 512


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """One row a vector, of length 1; a vector of zeros has nulls."""
    x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best(query: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int, ties: bool) -> np.ndarray:
    """The places of the k best of each query, by value and id; with `ties` all that are as good as the k-th."""
    order = np.lexsort((ids, -value, query))
    q, v = query[order], value[order]
    first = np.r_[True, q[1:] != q[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    place = np.arange(len(q)) - start
    if ties:
        new = first | np.r_[True, v[1:] != v[:-1]]
        place = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) - start
    return order[place < k]


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, ties: bool = False) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest of all vectors for each query vector, itself excluded, ties by id, or with `ties` all kept.

    `queries` is a stated set of any size, taken in blocks of MAX_QUERIES. Each partition of vectors keeps its own k best of each query
    before any are shuffled. A vector of zeros has no similarity and comes last.
    """
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"query_id {kind}, vec_id {kind}, similarity double"
    found = None
    for i in range(blocks):
        rows = queries.where(block == i).select("vec_id", "embedding").toPandas()  # about MAX_QUERIES rows
        if not len(rows):
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((rows["vec_id"].to_numpy(), _matrix(rows["embedding"])))

        def near(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            query_ids, q = shared.value
            kept = (np.empty(0, np.int64), np.empty(0, query_ids.dtype), np.empty(0))
            for batch in batches:
                for low in range(0, len(batch), CHUNK):
                    part = batch[low : low + CHUNK]
                    ids = part["vec_id"].to_numpy()
                    s = np.nan_to_num(q @ _matrix(part["embedding"]).T, nan=-2.0)
                    bar = np.partition(s, -min(k + 1, s.shape[1]), axis=1)[:, -min(k + 1, s.shape[1])]  # one more, as the query itself may be among them
                    at, of = np.nonzero(s >= bar[:, None])
                    other = ids[of] != query_ids[at]
                    at, of = at[other], of[other]
                    merged = tuple(np.concatenate([x, y]) for x, y in zip(kept, (at, ids[of], s[at, of]), strict=True))
                    best = _best(*merged, k, ties)
                    kept = tuple(x[best] for x in merged)
            at, ids, s = kept
            yield pd.DataFrame({"query_id": query_ids[at], "vec_id": ids, "similarity": np.where(s < -1.5, np.nan, s)})

        part = vectors.select("vec_id", "embedding").mapInPandas(near, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    by = W.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), *([] if ties else ["vec_id"]))
    found = found.withColumn("similarity", F.nanvl("similarity", F.lit(None).cast("double")))
    return found.withColumn("rank", (F.rank() if ties else F.row_number()).over(by)).where(F.col("rank") <= k)


def analogy(vectors: DataFrame, plus: int, minus: int, base: int) -> DataFrame:
    """(vec_id, similarity) to base - minus + plus."""
    of = lambda i: vectors.where(F.col("vec_id") == i).select("embedding").scalar()
    rows = vectors.withColumns({"_b": of(base), "_m": of(minus), "_p": of(plus)})
    target = F.zip_with(F.zip_with("_b", "_m", lambda a, b: a - b), F.col("_p"), lambda a, b: a + b)
    return rows.withColumn("_t", target).select("vec_id", cosine(F.col("embedding"), F.col("_t")).alias("similarity"))


def window_pairs(tokens: DataFrame, key: str, words: str = "tokens", width: int = 6) -> DataFrame:
    """(a, b, n), a < b: words within `width` places of each other, each occurrence. Windows are cut from the array, so long texts make no square."""
    rows = tokens.select(F.posexplode(words).alias("i", "a"), F.col(words).alias("ws"))
    rows = rows.select("a", F.explode(F.slice("ws", F.col("i") + 2, width)).alias("b"))
    return rows.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def windows(tokens: DataFrame, key: str, words: str = "tokens", k: int = 4) -> DataFrame:
    """(key, window_no, window): complete windows of k words, step 1."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return tokens.select(key, F.posexplode(F.transform(at, lambda i: F.slice(words, i, k))).alias("window_no", "window"))


def pruned_pairs(tokens: DataFrame, key: str, words: str = "tokens", width: int = 6, least: int = 5) -> DataFrame:
    """window_pairs() of words that occur at least `least` times; the windows are cut before words are left out."""
    often = tokens.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n_w")).where(F.col("n_w") >= least).select("w")
    return window_pairs(tokens, key, words, width).join(often.toDF("a"), "a", "left_semi").join(often.toDF("b"), "b", "left_semi")


def window_pmi(tokens: DataFrame, key: str, k: int = 4, least: int = 1) -> DataFrame:
    """(a, b, n, pmi): ln(p(a, b) / (p(a) p(b))) over windows, of words in at least `least` windows.

    Texts are read once: windows, words and pairs are counted together, as rows with two nulls, one or none, and written.
    """
    win = windows(tokens, key, k=k).select(F.array_sort(F.array_distinct("window")).alias("w"))
    none = F.lit(None).cast("string")
    own = F.transform("w", lambda a: F.struct(a.alias("a"), none.alias("b")))
    pairs = F.flatten(F.transform("w", lambda a, i: F.transform(F.slice("w", i + 2, k), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = win.select(F.explode(F.concat(F.array(F.struct(none.alias("a"), none.alias("b"))), own, pairs)).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n"))
    rows = cut_lineage(rows)
    single = rows.where(F.col("a").isNotNull() & F.col("b").isNull() & (F.col("n") >= least)).select("a", F.col("n").alias("n_a"))
    pair = rows.where("b is not null").join(single, "a").join(single.toDF("b", "n_b"), "b")
    rows = with_totals(pair, rows.where("a is null").select(F.col("n").alias("n_windows")))
    return rows.select("a", "b", "n", F.ln(F.col("n") * F.col("n_windows") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("pmi"))


def keyword_in_context(tokens: DataFrame, key: str, word: str, width: int = 6) -> DataFrame:
    """(key, place, before, after): the words around each occurrence."""
    rows = tokens.where(F.array_contains("tokens", word)).select(key, F.posexplode("tokens").alias("i", "w"), "tokens").where(F.col("w") == word)
    low = F.greatest(F.lit(0), F.col("i") - width)
    return rows.select(key, F.col("i").alias("place"), F.array_join(F.slice("tokens", low + 1, F.col("i") - low), " ").alias("before"), F.array_join(F.slice("tokens", F.col("i") + 2, width), " ").alias("after"))


def tf_idf(words: DataFrame, document: str) -> DataFrame:
    """(document, word, n, total, tf_idf): n / total * ln(N / df), from rows of one word each."""
    n = cut_lineage(words.groupBy(document, "word").agg(F.count("*").alias("n")))  # read three times
    total = n.groupBy(document).agg(F.sum("n").alias("total"))
    df = n.groupBy("word").agg(F.count("*").alias("df"))
    rows = with_totals(n.join(total, document).join(df, "word"), total.agg(F.count("*").alias("n_docs")))
    return rows.select(document, "word", "n", "total", (F.col("n") / F.col("total") * F.ln(F.col("n_docs") / F.col("df"))).alias("tf_idf"))


def top_with_ties(rows: DataFrame, by: str | list[str], value: str, k: int) -> DataFrame:
    """The rows whose value is among the k largest of their group, ties kept."""
    return rows.withColumn("rank", F.rank().over(W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc(value)))).where(F.col("rank") <= k)


def stem(word: Column) -> Column:
    """A light English stemmer by rules of endings: plurals, -ing, -ed, -ly, and a final e."""
    w = F.regexp_replace(F.regexp_replace(word, "sses$", "ss"), "ies$", "y")
    w = F.when((F.length(w) > 3) & w.rlike("[^su]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    w = F.when(w.rlike("[aeiouy].*ing$") & (F.length(w) > 5), F.regexp_replace(w, "ing$", "")).when(w.rlike("[aeiouy].*ed$") & (F.length(w) > 4), F.regexp_replace(w, "ed$", "")).otherwise(w)
    w = F.when((F.length(w) > 4) & w.endswith("ly"), F.regexp_replace(w, "ly$", "")).otherwise(w)
    return F.when((F.length(w) > 4) & w.endswith("e"), F.regexp_replace(w, "e$", "")).otherwise(w)


def skipgrams(tokens: DataFrame, key: str, width: int = 3, negatives: int = 1, seed: int = 42) -> DataFrame:
    """(key, target, context, label): pairs within `width` as 1, and as many drawn from the document's words as 0, at places that a sum of multiples scatters; repeatable by seed."""
    rows = tokens.select(key, F.posexplode("tokens").alias("i", "target"), "tokens")
    good = rows.select(key, "target", F.explode(F.slice("tokens", F.col("i") + 2, width)).alias("context"), F.lit(1).alias("label"))
    at = lambda j: ((F.col("i").cast("long") * 7920 + F.ascii("target") * 104729 + (seed + j) * 31) % F.size("tokens")).cast("int")
    bad = rows.select(key, "target", F.explode(F.array(*(F.get("tokens", at(j)) for j in range(negatives)))).alias("context"), F.lit(0).alias("label"))
    return good.unionByName(bad)


def uniform(ids: np.ndarray, run: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the id, the run and the seed alone; plain whole-number arithmetic, so that any engine can repeat it."""
    x = (ids.astype(np.int64) % 2147483647 * 1103515245 + run * 69621 + seed * 7919 + 12345) % 2147483648
    for _ in range(2):
        x = (x ^ (x >> 11)) * 1103515245 % 2147483648
    return x / 2147483648.0


#: The shares of 0, 1, 2, 3 draws of a Poisson distribution with mean 1, added up.
_DRAWS = np.array([0.367879, 0.735759, 0.919699, 0.981012])


def poisson(ids: np.ndarray, run: int, seed: int) -> np.ndarray:
    """How often each row counts in a resample: a draw of 0 to 4 with mean about 1."""
    return np.searchsorted(_DRAWS, uniform(ids, run, seed), side="right").astype(np.float64)


def weighted_sums(rows: DataFrame, by: list[str], weigh: Callable[[pd.DataFrame, int], np.ndarray], runs: int, vector: str = "embedding", first_run: int = 1) -> DataFrame:
    """(by, run, n, total): for each group and run the sum of weights and the weighted sum of vectors.

    weigh(rows, run) gives the weight of each row. Every task adds up what it reads, so no row is copied for a run; a group and run
    gives one row a task to the shuffle.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "run int, n double, total array<double>"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for group, part in batch.groupby(by, dropna=False) if len(batch) else ():
                x = np.array(part[vector].tolist(), dtype=np.float64)
                w = np.stack([weigh(part, r) for r in range(first_run, first_run + runs)])
                n, total = sums.get(group, (0.0, 0.0))
                sums[group] = (n + w.sum(axis=1), total + w @ x)
        out = [(*group, first_run + r, float(n[r]), total[r].tolist()) for group, (n, total) in sums.items() for r in range(runs)]
        yield pd.DataFrame(out, columns=[*by, "run", "n", "total"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[:1].copy()
        first["n"] = part["n"].sum()
        first["total"] = [np.sum(np.array(part["total"].tolist()), axis=0).tolist()]
        return first

    return rows.where(F.col(vector).isNotNull()).mapInPandas(add, schema).groupBy(*by, "run").applyInPandas(merge, schema).where("n > 0")


def bootstrap_means(vectors: DataFrame, group: str, boots: int = 20, seed: int = 42) -> DataFrame:
    """(group, boot, n, embedding): mean vectors of resampled rows; each row counts as often as a Poisson draw with mean 1, taken from vec_id."""
    sums = weighted_sums(vectors, [group], lambda rows, run: poisson(rows["vec_id"].to_numpy(), run, seed), boots)
    return sums.select(group, F.col("run").alias("boot"), "n", F.transform("total", lambda v: v / F.col("n")).alias("embedding"))


def count_vectors(tokens: DataFrame, key: str, dims: int = 16, width: int = 6, least: int = 5) -> DataFrame:
    """(word, vector): explicit vectors, ln(1 + n) for the number of times that each of the `dims` most frequent words stands within `width` places.

    Words that occur `least` times and stand near one of these; ties of the frequent words by name, which is the order of the vector.
    """
    often = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n_w")).where(F.col("n_w") >= least)
    top = F.broadcast(often.orderBy(F.desc("n_w"), "word").limit(dims).select(F.col("word").alias("other")))
    near = window_pairs(tokens, key, width=width)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), "n").unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), "n"))
    own = both.join(top, "other").join(often.select("word"), "word", "left_semi").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("other", F.ln(1.0 + F.col("n"))))).alias("own"))
    names = F.broadcast(top.agg(F.sort_array(F.collect_list("other")).alias("names")))
    rows = with_totals(own, names)
    return rows.select("word", F.transform("names", lambda w: F.coalesce(F.try_element_at("own", w), F.lit(0.0))).alias("vector"))


def around(tokens: DataFrame, key: str, vectors: DataFrame, width: int = 6) -> DataFrame:
    """(word, n, context): for each word with a vector, the mean vector of the words within `width` places, over all its occurrences.

    `vectors` is (word, vector). Window pairs are added up before vectors are joined to them; words are weighted by their number.
    """
    near = window_pairs(tokens, key, width=width)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), "n").unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), "n"))
    rows = both.join(vectors.select(F.col("word").alias("other"), "vector"), "other")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of a word lie together, so one sum is held at a time.
        word, n, total = None, 0, 0.0
        for batch in batches:
            out = []
            for w, times, v in zip(batch["word"], batch["n"], batch["vector"], strict=True):
                if w != word:
                    if word is not None:
                        out.append((word, n, (total / n).tolist()))
                    word, n, total = w, 0, 0.0
                n, total = n + times, total + times * np.asarray(v, dtype=np.float64)
            yield pd.DataFrame(out, columns=["word", "n", "context"])
        if word is not None:
            yield pd.DataFrame([(word, n, (total / n).tolist())], columns=["word", "n", "context"])

    return rows.select("word", "n", "vector").repartition("word").sortWithinPartitions("word").mapInPandas(add, "word string, n long, context array<double>")


def transform_matrix(contexts: DataFrame, vectors: DataFrame, ridge: float = 1e-6, weighting: float = 1000.0) -> DataFrame:
    """(row, values): the matrix that takes mean context vectors to word vectors best; words count as they occur, up to `weighting` times.

    Each task adds up its own products; the sums, of the size of the vectors squared, one pair a task, reach the driver.
    """
    rows = contexts.join(vectors, "word").select("context", "vector", F.least(F.col("n").cast("double"), F.lit(weighting)).alias("w"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = cross = 0.0
        for batch in batches:
            if len(batch):
                x, y = np.array(batch["context"].tolist()), np.array(batch["vector"].tolist())
                xw = x * batch["w"].to_numpy()[:, None]
                gram, cross = gram + xw.T @ x, cross + xw.T @ y
        if not np.isscalar(gram):
            yield pd.DataFrame({"k": [len(gram)], "gram": [gram.ravel().tolist()], "crossed": [cross.ravel().tolist()]})

    parts = rows.mapInPandas(products, "k int, gram array<double>, crossed array<double>")
    summed = parts.groupBy("k").applyInPandas(lambda p: pd.DataFrame({"k": p["k"][:1], "gram": [np.sum(p["gram"].tolist(), axis=0)], "crossed": [np.sum(p["crossed"].tolist(), axis=0)]}), "k int, gram array<double>, crossed array<double>").collect()
    if not summed:
        return contexts.sparkSession.createDataFrame([], "row int, values array<double>")
    k = summed[0]["k"]
    found = np.linalg.solve(np.array(summed[0]["gram"]).reshape(k, k) + ridge * np.eye(k), np.array(summed[0]["crossed"]).reshape(k, -1)).T
    return contexts.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(found)], "row int, values array<double>")


def contrast_neighbours(vectors: DataFrame, group: str, targets: DataFrame, permutations: int = 100, boots: int = 20, seed: int = 42) -> DataFrame:
    """(vec_id, ratio, std_error, p): how much nearer each target vector is to the mean of group 1 than to that of group 0.

    `group` holds 0 or 1. std_error is the spread of the ratio over resamples, p the share of random groupings at least as far from 1.
    Random groupings and resamples are taken from vec_id. Only the means of all runs reach the driver, two for each; targets of any number are read where they lie.
    """
    share = vectors.agg(F.avg(F.col(group).cast("double"))).first()[0]
    schema = f"vec_id {dict(targets.dtypes)['vec_id']}, ratio double, std_error double, p double"
    if share is None:
        return targets.sparkSession.createDataFrame([], schema)
    n_boots, rows = boots, vectors.select("vec_id", "embedding", F.col(group).cast("int").alias("g"), F.lit(0).alias("all"))

    def weigh(side: int) -> Callable[[pd.DataFrame, int], np.ndarray]:
        def of(part: pd.DataFrame, run: int) -> np.ndarray:
            ids, own = part["vec_id"].to_numpy(), part["g"].to_numpy()
            if run > n_boots:
                own = (uniform(ids, run, seed) < share).astype(int)
            return (own == side) * (poisson(ids, run, seed) if 1 <= run <= n_boots else 1.0)

        return of

    means = []
    for side in (1, 0):
        got = weighted_sums(rows, ["all"], weigh(side), 1 + n_boots + permutations, first_run=0).collect()  # one row a run
        means.append({r["run"]: np.array(r["total"]) / np.linalg.norm(r["total"]) for r in got})
    runs = sorted(means[0].keys() & means[1].keys())
    if 0 not in runs:
        return targets.sparkSession.createDataFrame([], schema)
    near, far = (np.stack([m[r] for r in runs]) for m in means)
    order = np.array(runs)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["embedding"])
            with np.errstate(invalid="ignore", divide="ignore"):
                ratio = (x @ near.T) / (x @ far.T)
            seen = ratio[:, 0]
            boot, drawn = ratio[:, (order >= 1) & (order <= n_boots)], ratio[:, order > n_boots]
            p = (np.abs(1 - drawn) >= np.abs(1 - seen)[:, None]).mean(axis=1) if drawn.shape[1] else np.full(len(x), np.nan)
            spread = boot.std(axis=1, ddof=1) if boot.shape[1] > 1 else np.full(len(x), np.nan)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "ratio": seen, "std_error": spread, "p": p})

    return targets.select("vec_id", "embedding").mapInPandas(compare, schema)

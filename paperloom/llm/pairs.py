"""Items that appear together, kept in an incremental pair table.

Method: the table keeps each basket's distinct items, and counts of items (the marginals) and of pairs in files bucketed by hash. A
change brings the new content of some baskets. A changed basket emits -1 for what it no longer holds and +1 for what it holds anew,
both for the pairs and for the items; these signed deltas are added up before they are shuffled, and merged into the counts of the
buckets they fall in; other buckets aren't read. The association of a pair rests on its count, its two marginals and the number of
baskets. Marginals are stored apart, so a changed marginal rewrites no pair; affected() scores again the pairs that a change touched.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from paperloom.session import fresh_folder, parallelism

#: Rows of a bucket. Where the stored and changed rows of a kind come to twice as many a bucket, its buckets are made as many more.
ROWS = 1_000_000
#: Items of a basket that are paired within one row; a larger basket is cut into blocks, and each pair of blocks is a row of its own that goes to any task.
BLOCK = 64

SCHEMAS = {"pairs": "bucket int, term_a string, term_b string, n_ab long", "items": "bucket int, term string, n long", "baskets": "bucket int, basket string, items array<string>"}
KEYS = {"pairs": ("term_a", "term_b"), "items": ("term",), "baskets": ("basket",)}


def spelling(term: Column) -> Column:
    """Lower case, hyphen and underscore as blank, blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(term), r"[\s _-]+", " "))


def baskets_of(rows: DataFrame, basket: str, term: str) -> DataFrame:
    """(basket, items): the sorted distinct items of each basket, from rows that may repeat. Rows with a null basket, or a null or empty term, are left out."""
    clean = rows.select(F.col(basket).cast("string").alias("basket"), spelling(F.col(term)).alias("term")).where("basket is not null and term <> ''")
    return clean.distinct().groupBy("basket").agg(F.sort_array(F.collect_list("term")).alias("items"))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """(term_a, term_b, d), term_a < term_b, from (d, left, right)."""
    return rows.select("d", F.explode("left").alias("term_a"), "right").select("d", "term_a", F.explode("right").alias("term_b")).where("term_a < term_b").select("term_a", "term_b", "d")


def signed_pairs(baskets: DataFrame, sign: Column) -> DataFrame:
    """(term_a, term_b, d): the sign of each basket for each of its pairs, summed on the map side by who groups it.

    Pairs of blocks of large baskets are spread over the tasks before they are written out, so a basket of any size is no task's alone.
    """
    signed = baskets.withColumn("d", sign)
    small = signed.where(F.size("items").between(2, BLOCK)).select("d", F.col("items").alias("left"), F.col("items").alias("right"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / BLOCK).cast("int")), lambda i: F.slice("items", i * BLOCK + 1, BLOCK))
    large = signed.where(F.size("items") > BLOCK).select("d", blocks.alias("blocks"))
    one = large.select("d", "blocks", F.posexplode("blocks").alias("i", "left"))
    two = one.select("d", "left", F.explode(F.slice("blocks", F.col("i") + 1, F.size("blocks"))).alias("right"))
    spread = two.repartition(parallelism(baskets.sparkSession), F.xxhash64("left", "right"))
    return _all_pairs(small).unionByName(_all_pairs(spread))


class PairTable:
    """Counts of items and pairs over baskets, in Parquet files below `path`, one folder for each kind, version and bucket.

    A version is written whole before the manifest names it, and only then does the object take it on; a change that fails midway leaves
    the version before it in force, and applying it again gives the same. Files that neither the last nor the one before last manifest
    names are removed. Buckets number what the rows need, at about `rows` a bucket.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rows: int = ROWS) -> None:
        self.spark, self.path, self.rows = spark, path or fresh_folder(spark, "pairs"), rows
        self.state: dict = {"version": 0, "n_baskets": 0, "kinds": {k: {"buckets": 1, "rows": 0, "files": {}} for k in SCHEMAS}}

    @property
    def version(self) -> int:
        return self.state["version"]

    @property
    def n_baskets(self) -> int:
        return self.state["n_baskets"]

    def _stored(self, kind: str, only: set[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(self.state["kinds"][kind]["files"].items()) if only is None or b in only]
        return self.spark.read.schema(SCHEMAS[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[kind])

    def _merge(self, kind: str, delta: DataFrame, n_delta: int, combine, version: int) -> dict:  # noqa: ANN001
        """The kind's next state: the buckets that `delta` falls in are read, combined and written again; all of them where there must be more buckets."""
        old = self.state["kinds"][kind]
        buckets = old["buckets"]
        while old["rows"] + n_delta > 2 * self.rows * buckets:
            buckets *= 2
        bucket = F.pmod(F.xxhash64(*KEYS[kind]), F.lit(buckets)).cast("int")
        delta = delta.withColumn("bucket", bucket)
        if buckets == old["buckets"]:
            touched = {r["bucket"] for r in delta.select("bucket").distinct().collect()}  # at most as many as there are buckets
            kept = {b: p for b, p in old["files"].items() if b not in touched}
            before = self._stored(kind, touched)
        else:
            touched, kept = set(range(buckets)), {}
            before = self._stored(kind).withColumn("bucket", bucket)
        folder = f"{self.path}/{kind}/v{version}"
        rows = combine(before, delta).withColumn("at", F.col("bucket"))
        rows.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("at").parquet(folder)
        files = kept | {b: f"{folder}/at={b}" for b in self._folders(folder)}
        # Rows that a change adds to ones that were there are counted twice until the buckets are made more, when all rows are counted again.
        n = old["rows"] + n_delta if buckets == old["buckets"] else self.spark.read.schema(SCHEMAS[kind]).parquet(*files.values()).count() if files else 0
        return {"buckets": buckets, "rows": n, "files": files}

    def _fs(self, path: str):  # noqa: ANN202
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path, jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, folder: str) -> list[int]:
        """The buckets that were written; a listing, no job."""
        path, fs = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return [int(n[3:]) for n in names if n.startswith("at=")]

    def _remove(self, paths: set[str]) -> None:
        for p in paths:
            path, fs = self._fs(p)
            fs.delete(path, True)

    def _step(self, version: int, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/step/v{version}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def apply(self, changed: DataFrame) -> None:
        """Takes (basket, items) as the whole new content of these baskets; an empty array takes a basket out. Baskets not named stay.

        Each basket once. Applying the same change twice changes nothing the second time.
        """
        version = self.version + 1
        old = self.state["kinds"]["baskets"]
        bucket = F.pmod(F.xxhash64("basket"), F.lit(old["buckets"])).cast("int")
        new = self._step(version, "new", changed.select("basket", F.array_sort(F.array_distinct("items")).alias("items"), bucket.alias("bucket")))
        before = self._stored("baskets", {r["bucket"] for r in new.select("bucket").distinct().collect()}) if old["files"] else self._stored("baskets")
        now = new.select("basket", F.col("items").alias("now"))
        both = now.join(before.select("basket", F.col("items").alias("was")), "basket", "left").withColumn("was", F.coalesce("was", F.array().cast("array<string>")))
        both = both.where("now <> was")
        signed = both.select(F.explode(F.array(F.struct(F.col("was").alias("items"), F.lit(-1).cast("long").alias("d")), F.struct(F.col("now").alias("items"), F.lit(1).cast("long").alias("d")))).alias("x")).select("x.*")
        pairs = self._step(version, "pairs", signed_pairs(signed, F.col("d")).groupBy("term_a", "term_b").agg(F.sum("d").alias("d")).where("d <> 0"))
        items = self._step(version, "items", signed.select("d", F.explode("items").alias("term")).groupBy("term").agg(F.sum("d").alias("d")).where("d <> 0"))
        come = both.agg(F.coalesce(F.sum((F.size("now") > 0).cast("int") - (F.size("was") > 0).cast("int")), F.lit(0)).alias("n")).first()["n"]

        def content(stored: DataFrame, delta: DataFrame) -> DataFrame:
            return stored.join(delta.select("basket"), "basket", "left_anti").unionByName(delta.where(F.size("items") > 0)).select("bucket", "basket", "items")

        def added(n: str):  # noqa: ANN202
            def combine(stored: DataFrame, delta: DataFrame) -> DataFrame:
                keys = [c for c in stored.columns if c != n]
                return stored.unionByName(delta.withColumnRenamed("d", n)).groupBy(*keys).agg(F.sum(n).alias(n)).where(F.col(n) > 0)

            return combine

        kinds = {
            "baskets": self._merge("baskets", new.drop("bucket"), new.count(), content, version),
            "items": self._merge("items", items, items.count(), added("n"), version),
            "pairs": self._merge("pairs", pairs, pairs.count(), added("n_ab"), version),
        }
        last = self.state
        state = {"version": version, "n_baskets": self.n_baskets + come, "kinds": kinds}
        self._save(state)
        self.state = state
        gone = set(last.get("before", [])) - self._named(state)
        self.state["before"] = sorted(self._named(last))
        self._remove({p for p in gone if p not in self._named(last)} | {f"{self.path}/step/v{version - 1}"})

    @staticmethod
    def _named(state: dict) -> set[str]:
        return {p for kind in state["kinds"].values() for p in kind["files"].values()}

    def _save(self, state: dict) -> None:
        """The manifest: version, number of baskets, and the folder of each bucket."""
        row = json.dumps({k: v for k, v in state.items() if k != "before"})
        self.spark.createDataFrame([(state["version"], row)], "version int, manifest string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, rows: int = ROWS) -> PairTable:
        """The last version that was saved below `path`."""
        self = cls(spark, path, rows)
        last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        self.state = json.loads(last["manifest"])
        for kind in self.state["kinds"].values():
            kind["files"] = {int(b): p for b, p in kind["files"].items()}
        return self

    def items(self) -> DataFrame:
        """(term, n): the number of baskets that hold each item."""
        return self._stored("items").select("term", "n")

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """Adds n_a, n_b and lift, the ratio of n_ab to what chance would give, n_ab * n / (n_a * n_b)."""
        n = self.items()
        both = pairs.join(n.toDF("term_a", "n_a"), "term_a").join(n.toDF("term_b", "n_b"), "term_b")
        return both.withColumn("lift", F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b")) * F.lit(float(self.n_baskets)))

    def pairs(self) -> DataFrame:
        """(term_a, term_b, n_ab, lift): baskets that hold both, and their association."""
        return self._scored(self._stored("pairs")).select("term_a", "term_b", "n_ab", "lift")

    def affected(self) -> DataFrame:
        """(term_a, term_b, n_ab, lift) of the pairs that the last change touched, by their own count or by a marginal, scored again. The number of baskets is a factor that all pairs share and touches none."""
        step = f"{self.path}/step/v{self.version}"
        pairs = self.spark.read.schema("term_a string, term_b string, d long").parquet(f"{step}/pairs")
        items = self.spark.read.schema("term string, d long").parquet(f"{step}/items").select("term")
        stored = self._stored("pairs").select("term_a", "term_b", "n_ab")
        parts = [stored.join(pairs, ["term_a", "term_b"], "left_semi"), stored.join(items, F.col("term_a") == F.col("term"), "left_semi"), stored.join(items, F.col("term_b") == F.col("term"), "left_semi")]
        return self._scored(reduce(DataFrame.unionByName, parts).distinct()).select("term_a", "term_b", "n_ab", "lift")

    def associated(self, min_count: int = 5, min_share: float = 0.002, min_lift: float = 3.0) -> DataFrame:
        """The pairs with enough joint baskets, absolutely and as a share of all baskets, and enough lift.

        The lift is compared in whole numbers, n_ab * n >= min_lift * n_a * n_b, so that a tie isn't lost to rounding. Pairs with too few
        joint baskets are left out as their files are read, before any marginal is joined.
        """
        kept = self._stored("pairs").where((F.col("n_ab") >= min_count) & (F.col("n_ab") >= min_share * self.n_baskets))
        whole = lambda c: F.col(c).cast(T.DecimalType(19, 0))
        enough = whole("n_ab") * F.lit(self.n_baskets).cast(T.DecimalType(18, 0)) >= F.lit(min_lift) * whole("n_a") * whole("n_b")
        return self._scored(kept).where(enough).select("term_a", "term_b", "n_ab", "lift")


def pair_table(rows: DataFrame, basket: str, term: str, when: str | None = None, first_share: float = 0.8, path: str | None = None) -> PairTable:
    """The pair table of all rows. With `when`, rows up to its quantile `first_share` come as the first change and each basket with a later row as the second."""
    table = PairTable(rows.sparkSession, path)
    cut = rows.select(F.percentile_approx(when, first_share)).first()[0] if when else None
    if cut is None:
        table.apply(baskets_of(rows, basket, term))
        return table
    late = rows.where(F.col(when) > F.lit(cut)).select(F.col(basket).alias("late_basket")).where("late_basket is not null").distinct()
    table.apply(baskets_of(rows.where((F.col(when) <= F.lit(cut)) | F.col(when).isNull()), basket, term))
    table.apply(baskets_of(rows.join(late, rows[basket] == late["late_basket"], "left_semi"), basket, term))
    return table

import os
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from paperloom.llm import pairs

ROW = "paragraph_id string, node string, loaded_at timestamp"


def brute(baskets):
    single, pair = Counter(), Counter()
    for items in baskets.values():
        single.update(set(items))
        pair.update(combinations(sorted(set(items)), 2))
    n = sum(bool(x) for x in baskets.values())
    return {(a, b): (k, round(k * n / (single[a] * single[b]), 9)) for (a, b), k in pair.items()}


def read(table):
    return {(r.term_a, r.term_b): (r.n_ab, round(r.lift, 9)) for r in table.pairs().collect()}


def frame(spark, baskets):
    return spark.createDataFrame(list(baskets.items()), "basket string, items array<string>")


def test_changes_give_what_a_whole_count_gives(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    state = {f"b{i}": rnd.sample(words, rnd.randint(1, 6)) for i in range(40)}
    table = pairs.PairTable(spark, rows=8)
    table.apply(frame(spark, state))
    assert read(table) == brute(state)
    for _ in range(2):
        change = {f"b{i}": rnd.sample(words, rnd.randint(0, 6)) for i in rnd.sample(range(50), 12)}
        table.apply(frame(spark, change))
        state |= change
        assert read(table) == brute(state) and table.n_baskets == sum(bool(x) for x in state.values())
    assert table.state["kinds"]["pairs"]["buckets"] > 1 and len(os.listdir(f"{table.path}/step")) == 1
    table.apply(frame(spark, change))
    assert read(table) == brute(state) and table.affected().count() == 0
    assert read(pairs.PairTable.load(spark, table.path, 8)) == brute(state)


def test_large_baskets_are_cut_into_blocks(spark):
    state = {"big": [f"i{k:03d}" for k in range(150)], "small": ["i000", "i149"]}
    table = pairs.PairTable(spark)
    table.apply(frame(spark, state))
    assert read(table) == brute(state)


def test_a_basket_of_any_size_goes_to_several_tasks(spark):
    one = frame(spark, {"big": [f"i{k:04d}" for k in range(1500)]})
    rows = pairs.signed_pairs(one, F.lit(1).cast("long")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in rows) == 1500 * 1499 // 2 and len(rows) >= 4 and max(r["count"] for r in rows) < 0.5 * 1500 * 1499 // 2


def test_a_failed_change_can_be_applied_again(spark, monkeypatch):
    state = {"b1": ["x", "y"], "b2": ["x", "z"]}
    table = pairs.PairTable(spark)
    table.apply(frame(spark, state))
    state["b2"] = ["y", "z"]
    save = pairs.PairTable._save
    monkeypatch.setattr(pairs.PairTable, "_save", lambda *a: 1 / 0)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            table.apply(frame(spark, {"b2": ["y", "z"]}))
    assert table.version == 1
    monkeypatch.setattr(pairs.PairTable, "_save", save)
    table.apply(frame(spark, {"b2": ["y", "z"]}))
    assert read(table) == brute(state) and table.n_baskets == 2


def test_affected_pairs_are_those_with_a_changed_count_or_marginal(spark):
    state = {"b1": ["p", "q"], "b2": ["r", "s"], "b3": ["r", "t"]}
    table = pairs.PairTable(spark)
    table.apply(frame(spark, state))
    table.apply(frame(spark, {"b4": ["r"]}))
    assert {(r.term_a, r.term_b): round(r.lift, 9) for r in table.affected().collect()} == {("r", "s"): 1.333333333, ("r", "t"): 1.333333333}


def test_spelling_nulls_repeats_and_ties(spark):
    rows = [("p1", " Harvest-Supper "), ("p1", "harvest_supper"), ("p1", "seed  exchange"), (None, "x"), ("p2", None), ("p2", "  "), ("p3", "seed exchange")]
    df = spark.createDataFrame(rows, "paragraph_id string, node string").withColumns({"loaded_at": F.lit(None).cast("timestamp"), "term": F.lit(1), "items": F.lit(2)})
    assert read(pairs.pair_table(df, "paragraph_id", "node")) == {("harvest supper", "seed exchange"): (1, 1.0)}


def test_thresholds_take_ties_in(spark):
    state = {f"b{i}": ["a", "b"] for i in range(5)} | {f"c{i}": ["c"] for i in range(10)}
    table = pairs.PairTable(spark)
    table.apply(frame(spark, state))
    assert [tuple(r)[:3] for r in table.associated().collect()] == [("a", "b", 5)]  # the lift is 3 exactly
    assert table.associated(min_lift=3.1).count() == 0 and table.associated(min_count=6).count() == 0


def test_late_rows_and_an_empty_table(spark):
    rows = spark.sql("select concat('p', id % 7) paragraph_id, concat('t', id % 5) node, timestamp_seconds(id) loaded_at from range(60)")
    assert read(pairs.pair_table(rows, "paragraph_id", "node", "loaded_at")) == read(pairs.pair_table(rows, "paragraph_id", "node"))
    assert read(pairs.pair_table(rows.where("false"), "paragraph_id", "node", "loaded_at")) == {}

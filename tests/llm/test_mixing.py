import os

import pytest
from pyspark.sql import functions as F

from paperloom.llm import mixing

SIZED = "doc_id long, source string, n_tokens long"
TARGET = "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark):
    sized = spark.createDataFrame([(i, "a", 10) for i in range(90)] + [(i, "b", 10) for i in range(90, 100)], SIZED)
    targets = spark.createDataFrame([("A ", 0.5, 1), ("b", 0.3, 2), ("gone", 0.2, 5)], TARGET)
    rows = {r.source: r for r in mixing.shares(None, targets, sized=sized).collect()}
    assert (rows["a"].short, rows["b"].short, rows["gone"].short) == (False, True, True)
    assert (rows["a"].given, rows["b"].given, rows["b"].n_passes, rows["gone"].n_tokens) == (500.0, 200.0, 2, 0)
    assert rows["a"].actual_share == pytest.approx(500 / 700) and sum(r.actual_share for r in rows.values()) == pytest.approx(1)
    assert (rows["b"].missing, rows["gone"].missing, rows["a"].run_out, rows["gone"].run_out) == (100.0, 200.0, 1.0, 0.0) and 0 < rows["b"].run_out < 1
    b = rows["b"]
    assert b.demand * (b.run_out + b.ramp * (b.run_out**2 - b.run_out)) == pytest.approx(b.stream_end)


def test_demand_equal_to_the_cap_is_no_case(spark):
    sized = spark.createDataFrame([(1, "a", 50), (2, "b", 50)], SIZED)
    assert mixing.shares(None, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGET), sized=sized).where("short").count() == 0


def test_short_sources_come_from_the_integral(spark, monkeypatch):
    sized = spark.createDataFrame([(i, "a", 10) for i in range(9)] + [(9, "b", 10)], SIZED)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGET)
    short = lambda: {r.source for r in mixing.shares(None, targets, sized=sized).where("short").collect()}
    assert short() == {"b"}
    monkeypatch.setattr(mixing, "demanded", lambda t, total, ramp: total * 0)
    assert short() == set()


def test_pieces_don_t_change_the_streams(spark, monkeypatch):
    sized = spark.createDataFrame([(i, "ab"[i % 3 == 0], i % 7) for i in range(200)], SIZED)
    plan = mixing.supply(sized, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGET))
    for in_piece in (10**6, 9):
        monkeypatch.setattr(mixing, "IN_PIECE", in_piece)
        for source in "ab":
            own = sorted((r.start, r.n_tokens) for r in mixing.streams(sized, plan).where(F.col("source") == source).collect())
            assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]


def test_order_gives_the_shares_everywhere_and_respects_repeats(spark):
    sized = spark.createDataFrame([(i, "a", 5) for i in range(2000)] + [(i, "b", 5) for i in range(2000, 2300)], SIZED)
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 4)], TARGET)
    rows = mixing.curriculum(None, targets, sized=sized).collect()
    plan = {r.source: r for r in mixing.ramps(mixing.supply(sized, targets)).collect()}
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    for s in "ab":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.n_tokens for r in own) - plan[s].given) <= 5
        assert max(r.repeat_no for r in own) == plan[s].n_passes and len({(r.doc_id, r.repeat_no) for r in own}) == len(own)
        a = plan[s].ramp
        for t in (0.25, 0.5, 0.75):
            got = sum(r.n_tokens for r in own if r.position < t)
            assert got == pytest.approx(plan[s].given * (t + a * (t * t - t)), abs=10)
    assert plan["b"].ramp > plan["a"].ramp


def test_empty_texts_no_documents_and_repeated_targets(spark):
    empty = spark.createDataFrame([], SIZED)
    targets = spark.createDataFrame([("a", 1.0, 1), ("a", 0.5, 2), (None, 0.3, 1)], TARGET)
    rows = mixing.shares(None, targets, sized=empty).collect()
    assert len(rows) == 1 and rows[0].max_repeats == 2 and not rows[0].short
    assert mixing.curriculum(None, targets, sized=spark.createDataFrame([(1, "a", 0)], SIZED)).count() == 0


@pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="needs a vocabulary file")
def test_tokens(spark):
    docs = spark.createDataFrame([(1, " Herald", "hello world"), (2, "herald", None), (3, "other", "x"), (4, None, "x"), (5, "herald", ""), (6, "herald", "<|endoftext|>")], "doc_id long, source string, text string").withColumn("n_tokens", F.lit(9))
    rows = {r.doc_id: r.n_tokens for r in mixing.with_tokens(docs, spark.createDataFrame([("herald", 1.0, 1)], TARGET)).collect()}
    assert rows[1] == 2 and rows[2] == 0 and rows[5] == 0 and rows[6] > 1 and set(rows) == {1, 2, 5, 6}

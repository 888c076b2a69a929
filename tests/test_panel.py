import math

import pytest
from pyspark.sql import functions as F

from paperloom import lexicon as lx
from paperloom.functions import stats, text as tx
from paperloom.operators import panel, themes

SCHEMA = "paragraph_id string, file_name string, year int, month int, text string"


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def labels(spark, *texts):
    return panel.labelled(spark.createDataFrame([(f"p{i}", "f", 1975, 5, t) for i, t in enumerate(texts)], SCHEMA))


def test_hits_are_distinct_sorted_and_joined(spark):
    assert one(spark, tx.hits(F.col("t"), lx.IDENTITY["panethnic"]), t="latinos and hispanic latinos") == "hispanic|latinos"


def test_metrics_of_a_short_line(spark):
    row = spark.createDataFrame([("The quick brown fox 12!",)], "t string").select(*(c.alias(k) for k, c in tx.metrics(F.col("t")).items())).first()
    assert (row.n_chars, row.n_tokens, row.n_word_tokens, row.nonvowel_token_ratio) == (23, 5, 4, 0)
    assert row.alpha_ratio == pytest.approx(16 / 23) and row.digit_ratio == pytest.approx(2 / 23) and row.punct_ratio == pytest.approx(1 / 23)


def test_gate_drops_short_and_empty_and_rescues_signals(spark):
    rows = panel.gated(labels(spark, "The quick brown fox 12!", "", None, "The health clinic opened its doors")).orderBy("paragraph_id").collect()
    few = "too_few_tokens|too_few_word_tokens"
    assert [r.quality_reason for r in rows] == [few, f"{few}|low_alpha_ratio", f"{few}|low_alpha_ratio", "rescued_substantive_signal"]
    assert [r.quality_keep for r in rows] == [0, 0, 0, 1]


def test_split_leaves_some_hits_in_neither_theme(spark):
    row = panel.themed(labels(spark, "affirmative action and the eeoc")).first()
    assert row[f"{lx.COMBINED}_hits"] == "affirmative action|eeoc" and not row.theme_anti_discrimination and not row.theme_equal_opportunity


def test_identity_classes_and_no_rows(spark):
    rows = labels(spark, "Chicano and Latino", "hispanics", "cuban-american", "none").orderBy("paragraph_id").select(panel.identity_type().alias("x")).collect()
    assert [r.x for r in rows] == ["both", "panethnic", "ethnic", "none"]
    assert panel.gated(labels(spark, "x").where("false")).count() == 0


@pytest.mark.parametrize(("x", "expected"), [(0.0, 0.0), (0.3, math.erf(0.3)), (-1.7, math.erf(-1.7)), (5.5, math.erf(5.5)), (9.0, 1.0)])
def test_erf(spark, x, expected):
    assert one(spark, stats.erf(F.col("v")), v=x) == pytest.approx(expected, abs=1e-14)


def test_two_proportions_and_odds(spark):
    cells = dict(a=526, b=1509, c=599, d=1481)
    cols = [F.col(k) for k in cells]
    assert one(spark, stats.two_proportion_p(*cols), **cells) == pytest.approx(0.00161264, abs=1e-8)
    assert one(spark, stats.odds_ratio(*cols), **cells) == pytest.approx(0.788042, abs=1e-6)
    assert one(spark, stats.two_proportion_p(*cols), a=0, b=10, c=0, d=10) == 1.0
    assert one(spark, stats.two_proportion_p(*cols), a=0, b=0, c=0, d=10) == 1.0


def test_contrast_of_groups_that_overlap(spark):
    rows = themes.contrast(themes.prevalence(panel.themed(labels(spark, "latino school", "latino chicano school", "chicano jail"))))
    got = {r.theme: (r.n_panethnic_paragraphs, r.n_ethnic_paragraphs, r.n_theme_panethnic, r.n_theme_ethnic) for r in rows.collect()}
    assert len(got) == 13 and got["domain_education"] == (2, 2, 2, 1) and got["domain_criminal_justice"] == (2, 2, 0, 1)


def test_max100_and_gap_change(spark):
    months = spark.createDataFrame([("1970-01", themes.GROUPS[0], "t", 2.0), ("1970-02", themes.GROUPS[0], "t", 4.0), ("1970-03", themes.GROUPS[1], "t", 1.0)], "year_month string, group_name string, theme string, per100 double")
    grid = themes.max100(themes.complete(months, ["t"]))
    assert sorted(r.norm for r in grid.where(F.col("group_name") == themes.GROUPS[0]).collect()) == [0, 50, 100]
    assert themes.gap_change(themes.gaps(grid)).first().change == -3.0
    assert themes.max100(themes.complete(months.withColumn("per100", F.lit(0.0)), ["t"])).agg(F.max("norm")).first()[0] == 0


def test_issue_summary_counts_only_kept(spark):
    long = "The school board of the county met with Latino parents about classrooms and teachers"
    row = panel.issue_summary(panel.gated(labels(spark, long, "x"))).first()
    assert (row.n_paragraphs_raw, row.n_paragraphs_filtered, row.n_panethnic_appeared, row.keep_rate_pct) == (2, 1, 1, 50.0)


def test_themes_are_discovered_by_column_names():
    columns = ["paragraph_id", "policy_frame_data", "policy_frame_funding", "policy_frame_funding_hits", "domain_other", lx.COMBINED, "domain_new", "theme_x"]
    assert themes.theme_columns(columns) == ["domain_new", "policy_frame_funding", "theme_anti_discrimination", "theme_equal_opportunity", "theme_x"]


def test_groups_and_periods(spark):
    rows = labels(spark, "latino", "chicano and latino", "chicano", "none").withColumn("year", F.when(F.col("paragraph_id") == "p2", 1970).otherwise(1980))
    assert [r.x for r in rows.orderBy("paragraph_id").select(panel.group_period(F.col("year"), 1976).alias("x")).collect()] == ["Panethnic, Post", "Both, Post", "Ethnic, Pre", None]


def test_wide_months_and_back(spark):
    wide = themes.monthly_wide(panel.themed(labels(spark, "latino school", "latino")))
    long = themes.long_by_suffix(wide, ["year_month", "group_name"], "_per100", "rate")
    assert {r.theme: r.rate for r in long.where("rate > 0").collect()} == {"domain_education": 50.0} and long.count() == 13
    assert one(spark, themes.recoded(F.col("c"), {"a": "Alpha"}), c="a") == "Alpha" and one(spark, themes.recoded(F.col("c"), {"a": "Alpha"}), c="z") == "z"


def test_issues_of_either_side(spark):
    gate = panel.gated(labels(spark, "x", None)).withColumn("file_name", F.when(F.col("paragraph_id") == "p0", "f"))
    meta = spark.createDataFrame([("f", "1975-05-01")], "file_name string, canonical_issue_date string")
    assert [tuple(r) for r in panel.issue_union(gate, meta).collect()] == [(None, "", 1, 0), ("f", "1975-05-01", 1, 0)]


def test_each_paragraph_is_one_of_its_rows(spark):
    rows = spark.createDataFrame([("p", "f", None, None, "t"), ("p", "f", 1975, 5, "t"), (None, "f", 1, 1, "t"), ("q", None, None, None, None)], "paragraph_id string, file_name string, canonical_year int, canonical_month int, paragraph_text string")
    assert sorted(map(tuple, panel.once(rows).collect())) == [("p", "f", 1975, 5, "t"), ("q", None, None, None, None)]

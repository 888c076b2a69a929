"""Labels of paragraphs, their quality gate, and summaries by issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperloom import lexicon as lx
from paperloom.functions import text as tx
from paperloom.functions.stats import percent

SIGNALS = ["has_panethnic_label", "has_ethnic_label", "policy_frame_funding", *lx.DOMAINS, "theme_invisibility"]


def once(panel: DataFrame) -> DataFrame:
    """(paragraph_id, file_name, year, month, text): each paragraph_id once, one of its rows whole; one with a year before one without."""
    row = F.max(F.struct(F.col("canonical_year").alias("year"), F.col("canonical_month").alias("month"), "file_name", F.col("paragraph_text").alias("text"))).alias("row")
    return panel.where("paragraph_id is not null").groupBy("paragraph_id").agg(row).select("paragraph_id", "row.file_name", "row.year", "row.month", "row.text")


def labelled(paragraphs: DataFrame, patterns: dict[str, str] = lx.ALL_PATTERNS) -> DataFrame:
    """Adds `<label>_hits`, empty where there is none, for each pattern over the normalised text, in one projection."""
    rows = paragraphs.withColumn("norm", tx.normalized(F.coalesce("text", F.lit(""))))
    return rows.select("*", *(tx.hits(F.col("norm"), p).alias(f"{label}_hits") for label, p in patterns.items())).drop("norm")


def flag(label: str) -> Column:
    return F.col(f"{label}_hits") != ""


def identity_type() -> Column:
    return F.when(flag("panethnic") & flag("ethnic"), "both").when(flag("panethnic"), "panethnic").when(flag("ethnic"), "ethnic").otherwise("none")


def domain_other() -> Column:
    """1 if no domain is hit; invisibility is no domain."""
    return (~reduce(lambda a, b: a | b, map(flag, lx.DOMAINS))).cast("int")


def themed(labels: DataFrame) -> DataFrame:
    """Adds a boolean column for each theme; the combined one is split by what its hits say, so that some hits fall into neither."""
    combined = F.col(f"{lx.COMBINED}_hits")
    split = {"theme_anti_discrimination": F.contains(combined, F.lit("discriminat")), "theme_equal_opportunity": F.contains(combined, F.lit("equal opportunity")) | F.contains(combined, F.lit("equal employment opportunity")) | F.contains(combined, F.lit("equal access"))}
    return labels.withColumns({t: split.get(t, F.lit(None)) if t in split else flag(t) for t in lx.THEMES})


def gated(labels: DataFrame) -> DataFrame:
    """Adds the text metrics, quality_keep and quality_reason.

    A paragraph is kept if no threshold speaks against it, or if it carries a substantive signal, five words and 45 % letters.
    """
    rows = labels.withColumns(tx.metrics(F.col("text")))
    c = F.col
    tests = [("too_few_tokens", c("n_tokens") < 8), ("too_few_word_tokens", c("n_word_tokens") < 5), ("low_alpha_ratio", c("alpha_ratio") < 0.55), ("high_punct_ratio", c("punct_ratio") > 0.22), ("high_nonvowel_token_ratio", c("nonvowel_token_ratio") > 0.45)]
    reasons = F.array_join(F.array_compact(F.array(*(F.when(t, name) for name, t in tests))), "|")
    signal = reduce(lambda a, b: a | b, [flag("panethnic"), flag("ethnic"), *map(flag, ["policy_frame_funding", *lx.DOMAINS, "theme_invisibility"])])
    rows = rows.withColumn("_reasons", reasons).withColumn("_rescued", (c("_reasons") != "") & signal & (c("n_word_tokens") >= 5) & (c("alpha_ratio") >= 0.45))
    reason = F.when(c("_rescued"), "rescued_substantive_signal").when(c("_reasons") == "", "pass").otherwise(c("_reasons"))
    return rows.withColumns({"quality_keep": (c("_rescued") | (c("_reasons") == "")).cast("int"), "quality_reason": reason}).drop("_reasons", "_rescued")


def kept(panel: DataFrame, gate: DataFrame) -> DataFrame:
    """The rows of the panel whose paragraph passed the gate, with their own columns."""
    return panel.join(gate.where("quality_keep = 1").select("paragraph_id"), "paragraph_id", "left_semi").select(*panel.columns)


def issue_union(gate: DataFrame, metadata: DataFrame) -> DataFrame:
    """(file_name, canonical_issue_date, n_paragraphs_raw, n_paragraphs_filtered): every issue of the raw or of the filtered rows, 0 where one lacks it, empty where it has no metadata; by date and name."""
    raw = gate.groupBy("file_name").agg(F.count("*").alias("n_paragraphs_raw"))
    filtered = gate.where("quality_keep = 1").groupBy(F.col("file_name").alias("of_file")).agg(F.count("*").alias("n_paragraphs_filtered"))
    both = raw.join(filtered, F.col("file_name").eqNullSafe(F.col("of_file")), "full_outer").withColumn("file_name", F.coalesce("file_name", "of_file")).drop("of_file").fillna(0)
    rows = both.join(metadata.select("file_name", "canonical_issue_date"), "file_name", "left").withColumn("canonical_issue_date", F.coalesce("canonical_issue_date", F.lit("")))
    return rows.select("file_name", "canonical_issue_date", "n_paragraphs_raw", "n_paragraphs_filtered").orderBy("canonical_issue_date", "file_name")


def group_period(year: Column, first_late_year: int) -> Column:
    """Group and period in one label, as Panethnic, Pre; null for paragraphs of no group or year. Years from `first_late_year` are Post."""
    group = F.when(flag("panethnic") & flag("ethnic"), "Both").when(flag("panethnic"), "Panethnic").when(flag("ethnic"), "Ethnic")
    return F.concat(group, F.lit(", "), F.when(year >= first_late_year, "Post").when(year < first_late_year, "Pre"))


def issue_summary(gate: DataFrame) -> DataFrame:
    """One row for each file: paragraphs before and after the gate, and counts and percents of labels among those kept."""
    keep = F.col("quality_keep") == 1
    n = {"identity_labeled": flag("panethnic") | flag("ethnic"), "panethnic_appeared": flag("panethnic"), "ethnic_appeared": flag("ethnic"), "both_labels": flag("panethnic") & flag("ethnic"), "invisibility": flag("theme_invisibility"), "funding": flag("policy_frame_funding")}
    rows = gate.groupBy("file_name").agg(
        F.max("year").alias("year"), F.max("month").alias("month"), F.count("*").alias("n_paragraphs_raw"), F.count_if(keep).alias("n_paragraphs_filtered"), *(F.count_if(keep & c).alias(f"n_{k}") for k, c in n.items())
    )
    rows = rows.withColumns({"keep_rate_pct": percent(F.col("n_paragraphs_filtered"), F.col("n_paragraphs_raw"))} | {f"{k}_pct": percent(F.col(f"n_{k}"), F.col("n_paragraphs_filtered")) for k in n})
    return rows.orderBy("year", "month", "file_name")


def corpus_summary(issues: DataFrame) -> DataFrame:
    """(metric, value): sums, means, medians and extremes over the issues."""
    raw, kept = F.col("n_paragraphs_raw"), F.col("n_paragraphs_filtered")
    month = F.when(F.col("year").isNotNull() & F.col("month").isNotNull(), F.format_string("%04d-%02d-01", "year", "month"))
    stats = {"n_issues": F.count("*"), "paragraphs_raw_total": F.sum(raw), "paragraphs_filtered_total": F.sum(kept), "keep_rate_pct_overall": percent(F.sum(kept), F.sum(raw))}
    stats |= {f"{name}_paragraphs_per_issue_{k}": f(c) for name, c in (("raw", raw), ("filtered", kept)) for k, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))}
    stats |= {f"{k}_total": F.sum(f"n_{k}") for k in ("identity_labeled", "panethnic_appeared", "ethnic_appeared", "both_labels", "invisibility", "funding")}
    stats |= {"identity_labeled_pct_of_filtered": percent(F.sum("n_identity_labeled"), F.sum(kept))}
    text = issues.agg(*(F.format_string("%.2f", c.cast("double")).alias(k) for k, c in stats.items()), F.min(month).alias("date_min"), F.max(month).alias("date_max"))
    return text.unpivot([], text.columns, "metric", "value")

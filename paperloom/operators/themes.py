"""Themes compared between groups of paragraphs, at once and by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom import lexicon as lx
from paperloom.functions import stats as st
from paperloom.operators.panel import flag

GROUPS = ("panethnic_appeared", "ethnic_appeared")


def in_groups(themed: DataFrame) -> DataFrame:
    """One row for each group that a paragraph belongs to; it may be both or none."""
    member = F.array_compact(F.array(F.when(flag("panethnic"), GROUPS[0]), F.when(flag("ethnic"), GROUPS[1])))
    return themed.withColumn("group_name", F.explode(member))


def counts(themed: DataFrame, *by: str, themes: list[str] = lx.THEMES) -> DataFrame:
    """(group_name, *by, n_paragraphs, and one count for each theme)."""
    return in_groups(themed).groupBy("group_name", *by).agg(F.count("*").alias("n_paragraphs"), *(F.count_if(F.col(t)).alias(t) for t in themes))


def theme_columns(columns: list[str]) -> list[str]:
    """The themes of a table by the names of its columns: frames, domains and themes without their hits, counting words and what is left over; the combined one is split in two."""
    own = [c for c in columns if c.startswith(("policy_frame_", "domain_", "theme_")) and not c.endswith("_hits") and c not in ("policy_frame_data", "domain_other", lx.COMBINED)]
    return sorted([*own, "theme_anti_discrimination", "theme_equal_opportunity"])


def from_flags(panel: DataFrame) -> DataFrame:
    """Each paragraph_id once with its stored hits as labels and a boolean for each of theme_columns(), as themed() has them from texts."""
    names = theme_columns(panel.columns)
    split = {"theme_anti_discrimination", "theme_equal_opportunity"}
    row = F.max(F.struct("canonical_year", "canonical_month", *(c for c in names if c not in split), f"{lx.COMBINED}_hits", "panethnic_hits", "ethnic_hits")).alias("row")
    rows = panel.where("paragraph_id is not null").groupBy("paragraph_id").agg(row).select("paragraph_id", "row.*")
    hits = [f"{lx.COMBINED}_hits", "panethnic_hits", "ethnic_hits"]
    rows = rows.fillna("", hits).withColumns({c: F.coalesce(F.col(c) == 1, F.lit(False)) for c in names if c not in split})
    combined = F.col(f"{lx.COMBINED}_hits")
    return rows.withColumns({"theme_anti_discrimination": combined.contains("discriminat"), "theme_equal_opportunity": combined.rlike("equal opportunity|equal employment opportunity|equal access")})


def recoded(value: Column, names: dict[str, str]) -> Column:
    """The display name of each code; codes without one stay as they are."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value)


def only_present(long: DataFrame, wanted: list[str]) -> DataFrame:
    """The rows of the wanted themes that there are."""
    return long.where(F.col("theme").isin(wanted))


def monthly_wide(themed: DataFrame) -> DataFrame:
    """(year_month, group_name, n_paragraphs, and <theme>_n and <theme>_per100 for each theme)."""
    rows = counts(themed.withColumn("year_month", month_key(F.col("year"), F.col("month"))), "year_month")
    pairs = [c for t in lx.THEMES for c in (F.col(t).alias(f"{t}_n"), st.percent(F.col(t), F.col("n_paragraphs")).alias(f"{t}_per100"))]
    return rows.select("year_month", "group_name", "n_paragraphs", *pairs)


def long_by_suffix(wide: DataFrame, ids: list[str], suffix: str, value: str) -> DataFrame:
    """One row for each column whose name ends in `suffix`; theme is the name without it."""
    cols = [c for c in wide.columns if c.endswith(suffix)]
    return wide.unpivot(ids, cols, "theme", value).withColumn("theme", F.substring("theme", F.lit(1), F.length("theme") - len(suffix)))


def share_long(gap: DataFrame) -> DataFrame:
    """(year_month, level, group_label, pct): both shares of share_gap() below each other, with display names and their fixed order."""
    long = gap.unpivot(["year_month"], ["pct_panethnic", "pct_ethnic"], "code", "pct")
    return long.select("year_month", F.when(F.col("code") == "pct_panethnic", 1).otherwise(2).alias("level"), recoded(F.col("code"), {"pct_panethnic": "Panethnic", "pct_ethnic": "Ethnic"}).alias("group_label"), "pct")


def pretty(theme: Column) -> Column:
    return F.initcap(F.replace(F.regexp_replace(theme, "^(policy_frame_|domain_|theme_)", ""), F.lit("_"), F.lit(" ")))


def prevalence(themed: DataFrame, themes: list[str] = lx.THEMES) -> DataFrame:
    """(group_name, theme, theme_pretty, n_paragraphs_group, n_theme, pct_theme)."""
    long = counts(themed, themes=themes).unpivot(["group_name", "n_paragraphs"], themes, "theme", "n_theme")
    return long.select("group_name", "theme", pretty(F.col("theme")).alias("theme_pretty"), F.col("n_paragraphs").alias("n_paragraphs_group"), "n_theme", st.percent(F.col("n_theme"), F.col("n_paragraphs")).alias("pct_theme"))


def contrast(prevalent: DataFrame) -> DataFrame:
    """One row for each theme: counts and percents of both groups, their gap, odds ratio, its log, and the p of equal shares."""
    of = lambda g, c: F.coalesce(F.max(F.when(F.col("group_name") == g, F.col(c))), F.lit(0))
    wide = prevalent.groupBy("theme").agg(of(GROUPS[0], "n_theme").alias("x1"), of(GROUPS[0], "n_paragraphs_group").alias("n1"), of(GROUPS[1], "n_theme").alias("x2"), of(GROUPS[1], "n_paragraphs_group").alias("n2"))
    x1, n1, x2, n2 = map(F.col, ("x1", "n1", "x2", "n2"))
    odds = st.odds_ratio(x1, n1, x2, n2)
    rows = wide.select(
        "theme", n1.alias("n_panethnic_paragraphs"), n2.alias("n_ethnic_paragraphs"), x1.alias("n_theme_panethnic"), x2.alias("n_theme_ethnic"), st.percent(x1, n1).alias("pct_panethnic"), st.percent(x2, n2).alias("pct_ethnic"),
        (st.percent(x1, n1) - st.percent(x2, n2)).alias("gap_pct_pan_minus_eth"), odds.alias("odds_ratio_pan_vs_eth"), F.ln(odds).alias("log_odds_ratio_pan_vs_eth"), st.two_proportion_p(x1, n1, x2, n2).alias("p_value_two_prop_z"),
    )
    return rows.orderBy(F.desc(F.abs(F.round("gap_pct_pan_minus_eth", 4))), "theme")


def month_key(year: Column, month: Column) -> Column:
    """YYYY-MM; missing parts are left empty, so such rows keep a key of their own."""
    return F.concat(F.coalesce(year.cast("string"), F.lit("")), F.lit("-"), F.when(month.isNull(), "00").otherwise(F.lpad(month.cast("string"), 2, "0")))


def monthly(themed: DataFrame) -> DataFrame:
    """(year_month, group_name, theme, n_paragraphs, n_theme, per100)."""
    wide = counts(themed.withColumn("year_month", month_key(F.col("year"), F.col("month"))), "year_month")
    return wide.unpivot(["group_name", "year_month", "n_paragraphs"], lx.THEMES, "theme", "n_theme").withColumn("per100", st.percent(F.col("n_theme"), F.col("n_paragraphs")))


def share_gap(themed: DataFrame) -> DataFrame:
    """(year_month, n, pct_panethnic, pct_ethnic, gap) over all paragraphs of valid months."""
    rows = themed.where(F.col("year").isNotNull() & F.col("month").between(1, 12)).withColumn("year_month", month_key(F.col("year"), F.col("month")))
    by = rows.groupBy("year_month").agg(F.count("*").alias("n"), F.count_if(flag("panethnic")).alias("p"), F.count_if(flag("ethnic")).alias("e"))
    p, e = st.percent(F.col("p"), F.col("n")), st.percent(F.col("e"), F.col("n"))
    return by.select("year_month", "n", p.alias("pct_panethnic"), e.alias("pct_ethnic"), (p - e).alias("gap"))


def complete(months: DataFrame, themes: list[str] = lx.THEMES) -> DataFrame:
    """monthly() with every month, group and theme, absent ones as 0. The grid is built by exploding lists of themes and groups on the months."""
    grid = months.select("year_month").distinct().withColumn("group_name", F.explode(F.array(*map(F.lit, GROUPS)))).withColumn("theme", F.explode(F.array(*map(F.lit, themes))))
    return grid.join(months.select("year_month", "group_name", "theme", "per100"), ["year_month", "group_name", "theme"], "left").fillna(0.0, ["per100"])


def max100(grid: DataFrame) -> DataFrame:
    """Adds `norm`: the rate with the largest of its theme and group as 100; 0 where that is 0."""
    return grid.withColumn("norm", st.percent(F.col("per100"), F.max("per100").over(W.partitionBy("theme", "group_name"))))


def gaps(grid: DataFrame, value: str = "per100") -> DataFrame:
    """(theme, year_month, pan, eth, gap, low, high): low and high, the ribbon, only where pan exceeds eth."""
    of = lambda g: F.sum(F.when(F.col("group_name") == g, F.col(value)).otherwise(0.0))
    wide = grid.groupBy("theme", "year_month").agg(of(GROUPS[0]).alias("pan"), of(GROUPS[1]).alias("eth"))
    above = F.col("pan") > F.col("eth")
    return wide.withColumns({"gap": F.col("pan") - F.col("eth"), "low": F.when(above, F.col("eth")), "high": F.when(above, F.col("pan"))})


def gap_change(gap: DataFrame) -> DataFrame:
    """(theme, first_gap, last_gap, change, label): between the first and the last month."""
    by = gap.groupBy("theme").agg(F.min_by("gap", "year_month").alias("first_gap"), F.max_by("gap", "year_month").alias("last_gap"))
    change = F.col("last_gap") - F.col("first_gap")
    return by.withColumns({"change": change, "label": F.format_string("%+.1f", change)})


def every_kth(months: DataFrame, k: int = 4) -> DataFrame:
    """(year_month): each k-th month in order, the first included. One row a month, so one ordered window holds them."""
    ranked = months.select("year_month").distinct().withColumn("i", F.row_number().over(W.orderBy("year_month")))
    return ranked.where((F.col("i") - 1) % k == 0).select("year_month")

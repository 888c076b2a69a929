"""Statistics of paragraphs, and the kind of text they tell of.

Method: every statistic with a threshold is a noisy labelling function: it fires or not, and speaks for one kind of text. Which
functions fired in a paragraph is one whole number, its pattern. Only the counts of the patterns, of which there are at most
2 ** number of functions, reach the driver, and expectation-maximization learns from their agreements how often each function fires
in each kind; the posterior of a paragraph's kind is that of its pattern.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.session import cut_lineage

KINDS = ("prose", "list", "tabular", "junk", "furniture")

# Frequent function words of the two languages of the corpus.
COMMON = """
    the of and to in for with that by on at from as was is it not be are this which or an were has have had been but their its who his
    her they will would until unless while after before during over under between into than about despite amid
    el la los las de del que en un una por para con se su sus al como entre pese antes mientras hubo desde sin sobre
""".split()
MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|ene|abr|ago|dic"

_CELL = r"(?:\$?\d[\d.,]*%?|n\.a\.|-)"
#: A row of figures: at least two cells in a row, or a name and then cells behind separators, to the end of the line.
_ROW = rf"(?m)^[^\d\n]{{0,40}}?(?:\d{{4}})?(?:(?:[^\S\n]{{2,}}|[^\S\n]*[|;][^\S\n]*|\t){_CELL}){{2,}}[^\S\n]*$|^{_CELL}(?:[^\S\n]+{_CELL})+$"
#: What a row needs: a separator of cells, or a line that begins as a cell does.
_MAY_BE_ROW = r"(?m)[^\S\n]{2}|[|;\t]|^(?:[$\d-]|n\.a)"
_ITEM = (
    r"(?m)^[^\S\n]*(?:[•*+·o–—-][^\S\n]+\d*[^\S\n]*\p{L}|\d{1,3}[^\S\n]*(?:[):]|-)[^\S\n]*\p{Lu})"
    r"|(?:\.[^\S\n]?){4,}[^\S\n]*\d+[^\w\n]*$"
    rf"|^(?i:{MONTH})\p{{L}}{{0,6}}\.?[^\S\n]+\d{{1,2}}[^\S\n]*(?:[:,–-]|\.\.\.)[^\S\n]*\p{{L}}"
)
_NAMES = r"(?m)^(?:\p{Lu}[\p{L}'~|^]*(?:[^\S\n]+\p{L}+)?,[^\S\n]*)+\p{Lu}[\p{L}']*(?:[^\S\n]+\p{L}+)?[;,.]?[^\S\n]*$"
_FOLIO = r"(?mi)^[^\w\n]*(?:p|pp|pg|page|pág|página)?[^\w\n]*(?:[\dOolI]{1,4}|[ivxlc]{1,8})[^\w\n]*$"
_RUNNING = (
    r"(?mi)^[^\w\n]*(?:page[^\S\n]*\d+[^\S\n]+\S.*|\d{1,4}[^\S\n]*[/|*·][^\S\n]*\S.*|.*\S[^\S\n]*[*·|/][^\S\n]*\d{1,4}|.*\bvol[^\w\n]*\d+.*|.*\bno[^\w\n]*\d+"
    r"|\S{3,9}[^\S\n]+1[89]\d\d[^\S\n]+\S.*|.*[,–-][^\S\n]*\S{3,9}[^\S\n]+1[89]\d\d)[^\w\n]*$"
)
#: Words in lower case, but for those that join the words of a title.
_LOWER_WORD = r"(?<![\p{L}~|^,'.@])(?!(?:of|the|del|de|la|los|and|y|edition|vol|no|page)(?!\p{L}))\p{Ll}{3,}"
_VOWELLESS = r"(?<!\p{L})[\p{L}&&[^aeiouyáéíóúü]]{2,}(?!\p{L})"
_MIXED = r"\p{L}\d+\p{L}|[Ãâï¿§¬]|(?<=\s)[^\p{L}\p{N}\s]{1,3}(?=\s|$)|[^\p{L}\p{N}\s]{2,}(?=\s|$)"


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def with_statistics(panel: DataFrame) -> DataFrame:
    """Adds the statistics of each row: counts of words, lines and characters, mean word length, and shares from 0 to 1.

    The lines are those of paragraph_text; the words those of paragraph_text_norm, or of the text in lower case where that is null.
    Null and empty texts have counts and shares of 0. Columns: n_words, n_tokens, n_lines, n_chars, mean_word_length, symbol_share,
    digit_share, common_share, n_common, n_common_kinds, end_share, vowelless_share, run_share, mixed_share, row_share, cell_share,
    item_share, names_share, running_share, folio, lower_words. Patterns that need a certain sign are tried only where it stands: rows
    and cells where there is a figure, a dash or n.a., rows where there is also a separator or a line that begins with a cell, names where
    there is a comma. Running lines are counted on up to three lines.
    """
    raw, low = F.col("_raw"), F.col("_low")
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern))
    c = F.col
    base = panel.withColumns({"_raw": F.coalesce("paragraph_text", F.lit("")), "_low": F.coalesce("paragraph_text_norm", F.lower("paragraph_text"), F.lit(""))})
    base = base.withColumn("_words", F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)))
    base = base.withColumns(
        {
            "n_words": F.size("_words"),
            "n_tokens": count(low, r"\S+"),
            "n_lines": count(raw, r"(?m)^.*\S"),
            "n_chars": F.length(low),
            "_common": F.filter("_words", lambda w: w.isin(COMMON)),
            "_digits": F.length(low) - F.length(F.translate(low, "0123456789", "")),
            "_letters": F.length(F.array_join("_words", "")),
        }
    )
    base = base.withColumns(
        {
            "mean_word_length": _share(c("_letters"), c("n_words")),
            "digit_share": _share(c("_digits"), c("n_chars")),
            "n_common": F.size("_common"),
            "common_share": _share(F.size("_common"), c("n_words")),
            "n_common_kinds": F.size(F.array_distinct("_common")),
            "symbol_share": _share(F.length(low) - F.length(F.regexp_replace(low, r"[^\p{L}\p{N}\s.,;:'\"()-]+", "")), c("n_chars")),
            "vowelless_share": _share(count(low, _VOWELLESS), c("n_words")),
            "run_share": _share(count(low, r"(\p{L})\1\1\S*|[-–—]{4,}"), c("n_tokens")),
            "mixed_share": _share(count(low, _MIXED), c("n_tokens")),
            "end_share": _share(count(raw, r"(?m)[.!?][^\w\n]*$"), c("n_lines")),
        }
    )
    cells = lambda x: x.rlike(r"[\d-]|n\.a\.")
    # Running lines have a figure; without one, only a page number in letters can be there.
    running = F.when(raw.rlike(r"\d"), count(raw, f"{_RUNNING}|{_FOLIO}")).otherwise(count(raw, _FOLIO))
    out = base.withColumns(
        {
            "row_share": F.when(cells(raw) & raw.rlike(_MAY_BE_ROW), _share(count(raw, _ROW), c("n_lines"))).otherwise(0.0),
            "cell_share": F.when(cells(low), _share(count(low, rf"(?<!\S){_CELL}[;|]?(?!\S)"), c("n_tokens"))).otherwise(0.0),
            "item_share": _share(count(raw, _ITEM), c("n_lines")),
            "names_share": F.when(F.contains(raw, F.lit(",")), _share(count(raw, _NAMES), c("n_lines"))).otherwise(0.0),
            "running_share": F.when(c("n_lines").between(1, 3), _share(running, c("n_lines"))).otherwise(0.0),
            "folio": F.when(c("n_lines") == 1, count(raw, _FOLIO)).otherwise(0),
            "lower_words": count(raw, _LOWER_WORD),
        }
    )
    return out.drop("_low", "_raw", "_words", "_common", "_digits", "_letters")


def labelling_functions() -> list[tuple[str, str, Column]]:
    """(name, the kind it speaks for, when it fires), over the columns of with_statistics()."""
    c = F.col
    some = c("n_tokens") > 0
    return [
        ("common_words", "prose", (c("common_share") >= 0.14) & (c("n_words") >= 4)),
        ("many_function_words", "prose", c("n_common_kinds") >= 3),
        ("lower_case_run", "prose", (c("lower_words") >= 3) & (c("common_share") > 0.08)),
        ("sentence_end", "prose", (c("end_share") > 0) & (c("n_words") >= 3) & (c("item_share") < 0.4) & (c("common_share") > 0)),
        ("item_lines", "list", (c("item_share") >= 0.45) & (c("row_share") < 0.5) & (c("symbol_share") < 0.15)),
        ("name_lines", "list", (c("names_share") >= 0.4) & (c("n_lines") >= 2) & (c("lower_words") <= 2)),
        ("bare_short_lines", "list", (c("n_lines") >= 2) & (c("n_common") <= 0.3 * c("n_lines")) & (c("mixed_share") < 0.25) & (c("row_share") < 0.4) & (c("vowelless_share") < 0.35) & (c("run_share") < 0.12) & (c("symbol_share") < 0.1)),
        ("figure_rows", "tabular", (c("row_share") >= 0.5) & (c("n_lines") >= 2)),
        ("figure_cells", "tabular", (c("cell_share") >= 0.34) & (c("n_lines") >= 2)),
        ("no_vowels", "junk", (c("vowelless_share") >= 0.35) & (c("n_tokens") >= 3) & (c("item_share") < 0.5)),
        ("symbols", "junk", (c("symbol_share") >= 0.12) & (c("row_share") < 0.5)),
        ("mixed_tokens", "junk", (c("mixed_share") >= 0.25) & (c("running_share") == 0) & (c("cell_share") < 0.3) & (c("item_share") < 0.5)),
        ("letter_runs", "junk", c("run_share") >= 0.12),
        ("no_known_word", "junk", (c("common_share") == 0) & (c("n_tokens") >= 4) & ((c("item_share") < 0.3) | (c("symbol_share") >= 0.15)) & (c("cell_share") < 0.2) & (c("names_share") < 0.3) & (c("running_share") < 1)),
        ("page_number", "furniture", c("folio") == 1),
        ("running_line", "furniture", (c("running_share") == 1) & (c("n_lines") <= 2) & (c("n_words") <= 12) & (c("lower_words") <= 1)),
        ("title_line", "furniture", (c("n_lines") == 1) & (c("end_share") == 0) & (c("lower_words") <= 1) & c("n_words").between(2, 12) & (c("mixed_share") < 0.34) & (c("vowelless_share") < 0.35) & (c("item_share") == 0) & (c("names_share") == 0)),
        ("title_with_number", "furniture", some & (c("n_lines") == 1) & (c("digit_share") > 0) & (c("lower_words") == 0) & (c("n_words") <= 10) & (c("mixed_share") < 0.34) & (c("item_share") == 0)),
    ]


def _prior(own: bool) -> tuple[float, float]:
    """Pseudo-counts of firing and not firing in a kind: functions are taken to be mostly right until agreements say otherwise."""
    return (16.0, 4.0) if own else (1.0, 19.0)


def learn(patterns: np.ndarray, counts: np.ndarray, kinds: list[int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern (rows) over KINDS, and the learned firing rates (functions by kinds). patterns: 0/1, one row a pattern."""
    k = len(KINDS)
    own = np.array(kinds)[:, None] == np.arange(k)[None, :]
    up = np.where(own, _prior(True)[0], _prior(False)[0])
    down = np.where(own, _prior(True)[1], _prior(False)[1])
    rate, share = up / (up + down), np.full(k, 1 / k)
    x, n = patterns.astype(float), counts.astype(float)
    for _ in range(rounds):
        log = np.log(share) + x @ np.log(rate) + (1 - x) @ np.log(1 - rate)
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = post * n[:, None]
        share = (weight.sum(axis=0) + 1) / (n.sum() + k)
        rate = (x.T @ weight + up) / (weight.sum(axis=0) + up + down)
    return post, rate


def with_text_kind(panel: DataFrame, key: str = "paragraph_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, text_kind, confidence): each key once, its kind out of KINDS and the posterior of that kind.

    Needs paragraph_text and paragraph_text_norm. Rows with a null key are left out; repeated rows of a key are taken to have the same
    text, and of differing ones one counts, always the same. A null or empty text is no prose, list or table: its kind is `empty`.
    `keep` names further columns of which the largest value of each key is carried along.
    """
    functions = labelling_functions()
    fired = reduce(lambda a, b: a + b, (F.when(c, 1 << i).otherwise(0) for i, (_, _, c) in enumerate(functions)))
    pattern = F.when(F.col("n_tokens") == 0, -1).otherwise(fired).cast("int")
    rows = with_statistics(panel.where(F.col(key).isNotNull())).select(key, *keep, pattern.alias("pattern"))
    rows = cut_lineage(rows.groupBy(key).agg(F.max("pattern").alias("pattern"), *(F.max(c).alias(c) for c in keep)))
    seen = rows.where("pattern >= 0").groupBy("pattern").count().collect()  # at most 2 ** number of functions rows
    names, posterior = [-1], [("empty", 1.0)]
    if seen:
        masks = [r["pattern"] for r in seen]
        x = np.array([[m >> i & 1 for i in range(len(functions))] for m in masks])
        post, _ = learn(x, np.array([r["count"] for r in seen]), [KINDS.index(k) for _, k, _ in functions])
        names += masks
        posterior += [(KINDS[i], float(p[i])) for p, i in zip(post, post.argmax(axis=1), strict=True)]
    table = panel.sparkSession.createDataFrame([(m, k, p) for m, (k, p) in zip(names, posterior, strict=True)], "pattern int, text_kind string, confidence double")
    return rows.join(F.broadcast(table), "pattern").select(key, *keep, "text_kind", "confidence")


def not_prose(panel: DataFrame) -> DataFrame:
    """(paragraph_id, text_kind) of the paragraphs that are list, tabular, junk or furniture."""
    return with_text_kind(panel).where(F.col("text_kind").isin(*KINDS[1:])).select("paragraph_id", "text_kind")


def issue_text_kinds(panel: DataFrame, issues: DataFrame) -> DataFrame:
    """(file_name, n_paragraphs, prose_share, keep_rate_pct): for each issue the share of prose beside the mean of its keep rates."""
    kinds = with_text_kind(panel, keep=("file_name",))
    by_issue = kinds.groupBy("file_name").agg(F.count("*").alias("n_paragraphs"), F.avg((F.col("text_kind") == "prose").cast("int")).alias("prose_share"))
    kept = issues.select("batch_no", "file_name", "keep_rate_pct").distinct().groupBy("file_name").agg(F.avg("keep_rate_pct").alias("keep_rate_pct"))
    return by_issue.join(kept, "file_name", "left")

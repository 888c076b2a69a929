"""What scanning and typesetting leave in lines: headers, page numbers, cut words, misread words; and their repair into paragraphs.

Method: SQL windows put the lines of each page in reading order, cut them into paragraphs where the gap is wide, and give each line its
neighbours. All words of the corpus are counted and grouped by their skeleton, in which glyphs that scanning takes for one another are
the same strokes. Within a group a form is given up if another one is far more frequent; an occurrence of it is misread if a frequent
form of its group is supported by the words around it, or if signs or figures stand inside it. Words cut at a line's end are joined if
the joined form is known and keep their hyphen if the compound is. Headers are lines at the top of a page whose text comes again on
other pages once figures are masked, or that have the parts of a running line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.llm.quality import _RUNNING, with_text_kind
from paperloom.session import cut_lineage

#: How many times as frequent the form must be that another one is given up for; and to do so without support of context.
DOMINANCE, CLEAR = 20, 200
#: The same for a word with signs or figures inside.
ODD_DOMINANCE = 3
#: Words told apart from suspects by a broadcast set; the most frequent accepted forms. The rest, of misread words and of words cut at
#: a line's end, is looked up by joins.
MAX_ACCEPTED = 50_000
MIN_ACCEPTED = 3
#: Misread forms with the forms that they stand for that are broadcast at most, some 20 MB.
MAX_VERDICTS = 100_000
#: Distinct words or word pairs counted in memory before they are handed on.
FLUSH = 200_000

# The strokes of confusable glyphs. A glyph that is read as two others has the strokes of both.
STROKES = {
    "0": "o", "1": "i", "l": "i", "i": "i", "5": "s", "9": "g", "@": "a", "(": "c", "e": "c", "f": "t", "y": "v", "d": "ci", "n": "ri", "m": "rri", "u": "ii", "w": "vv",
    "h": "ii", "b": "ii", "~": "", "^": "", "|": "", ",": "", ".": "", "'": "", "’": "", "!": "i", "8": "ii", "6": "ii", "é": "c", "í": "i", "ó": "o", "á": "a", "ú": "ii", "ñ": "ri",
}
#: The same for words in capitals.
CAPITALS = {"0": "o", "1": "i", "L": "i", "I": "i", "5": "s", "9": "g", "@": "a", "(": "c", "E": "f", "F": "f", "N": "iv", "U": "ii", "M": "rri", "~": "", "^": "", "|": "", ",": "", ".": "", "'": "", "’": "", "É": "f", "Í": "i", "Ó": "o", "Á": "a", "Ú": "ii", "Ñ": "iv"}
_LOWER, _UPPER = str.maketrans(STROKES), str.maketrans(CAPITALS)
HYPHENS = "\u2010\u2011\u00ac\u00ad-"

_TOKEN = re.compile("[^\\W_]+(?:[|~^@(,.'’\u00ad][^\\W_]+)*")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-\u2011\u2010][^\W\d_]+)+")
_SIGN = re.compile(r"[^\W_][|~^@(,.'’][^\W_]|[^\W\d_]\d|\d[^\W\d_]")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
#: Apostrophes and points that belong to a word: possessives, elisions, abbreviations, ordinals, times, sizes.
_OWN = re.compile(r"(?:.*['’]s|(?:do|does|did|is|are|was|were|has|have|had|wo|would|could|should|ca|must|need)n['’]t|(?:we|you|they|i|he|she|it|who|that|there)['’](?:re|ve|ll|d|m)|[a-z]['’].{1,2}|(?:[^\W\d_]\.)+[^\W\d_]?|\d+(?:st|nd|rd|th|s|a|o|am|pm|mm|cm|km|ft|in|lb)|[\d.,]+%?|\d+[a-z]?|[a-z]\d+)\Z", re.IGNORECASE)
_MOJIBAKE = re.compile(r"[ÃÂâï][\u0080-¿ -₯™]|�")
_TAIL = re.compile(rf"([^\W\d_][^\s{HYPHENS}]*(?:[-\u2011][^\s{HYPHENS}]+)*)([{HYPHENS}])\s*\Z")
_HEAD = re.compile(r"\s*([^\W_][^\s]*)")
_FIGURES = re.compile(r"(?<!\S)[\d_]+(?!\S)")
_EDGE = re.compile(r"^[^\w@(]+|[^\w@(]+$")


def skeleton(form: str) -> str:
    """The strokes of a word; words in capitals have their own, marked by a leading ^."""
    if form.isupper() and len(form) > 1:
        return "^" + form.translate(_UPPER).lower()
    return form.lower().translate(_LOWER)


def tokens(line: str) -> list[str]:
    """Words of a line with signs that stand inside them; without those of wrong decoding."""
    found = _TOKEN.findall(line)
    return [w for w in found if not _MOJIBAKE.search(w)] if not line.isascii() and _MOJIBAKE.search(line) else found


class Memo(dict):
    """A function of a word that is worked out once for each word; emptied when it grows large."""

    def __init__(self, of) -> None:  # noqa: ANN001
        super().__init__()
        self.of = of

    def __missing__(self, word: str):  # noqa: ANN204
        if len(self) > FLUSH:
            self.clear()
        value = self[word] = self.of(word)
        return value


def key_of(form: str) -> str:
    """What forms are counted by: lower case, unless in capitals."""
    return form if form.isupper() and len(form) > 1 else form.lower()


def odd(form: str) -> bool:
    """Whether signs or figures stand inside the word that don't belong there."""
    return bool(_SIGN.search(form)) and not _OWN.match(form)


def latest(lines: DataFrame) -> DataFrame:
    """Each line_id once, as last loaded; rows without line_id are left out. Lines lie together by page afterwards."""
    by_page = lines.where("line_id is not null").repartition("file_name", "page_number")
    again = W.partitionBy("file_name", "page_number", "line_id").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("text"), "column_index", "y0", "x0")
    return by_page.withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n")


def laid_out(lines: DataFrame) -> DataFrame:
    """(line_id, file_name, page_number, column_index, line_no, text, paragraph_in_column, ends, at_top, at_bottom, next_1, next_2, before) in reading order.

    A paragraph starts where the gap to the line above is more than max(8, 1.25 * median height) of its column; blank lines count for
    the median but belong to no paragraph and are left out. line_no is the place of the line in its column. ends: the line is its
    paragraph's last. at_top, at_bottom: no other line of the page lies higher, or lower. next_1 and next_2 are the lines below in the
    column of a line that ends in a hyphen, `before` the line above one if that ends in a hyphen; else they are null.
    """
    rows = latest(lines.select("line_id", "file_name", "page_number", "column_index", "x0", "y0", "y1", "text", "loaded_at"))
    column = W.partitionBy("file_name", "page_number", "column_index")
    rows = rows.withColumn("_h", F.median(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))).over(column)).where(F.trim("text") != "")
    down = column.orderBy("y0", "x0", "line_id")
    rows = rows.withColumn("_gap", F.col("y0") - F.lag("y1").over(down))
    rows = rows.withColumn("_new", (F.coalesce(F.col("_gap"), F.lit(0.0)) > F.greatest(F.lit(8.0), 1.25 * F.col("_h"))).cast("int"))
    rows = rows.withColumns({"line_no": F.row_number().over(down), "paragraph_in_column": 1 + F.sum("_new").over(down), "ends": F.coalesce(F.lead("_new").over(down), F.lit(1)) == 1})
    at_hyphen = lambda text: text.rlike(rf"[{HYPHENS}][^\p{{L}}\p{{N}}]*$")
    own, above = at_hyphen(F.col("text")), F.lag("text", 1).over(down)
    rows = rows.withColumns({"next_1": F.when(own, F.lead("text", 1).over(down)), "next_2": F.when(own, F.lead("text", 2).over(down)), "before": F.when(at_hyphen(above), above)})
    page = W.partitionBy("file_name", "page_number")
    rows = rows.withColumns({"at_top": F.col("y0") <= F.min("y0").over(page), "at_bottom": F.col("y1") >= F.max("y1").over(page)})
    return rows.drop("_h", "_gap", "_new", "x0", "y0", "y1", "loaded_at")


def paragraph_key() -> Column:
    """The paragraph_id that the lines of a paragraph lead to."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return F.format_string("%s_p%d_c%d_n%d", stem, "page_number", "column_index", "paragraph_in_column")


def _counted(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(form, n) of words and compounds, and (pair, n) of neighbouring words of a line, each pair as one hash."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        pairs: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = pd.DataFrame({"form": [*words, *(f"{a} {b}" for a, b in pairs)], "n": [*words.values(), *pairs.values()]}, dtype=object)  # or an empty one would hold floats
            words.clear()
            pairs.clear()
            return rows

        keys = Memo(key_of).__getitem__
        for batch in batches:
            for text in batch["text"]:
                found = list(map(keys, tokens(text)))
                words.update(found)
                pairs.update(zip(found, found[1:]))
                if "-" in text or "\u2010" in text:
                    words.update(w.lower().replace("\u2010", "-") for w in _COMPOUND.findall(text))
            if len(words) + len(pairs) > FLUSH:
                yield out()
        yield out()

    counted = lines.select("text").mapInPandas(count, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    return counted.where(~F.contains("form", F.lit(" "))), counted.where(F.contains("form", F.lit(" ")) & (F.col("n") >= 2))


def with_skeleton(forms: DataFrame) -> DataFrame:
    """(form, n, bones): forms by skeleton; a form in small letters is also filed as it would look in capitals, under its own name."""

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for form, n in zip(batch["form"], batch["n"], strict=True):
                if "-" in form:
                    continue
                rows.append((form, n, skeleton(form)))
                if _PLAIN.match(form) and not form.isupper():
                    rows.append((form.upper(), n, skeleton(form.upper())))
                elif _PLAIN.match(form):
                    rows.append((form.lower(), n, skeleton(form.lower())))
            yield pd.DataFrame(rows, columns=["form", "n", "bones"])

    filed = forms.mapInPandas(file, "form string, n long, bones string")
    return filed.groupBy("form", "bones").agg(F.sum("n").alias("n"))


def lexicon(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, given_up, pairs) of the corpus.

    accepted (form, n, bones): forms that no other form of their skeleton dominates, and compounds; given_up (form, n, bones); pairs
    (form, n): neighbouring words. A group's most frequent plain form is found by aggregation, so a group of any size is no burden.
    """
    forms, pairs = _counted(lines)
    filed = with_skeleton(forms)
    plain = filed.where(F.col("form").rlike(r"^\p{L}+$"))
    chief = plain.groupBy("bones").agg(F.max("n").alias("most"))
    judged = filed.join(chief, "bones", "left").withColumn("down", F.coalesce(F.col("n") * DOMINANCE <= F.col("most"), F.lit(False)))
    judged = cut_lineage(judged.where(F.length("form") > 1).select("form", "n", "bones", "down"))
    compounds = forms.where(F.contains("form", F.lit("-")) & (F.col("n") >= 2)).select("form", "n", F.lit("").alias("bones"))
    good = judged.where(~F.col("down") & (F.col("n") >= MIN_ACCEPTED) & F.col("form").rlike(r"^\p{L}+$")).select("form", "n", "bones")
    return good.unionByName(compounds), judged.where("down").select("form", "n", "bones"), pairs


def _seams(text: str | None, *after: str | None) -> Iterator[tuple[str, str, str, str, str]]:
    """(left, sign, bare, whole, right) of a line that ends in a hyphen with each line below that its last word may go on in."""
    end = _TAIL.search(text) if text else None
    if not end:
        return
    left, sign = end[1], end[2]
    bare = re.split("[-\u2011]", left)[-1]
    for text_below in after:
        begin = _HEAD.match(text_below) if text_below else None
        if not begin:
            continue
        whole = _EDGE.sub("", begin[1])
        right = re.split(f"[{HYPHENS}]", whole)[0]
        if right and right[0].isalpha():
            yield left, sign, bare, whole, right


def _hyphenated(text: str | None) -> bool:
    return bool(text) and text.rstrip()[-1:] in HYPHENS and bool(text.rstrip())


def _looked_up(text: str, one: str | None, two: str | None, before: str | None) -> set[str]:
    """The forms that the marks of a line at a hyphen ask for, and the skeletons that they do, each behind a blank."""
    forms, bones = set(), set()
    own, above = _hyphenated(text), _hyphenated(before)
    words = tokens(text)
    for w in (*(words[-1:] if own else ()), *(words[:1] if above else ())):
        forms |= {key_of(w), w.lower()}
    for left, _, bare, whole, right in (*(_seams(text, one, two) if own else ()), *(_seams(before, text) if above else ())):
        compounds = {f"{left}-{whole}".lower(), f"{left}-{right}".lower()}
        forms |= {f(w) for w in (bare + right, bare, right) for f in (key_of, str.lower)} | compounds
        bones |= {" " + skeleton(w) for w in (*compounds, bare + right, (bare + right).lower())}
    return forms | bones


def _beyond(lines: DataFrame, accepted: DataFrame, known: dict[str, int]) -> DataFrame:
    """(line_id, beyond): for lines at a hyphen, what they ask for that is accepted but too rare for the broadcast set, by a join with the whole table."""
    shared = lines.sparkSession.sparkContext.broadcast(set(known))
    kind = dict(lines.dtypes)["line_id"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = shared.value | {" " + skeleton(w) for w in shared.value}
        for batch in batches:
            rows = []
            for line_id, text, one, two, before in zip(batch["line_id"], batch["text"], batch["next_1"], batch["next_2"], batch["before"], strict=True):
                if _hyphenated(text) or _hyphenated(before):
                    rows += [(line_id, item) for item in _looked_up(text, one, two, before) - frequent]
            yield pd.DataFrame(rows, columns=["line_id", "item"])

    asked = lines.select("line_id", "text", "next_1", "next_2", "before").mapInPandas(ask, f"line_id {kind}, item string")
    bones = F.pandas_udf(lambda words: words.map(lambda w: " " + skeleton(w)), "string")
    held = accepted.select(F.col("form").alias("item"), "n").unionByName(accepted.select(bones("form").alias("item"), F.lit(1).cast("long").alias("n")).distinct())
    return asked.join(held, "item").groupBy("line_id").agg(F.collect_set(F.struct("item", "n")).alias("beyond"))


def _marks(lines: DataFrame, accepted: dict[str, int]) -> DataFrame:
    """Adds cut (the word goes on below) and suspects (words that aren't accepted, with their neighbours; seam: length of a cut word's part above, below zero where the line holds that part).

    `beyond`, if there is such a column, holds the accepted forms and skeletons outside the broadcast set that a line at a hyphen asks for, from _beyond(); null for none.
    """
    shared = lines.sparkSession.sparkContext.broadcast(accepted)
    kinds = dict(lines.dtypes)
    kept = [c for c in lines.columns if c not in ("next_1", "next_2", "before", "beyond")]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        bones = {skeleton(w) for w in known}
        rare: dict[str, int] = {}

        frequent = Memo(lambda form: known.get(key_of(form), 0) or known.get(form.lower(), 0)).__getitem__

        def count(form: str) -> int:
            if not rare:
                return frequent(form)
            return known.get(key_of(form), 0) or rare.get(key_of(form), 0) or known.get(form.lower(), 0) or rare.get(form.lower(), 0)

        def has_bones(form: str) -> bool:
            return skeleton(form) in bones or " " + skeleton(form) in rare

        def cut_at(text: str | None, *after: str | None) -> tuple[str, str] | None:
            """The word's part on this line and the part below, if it is cut."""
            best = None
            for left, sign, bare, whole, right in _seams(text, *after):
                joined, compound = count(bare + right), max(known.get(w, 0) or rare.get(w, 0) for w in (f"{left}-{whole}".lower(), f"{left}-{right}".lower()))
                if joined and joined >= compound:
                    return bare, right
                if compound:
                    return None
                if has_bones(f"{left}-{right}".lower()) or has_bones(f"{left}-{whole}".lower()):
                    return None
                if has_bones(bare + right) or has_bones((bare + right).lower()):
                    return bare, right
                if best is None:
                    best = (bare, right)
            if best and sign == "-" and count(best[0]) >= MIN_ACCEPTED and count(best[1]) >= MIN_ACCEPTED:
                return None
            if best and sign == "-" and best[1][0].isupper() and not best[0].isupper():
                return None
            return best

        for batch in batches:
            rows = []
            asked = batch["beyond"] if "beyond" in batch else [None] * len(batch)
            for text, one, two, before, beyond in zip(batch["text"], batch["next_1"], batch["next_2"], batch["before"], asked, strict=True):
                words = tokens(text)
                rare = {x["item"]: x["n"] for x in beyond} if beyond is not None else {}
                cut = cut_at(text, one, two) if _hyphenated(text) else None
                from_above = cut_at(before, text) if _hyphenated(before) else None
                suspects = []
                look = count if rare else frequent
                for i in [k for k, w in enumerate(words) if not look(w)]:
                    w = words[i]
                    first, last = i == 0 and from_above is not None, i == len(words) - 1 and cut is not None
                    if first or last:
                        a, b = from_above if first else cut
                        whole = a + b
                        if count(whole):
                            continue
                        suspects.append((whole, key_of(words[i - 1]) if last and i else "", key_of(words[1]) if first and len(words) > 1 else "", len(a) if first else -len(a)))
                        if not odd(w):
                            continue
                    if len(w) > 2 and not _OWN.match(w):
                        suspects.append((w, key_of(words[i - 1]) if i else "", key_of(words[i + 1]) if i + 1 < len(words) else "", 0))
                rows.append((cut is not None, [{"word": x[0], "before": x[1], "after": x[2], "seam": x[3]} for x in suspects]))
            yield batch[kept].assign(cut=[r[0] for r in rows], suspects=[r[1] for r in rows])

    columns = ", ".join(f"{c} {kinds[c]}" for c in kept)
    return lines.mapInPandas(mark, f"{columns}, cut boolean, suspects array<struct<word: string, before: string, after: string, seam: int>>")


def _misread(marked: DataFrame, accepted: DataFrame, given_up: DataFrame, pairs: DataFrame) -> DataFrame:
    """(line_id, file_name, page_number, word, at_seam, right): suspects with the form they are misread from; at_seam: the word is put together from two lines."""
    found = cut_lineage(marked.select(*LINE_KEY, F.explode("suspects").alias("s")).select(*LINE_KEY, "s.*").where(F.length("word") > 2))  # read twice
    bones = F.pandas_udf(lambda words: words.map(skeleton), "string")
    strange = F.pandas_udf(lambda words: words.map(odd), "boolean")
    form = F.pandas_udf(lambda words: words.map(key_of), "string")
    words = found.select("word").distinct().withColumns({"bones": bones("word"), "odd": strange("word"), "key": form("word")})
    words = words.join(accepted.select(F.col("form").alias("key")), "key", "left_anti")  # accepted, though too rare for the broadcast set
    words = words.join(accepted.select(F.col("form").alias("small")), F.lower("word") == F.col("small"), "left_anti")
    counts = given_up.select(F.col("form").alias("key"), F.col("n").alias("n_wrong")).groupBy("key").agg(F.max("n_wrong").alias("n_wrong"))
    words = words.join(counts, "key", "left").fillna(1, ["n_wrong"])
    right = accepted.where("bones <> ''").select("bones", F.col("form").alias("right"), F.col("n").alias("n_right"))
    words = words.join(right, "bones").where((F.col("right") != F.col("key")) & (F.col("n_right") >= F.when(F.col("odd"), ODD_DOMINANCE).otherwise(DOMINANCE) * F.col("n_wrong")))
    # A wrong form may be frequent: the verdicts go to all tasks where they are few, else to the occurrences, split where one form has too many.
    words = cut_lineage(words)
    found = found.join(F.broadcast(words) if words.count() <= MAX_VERDICTS else words, "word")
    # A word cut in two: the error is in the part that the right form doesn't share.
    head, tail = F.abs("seam"), F.length("word") - F.abs("seam")
    low, good = F.lower("word"), F.lower("right")
    in_head = ~F.startswith(good, F.substring(low, F.lit(1), head))
    in_tail = ~F.endswith(good, F.substring(low, head + 1, tail))
    found = found.where((F.col("seam") == 0) | ((F.col("seam") < 0) & in_head) | ((F.col("seam") > 0) & in_tail))
    seen = pairs.select(F.col("form").alias("pair"), F.col("n").alias("n_pair"))
    left = found.withColumn("pair", F.concat_ws(" ", "before", "right")).join(seen, "pair", "left").withColumnRenamed("n_pair", "n_before").drop("pair")
    both = left.withColumn("pair", F.concat_ws(" ", "right", "after")).join(seen, "pair", "left").withColumnRenamed("n_pair", "n_after").drop("pair")
    supported = F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0)) > 0
    both = both.where(F.col("odd") | supported | (F.col("n_right") >= CLEAR * F.col("n_wrong")))
    best = F.max_by("right", F.struct(supported.cast("int"), "n_right", "right")).alias("right")
    return both.groupBy(*LINE_KEY, "word", (F.col("seam") != 0).alias("at_seam")).agg(best)


#: Pages that a printed number may be off the number of the page in its file, as covers are counted or not. A file whose pages are
#: numbered otherwise, as in a volume numbered through, has an offset of its own: one that holds on so many pages at least and on that
#: share of the pages with a number at their top or bottom.
MAX_OFFSET, OWN_PAGES, OWN_SHARE = 3, 3, 0.5
#: Characters of a running title at most, strokes at least, and pages of its file that it stands on.
HEADER_LENGTH, HEADER_STROKES, HEADER_PAGES = 90, 6, 2
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}  # fixed values


def page_number_value(text: Column) -> Column:
    """The number that a line consists of, in figures or small Roman numerals and however decorated; null for other lines and for a number that ends a sentence."""
    arabic = F.regexp_extract(text, r"(?i)^\W*(?:p|pp|pg|page|pág|página)?\W*(\d{1,5})\W*$", 1)
    roman = F.lower(F.regexp_extract(text, r"(?i)^\W*(?:p|pp|pg|page|pág|página)?\W*([ivxlc]{1,8})\W*$", 1))
    digits = F.transform(F.split(roman, ""), lambda x: F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in ROMAN.items()), F.lit(0)))
    value = F.aggregate(
        F.reverse(digits),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, d: F.struct((acc["sum"] + F.when(d < acc["last"], -d).otherwise(d)).alias("sum"), d.alias("last")),
        lambda acc: acc["sum"],
    )
    number = F.when(arabic != "", arabic.cast("int")).when(roman != "", value)
    return F.when(~F.trim(text).rlike(r"^\d+\.$"), number)


LINE_KEY = ("line_id", "file_name", "page_number")


def page_numbers(lines: DataFrame) -> DataFrame:
    """(line_id, file_name, page_number) of the lines of laid_out() that consist of their page's number: near the page's own in its file, or off by what holds for the file."""
    rows = lines.select("line_id", "file_name", "page_number", (F.col("at_top") | F.col("at_bottom")).alias("at_edge"), (page_number_value(F.col("text")) - F.col("page_number")).alias("off")).where("off is not null")
    edge = rows.where("at_edge").groupBy("file_name", "off").agg(F.count_distinct("page_number").alias("n"))
    file = edge.groupBy("file_name").agg(F.max_by("off", F.struct("n", (-F.abs("off")).alias("d"))).alias("own"), F.max("n").alias("n"), F.sum("n").alias("n_all"))
    file = file.where((F.col("n") >= OWN_PAGES) & (F.col("n") >= OWN_SHARE * F.col("n_all")) & (F.abs("own") > MAX_OFFSET)).select(F.col("file_name").alias("of_file"), "own")
    rows = rows.join(file, F.col("file_name").eqNullSafe(F.col("of_file")), "left")
    return rows.where((F.abs("off") <= MAX_OFFSET) | (F.col("at_edge") & F.coalesce(F.col("off") == F.col("own"), F.lit(False)))).select(*LINE_KEY)


def headers(lines: DataFrame) -> DataFrame:
    """(line_id, file_name, page_number) of running titles, dates and issue lines at the top of pages, from laid_out().

    A line at the top is one if, with figures masked and glyphs made one, it comes again at the top of another page of its file, isn't a
    sentence, and stands alone or has a sign between its parts; or if it has the parts of a running line: a page number, date, volume or
    edition beside a title.
    """
    form = F.pandas_udf(lambda texts: texts.map(lambda t: skeleton(_FIGURES.sub("", re.sub(r"[^\w@(]+", " ", t)).replace(" ", "").lower())), "string")
    short = (F.length("text") <= HEADER_LENGTH) & page_number_value(F.col("text")).isNull()
    top = lines.where(F.col("at_top") & short).select("line_id", "file_name", "page_number", "text", "ends").withColumn("form", form("text"))
    again = top.groupBy("file_name", "form").agg(F.count_distinct("page_number").alias("n_pages")).withColumnRenamed("file_name", "of_file")
    top = top.join(again.withColumnRenamed("form", "of_form"), F.col("file_name").eqNullSafe(F.col("of_file")) & (F.col("form") == F.col("of_form")))
    sentence = F.col("text").rlike(r"[.!?;,]\s*$") | (F.regexp_count("text", F.lit(r"(?<![\p{L}])\p{Ll}{4,}")) >= 3)
    running = F.col("text").rlike(_RUNNING) & ~F.col("text").rlike(r"^\W*\d{1,3}\W+\p{Ll}") & (F.regexp_count("text", F.lit("[|;]")) < 2)
    apart = F.col("ends") | F.col("text").rlike(r"\S\s+[/|*·•]\s+\S")
    return top.where(((F.col("n_pages") >= HEADER_PAGES) & apart & ~sentence & (F.length("form") >= HEADER_STROKES)) | running).select(*LINE_KEY)


def noise(lines: DataFrame) -> DataFrame:
    """(line_id, noise_kind, detail): each line with each kind of noise that it has, once; kinds are header, page_number, hyphen, misread.

    Needs line_id, file_name, page_number, column_index, x0, y0, x1, y1, text and loaded_at; other columns are ignored. A line loaded
    again counts as it was last loaded. Null and blank texts have no noise. Words of one or two characters, such as 0f for of, are never taken for misread. `detail` holds the misread word and the form it stands
    for as word=right, and is null otherwise. An empty table gives no rows.
    """
    laid, right, _ = _analysed(lines)
    numbers = page_numbers(laid).select("line_id", F.lit("page_number").alias("noise_kind"))
    cut = laid.where("cut").select("line_id", F.lit("hyphen").alias("noise_kind"))
    top = headers(laid).select("line_id", F.lit("header").alias("noise_kind"))
    misread = right.groupBy("line_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "word", "right"))), " ").alias("detail"))
    plain = numbers.unionByName(cut).unionByName(top).withColumn("detail", F.lit(None).cast("string"))
    return plain.unionByName(misread.select("line_id", F.lit("misread").alias("noise_kind"), "detail"))


def _known(lines: DataFrame, accepted: DataFrame) -> dict[str, int]:
    """The accepted forms that are broadcast: at most MAX_ACCEPTED, the most frequent."""
    return {r["form"]: r["n"] for r in accepted.orderBy(F.desc("n"), "form").limit(MAX_ACCEPTED).select("form", "n").collect()}


def _cut_marks(lines: DataFrame, accepted: DataFrame, known: dict[str, int]) -> DataFrame:
    """_marks() by the whole accepted table: what the broadcast set doesn't hold is joined."""
    whole = len(known) < MAX_ACCEPTED  # the set is the whole table
    return _marks(lines if whole else lines.join(_beyond(lines, accepted, known), "line_id", "left"), known)


def _analysed(lines: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, dict[str, int]]]:
    """The lines laid out with cut marks, _misread(), and the accepted forms, whole and as far as they are broadcast."""
    laid = cut_lineage(laid_out(lines))
    accepted, given_up, pairs = lexicon(laid)
    known = _known(laid, accepted)
    marked = cut_lineage(_cut_marks(laid, accepted, known))
    return marked, _misread(marked, accepted, given_up, pairs), (accepted, known)


def noise_outside_junk(lines: DataFrame, panel: DataFrame) -> DataFrame:
    """noise() without the lines of paragraphs that are junk by their statistics."""
    laid, right, _ = _analysed(lines)
    junk = with_text_kind(panel).where("text_kind = 'junk'").select(F.col("paragraph_id").alias("of_paragraph"))
    # One pass over the lines keeps those that can have a kind; of these the lines of junk are left out.
    may_be = F.col("cut") | F.col("at_top") | (F.size("suspects") > 0) | page_number_value(F.col("text")).isNotNull()
    rows = laid.where(may_be).withColumn("of_paragraph", paragraph_key()).drop("suspects", "column_index", "line_no", "paragraph_in_column")
    clean = cut_lineage(rows.join(junk, "of_paragraph", "left_anti"))
    numbers = page_numbers(clean).select("line_id", F.lit("page_number").alias("noise_kind"))
    cut = clean.where("cut").select("line_id", F.lit("hyphen").alias("noise_kind"))
    top = headers(clean).select("line_id", F.lit("header").alias("noise_kind"))
    misread = right.select("line_id").distinct().join(clean.select("line_id"), "line_id", "left_semi").select("line_id", F.lit("misread").alias("noise_kind"))
    return numbers.unionByName(cut).unionByName(top).unionByName(misread)


def _in_case(word: str, right: str) -> str:
    return right.capitalize() if word[:1].isupper() and not right.isupper() else right


def _mended(text: str, word: str, right: str) -> str:
    """The text with `right` for each `word` that stands as a whole word."""
    return re.sub(rf"(?<![^\W_]){re.escape(word)}(?![^\W_])", lambda m: _in_case(word, right), text)


def reflow(lines: list) -> str:
    """One running text of (text, cut, fixes) in order: words mended, cut words joined, compounds joined with their hyphen, other lines by blanks.

    A fix at a seam is for the word that the lines make together.
    """
    out, open_end = "", False
    seams: dict[str, str] = {}
    for line in lines:
        fixes = line["fixes"] if line["fixes"] is not None else ()
        text = line["text"]
        for f in fixes:
            if not f["at_seam"]:
                text = _mended(text, f["word"], f["right"])
        seams |= {f["word"]: f["right"] for f in fixes if f["at_seam"]}
        if open_end:
            head = _HEAD.match(text)
            text = text.lstrip()
            tail = re.search(r"[^\s]*\Z", out)[0]
            whole = tail + (_EDGE.sub("", head[1]) if head else "")
            for word, right in seams.items():
                if whole.endswith(word):  # the mended word takes the place of both parts
                    rest = text[len(word) - (len(tail) - (len(whole) - len(word))) :]
                    out, text = out[: len(out) - len(tail)] + tail[: len(whole) - len(word)] + _in_case(word, right), rest
                    break
            seams = {f["word"]: f["right"] for f in fixes if f["at_seam"]}
        elif out:
            text = " " + text
        text = text.rstrip()
        if line["cut"]:
            text = text.rstrip(HYPHENS)
        open_end = line["cut"] or bool(re.search(r"[^\W\d_][-\u2011]\Z", text))
        out += text.replace("\u00ad", "")
    return re.sub(r"\s+", " ", out).strip()


#: A paragraph goes on in the next column or page if its text ends in a letter, comma or hyphen and the next one begins with a small letter.
_OPEN, _GOES_ON = rf"[\p{{L}},;{HYPHENS}]\s*$", r"^\s*\p{Ll}"


def _continued(paragraphs: DataFrame) -> DataFrame:
    """(key, parent, tail, head): the first paragraph of a column that the last one of the column before goes on in, on the same page or the next.

    Columns are linked to their neighbours by keys, so a file of any number of pages is no task's alone.
    """
    column = ["file_name", "page_number", "column_index"]
    part = lambda text: F.struct("paragraph_in_column", "key", F.col(text).alias("text"))
    columns = paragraphs.groupBy(*column).agg(F.min(part("head")).alias("first"), F.max(part("tail")).alias("last"))
    page = W.partitionBy("file_name", "page_number")
    columns = columns.withColumns({"rank": F.row_number().over(page.orderBy("column_index")), "n": F.count("*").over(page)})
    further = F.col("rank") < F.col("n")
    ends = columns.where(F.col("last.text").rlike(_OPEN)).select("file_name", F.when(further, F.col("page_number")).otherwise(F.col("page_number") + 1).alias("page_number"), F.when(further, F.col("rank") + 1).otherwise(1).alias("rank"), F.col("last.key").alias("parent"), F.col("last.text").alias("tail"))
    starts = columns.where(F.col("first.text").rlike(_GOES_ON)).select("file_name", "page_number", "rank", F.col("first.key").alias("key"), F.col("first.text").alias("head"))
    return ends.join(starts, ["file_name", "page_number", "rank"]).select("key", "parent", "tail", "head")


def _chains(links: DataFrame) -> DataFrame:
    """(key, root): the first paragraph of the chain that each linked paragraph belongs to; pointers double their reach each round."""
    found = cut_lineage(links.select("key", F.col("parent").alias("root")))
    while True:
        up = found.select(F.col("key").alias("root"), F.col("root").alias("higher"))
        step = cut_lineage(found.join(up, "root", "left").select("key", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        found = step.select("key", "root")
        if step.where("moved").isEmpty():
            return found


def repaired(lines: DataFrame) -> DataFrame:
    """(file_name, page_number, column_index, paragraph_in_column, text): running text of each paragraph.

    Lines stand in the order of the windows of laid_out(). Headers and page numbers are left out, misread words replaced by the form
    they stand for, cut words joined, compounds joined with their hyphen, and lines joined by blanks. A paragraph that goes on in the next
    column or page is one, under the place of its first part. A paragraph of nothing but headers and numbers is left out.
    """
    laid, right, (accepted, known) = _analysed(lines)
    gone = headers(laid).unionByName(page_numbers(laid)).withColumn("gone", F.lit(True))
    fixes = right.groupBy(*LINE_KEY).agg(F.sort_array(F.collect_list(F.struct("word", "right", "at_seam"))).alias("fixes"))
    # Lines and what is to be done to them meet by page, where the paragraphs are put together next, so texts are shuffled once.
    own = ["column_index", "paragraph_in_column", "line_no", "text", "cut"]
    both = laid.select(*LINE_KEY, *own).unionByName(gone, allowMissingColumns=True).unionByName(fixes, allowMissingColumns=True).repartition("file_name", "page_number")
    met = both.groupBy("file_name", "page_number", "line_id").agg(*(F.max(c).alias(c) for c in (*own, "gone")), F.first("fixes", ignorenulls=True).alias("fixes"))
    kept = met.where(F.col("gone").isNull() & F.col("text").isNotNull())
    place = ["file_name", "page_number", "column_index", "paragraph_in_column"]
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text", "cut", "fixes")))
    kind = "struct<text: string, tail: string, head: string>"

    def run(all_lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": [reflow(ls) for ls in all_lines], "tail": [ls[-1]["text"] for ls in all_lines], "head": [ls[0]["text"] for ls in all_lines]})

    whole = kept.groupBy(*place).agg(ordered.alias("ls")).select(*place, F.pandas_udf(run, kind)("ls").alias("x")).select(*place, "x.*")
    key = F.concat_ws("|", F.coalesce("file_name", F.lit("")), *place[1:])
    whole = cut_lineage(whole.withColumn("key", key))
    links = cut_lineage(_continued(whole))
    # Whether the word at a link is cut is judged as within a column.
    none = F.lit(None).cast("string")
    seam = links.select(F.col("parent").alias("line_id"), F.col("tail").alias("text"), F.col("head").alias("next_1"), none.alias("next_2"), none.alias("before"))
    seam = _cut_marks(seam, accepted, known).select(F.col("line_id").alias("key"), F.col("cut").alias("cut_below"))
    chains = _chains(links)
    chains = chains.unionByName(chains.select(F.col("root").alias("key"), "root").distinct())
    parts = whole.join(chains, "key").join(seam, "key", "left")
    again = F.array_sort(F.collect_list(F.struct("page_number", "column_index", "paragraph_in_column", "file_name", "text", F.coalesce("cut_below", F.lit(False)).alias("cut"), F.lit(None).cast("array<struct<word: string, right: string, at_seam: boolean>>").alias("fixes"))))
    joined = parts.groupBy("root").agg(again.alias("ls")).select(*(F.col("ls")[0][c].alias(c) for c in place), F.pandas_udf(lambda s: s.map(reflow), "string")("ls").alias("text"))
    return whole.join(chains, "key", "left_anti").select(*place, "text").unionByName(joined)

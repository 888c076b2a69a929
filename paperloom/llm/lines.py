"""Lines repeated across the paragraphs of one source.

Method: each line is parsed into a template, the sequence of its tokens reduced to their letters; tokens without letters, as figures,
dates and marks, are wildcard slots and may be anything. Neighbouring tokens are taken together into `DEPTH` slots of about equal
length, so that each template is a path of fixed depth in a token tree below its source. Every partition builds the tree of its own
lines in memory and hands on its leaves; trees are merged by adding the counts of equal leaves. A template that covers enough
paragraphs is excessive, which is verified on its exact letters.

The excessive templates make a second tree, in which each node has a wildcard child: a template is entered once for each of its slots,
with the others wild. Two misread letters spoil at most two of three slots, so a line reaches every template that it is near to by the
slot that it shares with it, and edit distance verifies what is found there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from paperloom.session import cut_lineage

#: Slots of a template. With MAX_EDITS edits, DEPTH = MAX_EDITS + 1 slots leave at least one whole.
DEPTH = 3
MAX_EDITS = DEPTH - 1
#: Leaves that a partition's tree holds before they are handed on.
FLUSH = 500_000
#: Excessive templates that are broadcast at most, some 30 MB; beyond that they go to the paragraphs of their source by key.
MAX_BROADCAST = 200_000
#: Paragraphs of one source that are looked up together where templates aren't broadcast.
BLOCK = 20_000

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_BLANKS = b" \t\n\r\f\v"
_GONE = bytes(set(range(128)) - set(_LETTERS + _BLANKS))
_SIGNS = re.compile(r"[^\w\s]|[\d_]")


def template(line: str) -> list[str]:
    """The tokens of a line as letters of any alphabet in lower case; wildcard slots leave none."""
    low = line.lower()
    if low.isascii():
        return low.encode().translate(None, _GONE).decode().split()
    tokens = _SIGNS.sub("", low).split()
    return tokens if all(map(str.isalpha, tokens)) else [t for t in ("".join(filter(str.isalpha, t)) for t in tokens) if t]


def templates_of(text: str | None) -> list[list[str]]:
    """template() of each line of a text; a null text is one empty line."""
    if not text:
        return [[]]
    if text.isascii():
        return [line.split() for line in text.lower().encode().translate(None, _GONE).decode().split("\n")]
    return [template(line) for line in text.split("\n")]


def path_of(tokens: list[str]) -> tuple[str, ...]:
    """The tokens in DEPTH slots: each slot ends with the token whose end is nearest to its share of the letters, or within a token too long for that."""
    letters, ends = "".join(tokens), list(accumulate(map(len, tokens)))
    cuts = [0]
    for i in range(1, DEPTH):
        share = len(letters) * i / DEPTH
        at = bisect_left(ends, share)
        end = ends[at - 1] if at and share - ends[at - 1] <= ends[at] - share else ends[at]
        cuts.append(end if abs(end - share) * 2 * DEPTH < len(letters) else round(share))
    return tuple(letters[a:b] for a, b in zip(cuts, [*cuts[1:], len(letters)], strict=True))


class TokenTree:
    """Counts of templates: source -> slot -> ... -> slot of depth DEPTH -> number of paragraphs."""

    def __init__(self) -> None:
        self.sources: dict[str, dict] = {}
        self.n_leaves = 0

    def add(self, source: str, path: tuple[str, ...], n: int = 1) -> None:
        node = self.sources.setdefault(source, {})
        for slot in path[:-1]:
            node = node.setdefault(slot, {})
        if path[-1] not in node:
            self.n_leaves += 1
        node[path[-1]] = node.get(path[-1], 0) + n

    def merge(self, other: TokenTree) -> None:
        for source, path, n in other.leaves():
            self.add(source, path, n)

    def leaves(self) -> Iterator[tuple[str, tuple[str, ...], int]]:
        def below(node: dict, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], int]]:
            for slot, child in node.items():
                if len(path) + 1 == DEPTH:
                    yield (*path, slot), child
                else:
                    yield from below(child, (*path, slot))

        for source, node in self.sources.items():
            for path, n in below(node, ()):
                yield source, path, n


def near(a: str, b: str, edits: int = MAX_EDITS) -> bool:
    """Whether the two are at most `edits` letters put in, left out or changed apart."""
    if abs(len(a) - len(b)) > edits:
        return False
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b:
        return len(a) + len(b) <= edits
    return edits > 0 and (near(a[1:], b[1:], edits - 1) or near(a[1:], b, edits - 1) or near(a, b[1:], edits - 1))


class WildcardTree:
    """The excessive templates of one source: number of letters -> the slot that stands, where it starts and ends, the others wild -> its letters -> templates."""

    def __init__(self, paths: Iterable[tuple[str, ...]]) -> None:
        self.whole: set[str] = set()
        self.by_length: dict[int, dict[tuple[int, int, int], dict[str, list[str]]]] = {}
        for path in paths:
            letters, at = "".join(path), 0
            self.whole.add(letters)
            node = self.by_length.setdefault(len(letters), {})
            for i, slot in enumerate(path):
                node.setdefault((i, at, at + len(slot)), {}).setdefault(slot, []).append(letters)
                at += len(slot)
        #: The numbers of letters of templates that a line of so many letters can be near to.
        self.totals: dict[int, list[int]] = {}
        for total in self.by_length:
            for n in range(total - MAX_EDITS, total + MAX_EDITS + 1):
                self.totals.setdefault(n, []).append(total)

    def covers(self, letters: str) -> bool:
        """Whether the letters are those of a template, or at most MAX_EDITS letters away from one."""
        if letters in self.whole:
            return True
        for total in self.totals.get(len(letters), ()):
            for (i, start, end), slots in self.by_length[total].items():
                # The first slot stands where it stood, the last as far from the end; in between edits on either side may have moved it.
                moves = (0,) if i == 0 else (len(letters) - total,) if i == DEPTH - 1 else range(1 - MAX_EDITS, MAX_EDITS)
                for by in moves:
                    if any(near(letters, t) for t in slots.get(letters[max(0, start + by) : end + by], ())):
                        return True
        return False


def once(panel: DataFrame) -> DataFrame:
    """Each paragraph_id once, as (paragraph_id, source, paragraph_text); rows without id are left out, of differing repeats the largest counts.

    `source` is file_name behind a +, or - for null, so that paragraphs without file_name form one source.
    """
    row = F.max(F.struct("file_name", "paragraph_text")).alias("row")
    rows = panel.where("paragraph_id is not null").groupBy("paragraph_id").agg(row)
    return rows.select("paragraph_id", F.coalesce(F.concat(F.lit("+"), "row.file_name"), F.lit("-")).alias("source"), "row.paragraph_text")


def token_trees(paragraphs: DataFrame, min_letters: int = 20) -> DataFrame:
    """(source, path, letters, n_paragraphs): the merged leaves of the trees of all partitions, for templates of at least `min_letters` letters.

    A form that stands twice in one paragraph counts once. Lines of the same letters with blanks in other places are one template.
    """

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = TokenTree()

        def out() -> pd.DataFrame:
            rows = [(source, " ".join(path), n) for source, path, n in tree.leaves()]
            tree.__init__()
            return pd.DataFrame(rows, columns=["source", "path", "n"])

        for batch in batches:
            for source, text in zip(batch["source"], batch["paragraph_text"], strict=True):
                seen = {}
                for tokens in templates_of(text):
                    letters = "".join(tokens)
                    if len(letters) >= min_letters:
                        seen.setdefault(letters, tokens)
                for tokens in seen.values():
                    tree.add(source, path_of(tokens))
            if tree.n_leaves > FLUSH:
                yield out()
        yield out()

    leaves = paragraphs.select("source", "paragraph_text").mapInPandas(grow, "source string, path string, n long")
    return leaves.groupBy("source", F.translate("path", " ", "").alias("letters")).agg(F.sum("n").alias("n_paragraphs"), F.min("path").alias("path"))


def excessive_templates(paragraphs: DataFrame, min_letters: int = 20, min_paragraphs: int = 5, min_share: float = 0.01) -> DataFrame:
    """(source, path, n_paragraphs, n_all): templates whose exact letters stand in enough distinct paragraphs of their source. `paragraphs` comes from once(); path has its slots between blanks."""
    leaves = token_trees(paragraphs, min_letters).where(F.col("n_paragraphs") >= min_paragraphs)
    sizes = paragraphs.groupBy("source").agg(F.count("*").alias("n_all"))
    return leaves.join(sizes, "source").where(F.col("n_paragraphs") >= min_share * F.col("n_all")).select("source", "path", "n_paragraphs", "n_all")


def _looked_up(panel: DataFrame, emit, schema: str, max_broadcast: int, **thresholds: float) -> DataFrame:  # noqa: ANN001
    """What emit(tree or None, batch) makes of the paragraphs of one source; the tree is that of the source's excessive templates, None where it has none."""
    paragraphs = cut_lineage(once(panel))
    found = cut_lineage(excessive_templates(paragraphs, **thresholds))
    if found.count() <= max_broadcast:
        paths: dict[str, list[tuple[str, ...]]] = {}
        for r in found.collect():  # at most max_broadcast rows
            paths.setdefault(r["source"], []).append(tuple(r["path"].split(" ")))
        shared = panel.sparkSession.sparkContext.broadcast(paths)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees = {source: WildcardTree(own) for source, own in shared.value.items()}
            for batch in batches:
                for source, rows in batch.groupby("source", sort=False):
                    yield emit(trees.get(source), rows)

        return paragraphs.mapInPandas(look, schema)

    def together(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return emit(WildcardTree(tuple(p.split(" ")) for p in own["path"]), rows)

    # Sources with templates are cut into pieces of about BLOCK paragraphs, each of which gets the source's templates.
    held = found.groupBy("source").agg(F.ceil(F.max("n_all") / BLOCK).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("paragraph_id"), "pieces").cast("int").alias("piece")
    split = paragraphs.join(held, "source").select("paragraph_id", "source", "paragraph_text", piece)
    copies = found.join(held, "source").select("source", "path", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    hit = split.groupBy("source", "piece").cogroup(copies.groupBy("source", "piece")).applyInPandas(together, schema)
    rest = paragraphs.join(held, "source", "left_anti").mapInPandas(lambda batches: (emit(None, b) for b in batches), schema)
    return hit.unionByName(rest)


def repeated_lines(panel: DataFrame, max_broadcast: int = MAX_BROADCAST, **thresholds: float) -> DataFrame:
    """(paragraph_id, line_no) of the lines whose template is excessive in its file_name or within two letters of one; line_no from 1.

    Needs paragraph_id, file_name and paragraph_text; other columns are ignored. Null or empty text is one empty line, never a hit. An
    empty table gives no rows. The templates of a source number at most its mean lines per paragraph over `min_share`.
    """

    def emit(tree: WildcardTree | None, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if tree:
            for paragraph, text in zip(rows["paragraph_id"], rows["paragraph_text"], strict=True):
                found += [(paragraph, i) for i, tokens in enumerate(templates_of(text), 1) if tree.covers("".join(tokens))]
        return pd.DataFrame(found, columns=["paragraph_id", "line_no"])

    return _looked_up(panel, emit, f"paragraph_id {dict(panel.dtypes)['paragraph_id']}, line_no int", max_broadcast, **thresholds)


def without_repeated_lines(panel: DataFrame, max_broadcast: int = MAX_BROADCAST, **thresholds: float) -> DataFrame:
    """(paragraph_id, clean_text, n_removed): every paragraph without its excessive lines; a text of nothing else becomes empty, a null text stays null."""

    def emit(tree: WildcardTree | None, rows: pd.DataFrame) -> pd.DataFrame:
        texts, removed = [], []
        for text in rows["paragraph_text"]:
            gone = [tree is not None and tree.covers("".join(tokens)) for tokens in templates_of(text)]
            removed.append(sum(gone))
            texts.append("\n".join(line for line, x in zip(text.split("\n"), gone, strict=True) if not x) if any(gone) else text)
        return pd.DataFrame({"paragraph_id": rows["paragraph_id"], "clean_text": texts, "n_removed": removed})

    return _looked_up(panel, emit, f"paragraph_id {dict(panel.dtypes)['paragraph_id']}, clean_text string, n_removed int", max_broadcast, **thresholds)

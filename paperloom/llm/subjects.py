"""Subject areas of paragraphs.

Method: a chain of classifiers over term, source and structure features. Link j of the chain is a logistic classifier of subject j
that also sees the subjects before it, so it models which subjects stand together. Each link is calibrated on labelled paragraphs
that it wasn't fitted on. A paragraph's set of subjects is decoded by beam search for the most probable combination. The chain is
fitted on a bounded sample of the labelled paragraphs, from which the term statistics come too; the decoding covers all paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Labelled paragraphs that the chain is fitted on at most, those they are chosen from, and the share that Spanish ones may take.
MAX_LABELLED = 5000
POOL = 40_000
SECOND_SHARE = 0.3
#: Standard deviations by which a feature must stand more often with some subject than by chance.
MIN_TELL = 4.0
#: A mark whose probability is below this is taken for a slip of the hand and left out of the last fit.
DOUBT = 0.04
#: Power of the inverse frequency that features are weighted by.
RARE = 1.0
BEAM = 8

# Function words that tell the two languages apart.
SPANISH = "el los las del la por y en de".split()
ENGLISH = "the of and to for in by with".split()
# Letters and figures that scanning takes for one another, by the letter that stands for them all.
GLYPHS = str.maketrans({"0": "o", "1": "l", "|": "", "5": "s", "9": "g", "@": "a", "i": "l", "(": "c", "h": "b", "f": "t", "e": "c", "v": "y", "~": "", "^": "", "8": "b", "6": "b"})
_CUT = re.compile("[-\u2010\u2011\u00ac\u00ad][^\\S\n]*\n\\s*")
_INSIDE = re.compile("(?<=\\w)[.,'’~^|](?=\\w)|\u00ad")
_TOKEN = re.compile(r"[^\W_]+(?:[@(][^\W_]+)*|[.!?](?=\s|$)")


def skeleton(word: str) -> str:
    """The word with confusable glyphs made one: rn as m, cl as d, ri as n, and single letters by GLYPHS; the end of a sentence is empty."""
    return "" if word in ".!?" else word.translate(GLYPHS).replace("rn", "m").replace("cl", "d").replace("rl", "n")


def tokens(text: str) -> list[str]:
    """Words in lower case and ends of sentences; words cut at a line's end are put together."""
    return _TOKEN.findall(_INSIDE.sub("", _CUT.sub("", text)).lower())


def terms(text: str) -> list[str]:
    """Skeletons of the words in order, without figures; ends of sentences are empty."""
    return [skeleton(w) for w in tokens(text) if not w.isdigit()]


def source_of(source: str | None) -> str:
    return "source:" + re.sub(r"[\d_.]+.*$", "", source or "")


def shape(text: str, n_sentences: int) -> tuple[str, str]:
    return f"sentences:{min(n_sentences, 6)}", f"lines:{min(text.count(chr(10)) // 3, 5)}"


def features(text: str | None, source: str | None) -> set[str]:
    """Terms of one, two and three words that don't cross a sentence, the source's name without its date, and the paragraph's shape."""
    ws = terms(text or "")
    found = set(ws)
    found.discard("")
    found.update(f"{a} {b}" for a, b in zip(ws, ws[1:]) if a and b)
    found.update(f"{a} {b} {c}" for a, b, c in zip(ws, ws[1:], ws[2:]) if a and b and c)
    found.add(source_of(source))
    found.update(shape(text or "", ws.count("")))
    return found


@dataclass
class Chain:
    """Weights of the links, in the order of `subjects`. `links[j, i]` is what subject i, known before j, adds to j."""

    subjects: list[str]
    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray
    scale: np.ndarray
    shift: np.ndarray

    def prepare(self) -> None:
        """Numbers the words of the features, and files features of two and three words under one number each."""
        parts = [(f.split(" "), i) for f, i in self.index.items() if ":" not in f]
        self.word_ids = {w: n for n, w in enumerate(sorted({w for ws, _ in parts for w in ws}), 1)}
        self.end, self.base = len(self.word_ids) + 1, len(self.word_ids) + 2
        self.one = np.full(self.base, -1)
        grams: tuple[dict, dict] = {}, {}
        for ws, i in parts:
            ids = [self.word_ids[w] for w in ws]
            if len(ids) == 1:
                self.one[ids[0]] = i
            else:
                grams[len(ids) - 2][sum(x * self.base**k for k, x in enumerate(ids))] = i
        self.grams = [(np.array(sorted(g), dtype=np.int64), np.array([g[k] for k in sorted(g)], dtype=np.int64)) for g in grams]
        self.memo: dict[str, int] = {}

    def number(self, word: str) -> int:
        """The word's number, 0 if no feature has it, -1 for figures."""
        if len(self.memo) > 500_000:
            self.memo.clear()
        n = self.memo[word] = self.end if word in ".!?" else -1 if word.isdigit() else self.word_ids.get(skeleton(word), 0)
        return n

    def matrix(self, texts: list[str | None], sources: list[str | None]) -> np.ndarray:
        """Scores without links: one row a paragraph, one column a subject."""
        if not hasattr(self, "memo"):
            self.prepare()
        flat, starts, rows, cols = [], [], [], []
        for r, (text, source) in enumerate(zip(texts, sources, strict=True)):
            starts.append(len(flat))
            numbers = [self.memo[w] if w in self.memo else self.number(w) for w in tokens(text or "")]
            numbers = [n for n in numbers if n >= 0]
            flat += numbers
            flat.append(0)
            for f in (source_of(source), *shape(text or "", numbers.count(self.end))):
                if f in self.index:
                    rows.append(r)
                    cols.append(self.index[f])
        ids = np.array(flat, dtype=np.int64)
        row_of = np.repeat(np.arange(len(texts)), np.diff([*starts, len(flat)]))
        found = [(row_of, self.one[ids])]
        for n, (keys, columns) in enumerate(self.grams, 2):
            if len(keys) and len(ids) >= n:
                key = sum(ids[k : len(ids) - n + 1 + k] * self.base**k for k in range(n))
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found.append((row_of[: len(key)], np.where(keys[at] == key, columns[at], -1)))
        r = np.concatenate([np.array(rows, dtype=np.int64), *(x for x, _ in found)])
        c = np.concatenate([np.array(cols, dtype=np.int64), *(x for _, x in found)])
        pairs = np.unique(r[c >= 0] * len(self.index) + c[c >= 0])
        out = np.tile(self.bias, (len(texts), 1))
        if len(pairs):
            r, c = np.divmod(pairs, len(self.index))
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[r[first]] += np.add.reduceat(self.weights[c], first, axis=0)
        return out

    def decode(self, scores: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The most probable combination of subjects of each row, and its probability, by beam search along the chain."""
        n, k = scores.shape
        sets, logs = np.zeros((n, 1, k)), np.zeros((n, 1))
        for j in range(k):
            z = self.scale[j] * (scores[:, None, j] + sets @ self.links[j]) + self.shift[j]
            yes = -np.logaddexp(0, -z)
            logs = np.concatenate([logs + yes, logs - np.logaddexp(0, z)], axis=1)
            with_j = sets.copy()
            with_j[:, :, j] = 1
            sets = np.concatenate([with_j, sets], axis=1)
            if logs.shape[1] > width:
                best = np.argsort(-logs, axis=1, kind="stable")[:, :width]
                logs, sets = np.take_along_axis(logs, best, axis=1), np.take_along_axis(sets, best[:, :, None], axis=1)
        best = logs.argmax(axis=1)
        rows = np.arange(n)
        return sets[rows, best], np.exp(logs[rows, best])


def _fit(x: np.ndarray, times: np.ndarray, y: np.ndarray, trust: np.ndarray, rounds: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights for all links at once, by Adam on the whole sample; link j sees the true subjects before it. trust: 0 for marks that don't count.

    Features that stand in the same paragraphs are one column of `x`, `times` of them: they have the same weight, as they'd get if each
    had a column of its own.
    """
    n, k = y.shape
    before = np.tril(np.ones((k, k)), -1)
    w, b, c = np.zeros((x.shape[1], k), np.float32), np.full(k, -2.0), np.zeros((k, k))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b, c)]
    for t in range(1, rounds + 1):
        z = x @ (w * times) + b + y @ (c * before).T
        off = trust * (1 / (1 + np.exp(-z)) - y) / n
        for (m, v), p, g in zip(state, (w, b, c), (x.T @ off.astype(np.float32) + ridge * w, off.sum(axis=0), (off.T @ y) * before + ridge * c), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)).astype(p.dtype)
    return w, b, c * before


def fit(rows: list[tuple[set[str], set[str]]], subjects: list[str], rounds: int = 80, ridge: float = 4e-3, min_tell: float = MIN_TELL) -> Chain:
    """The chain from (features, subjects) of labelled paragraphs. Frequent subjects come first in the chain.

    All features that tell a subject by `min_tell` are taken, so their number follows the labelled paragraphs.
    """
    k = len(subjects)
    if not rows:
        return Chain(subjects, {}, np.zeros((0, k)), np.full(k, -9.0), np.zeros((k, k)), np.ones(k), np.zeros(k))
    y = np.array([[s in labels for s in subjects] for _, labels in rows], float).reshape(len(rows), len(subjects))
    order = np.argsort(-y.sum(axis=0), kind="stable")
    subjects, y = [subjects[i] for i in order], y[:, order]
    df: Counter = Counter()
    for found, _ in rows:
        df.update(found)
    kept = sorted(f for f, n in df.items() if n >= 2)
    at, of = {f: i for i, f in enumerate(kept)}, np.zeros((len(kept), y.shape[1]))
    for (found, _), labels in zip(rows, y, strict=True):
        of[[at[f] for f in found if f in at]] += labels
    n, share = np.array([df[f] for f in kept])[:, None], y.mean(axis=0)
    tells = ((of - n * share) / np.sqrt(n * share * (1 - share) + 0.5)).max(axis=1, initial=0)
    kept = [f for f, tell in zip(kept, tells, strict=True) if tell >= min_tell]
    index = {f: i for i, f in enumerate(sorted(kept))}
    held: dict[str, list[int]] = {f: [] for f in index}
    for r, (found, _) in enumerate(rows):
        for f in found:
            if f in index:
                held[f].append(r)
    columns: dict[tuple[int, ...], int] = {}
    column = np.array([columns.setdefault(tuple(held[f]), len(columns)) for f in index], dtype=np.int64)
    x, times = np.zeros((len(rows), len(columns)), np.float32), np.bincount(column, minlength=len(columns)).astype(np.float32)[:, None]
    for paragraphs, i in columns.items():
        x[list(paragraphs), i] = 1
    # Rare features count for more, or the ridge would keep what is seldom said, as in a second language, below notice.
    rare = np.log(len(rows) / np.maximum(x.sum(axis=0), 1)).astype(np.float32) ** RARE
    x *= rare
    scale, shift, trust = np.ones(k), np.zeros(k), np.ones_like(y)
    if len(rows) >= 200:
        # Twice over halves: scores of paragraphs that a fit hasn't seen tell wrong marks, and then calibrate without them.
        half = np.arange(len(rows)) % 2
        for last in (False, True):
            z = np.zeros_like(y)
            for h in (0, 1):
                w, b, c = _fit(x[half != h], times, y[half != h], trust[half != h], rounds, ridge)
                z[half == h] = x[half == h] @ (w * times) + b + y[half == h] @ c.T
            scale, shift = _calibrate(z, y, trust)
            if not last:
                p = 1 / (1 + np.exp(-(scale * z + shift)))
                trust = 1.0 - (((y == 1) & (p < DOUBT)) | ((y == 0) & (p > 1 - DOUBT)))
    w, b, c = _fit(x, times, y, trust, rounds, ridge)
    return Chain(subjects, index, (w * rare[:, None]).astype(float)[column], b, c, scale, shift)


def _calibrate(z: np.ndarray, y: np.ndarray, trust: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Scale and shift of each link's score on held-out paragraphs, by Newton steps for the likelihood, drawn a little towards 1 and 0."""
    scale, shift = np.ones(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        off, v = trust * (p - y), trust * np.maximum(p * (1 - p), 1e-6)
        g0, g1 = (off * z).sum(axis=0) + (scale - 1), off.sum(axis=0) + 0.1 * shift
        a, b, c = (v * z * z).sum(axis=0) + 1, (v * z).sum(axis=0), v.sum(axis=0) + 0.1
        det = a * c - b * b
        scale, shift = scale - np.clip((c * g0 - b * g1) / det, -1, 1), shift - np.clip((a * g1 - b * g0) / det, -1, 1)
    return np.maximum(scale, 0.2), shift


def is_spanish(text: Column) -> Column:
    """Whether Spanish function words outnumber English ones."""
    count = lambda words: F.regexp_count(F.lower(text), F.lit(rf"\b(?:{'|'.join(words)})\b"))
    return F.coalesce(count(SPANISH) > count(ENGLISH), F.lit(False))


def labelled(panel: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, pool: int = POOL, second: float = SECOND_SHARE) -> list[tuple[set[str], set[str]]]:
    """Features and subjects of at most `most` labelled paragraphs. Labels without a paragraph are ignored.

    Of the `pool` labelled paragraphs with the smallest hash, the first by hash are taken, Spanish ones up to a share of `second`, as
    they are too few otherwise to teach their words.
    """
    marks = labels.where("paragraph_id is not null and theme is not null").groupBy("paragraph_id").agg(F.collect_set("theme").alias("themes"))
    marks = marks.join(panel.select("paragraph_id"), "paragraph_id", "left_semi")
    chosen = marks.withColumn("h", F.xxhash64("paragraph_id")).orderBy("h", "paragraph_id").limit(pool)  # at most `pool` rows
    texts = panel.select("paragraph_id", "file_name", "paragraph_text").join(F.broadcast(chosen), "paragraph_id").dropDuplicates(["paragraph_id"])
    texts = texts.withColumn("spanish", is_spanish(F.col("paragraph_text")))
    rank = F.row_number().over(W.partitionBy("spanish").orderBy("h", "paragraph_id"))
    few = int(most * second)
    rows = texts.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("spanish"), few).otherwise(most)).drop("h").collect()
    n_spanish = sum(r["spanish"] for r in rows)
    rows = sorted((r for r in rows if r["spanish"] or r["rank"] <= most - n_spanish), key=lambda r: r["paragraph_id"])
    return [(features(r["paragraph_text"], r["file_name"]), set(r["themes"])) for r in rows]


def subjects_of(panel: DataFrame, chain: Chain, key: str = "paragraph_id") -> DataFrame:
    """(key, subjects, confidence): each key once with its decoded combination, an array that may be empty.

    Repeated rows of a key are taken to have the same text. Null and empty texts have no subject. Rows with a null key are left out.
    """
    # The chain is of bounded size: its features are some of those of MAX_LABELLED paragraphs.
    shared = panel.sparkSession.sparkContext.broadcast({f.name: getattr(chain, f.name) for f in fields(chain)})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Chain(**shared.value)
        names = np.array(model.subjects, dtype=object)
        for batch in batches:
            sets, p = model.decode(model.matrix(batch["paragraph_text"].tolist(), batch["file_name"].tolist()))
            sets[[not t for t in batch["paragraph_text"]]] = 0
            yield pd.DataFrame({key: batch[key], "subjects": [sorted(names[row > 0]) for row in sets], "confidence": p})

    kind = dict(panel.dtypes)[key]
    scored = panel.where(F.col(key).isNotNull()).select(key, "paragraph_text", "file_name").mapInPandas(score, f"{key} {kind}, subjects array<string>, confidence double")
    best = F.max_by(F.struct("subjects", "confidence"), F.struct("confidence", F.array_join("subjects", "|"))).alias("best")
    return scored.groupBy(key).agg(best).select(key, "best.*")


def train(panel: DataFrame, labels: DataFrame, themes: DataFrame, most: int = MAX_LABELLED) -> Chain:
    """The chain for the theme values of `themes`, a list of subject areas that doesn't grow with the corpus."""
    names = sorted(r[0] for r in themes.select("theme").where("theme is not null").distinct().collect())
    return fit(labelled(panel, labels, most), names)


def subject_shares(found: DataFrame) -> DataFrame:
    """(theme, n_paragraphs, share): paragraphs by subject, from subjects_of(); a paragraph counts for each of its subjects, and under `none` if it has none."""
    names = F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("none")))
    counts = found.select(F.posexplode(names).alias("i", "theme")).groupBy("theme").agg(F.count("*").alias("n_paragraphs"), F.count_if(F.col("i") == 0).alias("n_first"))
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row for each subject
    return counts.select("theme", "n_paragraphs", (F.col("n_paragraphs") / F.sum("n_first").over(everything)).alias("share"))

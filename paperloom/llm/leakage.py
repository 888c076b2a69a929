"""Passages of evaluation items inside a training corpus.

Method: the word n-grams of the normalised passages make a hash set that is broadcast; each batch of documents is turned into words,
windows of n words are looked up by a rolling hash, and hits are verified word by word. The set's size is checked: beyond
`max_broadcast_words` a Bloom filter of the passages' windows, of fixed size, is broadcast in its place; windows of documents that pass
it, few but true ones, are joined with the passages' on the words themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

N_WORDS = 12
#: Words of all passages that may be broadcast; at about 100 bytes of Python objects a word, 200 MB at the most.
MAX_BROADCAST_WORDS = 2_000_000
#: Bytes of the Bloom filter and the bits that a window sets; at 20 windows a byte, one in 60 other windows passes and is dropped by the join.
FILTER_BYTES, FILTER_BITS = 1 << 25, 2
CHUNK = 1 << 15

# Characters that count as nothing inside a word, and hyphens that vanish with a line break.
SILENT = "­​‌‍⁠﻿'’‘ʼ´`"
_BREAK = re.compile(r"[-‐‑¬­][^\S\n]*\n\s*")
_SILENT = re.compile(f"[{SILENT}]")
_MARKS = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]")
_WORD = re.compile(r"[^\W_]+")


def _plain(text: str) -> str:
    """The text as words are read from it: no longer in the caller's positions."""
    text = _SILENT.sub("", _BREAK.sub("", text.replace("\r\n", "\n"))).lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text))


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, without accents, apostrophes, soft hyphens and zero-width spaces."""
    return _WORD.findall(_plain(text)) if text else []


class Grams:
    """The n-grams of the passages: word numbers from 1, a rolling hash for each gram, and the items that hold it."""

    def __init__(self, passages: list[tuple[int, str | None]], n: int) -> None:
        self.n, self.vocabulary, self.items = n, {}, {}
        for item, passage in passages:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(passage))
            for i in range(len(ids) - n + 1):
                self.items.setdefault(ids[i : i + n], set()).add(item)
        self.factors = np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        grams = np.array(list(self.items), dtype=np.uint64).reshape(-1, n)
        self.hashes = np.unique((grams * self.factors).sum(axis=1, dtype=np.uint64))

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text's index, place of the window's first word, item) for every verified window."""
        flat: list[int] = []
        starts = []
        get = self.vocabulary.get
        for text in texts:
            starts.append(len(flat))
            flat.extend([get(w, 0) for w in words(text)])
            flat.append(0)  # no window reaches into the next text
        ids = np.array(flat, dtype=np.uint64)
        n = self.n
        if len(ids) < n or not len(self.hashes):
            return
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(known[n:] - known[:-n] == n)  # windows of known words only
        if not len(at):
            return
        sums = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            sums += ids[at + k] * self.factors[k]
        found = np.searchsorted(self.hashes, sums)
        at = at[self.hashes[np.minimum(found, len(self.hashes) - 1)] == sums]
        of = np.searchsorted(np.array(starts), at, side="right") - 1
        for i, text in zip(at.tolist(), of.tolist(), strict=True):
            for item in self.items.get(tuple(flat[i : i + n]), ()):
                yield text, i - starts[text], item


def leaked(documents: DataFrame, items: DataFrame, n: int = N_WORDS, max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word): documents whose text shares `n` or more consecutive words with an item's passage.

    Every document is read whole, copies included. Null or empty texts and passages of fewer than `n` words share nothing, the latter
    are named by too_short(); repeated item rows count once; rows of one doc_id are taken together. Only doc_id, text, item_id and passage are read.
    """
    if _n_words(items) > max_broadcast_words:
        hits = _windows(documents.where("doc_id is not null"), "doc_id", "text", n, _bloom(items, n)).join(_windows(items.where("item_id is not null"), "item_id", "passage", n).select("item_id", "gram").distinct(), "gram")
        return hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.min("word").alias("first_word"))
    passages = [(r["item_id"], r["passage"]) for r in items.select("item_id", "passage").distinct().where("item_id is not null").collect()]
    shared = documents.sparkSession.sparkContext.broadcast(passages)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Grams(shared.value, n)
        for batch in batches:
            ids = batch["doc_id"].tolist()
            rows = [(ids[t], item, place) for t, place, item in table.hits(batch["text"].tolist())]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "word"])

    kinds = dict(documents.dtypes) | dict(items.dtypes)
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, word long"
    hits = documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(scan, schema)
    return hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.min("word").alias("first_word"))


def _n_words(items: DataFrame) -> int:
    """Words of all passages; each run of letters and digits is counted, as accents and the like only join runs."""
    return items.select(F.sum(F.regexp_count(F.coalesce("passage", F.lit("")), F.lit(r"[\p{L}\p{N}]+"))).alias("n")).first()["n"] or 0


def too_short(items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(item_id, n_words): items whose passage has fewer than `n` words and so can't be searched for; null passages have 0. Of repeated items the longest passage counts."""
    count = F.pandas_udf(lambda texts: texts.map(lambda t: len(words(t))), "long")
    return items.where("item_id is not null").select("item_id", count(F.coalesce("passage", F.lit(""))).alias("n_words")).groupBy("item_id").agg(F.max("n_words").alias("n_words")).where(F.col("n_words") < n)


def _hashes(ws: list[str], n: int) -> np.ndarray:
    """A hash of each window of n words; the same on every machine."""
    one = pd.util.hash_array(np.array(ws, dtype=object), categorize=False)
    out = np.zeros(len(ws) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + one[k : len(ws) - n + 1 + k]
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The places in the filter of each hash, one column each."""
    size = np.uint64(FILTER_BYTES * 8)
    return np.stack([(hashes >> np.uint64(8 * i)) % size for i in range(FILTER_BITS)], axis=1).astype(np.int64)


def _bloom(items: DataFrame, n: int) -> np.ndarray:
    """The filter of the passages' windows: each partition sets bits of its own, chunks of which are put together; FILTER_BYTES reach the driver."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(FILTER_BYTES * 8, dtype=bool)
        for batch in batches:
            for text in batch["passage"]:
                ws = words(text)
                if len(ws) >= n:
                    bits[_bits(_hashes(ws, n))] = True
        chunks = np.packbits(bits).reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        yield pd.DataFrame([(int(i), chunks[i].tobytes()) for i in used], columns=["chunk", "bits"])

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"chunk": rows["chunk"][:1], "bits": [bits.tobytes()]})

    schema = "chunk long, bits binary"
    rows = items.where("passage is not null").select("passage").mapInPandas(fill, schema).groupBy("chunk").applyInPandas(both, schema).collect()
    chunks = np.zeros((FILTER_BYTES // CHUNK, CHUNK), np.uint8)
    for r in rows:
        chunks[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return chunks.reshape(-1)


def _windows(table: DataFrame, key: str, text: str, n: int, bloom: np.ndarray | None = None) -> DataFrame:
    """(key, word, gram): each window of n words; those that pass the filter, if there is one."""
    kind = dict(table.dtypes)[key]
    shared = None if bloom is None else table.sparkSession.sparkContext.broadcast(bloom)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, value in zip(batch[key].tolist(), batch[text].tolist(), strict=True):
                w = words(value)
                at = range(len(w) - n + 1)
                if shared is not None and at:
                    bits = _bits(_hashes(w, n))
                    at = np.flatnonzero((shared.value[bits >> 3] >> (7 - (bits & 7)) & 1).all(axis=1)).tolist()
                rows += [(k, i, " ".join(w[i : i + n])) for i in at]
            yield pd.DataFrame(rows, columns=[key, "word", "gram"])

    return table.select(key, text).where(F.col(text).isNotNull()).mapInPandas(cut, f"{key} {kind}, word long, gram string")


def _without(text: str, found: set[int], mark: str) -> tuple[str, int]:
    """The text without the words of these numbers, and the number of stretches that they make."""
    spans, at = word_spans(text), np.array(sorted(found))
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    for run in reversed(runs):
        text = text[: spans[run[0]][0]] + mark + text[spans[run[-1]][1] :]
    return text, len(runs)


def without_leaks(documents: DataFrame, items: DataFrame, n: int = N_WORDS, mark: str = "", max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """(doc_id, clean_text, n_cut): each document without the stretches of words it shares with a passage; `mark` stands in their place.

    A stretch reaches from its first to its last shared word in the original text. A document without leak keeps its text to the letter.
    Beyond `max_broadcast_words` the windows are found as leaked() does, for each different text once, and joined to the documents.
    """
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, clean_text string, n_cut int"
    known = items.where("item_id is not null")
    if _n_words(items) > max_broadcast_words:
        own = documents.select("doc_id", "text", F.sha2("text", 256).alias("digest"))
        grams = _windows(known, "item_id", "passage", n).select("gram").distinct()
        texts = own.where("digest is not null").groupBy("digest").agg(F.first("text").alias("text"))
        hits = _windows(texts, "digest", "text", n, _bloom(items, n)).join(grams, "gram").groupBy("digest").agg(F.collect_set("word").alias("at"))

        def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                done = [(t, 0) if at is None else _without(t, {i + k for i in at.tolist() for k in range(n)}, mark) for t, at in zip(batch["text"], batch["at"], strict=True)]
                yield pd.DataFrame({"doc_id": batch["doc_id"], "clean_text": [d[0] for d in done], "n_cut": [d[1] for d in done]})

        return own.join(hits, "digest", "left").select("doc_id", "text", "at").mapInPandas(cut_out, schema)
    passages = [(r["item_id"], r["passage"]) for r in known.select("item_id", "passage").distinct().collect()]
    shared = documents.sparkSession.sparkContext.broadcast(passages)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Grams(shared.value, n)
        for batch in batches:
            texts, places = batch["text"].tolist(), {}
            for t, i, _ in table.hits(texts):
                places.setdefault(t, set()).update(range(i, i + n))
            done, cuts = list(texts), [0] * len(texts)
            for t, found in places.items():
                done[t], cuts[t] = _without(texts[t], found, mark)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "clean_text": done, "n_cut": cuts})

    return documents.select("doc_id", "text").mapInPandas(clean, schema)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end, in the text itself, of each of words(text)."""
    gone = [False] * len(text)
    for m in _BREAK.finditer(text):
        gone[m.start() : m.end()] = [True] * (m.end() - m.start())
    plain, at = [], []
    for i, ch in enumerate(text):
        if gone[i] or ch in SILENT:
            continue
        for x in _MARKS.sub("", unicodedata.normalize("NFD", ch.lower())):
            plain.append(x)
            at.append(i)
    return [(at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer("".join(plain))]

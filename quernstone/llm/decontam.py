"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH and exact verification.

Symbols are words (lower-cased runs of letters and digits). An item of m words is found in a document if some window of
m consecutive words, or the whole document if it is shorter, is within k word edits of it: k = floor(TOLERANCE * m), and
0 for items of fewer than EDITS_FROM words, where one edit makes another sentence.

1. Windows: an item within k edits shares at least m - 2 - 3k word trigrams with its window, so only windows with that
   many of the item's trigrams are embedded. This loses no match.
2. CGK embedding: a random walk reads the window; at step j it writes the word under its pointer and moves on by a
   random bit of (j, word). Edits then show as a bounded number of differing places (Hamming distance).
3. LSH: each of REPETITIONS repetitions has a walk of its own and compares SAMPLED places of it. Windows that collide
   come first; equal ones always do.
4. Every window is verified by the exact edit distance: those that collide in a band of k, then all others in a band
   of the least distance found so far, unless that is 0. So LSH saves work and loses no match, whatever an item's length.

The benchmark is read in parts of at most PART_WORDS words, each a pass over the documents, so what travels to the
executors is bounded whatever the benchmark's size.

Defined results: a null or empty text has no words and matches nothing; items of one or two words, which any text may
hold, match only documents whose words equal theirs; equal items match each on its own, repeated documents and those
without an id too; of windows at one distance the first counts; an empty table gives an empty result; other columns, also
of the benchmark, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, small

TOLERANCE = 0.2
EDITS_FROM = 8
#: Words of the shortest items that are looked for inside texts.
WINDOW_FROM = 3
SAMPLED = 3
REPETITIONS = 4
PART_WORDS = 8_000_000
#: Cells of windows that are verified at once.
CELLS = 1 << 21
SEED = 20_240_229
_TOKEN = re.compile(r"[^\W_]+")
_SCHEMA = "doc_id bigint, item_id bigint, n_item_words int, start_word int, edit_distance int"
_COLUMNS = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_words", pa.int32()), ("start_word", pa.int32()), ("edit_distance", pa.int32())]


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def tolerance(m: int) -> int:
    """Edits within which an item of m words is found."""
    return int(TOLERANCE * m) if m >= EDITS_FROM else 0


def edit_distance(a, b, k: int) -> int:
    """Word edits from a to b, or k + 1 if more than k."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    before = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        lo, hi = max(1, i - k), min(len(b), i + k)
        row = [k + 1] * (len(b) + 1)
        if lo == 1:
            row[0] = i
        for j in range(lo, hi + 1):
            cost = before[j - 1] + (a[i - 1] != b[j - 1])
            row[j] = min(cost, before[j] + 1, row[j - 1] + 1)
        if min(row[lo - 1 : hi + 1]) > k:
            return k + 1
        before = row
    return min(before[len(b)], k + 1)


def _bits(step: int, rep: int, symbols: np.ndarray) -> np.ndarray:
    """The random bit of (repetition, step, symbol)."""
    with np.errstate(over="ignore"):
        x = symbols.astype(np.uint64) + np.uint64((rep * 4096 + step + SEED) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def embed(windows: np.ndarray, repetitions: int) -> np.ndarray:
    """(c, m) symbols -> (c, repetitions) hashes of the sampled places of their CGK embeddings."""
    c, m = windows.shape
    padded = np.concatenate([windows, np.full((c, 1), -1)], axis=1)
    rows, out = np.arange(c), np.zeros((c, repetitions), np.uint64)
    for rep in range(repetitions):
        places = set(np.random.default_rng((SEED, rep, m)).choice(3 * m, min(SAMPLED, 3 * m), replace=False).tolist())
        at = np.zeros(c, np.int64)
        for step in range(max(places) + 1):
            under = padded[rows, at]
            if step in places:
                out[:, rep] = (out[:, rep] ^ (under + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out[:, rep] ^= out[:, rep] >> np.uint64(31)
            at = np.minimum(at + _bits(step, rep, under), m)
    return out


def distances(windows: np.ndarray, lengths: np.ndarray, items: np.ndarray, k: int) -> np.ndarray:
    """Word edits from each row of windows (of which the first lengths words count) to the same row of items, or k + 1
    if more than k. Place o of a row of the band is column i + o - k of row i of the table."""
    c, m = items.shape
    band = np.arange(2 * k + 1, dtype=np.int32)
    far = np.int32(2 * (m + k) + 2)
    out = np.full(c, k + 1, np.int64)
    own = np.flatnonzero(lengths >= m - k)
    padded = np.full((len(own), m + 2 * k), -1, np.int64)
    padded[:, k : k + m] = windows[own]
    items = items[own]
    before = np.tile(np.where(band >= k, band - k, far).astype(np.int32), (len(own), 1))
    for i in range(m):
        row = before + (padded[:, i : i + 2 * k + 1] != items[:, i : i + 1])
        row[:, :-1] = np.minimum(row[:, :-1], before[:, 1:] + 1)
        before = np.minimum.accumulate(row - band, axis=1) + band
        if i % 8 == 7:
            alive = before.min(axis=1) <= k
            if 2 * alive.sum() < len(alive):
                own, padded, items, before = own[alive], padded[alive], items[alive], before[alive]
                if not len(own):
                    return out
    out[own] = np.minimum(before[np.arange(len(own)), lengths[own] - m + k], k + 1)
    return out


class Index:
    """Items of one part of the benchmark, as arrays."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        words = [(i, words_of(t)) for i, t in rows]
        words = [(i, w) for i, w in words if w]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, w in words:
            if len(w) < WINDOW_FROM:
                self.short.setdefault(tuple(w), []).append(i)
        words = [(i, w) for i, w in words if len(w) >= WINDOW_FROM]
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in words]
        self.items = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64) for _, w in words]
        self.need = np.array([len(t) - 2 - 3 * tolerance(len(t)) for t in self.items], np.int64)
        codes = [np.unique(self.codes(t)) for t in self.items]
        flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.grams, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat))
        self.mask = (1 << max(16, int(4 * len(self.grams)).bit_length())) - 1
        self.maybe = np.zeros(self.mask + 1, bool)
        self.maybe[self.slot(self.grams)] = True
        self.hashes = [embed(t[None, :], REPETITIONS)[0] for t in self.items]

    @staticmethod
    def codes(ids: np.ndarray) -> np.ndarray:
        return (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]

    def slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, starts of windows with enough of the item's trigrams) of one document."""
        codes = self.codes(ids)
        places = np.flatnonzero(self.maybe[self.slot(codes)])
        if not len(places):
            return
        at = np.searchsorted(self.grams, codes[places])
        at[at == len(self.grams)] = 0
        real = self.grams[at] == codes[places]
        places, at = places[real], at[real]
        n = self.starts[at + 1] - self.starts[at]
        where = np.repeat(places, n)
        offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = self.owner[np.repeat(self.starts[at], n) + offsets]
        counts = np.bincount(owner, minlength=len(self.items)) if len(self.items) < 4 * len(owner) else None
        some = np.flatnonzero(counts >= self.need) if counts is not None else (lambda u, c: u[c >= self.need[u]])(*np.unique(owner, return_counts=True))
        for item in some:
            m = len(self.items[item])
            hit = np.zeros(len(ids) + 1, np.int64)
            hit[where[owner == item] + 1] = 1
            run = np.cumsum(hit)
            last = max(len(ids) - m, 0)
            starts = np.arange(last + 1)
            inside = run[np.minimum(starts + m - 2, len(ids))] - run[starts]
            starts = starts[inside >= self.need[item]]
            if len(starts):
                yield int(item), starts


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.vocabulary.get
        for batch in batches:
            rows, found = [], {}
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                words = words_of(text)
                if index.short and len(words) < WINDOW_FROM:
                    rows += [(doc_id, i, len(words), 0, 0) for i in index.short.get(tuple(words), ())]
                if len(words) < 3 or not index.items:
                    continue
                ids = np.array([get(w, 0) for w in words], np.int64)
                for item, starts in index.candidates(ids):
                    m = len(index.items[item])
                    place = starts[:, None] + np.arange(m)
                    windows = np.where(place < len(ids), ids[np.minimum(place, len(ids) - 1)], -1)
                    found.setdefault(m, []).append((doc_id, item, starts, windows, len(ids)))
            for m, own in found.items():
                k = tolerance(m)
                windows, starts = np.concatenate([w for *_, w, _ in own]), np.concatenate([s for _, _, s, _, _ in own])
                pair = np.repeat(np.arange(len(own)), [len(s) for _, _, s, _, _ in own])
                lengths = np.minimum(np.array([n for *_, n in own])[pair] - starts, m)
                items, hashes = np.array([index.items[i] for _, i, *_ in own]), np.array([index.hashes[i] for _, i, *_ in own])
                near = np.concatenate([embed(windows[i : i + 65_536], REPETITIONS) for i in range(0, len(windows), 65_536)])
                alike = (near == hashes[pair]).any(axis=1)
                distance, best = np.full(len(windows), k + 1), np.full(len(own), k)

                def verify(which, limit):
                    for at in np.array_split(which, -(-len(which) * (m + 2 * limit) // CELLS) or 1):
                        distance[at] = distances(windows[at], lengths[at], items[pair[at]], limit)  # noqa: B023

                verify(np.flatnonzero(alike), k)
                np.minimum.at(best, pair, distance)
                for limit in np.unique(best[best > 0]).tolist():
                    verify(np.flatnonzero(~alike & (best[pair] == limit)), limit)
                order = np.lexsort((starts, distance, pair))
                first = order[np.searchsorted(pair, np.arange(len(own)))]
                rows += [(d, index.ids[i], m, int(starts[j]), int(distance[j])) for (d, i, *_), j in zip(own, first, strict=True) if distance[j] <= k]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)], [n for n, _ in _COLUMNS])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> a row for each document and item that it holds: n_item_words,
    start_word (of the nearest window; from 0) and edit_distance."""
    n_words = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(n_words) // (6 * PART_WORDS)))
    out = None
    for part in range(parts):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).select(F.col("item_id").cast("bigint").alias("item_id"), "text").orderBy("item_id", "text").collect()
        index = Index([(r[0], r[1]) for r in rows])
        found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_search(index), _SCHEMA)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; rows without a doc_id cannot be told apart, and stay."""
    bad = Staged(contaminated(docs, benchmark).select("doc_id").distinct()).df
    return docs.join(small(bad, bad.count()), "doc_id", "left_anti").select(docs.columns)


def op5_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)

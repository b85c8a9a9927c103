"""Toxicity of texts after noisy-channel deobfuscation.

1. Language model: counts of character trigrams of the plain words of *all* documents, summed in the tasks and then over
   them, so the tables grow with the input's variety only up to SYMBOLS**3 numbers.
2. Channel: a word with leetspeak, runs of repeated letters, or letters set apart by spaces or signs is a lattice: each
   character stands for itself or for the letters it may hide, a run of a letter for one or two of it, and a gap between
   letters that are set apart for nothing or for a word's border. Viterbi decoding finds the reading of the highest
   language-model and channel probability, whatever the length. Plain words pass as they are.
3. Score: a logistic regression on which words the restored text has, fitted on a bounded sample of the labelled rows
   that may be learnt from (SAMPLE at most, drawn by hash). Its features are the FEATURES words whose presence differs
   most between the two labels.

Labels are learnt only from rows whose crc32 of the doc_id, as text, is not divisible by 5. A score sees the text alone.

Defined results: a null or empty text has no words and gets the score of the intercept; repeated rows get equal scores;
rows of `labels` without a document, or with a null label, are not used; of labels that disagree 1 counts; without any
usable label of both kinds every score is about 0; an empty table gives an empty result; other columns, also of `labels`,
are not looked at. Ids pass through Arrow as they are; a document without one is not held out.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, passing, small

#: Characters of the language model: 0 is the word's border, 1 to 26 a to z, 27 any other letter.
SYMBOLS = 28
#: What a character may stand for in a disguised word.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": ""}
#: Log probabilities of the channel: a letter as itself, a letter disguised, a run kept double, a run made single.
KEPT, DISGUISED, DOUBLE, SINGLE = -0.05, -1.5, -1.0, -0.5
#: The same of a gap between letters that are set apart: a border, none.
BORDER, NO_BORDER = -1.0, -0.5
#: Places of a lattice after which what all readings share is settled.
SETTLE = 64
SAMPLE, FEATURES = 50_000, 400
LEAST_DOCS = 3
PENALTY = 0.2
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[0-9@$!|+(€£*])[\w@$!|+(€£*]{3,}+(?=[.,;:?)\"']*(?!\S))")
_SIGN = re.compile(r"[0-9@$!|+(€£*]")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:([ .*_-])[^\W_])(?:\1[^\W_])+(?!\S)")
_RUN = re.compile(r"([^\W\d_])\1\1+")
_HAS_RUN = re.compile(r"\b[^\W\d_]*?([^\W\d_])\1\1+[^\W\d_]*")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of plain words; words are counted first, so each distinct word is encoded once."""
    table = np.zeros(SYMBOLS**3, np.int64)
    words: Counter = Counter()

    def add():
        for w, n in words.items():
            s = [0, 0, *map(symbol, w), 0]
            for a, b, c in zip(s, s[1:], s[2:], strict=False):
                table[(a * SYMBOLS + b) * SYMBOLS + c] += n
        words.clear()

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                words.update(_WORD.findall(text.lower()))
        if len(words) > 200_000:
            add()
    add()
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(table[at])], ["gram", "n"])


class Decoder:
    """Viterbi over the lattice of a disguised word, under a trigram model with add-one smoothing."""

    def __init__(self, grams: np.ndarray):
        t = grams.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        self.log = np.log((t + 0.1) / (t.sum(axis=2, keepdims=True) + 0.1 * SYMBOLS)).tolist()
        self.known: dict[tuple[str, bool], str] = {}

    def arcs(self, word: str, apart: bool = False) -> list[list[tuple[str, float]]]:
        """For each place the letters that may be read there, and their channel log probability; apart: a gap lies between all characters."""
        out, i = [], 0
        while i < len(word):
            j = i + 1
            while not apart and j < len(word) and word[j] == word[i]:
                j += 1
            own = [(word[i], KEPT)] if word[i].isalpha() else []
            own += [(x, DISGUISED) for x in LEET.get(word[i], "")]
            if word[i] == "*":
                own = [(chr(97 + k), DISGUISED - 2) for k in range(26)]
            if own:
                run = j - i
                if apart and out:
                    out.append([("", NO_BORDER), (" ", BORDER)])
                out.append([(x, p + (SINGLE if run > 1 else 0)) for x, p in own] + ([(x * 2, p * 2 + DOUBLE) for x, p in own] if run > 1 else []))
            i = j
        return out

    def decode(self, word: str, apart: bool = False) -> str:
        """The likeliest reading."""
        if (word, apart) in self.known:
            return self.known[word, apart]
        settled, best = [], {(0, 0): (0.0, "")}
        for place, choices in enumerate(self.arcs(word, apart), 1):
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, read) in best.items():
                for letters, p in choices:
                    x, y, s = a, b, score + p
                    for c in letters:
                        if c == " ":
                            s, x, y = s + self.log[x][y][0], 0, 0
                        else:
                            k = symbol(c)
                            s += self.log[x][y][k]
                            x, y = y, k
                    if (x, y) not in nxt or (s, read + letters) > nxt[x, y]:
                        nxt[x, y] = (s, read + letters)
            best = nxt
            if not place % SETTLE:
                shared = os.path.commonprefix([read for _, read in best.values()])
                settled.append(shared)
                best = {k: (s, read[len(shared) :]) for k, (s, read) in best.items()}
        read = "".join(settled) + max((s + self.log[a][b][0], read) for (a, b), (s, read) in best.items())[1]
        if len(word) <= SETTLE:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word, apart] = read
        return read

    def restore(self, text: str) -> str:
        """The text, lower-cased, with disguised words decoded."""
        low = text.lower()
        low = _SPACED.sub(lambda m: " " + self.decode("".join(c for c in m[0] if c.isalnum()), True) + " ", low)
        low = _ODD.sub(lambda m: self.decode(m[0]), low) if _SIGN.search(low) else low
        return _HAS_RUN.sub(lambda m: self.decode(m[0]), low) if _RUN.search(low) else low

    def words(self, text: str | None) -> set[str]:
        return set(_WORD.findall(self.restore(text))) if text else set()


def language_model(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all documents; at most SYMBOLS**3 rows come to the driver."""
    counts = docs.select("text").mapInArrow(_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3, np.int64)
    for r in counts:
        out[r["gram"]] = r["n"]
    return out


def fit(has: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by Newton's method. has: (rows, features) of 0 and 1 in bytes; rows are widened a block at a time."""
    width = has.shape[1] + 1
    penalty = np.full(width, PENALTY)
    penalty[-1] = 1e-6
    weights = np.zeros(width)
    for _ in range(25):
        gradient, hessian = penalty * weights, np.diag(penalty)
        for at in range(0, len(has), 4096):
            x = np.ones((len(has[at : at + 4096]), width))
            x[:, :-1] = has[at : at + 4096]
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            gradient += x.T @ (p - toxic[at : at + 4096])
            hessian += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights[:-1], float(weights[-1])


def _presence(features: list[str]):
    place = {w: i for i, w in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((len(batch), len(features)), np.uint8)
            for i, words in enumerate(batch.column("words").to_pylist()):
                bits[i, [place[w] for w in words if w in place]] = 1
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], ["toxic", "bits"])

    return run


def _restored(grams: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(grams)
        for batch in batches:
            words = [sorted(decoder.words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], ["toxic", "words"])

    return run


def train(docs: DataFrame, labels: DataFrame, grams: np.ndarray) -> tuple[list[str], np.ndarray, float]:
    """Fits on at most SAMPLE labelled rows that may be learnt from."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    sample = Staged(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(SAMPLE)).df
    chosen = docs.select("doc_id", "text").join(small(sample, SAMPLE), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    rows = Staged(chosen.mapInArrow(_restored(grams), "toxic int, words array<string>")).df
    counted = rows.agg(F.count("*")).first()[0]
    # of the words only those in enough rows can become features
    often = Staged(rows.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b")).where(f"a + b >= {LEAST_DOCS}")).df
    n1 = rows.where("toxic = 1").count()
    n0 = counted - n1
    if not n0 or not n1:
        return [], np.zeros(0), -20.0
    odds = f"abs(ln((a + 0.5) / ({n1} - a + 0.5)) - ln((b + 0.5) / ({n0} - b + 0.5)))"
    spread = f"sqrt(1 / (a + 0.5) + 1 / ({n1} - a + 0.5) + 1 / (b + 0.5) + 1 / ({n0} - b + 0.5))"
    features = [r["w"] for r in often.orderBy(F.expr(f"-({odds}) / {spread}"), "w").limit(FEATURES).select("w").collect()]
    # in one order at every run, so that sums of floats agree
    got = sorted(rows.mapInArrow(_presence(features), "toxic int, bits binary").collect(), key=lambda r: (r["bits"], r["toxic"]))
    has = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1), axis=1, count=len(features))
    return (features, *fit(has, np.array([r["toxic"] == 1 for r in got], float)))


def _score(grams: np.ndarray, words: list[str], weights: np.ndarray, intercept: float):
    weight = dict(zip(words, weights.tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(grams)
        for batch in batches:
            raw = np.array([intercept + sum(weight[w] for w in sorted(decoder.words(t) & weight.keys())) for t in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], ["doc_id", "score"])

    return run


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with passing():
        grams = language_model(docs)
        words, weights, intercept = train(docs, labels, grams)
    scored = docs.mapInArrow(_score(grams, words, weights, intercept), "doc_id bigint, score double")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

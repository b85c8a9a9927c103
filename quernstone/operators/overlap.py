"""Contamination by a reference set: n-gram coverage, whole-text equality and MinHash near-duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse_runs, gram_hashes, grams, tokens
from .cut import cut

GRAM = 8
SHINGLE = 5
OVERLAP, NEAR, SET_SHARE = 0.5, 0.8, 0.02
#: Bands and rows of 128 permutations: texts of similarity 0.8 meet in a band with a probability of 0.9999. (9, 13), which
#: compares fewer pairs, finds about half of them.
PERMUTATIONS, BANDS, ROWS = 128, 25, 5
_PRIME = (1 << 61) - 1
#: Rows of a reference set up to which its grams are broadcast; above, the join shuffles.
BROADCAST_GRAMS = 500_000


def positions(df: DataFrame, key: str, text: str, n: int = GRAM) -> DataFrame:
    """(key, n_tok, pos, gram) of every n-gram of a text, as 64-bit hashes; runs of one repeated token count once."""
    words = df.select(key, tokens(text).alias("_t")).select(key, collapse_runs("_t").alias("_w"))
    return words.select(key, F.size("_w").alias("n_tok"), F.posexplode(gram_hashes("_w", n)).alias("pos", "gram"))


def whole(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tok, joined): the whole normalised text."""
    words = df.select(key, tokens(text).alias("_t")).select(key, collapse_runs("_t").alias("_w"))
    return words.select(key, F.size("_w").alias("n_tok"), F.array_join("_w", " ").alias("joined"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_GRAMS else df


def shared_grams(docs: DataFrame, refs: DataFrame, doc_key: str, ref_key: str, n: int = GRAM) -> DataFrame:
    """(doc, ref, pos, ref_pos, n_tok, ref_n_tok) of every gram that both hold; documents' grams that no reference has end at the first join."""
    r = positions(refs, ref_key, "text", n).withColumnsRenamed({"pos": "ref_pos", "n_tok": "ref_n_tok"})
    return positions(docs, doc_key, "text", n).join(_small(r, r.count()), "gram")


def coverage(hits: DataFrame, by: list[str], pos: str, total: str, n: int = GRAM) -> DataFrame:
    """Share of the tokens that lie inside shared n-grams: distinct positions pos .. pos + n - 1 over the total."""
    gap = F.lead(pos).over(W.partitionBy(*by).orderBy(pos)) - F.col(pos)
    spans = hits.select(*by, pos, total).distinct().withColumn("_new", F.least(F.coalesce(gap, F.lit(n)), F.lit(n)))
    return spans.groupBy(*by).agg((F.sum("_new") / F.max(total)).alias("fraction"))


def contaminated(docs: DataFrame, refs: DataFrame, doc_key: str = "doc_id", ref_key: str = "item_id") -> DataFrame:
    """(doc, ref, rule, share) of every rule that holds: ngram, covers_reference or whole."""
    hits = cut(shared_grams(docs, refs, doc_key, ref_key))
    by_doc = coverage(hits, [doc_key], "pos", "n_tok").where(F.col("fraction") > OVERLAP).select(doc_key, F.lit(None).cast("bigint").alias(ref_key), F.lit("ngram").alias("rule"), F.col("fraction").alias("share"))
    by_ref = coverage(hits, [doc_key, ref_key], "ref_pos", "ref_n_tok").where(F.col("fraction") > OVERLAP).select(doc_key, ref_key, F.lit("covers_reference").alias("rule"), F.col("fraction").alias("share"))
    same = whole(docs, doc_key, "text").join(whole(refs, ref_key, "text").select(ref_key, "joined").where("joined <> ''"), "joined")
    return by_doc.union(by_ref).union(same.select(doc_key, ref_key, F.lit("whole").alias("rule"), F.lit(1.0).alias("share")))


def _permutations() -> list[tuple[int, int]]:
    """Multipliers and offsets below 2**29, so that products with 32-bit hashes stay in 62 bits."""
    x, out = 88172645463325252, []
    for _ in range(PERMUTATIONS):
        pair = []
        for _ in range(2):
            x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
            x ^= x >> 7
            x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
            pair.append((x % ((1 << 29) - 1)) + 1)
        out.append((pair[0], pair[1]))
    return out


def _signatures(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = (np.array(x, np.uint64)[:, None] for x in zip(*_permutations(), strict=True))
        for batch in batches:
            sig = [((a * np.asarray(h, np.uint64) + b) % np.uint64(_PRIME) & np.uint64(0xFFFFFFFF)).min(axis=1).astype(np.int64) for h in batch["h"]]
            yield pd.DataFrame({key: batch[key], "sig": sig})

    return run


def minhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sig): minima of ((a h + b) mod (2**61 - 1)) mod 2**32 over the shingles' hashes; texts under SHINGLE tokens have no row.

    Tokens and hashes come from built-in functions; the minima from Arrow batches, as lambdas would be evaluated 128 times for every shingle."""
    hashes = F.transform(F.array_distinct(grams(collapse_runs(tokens(text)), SHINGLE)), lambda g: F.xxhash64(g).bitwiseAND(F.lit((1 << 32) - 1)))
    kind = dict(df.dtypes)[key]
    return df.select(key, hashes.alias("h")).where(F.size("h") > 0).mapInPandas(_signatures(key), f"{key} {kind}, sig array<bigint>")


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(PERMUTATIONS))


def near_pairs(df: DataFrame, key: str, text: str, least: float = NEAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, jaccard), a < b, of texts whose shingles are similar by at least `least`: banded candidates, whose estimated
    and then exact similarity is looked at. Texts that repeat exactly are compared once, by their smallest key."""
    once = df.groupBy(F.sha2(text, 256).alias("_s")).agg(F.min(F.struct(F.col(key).alias("k"), F.col(text).alias("t"))).alias("m")).select(F.col("m.k").alias(key), F.col("m.t").alias(text))
    sigs = cut(minhash(once, key, text))
    cells = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("sig", i * rows + 1, F.lit(rows))).alias("h")))
    banded = sigs.select(F.col(key).alias("k"), F.explode(cells).alias("x")).select("k", "x.*")
    pairs = banded.alias("x").join(banded.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.k") < F.col("y.k"))).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()
    left, right = sigs.select(F.col(key).alias("a"), F.col("sig").alias("sa")), sigs.select(F.col(key).alias("b"), F.col("sig").alias("sb"))
    # the estimate's standard deviation at 0.8 is 0.035; what is four of them below is not near
    likely = pairs.join(left, "a").join(right, "b").where(estimated_jaccard(F.col("sa"), F.col("sb")) >= least - 0.15).select("a", "b")
    sets = once.select(key, F.array_distinct(gram_hashes(collapse_runs(tokens(text)), SHINGLE)).alias("s"))
    whole_sets = likely.join(sets.toDF("a", "xs"), "a").join(sets.toDF("b", "ys"), "b")
    both = F.size(F.array_intersect("xs", "ys"))
    return whole_sets.select("a", "b", (both / (F.size("xs") + F.size("ys") - both)).alias("jaccard")).where(F.col("jaccard") >= least)


def set_share(docs: DataFrame, refs: DataFrame, doc_key: str = "doc_id", ref_key: str = "item_id") -> DataFrame:
    """One row: the share of references that all documents together cover by more than half, and whether it fails the set rule."""
    hits = shared_grams(docs, refs, doc_key, ref_key).select(ref_key, "ref_pos", "ref_n_tok").distinct()
    over = coverage(hits, [ref_key], "ref_pos", "ref_n_tok").where(F.col("fraction") > OVERLAP).agg(F.count("*").alias("n_over"))
    total = refs.agg(F.count("*").alias("n_refs"))
    return over.join(F.broadcast(total)).select("n_refs", "n_over", (F.col("n_over") / F.col("n_refs") > SET_SHARE).alias("fails"))

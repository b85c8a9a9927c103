"""Rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair has a pseudo-random number u in (0, 1), the same for every run; a record goes to the shard of the
largest -weight / ln(u). A shard's share is its weight over the sum of weights, and when a shard is added, the records
that it wins are the only ones that move. The key alone decides: no count, order or other row has a say, so any subset
of the table shards alike and a lost task's retry gives the same rows.

Defined results: a null key hashes as a value of its own; a null text has no bytes and the CRC of the empty text; rows
that repeat a key share its shard and take a slot each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "rendezvous-1"
#: Slots are numbered within (shard, bin) and then moved by the bins before; bins bound a task's rows.
SLOT_BINS = 1024


def unit(*parts: Column) -> Column:
    """Uniform in (0, 1), from the upper 53 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key. weights: shard -> weight above 0; ties, of probability 2**-53, go to the larger shard."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights are to be positive")
    shards = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in sorted(weights.items())])
    score = lambda x: F.struct((x["w"] / -F.ln(unit(F.lit(SEED), key, x["s"]))).alias("score"), x["s"].alias("s"))
    return F.array_max(F.transform(shards, score))["s"].cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str], key: str, bins: int = SLOT_BINS) -> DataFrame:
    """df with `slot`: 0, 1, ... within each shard, without gaps. No task sees more than one (shard, bin) at a time."""
    binned = df.withColumn("_bin", F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(bins)).cast("int"))
    sizes = binned.groupBy(shard, "_bin").agg(F.count("*").alias("_n"))
    # at most shards x bins rows, whatever the input
    before = sizes.selectExpr(shard, "_bin", f"sum(_n) OVER (PARTITION BY {shard} ORDER BY _bin) - _n AS _before")
    ranked = binned.selectExpr("*", f"row_number() OVER (PARTITION BY {shard}, _bin ORDER BY {', '.join(order)}) - 1 AS _i")
    return ranked.join(F.broadcast(before), [shard, "_bin"]).withColumn("slot", (F.col("_before") + F.col("_i")).cast("long")).drop("_bin", "_before", "_i")


def shard(df: DataFrame, key: str, weights: Mapping[int, float], shard_column: str = "shard") -> DataFrame:
    """df with the shard of every row by its key."""
    return df.withColumn(shard_column, rendezvous(F.col(key), weights))


def equal_weights(n: int) -> dict[int, float]:
    return dict.fromkeys(range(n), 1.0)


def op2_sharding(docs: DataFrame, n: int = 24) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    slim = shard(shard(slim, "doc_id", equal_weights(n)), "doc_id", equal_weights(n + 1), "grown_shard")
    out = with_slots(slim, "shard", ["doc_id", "text_crc32", "size"], "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

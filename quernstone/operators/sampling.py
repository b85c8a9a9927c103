"""Splits, samples, quotas and shares. Every draw is an order by keyed hash, so it is the same at any parallelism."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import keyed, split_name, unit


def _rank(df: DataFrame, by: list[str], *order: Column, name: str = "_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def _match(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on `by`, nulls being equal; right's columns of these names go."""
    other = right.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return left.join(other, same, how).drop(*[f"_of_{c}" for c in by])


def running(df: DataFrame, by: str, order: str, value: str, width: int = 4096) -> DataFrame:
    """df with `before`, the sum of value over the rows of the group that come earlier, and `total`, of all of them. order is
    an integer; rows are summed in bins of `width` of it, so that a hot group is many tasks and only the bins' sums meet in one."""
    binned = df.withColumn("_bin", F.floor(F.col(order) / width))
    sums = binned.groupBy(by, "_bin").agg(F.sum(value).alias("_sum"))
    sums = sums.select(by, "_bin", (F.sum("_sum").over(W.partitionBy(by).orderBy("_bin")) - F.col("_sum")).alias("_earlier"), F.sum("_sum").over(W.partitionBy(by)).alias("total"))
    inner = binned.withColumn("_own", F.sum(value).over(W.partitionBy(by, "_bin").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value))
    return _match(inner, sums, [by, "_bin"]).withColumn("before", F.col("_earlier") + F.col("_own")).drop("_bin", "_earlier", "_own")


def hash_rank(df: DataFrame, by: list[str], salt: str, key: str) -> DataFrame:
    """df with `_rank`, the row's place in the hash order of its group, and `_total`, the group's rows. Rows are ranked in 1,024
    bins of the hash and the bins' counts added up, so that a hot group is many tasks and only counts of it meet in one."""
    binned = df.withColumn("_h", keyed(salt, key)).withColumn("_bin", F.shiftright("_h", 50))
    n = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    group = W.partitionBy(*by)
    sums = n.select(*by, "_bin", (F.sum("_n").over(group.orderBy("_bin")) - F.col("_n")).alias("_earlier"), F.sum("_n").over(group).alias("_total"))
    inner = binned.withColumn("_own", F.row_number().over(W.partitionBy(*by, "_bin").orderBy("_h", key)))
    return _match(inner, sums, [*by, "_bin"]).withColumn("_rank", F.col("_earlier") + F.col("_own")).drop("_h", "_bin", "_earlier", "_own")


def hash_split(df: DataFrame, key: str, salt: str, shares: dict[str, float]) -> DataFrame:
    return df.withColumn("split", split_name(unit(salt, key), shares))


def fold_of(df: DataFrame, key: str, salt: str, k: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(keyed(salt, key), F.lit(k)).cast("int"))


def cap_per_group(df: DataFrame, group: str, key: str, salt: str, cap: int) -> DataFrame:
    """At most cap rows of each group, in hash order."""
    return _rank(df, [group], keyed(salt, key), F.col(key)).where(F.col("_rank") <= cap).drop("_rank")


def hash_order_limit(df: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The first n rows in hash order; a larger n extends the same prefix."""
    return df.withColumn("_h", keyed(salt, key)).orderBy("_h", key).limit(n).drop("_h")


def apportion(sizes: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """Largest-remainder integer shares of total in proportion to size; ties to the smaller group."""
    exact = F.lit(total) * F.col(size) / F.sum(size).over(W.partitionBy())
    out = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("bigint"))
    out = out.withColumn("_left", F.lit(total) - F.sum("_floor").over(W.partitionBy()))
    out = out.withColumn("_k", F.row_number().over(W.orderBy(F.desc(F.col("_exact") - F.col("_floor")), F.col(group))))
    return out.withColumn("share", F.col("_floor") + (F.col("_k") <= F.col("_left")).cast("bigint")).drop("_exact", "_floor", "_left", "_k")


def water_fill(sizes: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """The largest cap c with sum(min(size, c)) <= total, then one more each to the largest groups while total allows."""
    up = W.orderBy(size, group)
    out = sizes.withColumn("_n", F.count("*").over(W.partitionBy())).withColumn("_i", F.row_number().over(up))
    out = out.withColumn("_before", F.coalesce(F.sum(size).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # with the groups before row i whole, the rest share what is left; the cap is that of the first row it does not fill
    out = out.withColumn("_level", F.floor((F.lit(total) - F.col("_before")) / (F.col("_n") - F.col("_i") + 1)))
    out = out.withColumn("_cap", F.min(F.when(F.col(size) > F.col("_level"), F.struct("_i", "_level"))).over(W.partitionBy())["_level"])
    out = out.withColumn("_take", F.least(F.col(size), F.coalesce("_cap", F.col(size))).cast("bigint"))
    out = out.withColumn("_left", F.lit(total) - F.sum("_take").over(W.partitionBy()))
    out = out.withColumn("_k", F.row_number().over(W.orderBy(F.desc(size), F.col(group))))
    more = (F.col(size) > F.col("_take")) & (F.col("_k") <= F.col("_left"))
    return out.withColumn("share", F.col("_take") + more.cast("bigint")).select(*sizes.columns, "share")


def stratified_take(df: DataFrame, stratum: str, key: str, salt: str, total: int) -> DataFrame:
    """A proportional sample of total rows: apportioned quotas, hash order within the stratum."""
    quota = apportion(df.groupBy(stratum).agg(F.count("*").alias("_size")), stratum, "_size", total).select(stratum, "share")
    return _match(hash_rank(df, [stratum], salt, key), quota, [stratum]).where("_rank <= share").drop("_rank", "_total", "share")


def stratified_carve(df: DataFrame, stratum: str, key: str, salt: str, share: float) -> DataFrame:
    """`part`: held for the first share of every stratum, at least one and never all of a stratum of two or more; else kept."""
    n = F.col("_total")
    want = F.when(n >= 2, F.least(F.greatest(F.floor(n * share + 0.5), F.lit(1)), n - 1)).otherwise(0)
    return hash_rank(df, [stratum], salt, key).withColumn("part", F.when(F.col("_rank") <= want, "held").otherwise("kept")).drop("_rank", "_total")


def systematic_fraction(df: DataFrame, stratum: str, key: str, salt: str, fraction: float) -> DataFrame:
    """Row i of the (stratum, hash) order is kept iff floor((i + 1) f) > floor(i f)."""
    out = hash_rank(df, [stratum], salt, key)
    return out.where(F.floor(F.col("_rank") * fraction) > F.floor((F.col("_rank") - 1) * fraction)).drop("_rank", "_total")


def alternate_halves(df: DataFrame, stratum: str, key: str, salt: str) -> DataFrame:
    return hash_rank(df, [stratum], salt, key).withColumn("half", F.when(F.col("_rank") % 2 == 1, "public").otherwise("private")).drop("_rank", "_total")


def matched_cells(df: DataFrame, cell: str, label: str, key: str, salt: str) -> DataFrame:
    """Equal label counts in every cell: as many of each label as the rarest has; cells that lack a label go."""
    counts = df.groupBy(cell, label).agg(F.count("*").alias("_n"))
    labels = df.select(label).distinct().agg(F.count("*").alias("_all"))
    least = counts.groupBy(cell).agg(F.min("_n").alias("_least"), F.count("*").alias("_has")).join(F.broadcast(labels)).where("_has = _all")
    return _match(hash_rank(df, [cell, label], salt, key), least.select(cell, "_least"), [cell]).where("_rank <= _least").drop("_rank", "_total", "_least")


def cap_top_share(df: DataFrame, group: str, answer: str, key: str, salt: str, cap: float) -> DataFrame:
    """The most common answer's share within a group is cut to cap: int(cap * others / (1 - cap)) of its rows stay."""
    counts = df.groupBy(group, answer).agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(W.partitionBy(group)))
    limit = F.when(F.col("_n") > cap * F.col("_all"), F.floor(cap * (F.col("_all") - F.col("_n")) / (1 - cap) + 1e-9)).otherwise(F.col("_n"))
    limits = counts.select(group, answer, limit.alias("_limit"))
    return _match(hash_rank(df, [group, answer], salt, key), limits, [group, answer]).where("_rank <= _limit").drop("_rank", "_total", "_limit")


def balanced_class_draw(df: DataFrame, label: str, key: str, salt: str, most: int) -> DataFrame:
    """As many of each class as the rarest has, at most most / 2; one class only gives none."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    each = counts.agg(F.least(F.min("_n"), F.lit(most // 2)).alias("_each"), F.count("*").alias("_classes")).where("_classes > 1")
    return hash_rank(df, [label], salt, key).join(F.broadcast(each.select("_each"))).where("_rank <= _each").drop("_rank", "_total", "_each")


def paired_draw(df: DataFrame, label: str, key: str, salt: str, n: int) -> DataFrame:
    """The first n (positive, negative) pairs in hash order: pair, positive, negative."""
    # only the first n of each side meet in a task
    side = lambda y, name: _rank(hash_order_limit(df.where(F.col(label) == y), key, salt, n), [], keyed(salt, key), F.col(key), name="pair").select("pair", F.col(key).alias(name))
    return side(1, "positive").join(side(0, "negative"), "pair")


def round_robin(df: DataFrame, stratum: str, key: str, salt: str) -> DataFrame:
    """`turn`: rank within the stratum; orders by (turn, stratum hash) take one of each stratum in turn."""
    return hash_rank(df, [stratum], salt, key).withColumnRenamed("_rank", "turn").drop("_total").withColumn("stratum_order", keyed(salt, stratum))


def balanced_unit_halves(units: DataFrame, stratum: str, unit_key: str, size: str, salt: str) -> DataFrame:
    """Whole units to the half of the stratum that has fewer items so far, in hash order; a tie goes to public.

    The fold is sequential by definition; a stratum's units, of a size in rows each, are one group of (unit, size)."""
    rows = F.sort_array(F.collect_list(F.struct(keyed(salt, unit_key).alias("h"), F.col(unit_key).alias("unit"), F.col(size).cast("bigint").alias("size"))))
    start = F.expr("named_struct('a', 0L, 'b', 0L, 'out', cast(array() as array<struct<unit: string, half: string>>))")

    def step(acc: Column, x: Column) -> Column:
        first = acc["a"] <= acc["b"]
        got = F.struct(x["unit"].cast("string").alias("unit"), F.when(first, "public").otherwise("private").alias("half"))
        return F.struct((acc["a"] + F.when(first, x["size"]).otherwise(0)).alias("a"), (acc["b"] + F.when(first, 0).otherwise(x["size"])).alias("b"), F.concat(acc["out"], F.array(got)).alias("out"))

    return units.groupBy(stratum).agg(rows.alias("rows")).select(stratum, F.explode(F.aggregate("rows", start, step)["out"]).alias("x")).select(stratum, "x.unit", "x.half")

"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target/size ratio r is to be taken r times: floor(r) whole copies, and one more with the
probability r - floor(r). The pivotal method rounds these probabilities together: two documents exchange mass, in the
random direction that leaves each one's expectation as it was, until one of them is 0 or 1; what the other still has
goes on to the next. Mass is counted in words (size x probability), so a source's total stays exact and only the last
residual of a source, a part of one document, is rounded by itself.

The exchanges form a tree: groups of about FAN documents of one source are rounded in one task each, every group hands
at most one residual document to the level above, and levels follow until every source has one group. A level holds
1/FAN of the rows below it, so the depth is log(rows) / log(FAN) and no group grows with the input. All randomness is
a hash of (seed, level, doc_id), so reruns agree.

Defined results: a null text has size 0; a document of size 0 is never taken, whatever its source's target; a null
source is a source of its own, the last; repeated rows are documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Staged, passing, small

WEIGHTS = (5, 2, 1)
CAP = 3
FAN = 64
#: Sources that a mix may have; a target depends on all of them, so their sizes (not their documents) are held together.
SOURCES = 1_000_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size, n_docs) with target: the total shared by weight, capped at cap x source_size, the excess reshared.

    Resharing ends at a water level L: a source gets min(cap x size, weight x L). With sources in the order of
    cap x size / weight, those before some place are capped; L of each place follows from running sums, and the place
    is the first whose own ratio is not below its L. A row for each source meets in one task, SOURCES at most."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    if sizes.count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources; group them first")
    out = sizes.selectExpr("*", "row_number() OVER (ORDER BY source NULLS LAST) - 1 AS _rank").withColumn("_w", w.cast("double"))
    out = out.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    out = out.selectExpr(
        "*",
        "sum(source_size) OVER () AS _total",
        "coalesce(sum(_cap) OVER (ORDER BY _cap / _w, _rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D) AS _capped",
        "sum(_w) OVER (ORDER BY _cap / _w, _rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _open",
        "row_number() OVER (ORDER BY _cap / _w, _rank) AS _place",
    )
    level = "min(CASE WHEN _cap / _w >= (_total - _capped) / _open THEN struct(_place, (_total - _capped) / _open AS level) END) OVER ()"
    out = out.selectExpr("*", f"({level}).level AS _level")
    return out.selectExpr("source", "source_size", "n_docs", "least(_cap, coalesce(_w * _level, _cap)) AS target")


def _fold(id_type: str) -> str:
    """SQL: rows, an array of (id, s, p), folded into struct(r, done): the residual row and the rows whose p is final.

    a is the residual so far, x the next row. `up` words can move from x to a, `down` from a to x; up is chosen with
    the probability down / (up + down), so that the expectation of either stays."""
    row = f"struct<id: {id_type}, s: bigint, p: double>"
    node = lambda of, p: f"named_struct('id', {of}.id, 's', {of}.s, 'p', {p})"
    state = lambda r, final: f"named_struct('r', {r}, 'done', concat(acc.done, array({final})))"
    u = "(shiftrightunsigned(xxhash64(seed, level, x.id, acc.r.id, x.s), 11) + 0.5D) / 9007199254740992D"
    move_up = f"""CASE WHEN (1 - acc.r.p) * acc.r.s <= x.p * x.s
        THEN {state(node("x", "greatest(0D, x.p - m.up / x.s)"), node("acc.r", "1D"))}
        ELSE {state(node("acc.r", "least(1D, acc.r.p + m.up / acc.r.s)"), node("x", "0D"))} END"""
    move_down = f"""CASE WHEN acc.r.p * acc.r.s <= (1 - x.p) * x.s
        THEN {state(node("x", "least(1D, x.p + m.down / x.s)"), node("acc.r", "0D"))}
        ELSE {state(node("acc.r", "greatest(0D, acc.r.p - m.down / acc.r.s)"), node("x", "1D"))} END"""
    moves = "named_struct('up', least((1 - acc.r.p) * acc.r.s, x.p * x.s), 'down', least(acc.r.p * acc.r.s, (1 - x.p) * x.s))"
    return f"""aggregate(rows, named_struct('r', cast(null as {row}), 'done', cast(array() as array<{row}>)), (acc, x) ->
      CASE WHEN acc.r IS NULL THEN named_struct('r', x, 'done', acc.done)
      ELSE transform(array({moves}), m -> CASE WHEN {u} * (m.up + m.down) < m.down THEN {move_up} ELSE {move_down} END)[0] END)"""


def pivotal(rows: DataFrame, seed: str = SEED, fan: int = FAN) -> DataFrame:
    """rows(source, id, s, p) with 0 < p < 1 and s > 0 -> (source, id, s, took): took is 0 or 1, and within each source
    sum(s x took) differs from sum(s x p) by less than one row's s."""
    fold, level = _fold(dict(rows.dtypes)["id"]), 0
    done, residual = None, rows
    while True:
        counts = residual.groupBy("source").agg(F.count("*").alias("_n"))
        most = counts.agg(F.max("_n"), F.count("*")).first()
        if not most[1]:
            break
        last = most[0] <= fan
        groups = counts.select(F.col("source").alias("_source"), F.ceil(F.col("_n") / F.lit(fan)).cast("long").alias("_groups"))
        dealt = residual.join(small(groups, most[1]), F.col("source").eqNullSafe(F.col("_source")))
        dealt = dealt.withColumn("_group", F.pmod(F.xxhash64(F.lit(f"{seed}:{level}"), "id", "s"), F.col("_groups")))
        # each group has about `fan` rows, so this list is bounded
        lists = dealt.groupBy("source", "_group").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(f"order:{level}"), "id").alias("h"), "id", "s", "p"))).alias("rows"))
        lists = lists.select("source", F.transform("rows", lambda x: F.struct(x["id"].alias("id"), x["s"].alias("s"), x["p"].alias("p"))).alias("rows"), F.lit(seed).alias("seed"), F.lit(level).alias("level"))
        step = Staged(lists.select("source", F.expr(fold).alias("f")).select("source", F.explode(F.concat(F.expr("transform(f.done, x -> named_struct('x', x, 'final', true))"), F.expr("array(named_struct('x', f.r, 'final', false))"))).alias("e")).select("source", "e.x.*", "e.final")).df
        final = step.filter("final").select("source", "id", "s", F.col("p").cast("int").alias("took"))
        done = final if done is None else done.unionByName(final)
        residual = step.filter("NOT final").drop("final")
        if last:
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:last"), "id", "s"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
            return done.unionByName(residual.select("source", "id", "s", F.when(u < F.col("p"), 1).otherwise(0).alias("took")))
        level += 1
    return rows.select("source", "id", "s", F.lit(0).alias("took")).limit(0) if done is None else done


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source, source_size, target, copies (how often the mix takes the document)."""
    with passing() as scope:
        return scope.keep(Staged(_mix(docs, seed)))


def _mix(docs: DataFrame, seed: str) -> DataFrame:
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    sized = Staged(docs.select("doc_id", "source", size.alias("size"))).df
    per_source = Staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))).df
    n_sources = per_source.count()
    rated = per_source.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rated = rated.withColumn("whole", F.floor("ratio").cast("long")).withColumn("p", F.col("ratio") - F.floor("ratio"))
    rated = rated.withColumnRenamed("source", "_source")
    all_rows = sized.join(small(rated, n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    open_rows = all_rows.filter("size > 0 AND p > 0").select("source", F.col("doc_id").alias("id"), F.col("size").alias("s"), "p")
    rounded = pivotal(open_rows, seed).select("source", F.col("id").alias("doc_id"), F.col("s").alias("size"), "took")
    settled = all_rows.filter("NOT (size > 0 AND p > 0)").select("source", "doc_id", "size", F.lit(0).alias("took"))
    out = rounded.unionByName(settled).join(small(rated, n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("whole") + F.col("took")).cast("long").alias("copies"))


def repeat_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    with passing() as scope:
        copies = mix(docs.select("doc_id", "text", "source"), seed).groupBy("doc_id").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
        copies = scope.keep(Staged(copies.where("_copies > 0 OR _rows > 1")))
    if not copies.where("_rows > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id"])
    taken = copies.where("_copies > 0").select(F.col("doc_id").alias("_id"), F.col("_copies").cast("int").alias("_copies"))
    many = docs.join(small(taken, taken.count()), docs["doc_id"].eqNullSafe(taken["_id"]))
    return many.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def op3_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")

"""Queries over model answers and votes: metrics, resampling, calibration, boards, label aggregation and routing.

The test tables hold no model answers, so answers are made from them by keyed hashes: three models answer a
three-outcome question about every document, with more mass on the gold outcome for better models."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import keyed, unit
from ..operators import metrics as M
from .registry import h, query, table, u

MODELS = {"m1": 0.9, "m2": 0.5, "m3": 0.2}


def answers(spark, d):
    """doc_id, track, model, gold (0..2; null for some), probs (renormalised)."""
    base = table(spark, d, "documents").select("doc_id", F.col("lang").alias("track"), "source", F.pmod(keyed("gold", "doc_id"), F.lit(3)).cast("int").alias("g"), (F.pmod(keyed("null", "doc_id"), F.lit(20)) == 0).alias("nul"))
    models = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(w).alias("w")) for m, w in MODELS.items()])
    x = base.select("*", F.explode(models).alias("x")).select("doc_id", "track", "source", "g", "nul", F.col("x.m").alias("model"), F.col("x.w").alias("w"))
    raw = F.array(*[F.round(unit(f"p{k}", F.concat_ws(":", "model", F.col("doc_id").cast("string"))), 4) + F.when(F.col("g") == k, F.col("w")).otherwise(0.0) + F.lit(0.0001) for k in range(3)])
    x = x.withColumn("probs", raw).withColumn("probs", M.renormalise("probs"))
    return x.select("doc_id", "track", "source", "model", F.when(~F.col("nul"), F.col("g")).alias("gold"), "probs")


def _p(k):
    key = "model || ':' || CAST(doc_id AS VARCHAR)"
    return f"(round({u(f'p{k}', key)}, 4) + CASE WHEN g = {k} THEN w ELSE 0.0::DOUBLE END + 0.0001::DOUBLE)"


ANSWERS = f"""a0 AS (SELECT doc_id, lang AS track, source, CAST({h('gold', 'doc_id')} % 3 AS INTEGER) AS g, {h('null', 'doc_id')} % 20 = 0 AS nul FROM documents),
a1 AS (SELECT a0.*, model, w FROM a0, (VALUES {', '.join(f"('{m}', {w}::DOUBLE)" for m, w in MODELS.items())}) AS m(model, w)),
a2 AS (SELECT *, {_p(0)} AS r0, {_p(1)} AS r1, {_p(2)} AS r2 FROM a1),
a AS (SELECT doc_id, track, source, model, CASE WHEN nul THEN NULL ELSE g END AS gold, r0 / (r0 + r1 + r2) AS p0, r1 / (r0 + r1 + r2) AS p1, r2 / (r0 + r1 + r2) AS p2 FROM a2),
s AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted, greatest(p0, p1, p2) AS confidence,
  CASE gold WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS pg FROM a WHERE gold IS NOT NULL),
sc AS (SELECT *, CASE WHEN predicted = gold THEN 1 ELSE 0 END AS hit, -ln(greatest(pg, 1e-12)) AS nll,
  pow(p0 - (CASE WHEN gold = 0 THEN 1 ELSE 0 END), 2) + pow(p1 - (CASE WHEN gold = 1 THEN 1 ELSE 0 END), 2) + pow(p2 - (CASE WHEN gold = 2 THEN 1 ELSE 0 END), 2) AS brier FROM s)"""


def scored(spark, d):
    return M.scored(answers(spark, d))


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("accuracy", f"WITH {ANSWERS} SELECT model, track, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(brier), 6) AS brier, round(sqrt(avg(brier) / 2), 6) AS root_brier, round(avg(nll), 6) AS nll FROM sc GROUP BY 1, 2")
def accuracy(spark, d):
    return _r(M.summary(scored(spark, d), ["model", "track"]), "accuracy", "brier", "root_brier", "nll")


@query("macro_f1", f"WITH {ANSWERS}, c AS (SELECT model, gold AS k, 1 AS g, 0 AS p, CASE WHEN gold = predicted THEN 1 ELSE 0 END AS tp FROM sc UNION ALL SELECT model, predicted, 0, 1, 0 FROM sc), f AS (SELECT model, k, 2 * sum(tp) / (sum(g) + sum(p))::DOUBLE AS f1 FROM c GROUP BY 1, 2) SELECT model, round(avg(f1), 6) AS macro_f1, count(*) AS n_classes FROM f GROUP BY 1")
def macro_f1(spark, d):
    return _r(M.macro_f1(scored(spark, d), ["model"]), "macro_f1")


@query("ece_binned", f"WITH {ANSWERS}, b AS (SELECT model, greatest(ceil(confidence * 10), 1) AS bin, count(*) AS n, avg(confidence) AS c, avg(hit) AS a FROM sc GROUP BY 1, 2) SELECT model, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def ece_binned(spark, d):
    return _r(M.ece(scored(spark, d), ["model"]), "ece")


_TIES = "t AS (SELECT model, confidence, count(*) AS n, sum(1 - hit) AS loss FROM sc GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER w AS rows, sum(loss) OVER w AS losses, sum(n) OVER (PARTITION BY model) AS total FROM t WINDOW w AS (PARTITION BY model ORDER BY confidence DESC))"


@query("augrc", f"WITH {ANSWERS}, {_TIES} SELECT model, round(sum(n * (losses - loss) + loss * (n + 1) / 2.0) / pow(max(total), 2), 6) AS augrc, CAST(max(total) AS BIGINT) AS n, round(sum(n * (losses - loss) + loss * (n + 1) / 2.0) / pow(max(total), 2) / ((max(total) + 1) / (2.0 * max(total))), 6) AS augrc_normalised FROM r GROUP BY 1")
def augrc(spark, d):
    return _r(M.augrc(scored(spark, d), ["model"]), "augrc", "augrc_normalised")


@query("coverage_at_risk", f"WITH {ANSWERS}, {_TIES} SELECT model, round(min(confidence) FILTER (WHERE losses <= 0.3::DOUBLE * rows), 6) AS threshold, round(coalesce(max(rows) FILTER (WHERE losses <= 0.3::DOUBLE * rows) / max(total)::DOUBLE, 0), 6) AS coverage FROM r GROUP BY 1")
def coverage_at_risk(spark, d):
    return _r(M.coverage_at_risk(scored(spark, d), ["model"], 0.3), "threshold", "coverage")


@query("error_direction", f"WITH {ANSWERS} SELECT model, count(*) FILTER (WHERE gold = 0 AND predicted <> 0) AS misses, count(*) FILTER (WHERE gold <> 0 AND predicted = 0) AS false_alarms FROM sc GROUP BY 1")
def error_direction(spark, d):
    return scored(spark, d).groupBy("model").agg(F.count_if(F.expr("gold = 0 AND predicted <> 0")).alias("misses"), F.count_if(F.expr("gold <> 0 AND predicted = 0")).alias("false_alarms"))


@query("wilson", f"WITH {ANSWERS}, c AS (SELECT model, sum(hit) AS x, count(*)::DOUBLE AS n FROM sc GROUP BY 1), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, x / n AS p FROM c) SELECT model, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM z")
def wilson(spark, d):
    c = scored(spark, d).groupBy("model").agg(F.sum("hit").alias("x"), F.count("*").alias("n"))
    low, high = M.wilson(F.col("x"), F.col("n"))
    return c.select("model", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("confidence_scores", f"WITH {ANSWERS} SELECT doc_id, model, round(confidence, 6) AS max_prob, round((p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3), 6) AS neg_entropy, round(confidence - (p0 + p1 + p2 - confidence - least(p0, p1, p2)), 6) AS gap, round(-(1 - (p0 * p0 + p1 * p1 + p2 * p2)) / (p0 * p0 + p1 * p1 + p2 * p2), 6) AS doctor FROM s")
def confidence_scores(spark, d):
    a = answers(spark, d).where("gold IS NOT NULL")
    return a.select("doc_id", "model", *[F.round(c, 6).alias(n) for n, c in M.confidence_scores(F.col("probs")).items()])


def _boot_sql(draws, salt, items):
    """SQL of metrics.resample over items(block, id, v): m(block, draw, m)."""
    weight = " ".join(f"WHEN u < '{bound}' THEN {k}" for k, bound in enumerate(M.POISSON))
    return f"""x AS ({items}), b AS (SELECT *, sha256('{salt}:' || CAST(k AS VARCHAR) || ':' || CAST(id AS VARCHAR)) AS hex FROM x, range({draws // 8}) AS r(k)),
e AS (SELECT block, v, k * 8 + j AS draw, substr(hex, CAST(8 * j + 1 AS INTEGER), 8) AS u FROM b, range(8) AS r(j)),
w AS (SELECT block, draw, v, CASE {weight} ELSE {len(M.POISSON)} END AS w FROM e),
m AS (SELECT block, draw, sum(w * v) / sum(w)::DOUBLE AS m FROM w WHERE w > 0 GROUP BY 1, 2)"""


DRAWS = 2000
_GAIN = "SELECT 'm1-m2' AS block, a.doc_id AS id, a.hit - b.hit AS v FROM sc AS a JOIN sc AS b ON a.doc_id = b.doc_id AND a.model = 'm1' AND b.model = 'm2'"


@query("bootstrap_ci", f"WITH {ANSWERS}, {_boot_sql(DRAWS, 'boot', 'SELECT model AS block, doc_id AS id, hit AS v FROM sc')} SELECT block AS model, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1")
def bootstrap_ci(spark, d):
    return _r(M.bootstrap(scored(spark, d).select("model", "doc_id", "hit"), ["model"], "doc_id", "hit", DRAWS, "boot"), "low", "high")


@query("paired_bootstrap", f"WITH {ANSWERS}, {_boot_sql(DRAWS, 'pairs', _GAIN)} SELECT block AS pair, round((SELECT avg(v) FROM x), 6) AS difference, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(least(1, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0.0 END))), 6) AS p FROM m GROUP BY 1")
def paired_bootstrap(spark, d):
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("hit")))
    x = scored(spark, d).groupBy("doc_id").agg((of("m1") - of("m2")).alias("gain")).withColumn("pair", F.lit("m1-m2"))
    return _r(M.paired(x, ["pair"], "doc_id", "gain", DRAWS, "pairs"), "difference", "low", "high", "p")


@query("holm", "WITH p AS (SELECT n_nationkey AS test, (n_nationkey + 1) / 300.0::DOUBLE AS p FROM nation), r AS (SELECT *, least(1, p * (25 - row_number() OVER (ORDER BY p) + 1)) AS raw FROM p) SELECT test, round(p, 6) AS p, round(max(raw) OVER (ORDER BY p), 6) AS adjusted FROM r")
def holm(spark, d):
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("test"), ((F.col("n_nationkey") + 1) / F.lit(300.0)).alias("p")).withColumn("family", F.lit(1))
    return _r(M.holm(p, "p", ["family"]).drop("family"), "p", "adjusted")


_GRID = [math.exp(math.log(0.05) + i * (math.log(20.0) - math.log(0.05)) / 48) for i in range(49)]


@query("temperature_fit", f"WITH {ANSWERS}, g AS (SELECT model, gold, p0, p1, p2, unnest([{', '.join(f'{t!r}::DOUBLE' for t in _GRID)}]) AS t FROM s), r AS (SELECT model, t, gold, pow(p0, 1 / t) AS a, pow(p1, 1 / t) AS b, pow(p2, 1 / t) AS c FROM g), l AS (SELECT model, t, avg(-ln(greatest(CASE gold WHEN 0 THEN a WHEN 1 THEN b ELSE c END / (a + b + c), 1e-12))) AS loss FROM r GROUP BY 1, 2), m AS (SELECT model, arg_min(t, loss) AS t, min(loss) AS loss FROM l GROUP BY 1) SELECT model, round(CASE WHEN t IN ({_GRID[0]!r}::DOUBLE, {_GRID[-1]!r}::DOUBLE) THEN 1.0 ELSE t END, 6) AS temperature, round(loss, 6) AS loss FROM m")
def temperature_fit(spark, d):
    return _r(M.fit_temperature(answers(spark, d), ["model"], "probs", "gold"), "temperature", "loss")


@query("isotonic_abstain_map", f"WITH {ANSWERS}, c AS (SELECT model, CAST(least(floor(confidence * 1024), 1023) AS BIGINT) AS bin, count(*) AS n, sum(1 - hit) AS wrong FROM sc GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY bin) AS i FROM c), e AS (SELECT a.model, a.i AS lo, b.i AS hi, sum(b.wrong) OVER w / sum(b.n) OVER w::DOUBLE AS v FROM k AS a JOIN k AS b ON a.model = b.model AND a.i <= b.i WINDOW w AS (PARTITION BY a.model, a.i ORDER BY b.i)), x AS (SELECT model, lo, hi, max(v) OVER (PARTITION BY model, lo ORDER BY hi DESC) AS v FROM e), f AS (SELECT model, hi AS i, min(v) AS v FROM x GROUP BY 1, 2) SELECT k.model, bin, n, round(v, 6) AS error FROM k JOIN f ON f.model = k.model AND f.i = k.i")
def isotonic_abstain_map(spark, d):
    """Decreasing isotonic map from confidence, in 1,024 bins, to expected error, for each model."""
    bin_ = F.least(F.floor(F.col("confidence") * 1024), F.lit(1023))
    cells = scored(spark, d).groupBy("model", bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(1 - F.col("hit")).alias("wrong"))
    return _r(cells.groupBy("model").applyInPandas(_pool, "model string, bin long, n long, error double"), "error")


def _pool(cells):
    """Pools adjacent bins whose mean errors rise until none do. A model's bins are bounded in number, whatever its rows."""
    cells, blocks = cells.sort_values("bin"), []
    for wrong, n in zip(cells["wrong"], cells["n"]):
        blocks.append([wrong, n, 1])
        while len(blocks) > 1 and blocks[-1][0] * blocks[-2][1] > blocks[-2][0] * blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return cells.assign(error=[w / n for w, n, k in blocks for _ in range(k)])[["model", "bin", "n", "error"]]


@query("geometric_mean_board", f"WITH {ANSWERS}, x AS (SELECT model, 'accuracy' AS axis, avg(hit) AS v FROM sc GROUP BY 1 UNION ALL SELECT model, 'brier', 1 - avg(brier) / 2 FROM sc GROUP BY 1), b AS (SELECT model, exp(sum(CASE axis WHEN 'accuracy' THEN 2.0 ELSE 1.0 END * ln(v)) / 3) AS composite FROM x GROUP BY 1) SELECT model, round(composite, 6) AS composite, rank() OVER (ORDER BY composite DESC) AS place FROM b")
def geometric_mean_board(spark, d):
    s = M.summary(scored(spark, d), ["model"])
    axes = s.select("model", F.explode(F.array(F.struct(F.lit("accuracy").alias("axis"), F.col("accuracy").alias("v")), F.struct(F.lit("brier").alias("axis"), (1 - F.col("brier") / 2).alias("v")))).alias("x")).select("model", "x.*")
    return _r(M.board(axes, "model", "axis", "v", {"accuracy": 2.0, "brier": 1.0}), "composite").withColumn("place", F.col("place").cast("bigint"))


@query("speed_cost", "SELECT event_type, median(value) AS median_value, CASE WHEN count(*) = count(value) THEN round(sum(value), 4) END AS total FROM events GROUP BY 1")
def speed_cost(spark, d):
    e = table(spark, d, "events").groupBy("event_type")
    return e.agg(F.median("value").alias("median_value"), F.when(F.count("*") == F.count("value"), F.round(F.sum("value"), 4)).alias("total"))


@query("gap", f"WITH {ANSWERS} SELECT model, round(100 * (avg(hit) FILTER (WHERE {u('half', 'doc_id')} < 0.5) - avg(hit) FILTER (WHERE {u('half', 'doc_id')} >= 0.5)), 6) AS points FROM sc GROUP BY 1")
def gap(spark, d):
    public = unit("half", "doc_id") < 0.5
    return scored(spark, d).groupBy("model").agg(F.round(100 * (F.avg(F.when(public, F.col("hit"))) - F.avg(F.when(~public, F.col("hit")))), 6).alias("points"))


@query("order_sensitivity", f"WITH {ANSWERS}, c AS (SELECT source, model, predicted, count(*) AS n FROM s GROUP BY 1, 2, 3), q AS (SELECT source, model, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS sq FROM c GROUP BY 1, 2) SELECT model, round(avg(n / (n - 1) * (1 - sq / (n * n))), 6) AS sensitivity FROM q GROUP BY 1")
def order_sensitivity(spark, d):
    c = scored(spark, d).groupBy("source", "model", "predicted").agg(F.count("*").alias("n"))
    q = c.groupBy("source", "model").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("n")).cast("double").alias("sq"))
    return q.groupBy("model").agg(F.round(F.avg(F.col("n") / (F.col("n") - 1) * (1 - F.col("sq") / (F.col("n") * F.col("n")))), 6).alias("sensitivity"))


@query("chi2_cramers_v", f"WITH {ANSWERS}, t AS (SELECT model, gold, hit, count(*)::DOUBLE AS o FROM sc GROUP BY 1, 2, 3), e AS (SELECT *, sum(o) OVER (PARTITION BY model, gold) * sum(o) OVER (PARTITION BY model, hit) / sum(o) OVER (PARTITION BY model) AS e, sum(o) OVER (PARTITION BY model) AS n FROM t) SELECT model, round(sum((o - e) * (o - e) / e), 6) AS chi2, round(sqrt(sum((o - e) * (o - e) / e) / max(n)), 6) AS v FROM e GROUP BY 1")
def chi2_cramers_v(spark, d):
    t = scored(spark, d).groupBy("model", "gold", "hit").agg(F.count("*").cast("double").alias("o"))
    over = lambda *c: F.sum("o").over(W.partitionBy("model", *c))
    e = t.withColumns({"e": over("gold") * over("hit") / over(), "n": over()})
    chi2 = F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e"))
    return e.groupBy("model").agg(F.round(chi2, 6).alias("chi2"), F.round(F.sqrt(chi2 / F.max("n")), 6).alias("v"))


@query("tvd", f"WITH {ANSWERS} SELECT round(avg((abs(x.p0 - y.p0) + abs(x.p1 - y.p1) + abs(x.p2 - y.p2)) / 2), 6) AS tvd, round(avg(CASE WHEN x.predicted = y.predicted THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM s AS x JOIN s AS y ON x.doc_id = y.doc_id AND x.model = 'm1' AND y.model = 'm2'")
def tvd(spark, d):
    s = scored(spark, d)
    pair = s.where("model = 'm1'").select("doc_id", F.col("probs").alias("x"), F.col("predicted").alias("px")).join(s.where("model = 'm2'").select("doc_id", F.col("probs").alias("y"), F.col("predicted").alias("py")), "doc_id")
    distance = F.aggregate(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / 2
    return pair.agg(F.round(F.avg(distance), 6).alias("tvd"), F.round(F.avg((F.col("px") == F.col("py")).cast("double")), 6).alias("agreement"))


@query("vote_mean", f"WITH {ANSWERS} SELECT doc_id, round(avg(p0), 6) AS p0, round(avg(p1), 6) AS p1, round(avg(p2), 6) AS p2 FROM a GROUP BY 1")
def vote_mean(spark, d):
    return answers(spark, d).groupBy("doc_id").agg(*[F.round(F.avg(F.col("probs")[k]), 6).alias(f"p{k}") for k in range(3)])


@query("unanimous_share", f"WITH {ANSWERS}, v AS (SELECT doc_id, track, count(DISTINCT predicted) AS n FROM s GROUP BY 1, 2) SELECT track, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS unanimous FROM v GROUP BY 1")
def unanimous_share(spark, d):
    v = scored(spark, d).groupBy("doc_id", "track").agg(F.count_distinct("predicted").alias("n"))
    return v.groupBy("track").agg(F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("unanimous"))


@query("screen_verdict", f"WITH {ANSWERS}, c AS (SELECT source, predicted, count(*) AS n FROM s GROUP BY 1, 2), g AS (SELECT source, sum(n) AS kept, max(n) / sum(n)::DOUBLE AS top FROM c GROUP BY 1) SELECT source, CASE WHEN kept < 4 THEN 'few' WHEN top >= 0.35 THEN 'skewed' ELSE 'keep' END AS verdict FROM g")
def screen_verdict(spark, d):
    c = scored(spark, d).groupBy("source", "predicted").agg(F.count("*").alias("n"))
    g = c.groupBy("source").agg(F.sum("n").alias("kept"), (F.max("n") / F.sum("n")).alias("top"))
    return g.select("source", F.when(F.col("kept") < 4, "few").when(F.col("top") >= 0.35, "skewed").otherwise("keep").alias("verdict"))


@query("no_fit", f"WITH {ANSWERS} SELECT model, count(*) AS n FROM a WHERE greatest(p0, p1, p2) - least(p0, p1, p2) <= 0.1 GROUP BY 1")
def no_fit(spark, d):
    flat = F.array_max("probs") - F.array_min("probs") <= 0.1
    return answers(spark, d).where(flat).groupBy("model").agg(F.count("*").alias("n"))


@query("route_units", f"WITH {ANSWERS}, v AS (SELECT doc_id, count(DISTINCT predicted) AS n FROM s GROUP BY 1) SELECT route, count(*) AS n FROM (SELECT CASE WHEN n > 1 THEN 'disputed' WHEN {u('audit', 'doc_id')} < 0.1 THEN 'sampled' ELSE 'agreed' END AS route FROM v) GROUP BY route")
def route_units(spark, d):
    v = scored(spark, d).groupBy("doc_id").agg(F.count_distinct("predicted").alias("n"))
    return v.select(F.when(F.col("n") > 1, "disputed").when(unit("audit", "doc_id") < 0.1, "sampled").otherwise("agreed").alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query("collect_gold", f"WITH {ANSWERS}, v AS (SELECT doc_id, count(DISTINCT predicted) AS n, min(predicted) AS p FROM s GROUP BY 1) SELECT v.doc_id, CASE WHEN l.quality IS NOT NULL THEN l.quality WHEN n = 1 THEN p END AS gold, CASE WHEN l.quality IS NOT NULL THEN 'known' WHEN n = 1 THEN 'agreed' ELSE 'open' END AS basis FROM v LEFT JOIN labels AS l ON v.doc_id = l.doc_id")
def collect_gold(spark, d):
    v = scored(spark, d).groupBy("doc_id").agg(F.count_distinct("predicted").alias("n"), F.min("predicted").alias("p")).join(table(spark, d, "labels"), "doc_id", "left")
    known, agreed = F.col("quality").isNotNull(), F.col("n") == 1
    return v.select("doc_id", F.when(known, F.col("quality")).when(agreed, F.col("p")).alias("gold"), F.when(known, "known").when(agreed, "agreed").otherwise("open").alias("basis"))


@query("confident_flags", f"""WITH {ANSWERS}, t AS (SELECT model, gold AS k, avg(pg) AS bar FROM sc GROUP BY 1, 2),
l AS (SELECT model, doc_id, gold, pg, unnest([0, 1, 2]) AS k, unnest([p0, p1, p2]) AS p FROM sc),
o AS (SELECT l.model, l.gold, l.k, row_number() OVER (PARTITION BY l.model, l.doc_id ORDER BY l.p DESC, l.k DESC) AS r FROM l JOIN t ON t.model = l.model AND t.k = l.k WHERE l.p >= t.bar),
j AS (SELECT model, gold, k, count(*) AS n FROM o WHERE r = 1 GROUP BY 1, 2, 3),
g AS (SELECT model, gold, count(*) AS n_given FROM sc GROUP BY 1, 2),
q AS (SELECT j.model, j.gold, j.k, round_even(n / sum(n) OVER (PARTITION BY j.model, j.gold)::DOUBLE * n_given, 0) AS quota FROM j JOIN g ON g.model = j.model AND g.gold = j.gold),
r AS (SELECT *, row_number() OVER (PARTITION BY model, gold, k ORDER BY p - pg DESC, doc_id DESC) AS rank FROM l WHERE k <> gold)
SELECT DISTINCT r.model, r.doc_id FROM r JOIN q ON q.model = r.model AND q.gold = r.gold AND q.k = r.k WHERE rank <= quota AND p > pg""")
def confident_flags(spark, d):
    return M.confident(scored(spark, d), "model", "doc_id")


@query("label_audit", f"WITH c AS (SELECT CASE WHEN {u('half', 'doc_id')} < 0.5 THEN 'public' ELSE 'private' END AS half, toxic, count(*) AS n FROM labels GROUP BY 1, 2) SELECT half, toxic, n, round(n / sum(n) OVER (PARTITION BY half)::DOUBLE, 6) AS share, n / sum(n) OVER (PARTITION BY half)::DOUBLE > 0.9 AS skewed FROM c")
def label_audit(spark, d):
    c = table(spark, d, "labels").groupBy(F.when(unit("half", "doc_id") < 0.5, "public").otherwise("private").alias("half"), "toxic").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("half"))
    return c.select("half", "toxic", "n", F.round(share, 6).alias("share"), (share > 0.9).alias("skewed"))


@query("answer_sanity", f"WITH {ANSWERS} SELECT model, round(avg(greatest(p0, p1, p2)), 6) AS mean_max, count(*) FILTER (WHERE greatest(p0, p1, p2) - 1 / 3.0::DOUBLE <= 0.02 AND 1 / 3.0::DOUBLE - least(p0, p1, p2) <= 0.02) AS near_uniform, round(stddev_pop(p0), 6) AS spread FROM a GROUP BY 1")
def answer_sanity(spark, d):
    third = F.lit(1 / 3.0)
    near = (F.array_max("probs") - third <= 0.02) & (third - F.array_min("probs") <= 0.02)
    return answers(spark, d).groupBy("model").agg(F.round(F.avg(F.array_max("probs")), 6).alias("mean_max"), F.count_if(near).alias("near_uniform"), F.round(F.stddev_pop(F.col("probs")[0]), 6).alias("spread"))


@query("seed_summary", f"WITH {ANSWERS} SELECT track, round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6) AS sd FROM (SELECT track, model, avg(hit) AS a FROM sc GROUP BY 1, 2) GROUP BY 1")
def seed_summary(spark, d):
    a = M.summary(scored(spark, d), ["track", "model"])
    return a.groupBy("track").agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)), 6).alias("sd"))


@query("result_diff", f"WITH {ANSWERS}, x AS (SELECT doc_id, predicted AS x FROM s WHERE model = 'm1' AND doc_id % 7 > 0), y AS (SELECT doc_id, predicted AS y FROM s WHERE model = 'm2' AND doc_id % 5 > 0) SELECT CASE WHEN x IS NULL THEN 'right only' WHEN y IS NULL THEN 'left only' WHEN x = y THEN 'same' ELSE 'differ' END AS verdict, count(*) AS n FROM x FULL JOIN y USING (doc_id) GROUP BY 1")
def result_diff(spark, d):
    s = scored(spark, d)
    x = s.where("model = 'm1' AND doc_id % 7 > 0").select("doc_id", F.col("predicted").alias("x"))
    y = s.where("model = 'm2' AND doc_id % 5 > 0").select("doc_id", F.col("predicted").alias("y"))
    verdict = F.when(F.col("x").isNull(), "right only").when(F.col("y").isNull(), "left only").when(F.col("x") == F.col("y"), "same").otherwise("differ")
    return x.join(y, "doc_id", "full_outer").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("observed_concurrency", "SELECT user_id, round(sum(value) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 6) AS concurrency FROM events GROUP BY user_id")
def observed_concurrency(spark, d):
    e = table(spark, d, "events").groupBy("user_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    elapsed = F.greatest(F.max(at) - F.min(at), F.lit(1.0))
    return e.agg(F.round(F.sum("value") / elapsed, 6).alias("concurrency"))

"""Queries over decisions: results with their gold and split, query-passage judgements, guard selection, saturation, packing, canonical JSON and quotas."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import keyed, unit
from ..operators import metrics as M
from ..operators import sampling
from .registry import h, query, table, u
from .scoring import ANSWERS, answers, scored

CONTEXT = 1024
RECALL_BAR = 0.5
QUOTA = 60


@query("item_gold_join", f"WITH {ANSWERS}, g AS (SELECT doc_id, toxic AS gold FROM labels WHERE toxic IS NOT NULL), p AS (SELECT doc_id, CASE WHEN {u('half', 'doc_id')} < 0.5 THEN 'public' ELSE 'private' END AS split FROM documents), r AS (SELECT model, doc_id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted FROM a) SELECT r.model, p.split, count(*) AS n_rows, count(*) FILTER (WHERE g.gold IS NULL) AS unscored, count(*) FILTER (WHERE r.predicted = g.gold) AS hits, round(avg(CASE WHEN r.predicted = g.gold THEN 1.0 WHEN g.gold IS NOT NULL THEN 0.0 END), 6) AS accuracy FROM r JOIN p ON r.doc_id = p.doc_id LEFT JOIN g ON r.doc_id = g.doc_id GROUP BY 1, 2")
def item_gold_join(spark, d):
    """Result rows with the split of their item (which each has to have) and its gold answer, if it has one; others stay unscored."""
    gold = table(spark, d, "labels").where("toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("item_gold"))
    splits = table(spark, d, "documents").select("doc_id", F.when(unit("half", "doc_id") < 0.5, "public").otherwise("private").alias("split"))
    rows = answers(spark, d).select("model", "doc_id", M.top("probs").alias("predicted"))
    joined = rows.join(splits, "doc_id").join(gold, "doc_id", "left").withColumn("hit", (F.col("predicted") == F.col("item_gold")).cast("int"))
    return joined.groupBy("model", "split").agg(F.count("*").alias("n_rows"), F.count_if(F.col("item_gold").isNull()).alias("unscored"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("accuracy"))


@query("join_qrels", f"WITH j AS (SELECT conv_id, turn, {h('qrel', 'conv_id')} % 3 AS score FROM conversations WHERE role = 'user') SELECT j.conv_id, j.turn, md5(q.text) AS question, md5(c.text) AS answer FROM j JOIN conversations AS q ON q.conv_id = j.conv_id AND q.turn = j.turn AND q.role = 'user' JOIN conversations AS c ON c.conv_id = j.conv_id AND c.turn = j.turn + 1 AND c.role = 'assistant' WHERE j.score > 0")
def join_qrels(spark, d):
    """Judgements with the texts of their question and passage; those of score 0 are no pairs. A question is a user's turn, its passage the reply."""
    turns = table(spark, d, "conversations")
    questions = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    corpus = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    judged = questions.select("conv_id", "turn", F.pmod(keyed("qrel", "conv_id"), F.lit(3)).alias("score")).where("score > 0")
    pairs = judged.join(questions, ["conv_id", "turn"]).join(corpus, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.md5(F.col("question").cast("binary")).alias("question"), F.md5(F.col("answer").cast("binary")).alias("answer"))


_GUARD = "c AS (SELECT model, count(*) FILTER (WHERE g AND f)::DOUBLE AS tp, count(*) FILTER (WHERE g AND NOT f)::DOUBLE AS fn, count(*) FILTER (WHERE NOT g AND f)::DOUBLE AS fp, count(*) FILTER (WHERE NOT g AND NOT f)::DOUBLE AS tn FROM (SELECT model, toxic = 1 AS g, p0 >= 0.4 AS f FROM a JOIN labels USING (doc_id) WHERE toxic IS NOT NULL) GROUP BY 1), m AS (SELECT model, tp / greatest(tp + fn, 1) AS recall, tn / greatest(tn + fp, 1) AS passed, (2 * tp / greatest(2 * tp + fn + fp, 1) + 2 * tn / greatest(2 * tn + fn + fp, 1)) / 2 AS f1 FROM c)"


@query("confusion_guard", f"WITH {ANSWERS}, {_GUARD}, v AS (SELECT model, avg(hit) AS dev FROM sc GROUP BY 1), x AS (SELECT model, recall, passed, f1, recall >= {RECALL_BAR}::DOUBLE AS qualifies, CASE WHEN recall >= {RECALL_BAR}::DOUBLE THEN dev ELSE -1 END AS first FROM m JOIN v USING (model)) SELECT model, round(recall, 6) AS attack_recall, round(passed, 6) AS benign_pass_rate, round(f1, 6) AS macro_f1, qualifies, row_number() OVER (ORDER BY qualifies DESC, first DESC, f1 DESC, model DESC) = 1 AS chosen FROM x")
def confusion_guard(spark, d):
    """Attack recall, benign pass rate and macro F1 of each model's flags; of the models that reach the recall bar the best by score is chosen, else the best by macro F1."""
    rows = answers(spark, d).join(table(spark, d, "labels").where("toxic IS NOT NULL"), "doc_id").select("model", (F.col("toxic") == 1).alias("g"), (F.col("probs")[0] >= 0.4).alias("f"))
    n = lambda g, f: F.count_if((F.col("g") == F.lit(g)) & (F.col("f") == F.lit(f))).cast("double")
    c = rows.groupBy("model").agg(n(True, True).alias("tp"), n(True, False).alias("fn"), n(False, True).alias("fp"), n(False, False).alias("tn"))
    f1 = lambda x: 2 * F.col(x) / F.greatest(2 * F.col(x) + F.col("fn") + F.col("fp"), F.lit(1.0))
    m = c.select("model", (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1.0))).alias("recall"), (F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), F.lit(1.0))).alias("passed"), ((f1("tp") + f1("tn")) / 2).alias("f1"))
    m = m.join(M.summary(scored(spark, d), ["model"]).select("model", F.col("accuracy").alias("dev")), "model").withColumn("qualifies", F.col("recall") >= RECALL_BAR)
    best = m.agg(F.max(F.struct("qualifies", F.when(F.col("qualifies"), F.col("dev")).otherwise(F.lit(-1.0)).alias("first"), "f1", "model")).alias("b")).select(F.col("b.model").alias("best"))
    out = m.join(best, F.col("model") == F.col("best"), "left")
    return out.select("model", F.round("recall", 6).alias("attack_recall"), F.round("passed", 6).alias("benign_pass_rate"), F.round("f1", 6).alias("macro_f1"), "qualifies", F.col("best").isNotNull().alias("chosen"))


@query("saturated_datasets", f"WITH {ANSWERS}, r AS (SELECT track, model, {h('seed', 'doc_id')} % 3 AS seed, avg(hit) AS a FROM sc GROUP BY 1, 2, 3), b AS (SELECT track, model, avg(a) AS mean, coalesce(stddev_samp(a), 0) AS sd FROM r GROUP BY 1, 2) SELECT track, round(max(mean) - min(mean), 6) AS spread, round(max(sd), 6) AS noise, max(mean) - min(mean) < max(sd) AS saturated FROM b GROUP BY 1")
def saturated_datasets(spark, d):
    """Datasets (tracks) on which the models' means differ by less than one model's runs do."""
    runs = scored(spark, d).groupBy("track", "model", F.pmod(keyed("seed", "doc_id"), F.lit(3)).alias("seed")).agg(F.avg("hit").alias("a"))
    means = runs.groupBy("track", "model").agg(F.avg("a").alias("mean"), F.coalesce(F.stddev_samp("a"), F.lit(0.0)).alias("sd"))
    spread, noise = F.max("mean") - F.min("mean"), F.max("sd")
    return means.groupBy("track").agg(F.round(spread, 6).alias("spread"), F.round(noise, 6).alias("noise"), (spread < noise).alias("saturated"))


@query("pack_windows", f"WITH t AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \\n]+')) + 1 AS n FROM documents), c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS e, sum(n) OVER (PARTITION BY source) AS total FROM t), x AS (SELECT source, doc_id, e - n AS b, e, total, unnest(range(CAST((e - n) // {CONTEXT} AS BIGINT), CAST((e - 1) // {CONTEXT} AS BIGINT) + 1)) AS win FROM c) SELECT source, win, count(*) AS documents, min(doc_id) AS first_id, CAST(sum(least(e, (win + 1) * {CONTEXT}) - greatest(b, win * {CONTEXT})) AS BIGINT) AS tokens FROM x WHERE (win + 1) * {CONTEXT} <= total GROUP BY 1, 2")
def pack_windows(spark, d):
    """Documents of a source, each with a separator behind it, cut into windows of CONTEXT tokens; the tail that fills none is dropped."""
    n = (F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))) + 1).cast("bigint")
    t = sampling.running(table(spark, d, "documents").select("doc_id", "source", n.alias("n")), "source", "doc_id", "n")
    t = t.withColumn("win", F.explode(F.sequence(F.floor(F.col("before") / CONTEXT), F.floor((F.col("before") + F.col("n") - 1) / CONTEXT)))).where((F.col("win") + 1) * CONTEXT <= F.col("total"))
    inside = F.least(F.col("before") + F.col("n"), (F.col("win") + 1) * CONTEXT) - F.greatest("before", F.col("win") * CONTEXT)
    return t.groupBy("source", "win").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"), F.sum(inside).alias("tokens"))


@query("canonical_json", "SELECT event_id, sha256('{' || (SELECT string_agg(to_json(k) || ':' || CAST(json_extract(props, '$.\"' || k || '\"') AS VARCHAR), ',' ORDER BY k) FROM (SELECT unnest(json_keys(props)) AS k)) || '}') AS id FROM events")
def canonical_json(spark, d):
    """Digest of the canonical form of a JSON object: keys in order, no blanks; numbers and strings as they are."""
    return table(spark, d, "events").select("event_id", F.sha2(F.to_json(F.parse_json("props")), 256).alias("id"))


@query("half_half_quota_select", f"WITH {ANSWERS}, v AS (SELECT doc_id, source, avg(p0) >= 0.4 AS claim FROM a GROUP BY 1, 2), n AS (SELECT claim, source, count(*) AS n FROM v GROUP BY 1, 2), q AS (SELECT claim, source, floor({QUOTA // 2} * n / sum(n) OVER (PARTITION BY claim)::DOUBLE + 0.5::DOUBLE) AS quota FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY claim, source ORDER BY {h('quota', 'doc_id')}, doc_id) AS k FROM v), sel AS (SELECT doc_id, source, claim, row_number() OVER (PARTITION BY claim ORDER BY CASE WHEN k <= quota THEN 0 ELSE 1 END, {h('quota', 'doc_id')}, doc_id) AS j FROM r JOIN q USING (claim, source)) SELECT doc_id, source, claim FROM sel WHERE j <= {QUOTA // 2}")
def half_half_quota_select(spark, d):
    """Half claims (by the mean vote) and half others, each dealt to the sources in proportion by rounding; what rounding or
    small sources leave open is filled from the other rows in hash order. Only as many rows as are wanted are ranked."""
    want = QUOTA // 2
    v = answers(spark, d).groupBy("doc_id", "source").agg((F.avg(F.col("probs")[0]) >= 0.4).alias("claim")).withColumn("h", keyed("quota", "doc_id"))
    n = v.groupBy("claim", "source").agg(F.count("*").alias("n"))
    quota = n.withColumn("quota", F.floor(F.lit(want) * F.col("n") / F.sum("n").over(W.partitionBy("claim")) + 0.5)).drop("n")
    first = v.withColumn("k", F.row_number().over(W.partitionBy("claim", "source").orderBy("h", "doc_id"))).where(F.col("k") <= 2 * want)
    ranked = first.join(quota, ["claim", "source"]).withColumn("j", F.row_number().over(W.partitionBy("claim").orderBy((F.col("k") > F.col("quota")).cast("int"), "h", "doc_id")))
    return ranked.where(F.col("j") <= want).select("doc_id", "source", "claim")

"""Queries that need files, streams or longer compositions: sources and sinks, packing, label work, audits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import keyed, unit
from ..functions.votes import distribution
from ..operators import metrics as M
from ..operators import overlap, sampling
from ..operators.cut import shared_dir
from ..sources import files
from ..streaming import journal as streams
from .corpus import _BY_REF, _HITS, _gram_sql
from .registry import h, query, table, u
from .scoring import ANSWERS, answers, scored


def scratch(spark) -> str:
    """A new folder that all executors share: in the session's, or a temporary one where all of Spark is in this process."""
    shared = shared_dir(spark)
    return f"{shared}/scratch-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="quernstone-")


_COUNTS = "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang"


def _counts(df):
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("read_parquet", _COUNTS)
def read_parquet(spark, d):
    return _counts(files.parquet(spark, f"{d}/documents.parquet", ["lang", "text"]))


@query("read_jsonl", _COUNTS)
def read_jsonl(spark, d):
    path = f"{scratch(spark)}/documents.jsonl"
    table(spark, d, "documents").write.json(path)
    return _counts(files.jsonl(spark, path, "doc_id long, text string, lang string, source string, n_chars long"))


@query("read_csv_tsv", _COUNTS)
def read_csv_tsv(spark, d):
    path = f"{scratch(spark)}/documents.tsv"
    table(spark, d, "documents").select("doc_id", "lang", "text").write.options(header=True, sep="\t", escape='"').csv(path)
    return _counts(files.csv(spark, path, ["doc_id", "lang", "text"], sep="\t"))


@query("read_nested_json", "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2")
def read_nested_json(spark, d):
    path = f"{scratch(spark)}/nested.jsonl"
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns")).write.json(path)
    nested = files.jsonl(spark, path, "conv_id long, turns array<struct<turn: long, role: string, text: string>>")
    return nested.select("conv_id", F.explode("turns").alias("t")).groupBy("conv_id", "t.role").agg(F.count("*").alias("n"))


@query("training_texts", "SELECT origin, count(*) AS n FROM (SELECT 'documents' AS origin FROM documents UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY origin")
def training_texts(spark, d):
    root = scratch(spark)
    for name in ("documents", "benchmark"):
        table(spark, d, name).select("text").write.json(f"{root}/{name}")
    return files.texts_under(spark, root).groupBy(F.element_at(F.split("file", "/"), -2).alias("origin")).agg(F.count("*").alias("n"))


@query("row_group_sample_scan", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY {h('block', 'doc_id')}, doc_id) AS k FROM documents) WHERE k <= 5")
def row_group_sample_scan(spark, d):
    blocks = table(spark, d, "documents").withColumn("block", F.floor(F.col("doc_id") / 100))
    return sampling.cap_per_group(blocks, "block", "doc_id", "block", 5).select("doc_id")


@query("write_partitioned_splits", f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN {u('split', 'doc_id')} < 0.1 THEN 'validation' WHEN {u('split', 'doc_id')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY split")
def write_partitioned_splits(spark, d):
    path = f"{scratch(spark)}/splits"
    files.write_splits(sampling.hash_split(table(spark, d, "documents"), "doc_id", "split", {"validation": 0.1, "test": 0.1, "train": 0.8}), path, "split")
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("journal_stream", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def journal_stream(spark, d):
    """The journal as a stream: each (user, type) counts once, however often it arrives."""
    return streams.first_seen(spark, d, "events", ["user_id", "event_type"], scratch(spark)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("contamination_stream", f"WITH {_gram_sql('r', 'item_id', 'benchmark')}, {_gram_sql('g', 'doc_id', 'documents')}, t AS (SELECT id, count(DISTINCT gram) AS n FROM r GROUP BY 1) SELECT g.id AS doc_id, r.id AS item_id, count(DISTINCT g.gram) / max(t.n)::DOUBLE AS share FROM g JOIN r ON g.gram = r.gram JOIN t ON t.id = r.id GROUP BY 1, 2")
def contamination_stream(spark, d):
    """Arriving documents against the benchmark's grams: a stream-static join."""
    return streams.contaminated(spark, d, scratch(spark))


@query("windowed_events", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    return streams.daily(spark, d, scratch(spark)).select("day", "event_type", "n", F.round("total", 4).alias("total"))


@query("surface_baseline", "WITH x AS (SELECT l.toxic AS gold, c.cue, CASE c.cue WHEN 'digits' THEN regexp_matches(text, '[0-9]') WHEN 'long' THEN length(text) > 1000 ELSE contains(text, chr(10)) END AS bin FROM documents JOIN labels AS l USING (doc_id), (VALUES ('digits'), ('long'), ('lines')) AS c(cue)), n AS (SELECT cue, bin, gold, count(*) AS n FROM x GROUP BY 1, 2, 3), g AS (SELECT *, sum(n) OVER (PARTITION BY cue, bin) AS t FROM n) SELECT cue, round(sum(n * ln((n + 1) / (t + 2)::DOUBLE)), 6) AS fit FROM g GROUP BY cue")
def surface_baseline(spark, d):
    t = F.col("text")
    cues = F.explode(F.array(*[F.struct(F.lit(n).alias("cue"), c.alias("bin")) for n, c in (("digits", t.rlike("[0-9]")), ("long", F.length(t) > 1000), ("lines", t.contains("\n")))]))
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("toxic").alias("gold"), cues.alias("x")).select("gold", "x.*")
    n = x.groupBy("cue", "bin", "gold").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(W.partitionBy("cue", "bin")))
    return n.groupBy("cue").agg(F.round(F.sum(F.col("n") * F.ln((F.col("n") + 1) / (F.col("t") + 2))), 6).alias("fit"))


@query("style_leak")
def style_leak(spark, d):
    """How well hashed character trigrams of whole texts tell the classes apart: accuracy on held-out rows of a logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram

    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.filter(F.split(F.lower("text"), ""), lambda c: c != "").alias("c"), F.col("quality").cast("double").alias("label"))
    x = sampling.fold_of(x, "doc_id", "style", 5)
    model = Pipeline(stages=[NGram(n=3, inputCol="c", outputCol="g"), HashingTF(numFeatures=4096, inputCol="g", outputCol="tf"), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=10, regParam=0.01)]).fit(x.where("fold <> 0"))
    scored_rows = model.transform(x.where("fold = 0"))
    return scored_rows.groupBy("label").agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("recall"), F.count("*").alias("n"))


@query("per_task_vote_report", f"WITH {ANSWERS} SELECT track, model, round(avg(greatest(p0, p1, p2)), 6) AS mean_top, count(*) AS n FROM a GROUP BY 1, 2")
def per_task_vote_report(spark, d):
    return answers(spark, d).groupBy("track", "model").agg(F.round(F.avg(F.array_max("probs")), 6).alias("mean_top"), F.count("*").alias("n"))


@query("ensemble_unanimous", f"WITH {ANSWERS} SELECT doc_id FROM s GROUP BY 1 HAVING count(DISTINCT predicted) = 1 AND count(*) = 3")
def ensemble_unanimous(spark, d):
    return scored(spark, d).groupBy("doc_id").agg(F.count_distinct("predicted").alias("k"), F.count("*").alias("n")).where("k = 1 AND n = 3").select("doc_id")


@query("freeze_splits", f"SELECT half, count(*) AS n FROM (SELECT CASE WHEN source IN ('src0', 'src1') THEN 'private' WHEN {u('freeze', 'doc_id')} < 0.5 THEN 'public' ELSE 'private' END AS half FROM documents) GROUP BY half")
def freeze_splits(spark, d):
    half = F.when(F.col("source").isin("src0", "src1"), "private").when(unit("freeze", "doc_id") < 0.5, "public").otherwise("private")
    return table(spark, d, "documents").groupBy(half.alias("half")).agg(F.count("*").alias("n"))


@query("scene_split", "SELECT source, CASE WHEN (dense_rank() OVER (ORDER BY source) - 1) % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT source FROM documents)")
def scene_split(spark, d):
    s = table(spark, d, "documents").select("source").distinct()
    return s.select("source", F.when((F.dense_rank().over(W.orderBy("source")) - 1) % 5 == 0, "validation").otherwise("train").alias("split"))


@query("agreement_with_intent", f"WITH {ANSWERS} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l.toxic IS NULL THEN 'missing' WHEN (p0 >= 0.5) = (l.toxic = 1) THEN 'agree' ELSE 'differ' END AS verdict FROM a LEFT JOIN labels AS l ON a.doc_id = l.doc_id WHERE model = 'm1') GROUP BY verdict")
def agreement_with_intent(spark, d):
    x = answers(spark, d).where("model = 'm1'").join(table(spark, d, "labels"), "doc_id", "left")
    verdict = F.when(F.col("toxic").isNull(), "missing").when((F.col("probs")[0] >= 0.5) == (F.col("toxic") == 1), "agree").otherwise("differ")
    return x.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("known_text_exclusion", "SELECT lang, count(*) AS n FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0') GROUP BY lang")
def known_text_exclusion(spark, d):
    x = table(spark, d, "documents").withColumn("k", F.md5(F.col("text").cast("binary")))
    return x.join(x.where("source = 'src0'").select("k").distinct(), "k", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@query("party_table", f"SELECT source, count(*) FILTER (WHERE {u('half', 'doc_id')} < 0.5) AS public, count(*) FILTER (WHERE {u('half', 'doc_id')} >= 0.5) AS private, round(avg(quality), 6) AS share FROM documents JOIN labels USING (doc_id) GROUP BY source")
def party_table(spark, d):
    public = unit("half", "doc_id") < 0.5
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count_if(public).alias("public"), F.count_if(~public).alias("private"), F.round(F.avg("quality"), 6).alias("share"))


@query("prior_weights", "WITH c AS (SELECT source, toxic, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share, sum(n) OVER (PARTITION BY source) AS total, sum(n) OVER (PARTITION BY toxic) / sum(n) OVER () AS nat FROM c) SELECT source, toxic, round(least(greatest((nat / share) * total / (total + 20) + 20 / (total + 20), 0.25), 4), 6) AS weight FROM s")
def prior_weights(spark, d):
    c = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source", "toxic").agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n").over(W.partitionBy("source"))
    natural = F.sum("n").over(W.partitionBy("toxic")) / F.sum("n").over(W.partitionBy())
    shrunk = natural / (F.col("n") / total) * total / (total + 20) + 20 / (total + 20)
    return c.select("source", "toxic", F.round(F.least(F.greatest(shrunk, F.lit(0.25)), F.lit(4.0)), 6).alias("weight"))


@query("smooth_ece")
def smooth_ece(spark, d):
    """Kernel-smoothed calibration error with automatic bandwidth: the bandwidth at which it equals the error itself.
    Confidences and residuals are summed on a grid first, so what is smoothed does not grow with the rows."""
    points = 200
    cell = F.least(F.floor(F.col("confidence") * points), F.lit(points - 1)).cast("int")
    grid = scored(spark, d).groupBy("model", cell.alias("cell")).agg(F.sum(F.col("hit") - F.col("confidence")).alias("r"), F.count("*").alias("n"))
    return grid.groupBy("model").applyInPandas(lambda g: _smooth(g, points), "model string, smooth_ece double, bandwidth double")


def _smooth(g, points):
    import numpy as np
    import pandas as pd

    x = (np.arange(points) + 0.5) / points
    r = np.zeros(points)
    r[g["cell"]] = g["r"] / g["n"].sum()

    def error(width):
        total = 0
        for shift in (x, -x, 2 - x):  # the kernel is reflected at 0 and 1
            total = total + np.exp(-((x[:, None] - shift[None, :]) ** 2) / (2 * width**2)) / (width * np.sqrt(2 * np.pi)) @ r
        return np.abs(total).mean()

    low, high = 1e-3, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if error(mid) > mid else (low, mid)
    return pd.DataFrame({"model": [g["model"].iloc[0]], "smooth_ece": [error(high)], "bandwidth": [high]})


@query("candidate_overlap", f"{_HITS}, a AS (SELECT item_id, count(DISTINCT ref_pos + k) / max(ref_n)::DOUBLE AS covered FROM hit, range(8) AS o(k) GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY share DESC, doc_id) AS j FROM {_BY_REF}) SELECT item_id, covered, doc_id AS best_doc, share AS best, covered > 0.5 AS drop FROM a JOIN b USING (item_id) WHERE j = 1")
def candidate_overlap(spark, d):
    """Per reference: covered by all documents together, its best covering document, and whether it is dropped."""
    hits = overlap.shared_grams(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")
    union = overlap.coverage(hits, ["item_id"], "ref_pos", "ref_n_tok").withColumnRenamed("fraction", "covered")
    best = overlap.coverage(hits, ["doc_id", "item_id"], "ref_pos", "ref_n_tok").groupBy("item_id").agg(F.max(F.struct("fraction", (-F.col("doc_id")).alias("d"))).alias("b"))
    return union.join(best, "item_id").select("item_id", "covered", (-F.col("b.d")).alias("best_doc"), F.col("b.fraction").alias("best"), (F.col("covered") > 0.5).alias("drop"))


@query("boilerplate", "WITH g AS (SELECT DISTINCT source, line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 20) SELECT line, count(*) AS sources FROM g GROUP BY line HAVING count(*) >= 3")
def boilerplate(spark, d):
    g = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).where("length(line) >= 20").distinct()
    return g.groupBy("line").agg(F.count("*").alias("sources")).where("sources >= 3")


def _stems_sql(table_, key, lang):
    listed = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in T.FUNCTION_WORDS.items()}
    every = "[" + ", ".join(f"'{w}'" for w in sorted({w for v in T.FUNCTION_WORDS.values() for w in v})) + "]"
    out = f"CASE lang {' '.join(f'WHEN {k!r} THEN {v}' for k, v in listed.items())} ELSE {every} END" if lang else every
    return f"(SELECT {key}, len(s) AS n, unnest(s) AS t FROM (SELECT {key}, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4 AND NOT list_contains({out}, w)), lambda w: substr(w, 1, 5))) AS s FROM {table_}))"


@query("stems_jaccard", f"WITH b AS (SELECT doc_id, item_id, x.n AS n, y.n AS m, count(*) AS c FROM {_stems_sql('documents', 'doc_id', True)} AS x JOIN {_stems_sql('benchmark', 'item_id', False)} AS y USING (t) GROUP BY 1, 2, 3, 4) SELECT doc_id, item_id, c / (n + m - c)::DOUBLE AS jaccard FROM b WHERE c / (n + m - c)::DOUBLE >= 0.05")
def stems_jaccard(spark, d):
    """Overlap of five-character stems of a document with its language's function words left out, against each item.
    Items, and documents of other languages, have no language to go by: the function words of all are left out."""
    listed = F.create_map(*[x for lang, words in T.FUNCTION_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))])
    every = F.array(*[F.lit(w) for w in sorted({w for words in T.FUNCTION_WORDS.values() for w in words})])
    stem = lambda df, key, out: df.select(key, F.array_distinct(F.transform(F.filter(T.tokens("text"), lambda w: (F.length(w) >= 4) & ~F.array_contains(out, w)), lambda w: F.substring(w, 1, 5))).alias("s"))
    each = lambda df, key, n: df.select(key, F.size("s").alias(n), F.explode("s").alias("t"))
    x = each(stem(table(spark, d, "documents"), "doc_id", F.coalesce(F.try_element_at(listed, F.col("lang")), every)), "doc_id", "n")
    y = each(stem(table(spark, d, "benchmark"), "item_id", every), "item_id", "m")
    # a Jaccard index of 0.05 needs sizes within a factor of 20
    both = x.join(y, "t").where("n <= 20 * m AND m <= 20 * n").groupBy("doc_id", "item_id", "n", "m").agg(F.count("*").alias("both"))
    return both.select("doc_id", "item_id", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("jaccard")).where("jaccard >= 0.05")


@query("expected_level", f"WITH {ANSWERS} SELECT doc_id, model, round(p1 + 2 * p2, 6) AS level, round(pow(p0, 0.5) / (pow(p0, 0.5) + pow(p1, 0.5) + pow(p2, 0.5)), 6) AS tempered FROM a")
def expected_level(spark, d):
    return answers(spark, d).select("doc_id", "model", F.round(F.col("probs")[1] + 2 * F.col("probs")[2], 6).alias("level"), F.round(M.temper(F.col("probs"), 2.0)[0], 6).alias("tempered"))


_OFF = f"(round({u('off', 'doc_id')} * 0.2::DOUBLE, 4) + 0.00005::DOUBLE)"


@query("parse_distribution", f"WITH {ANSWERS}, x AS (SELECT *, {h('mute', 'doc_id')} % 50 = 0 AS mute, {_OFF} AS off FROM a), y AS (SELECT *, CASE WHEN mute THEN 'no logprobs' WHEN off > 0.1 THEN 'low mass' END AS reason FROM x) SELECT doc_id, model, reason, CASE WHEN reason IS NULL THEN round(p0, 6) END AS a, CASE WHEN reason IS NULL THEN round(p1, 6) END AS b, CASE WHEN reason IS NULL THEN round(p2, 6) END AS c, CASE WHEN reason IS NULL THEN round(off, 6) END AS off_mass FROM y")
def parse_distribution(spark, d):
    """Judges' responses (made from the answers, as JSON) -> distribution over the options, and the mass off the letters."""
    x = answers(spark, d).withColumn("off", F.round(unit("off", "doc_id") * 0.2, 4) + 0.00005)
    p = lambda k, part: F.ln(F.col("probs")[k] * (1 - F.col("off")) * part)
    said = [(" A", p(0, 0.75)), ("a", p(0, 0.25)), ("(B)", p(1, 1.0)), ("C.", p(2, 1.0)), ("The", F.ln("off")), ("ı", F.lit(-20.0))]
    top = F.when(F.pmod(keyed("mute", "doc_id"), F.lit(50)) != 0, F.array(*[F.struct(F.lit(t).alias("token"), v.alias("logprob")) for t, v in said]))
    response = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(top.alias("top_logprobs"))).alias("content")).alias("logprobs"))).alias("choices")))
    r = x.select("doc_id", "model", response.alias("response")).select("doc_id", "model", distribution("response", 3).alias("r"))
    return r.select("doc_id", "model", "r.reason", *[F.round(F.get("r.probs", F.lit(k)), 6).alias(n) for k, n in enumerate("abc")], F.round("r.off_mass", 6).alias("off_mass"))

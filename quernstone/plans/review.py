"""Queries over reviews and rows on their way to training: audits, replaced votes, row checks, manifests, weights, mixes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import keyed, split_name, unit
from ..operators import metrics as M
from ..operators import sampling
from .registry import h, query, table, u
from .scoring import ANSWERS, answers, scored

#: Units of each stratum that an audit takes.
AUDIT = {"known_truth": 18, "unanimous": 70, "adjudicated": 100}
_SIZE = "CASE stratum " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in AUDIT.items()) + " END"
_FRAME = f"""v AS (SELECT doc_id, track, count(DISTINCT predicted) AS k, min(CASE WHEN model = 'm1' THEN predicted END) AS ai FROM s GROUP BY 1, 2),
f AS (SELECT doc_id, track, ai, CASE WHEN {h("known", "doc_id")} % 10 = 0 THEN 'known_truth' WHEN k = 1 THEN 'unanimous' ELSE 'adjudicated' END AS stratum FROM v WHERE {h("seen", "doc_id")} % 20 <> 0),
c AS (SELECT stratum, track, count(*) AS n, {_SIZE} AS size FROM f GROUP BY 1, 2),
e AS (SELECT *, size * n / sum(n) OVER (PARTITION BY stratum)::DOUBLE AS exact, least(size, sum(n) OVER (PARTITION BY stratum)) AS want FROM c),
q AS (SELECT stratum, track, least(n, floor(exact)) AS base, n, want, row_number() OVER (PARTITION BY stratum ORDER BY exact - floor(exact) DESC, track) AS place FROM e),
t AS (SELECT stratum, track, least(n, base + CASE WHEN place <= want - sum(base) OVER (PARTITION BY stratum) THEN 1 ELSE 0 END) AS take FROM q),
chosen AS (SELECT doc_id, track, stratum, ai FROM (SELECT *, row_number() OVER (PARTITION BY stratum, track ORDER BY {h("audit", "doc_id")}, doc_id) AS r FROM f) JOIN t USING (stratum, track) WHERE r <= take)"""


def audit_frame(spark, d):
    """Units that may be audited: doc_id, track, ai (the panel's first answer), stratum. What the owner has seen is outside."""
    v = scored(spark, d).groupBy("doc_id", "track").agg(F.count_distinct("predicted").alias("k"), F.min(F.when(F.col("model") == "m1", F.col("predicted"))).alias("ai"))
    known = F.pmod(keyed("known", "doc_id"), F.lit(10)) == 0
    f = v.where(F.pmod(keyed("seen", "doc_id"), F.lit(20)) != 0)
    return f.select("doc_id", "track", "ai", F.when(known, "known_truth").when(F.col("k") == 1, "unanimous").otherwise("adjudicated").alias("stratum"))


def audit_chosen(frame):
    """Of each stratum its size, dealt to the tracks by largest remainder and taken in hash order."""
    by = W.partitionBy("stratum")
    size = F.coalesce(*[F.when(F.col("stratum") == s, n) for s, n in AUDIT.items()])
    c = frame.groupBy("stratum", "track").agg(F.count("*").alias("n"))
    e = c.withColumns({"exact": size * F.col("n") / F.sum("n").over(by), "want": F.least(size, F.sum("n").over(by))}).withColumn("base", F.least("n", F.floor("exact")))
    e = e.withColumns({"place": F.row_number().over(by.orderBy(F.desc(F.col("exact") - F.floor("exact")), "track")), "left": F.col("want") - F.sum("base").over(by)})
    take = e.select("stratum", "track", F.least("n", F.col("base") + (F.col("place") <= F.col("left")).cast("int")).alias("take"))
    return sampling.hash_rank(frame, ["stratum", "track"], "audit", "doc_id").join(take, ["stratum", "track"]).where("_rank <= take").select("doc_id", "track", "stratum", "ai")


@query("audit_sample", f"WITH {ANSWERS}, {_FRAME} SELECT doc_id, track, stratum FROM chosen")
def audit_sample(spark, d):
    return audit_chosen(audit_frame(spark, d)).select("doc_id", "track", "stratum")


@query("audit_report", f"WITH {ANSWERS}, {_FRAME}, o AS (SELECT stratum, ai, CASE WHEN {h('unsure', 'doc_id')} % 12 = 0 THEN NULL WHEN {u('owner', 'doc_id')} < 0.85 THEN ai ELSE (ai + 1) % 3 END AS owner FROM chosen), g AS (SELECT stratum, count(*) AS drawn, count(owner) AS answered, count(*) - count(owner) AS ambiguous, count(*) FILTER (WHERE owner <> ai) AS differ FROM o GROUP BY 1), z AS (SELECT g.*, (SELECT count(*) FROM f WHERE f.stratum = g.stratum) AS size, differ / answered::DOUBLE AS rate, 1.959963984540054::DOUBLE AS z, answered::DOUBLE AS m FROM g) SELECT stratum, drawn, answered, ambiguous, differ, size, round(rate, 6) AS rate, round((rate + z * z / (2 * m) - z * sqrt(rate * (1 - rate) / m + z * z / (4 * m * m))) / (1 + z * z / m), 6) AS low, round((rate + z * z / (2 * m) + z * sqrt(rate * (1 - rate) / m + z * z / (4 * m * m))) / (1 + z * z / m), 6) AS high, round(sum(CASE WHEN stratum <> 'known_truth' THEN size * rate END) OVER () / sum(CASE WHEN stratum <> 'known_truth' THEN size END) OVER (), 6) AS pooled FROM z")
def audit_report(spark, d):
    """The owner's blind disagreement with the panel for each stratum of the audit, and pooled by the strata's sizes; an unsure answer is ambiguous, no disagreement."""
    frame = audit_frame(spark, d)
    sizes = frame.groupBy("stratum").agg(F.count("*").alias("size"))
    unsure = F.pmod(keyed("unsure", "doc_id"), F.lit(12)) == 0
    owner = F.when(~unsure, F.when(unit("owner", "doc_id") < 0.85, F.col("ai")).otherwise((F.col("ai") + 1) % 3))
    o = audit_chosen(frame).withColumn("owner", owner).groupBy("stratum")
    g = o.agg(F.count("*").alias("drawn"), F.count("owner").alias("answered"), (F.count("*") - F.count("owner")).alias("ambiguous"), F.count_if(F.col("owner") != F.col("ai")).alias("differ")).join(sizes, "stratum")
    low, high = M.wilson(F.col("differ"), F.col("answered"))
    every, blind = W.partitionBy(), F.col("stratum") != "known_truth"
    pooled = F.sum(F.when(blind, F.col("size") * F.col("differ") / F.col("answered"))).over(every) / F.sum(F.when(blind, F.col("size"))).over(every)
    r = {"rate": F.col("differ") / F.col("answered"), "low": low, "high": high, "pooled": pooled}
    return g.select("stratum", "drawn", "answered", "ambiguous", "differ", "size", *[F.round(c, 6).alias(n) for n, c in r.items()])


@query("replace_vote", f"WITH {ANSWERS}, x AS (SELECT a.doc_id, CASE WHEN a.track IN ('en', 'fr') THEN 'B,C' ELSE 'A,C' END AS judges, CASE WHEN a.track IN ('en', 'fr') THEN [b.p0, b.p1, b.p2] ELSE [a.p0, a.p1, a.p2] END AS p, [c.p0, c.p1, c.p2] AS q FROM a JOIN a AS b ON a.doc_id = b.doc_id AND a.model = 'm1' AND b.model = 'm2' JOIN a AS c ON a.doc_id = c.doc_id AND c.model = 'm3'), y AS (SELECT doc_id, judges, list_max(p) - list_min(p) <= 0.1 OR list_max(q) - list_min(q) <= 0.1 AS flat, (p[1] + q[1]) / 2 AS t0, (p[2] + q[2]) / 2 AS t1, (p[3] + q[3]) / 2 AS t2 FROM x) SELECT doc_id, judges, round(t0, 6) AS t0, round(t1, 6) AS t1, round(t2, 6) AS t2, CASE WHEN flat THEN 'no_fit' ELSE 'labelled' END AS outcome FROM y")
def replace_vote(spark, d):
    """Rows voted on by A and C. On the tasks whose texts A wrote, B's vote takes the place of A's; target and outcome (no_fit if a vote is flat) are made again."""
    judge = F.create_map(*[F.lit(x) for pair in (("m1", "A"), ("m2", "B"), ("m3", "C")) for x in pair])
    votes = F.sort_array(F.collect_list(F.struct(F.element_at(judge, F.col("model")).alias("judge"), "probs")))
    rows = answers(spark, d).groupBy("doc_id", "track").agg(votes.alias("v"))
    kept = F.filter("v", lambda x: x["judge"] != F.when(F.col("track").isin("en", "fr"), "A").otherwise("B"))
    r = rows.select("doc_id", kept.alias("v")).withColumn("t", F.transform(F.array(*map(F.lit, range(3))), lambda k: F.aggregate("v", F.lit(0.0), lambda a, x: a + F.get(x["probs"], k)) / F.size("v")))
    flat = F.exists("v", lambda x: F.array_max(x["probs"]) - F.array_min(x["probs"]) <= 0.1)
    return r.select("doc_id", F.array_join(F.transform("v", lambda x: x["judge"]), ",").alias("judges"), *[F.round(F.get("t", F.lit(k)), 6).alias(f"t{k}") for k in range(3)], F.when(flat, "no_fit").otherwise("labelled").alias("outcome"))


_FAULT = h("fault", "doc_id") + " % 40"


@query("row_validation", f"""WITH {ANSWERS}, r AS (SELECT doc_id, {_FAULT} AS fault, list(model ORDER BY model) AS judges, avg(p0) AS t0, avg(p1) AS t1, avg(p2) AS t2 FROM a GROUP BY 1),
b AS (SELECT doc_id, CASE fault WHEN 1 THEN judges[1:1] WHEN 2 THEN list_concat(judges, ['m1']) ELSE judges END AS judges, CASE fault WHEN 3 THEN [t0, t1] WHEN 4 THEN [t0 + 1, t1 - 1, t2] WHEN 5 THEN [t0 / 2, t1, t2] WHEN 6 THEN [t0, t1, t2, 0.0] ELSE [t0, t1, t2] END AS t FROM r)
SELECT doc_id, CASE WHEN len(t) <> 3 THEN 'keys' WHEN len(list_filter(t, lambda x: x < 0 OR x > 1)) > 0 THEN 'range' WHEN abs(list_sum(t) - 1) > 1e-3 THEN 'sum' WHEN len(judges) < 2 THEN 'judges' WHEN len(list_distinct(judges)) <> len(judges) THEN 'repeated judge' END AS reason FROM b""")
def row_validation(spark, d):
    """First reason why a labelled row (made from the answers, one in seven with a fault) is not valid; null if it is."""
    votes = F.sort_array(F.collect_list("model"))
    mean = [F.avg(F.col("probs")[k]) for k in range(3)]
    r = answers(spark, d).groupBy("doc_id").agg(votes.alias("judges"), *[m.alias(f"t{k}") for k, m in enumerate(mean)]).withColumn("fault", F.pmod(keyed("fault", "doc_id"), F.lit(40)))
    t0, t1, t2, zero = F.col("t0"), F.col("t1"), F.col("t2"), F.lit(0.0)
    is_ = lambda k: F.col("fault") == k
    t = F.when(is_(3), F.array(t0, t1)).when(is_(4), F.array(t0 + 1, t1 - 1, t2)).when(is_(5), F.array(t0 / 2, t1, t2)).when(is_(6), F.array(t0, t1, t2, zero)).otherwise(F.array(t0, t1, t2))
    judges = F.when(is_(1), F.slice("judges", 1, 1)).when(is_(2), F.concat("judges", F.array(F.lit("m1")))).otherwise(F.col("judges"))
    b = r.select("doc_id", judges.alias("judges"), t.alias("t"))
    return b.select("doc_id", row_fault("t", 3, "judges").alias("reason"))


def row_fault(target: str, options: int, judges: str):
    """Column: the first fault of a row's target and votes, or null."""
    total = F.aggregate(target, F.lit(0.0), lambda a, x: a + x)
    reason = F.when(F.size(target) != options, "keys").when(F.exists(target, lambda x: (x < 0) | (x > 1) | F.isnan(x)), "range").when(F.abs(total - 1) > 1e-3, "sum")
    return reason.when(F.size(judges) < 2, "judges").when(F.size(F.array_distinct(judges)) != F.size(judges), "repeated judge")


#: Terms of a licence, as its source shows it, that an allowed licence does not have.
DENIED = ["nc", "noncommercial", "nd", "noderivatives", "noderivs", "sa", "sharealike", "research", "academic", "gpl", "agpl", "lgpl", "odbl", "proprietary", "unknown", "unlicensed", "other"]
DENIED_PAIRS = ["non commercial", "share alike", "no derivatives", "no derivs", "all rights"]


def denied_terms(shown):
    """Column: the denied terms of a licence string, words first, each kind in order of appearance."""
    words = lambda w: F.filter(w, lambda x: x.isin(DENIED))
    pairs = lambda w: F.filter(F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))), lambda x: x.isin(DENIED_PAIRS))
    return T.let(F.regexp_extract_all(F.lower(shown), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.concat(words(w), pairs(w)))


def _denied_sql(shown):
    w = f"regexp_extract_all(lower({shown}), '[a-z0-9]+')"
    listed = lambda x: "(" + ", ".join(f"'{t}'" for t in x) + ")"
    return f"list_concat(list_filter({w}, lambda x: x IN {listed(DENIED)}), list_filter(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]), lambda x: x IN {listed(DENIED_PAIRS)}))"


@query("licence_predicate", f"SELECT array_to_string({_denied_sql('line')}, ',') AS denied, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(lower(line), 'licen[cs]e|rights reserved') GROUP BY 1")
def licence_predicate(spark, d):
    """Lines that show a licence, by the denied terms in them."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.lower("line").rlike("licen[cs]e|rights reserved"))
    return lines.groupBy(F.array_join(denied_terms(F.col("line")), ",").alias("denied")).agg(F.count("*").alias("n"))


#: Licences that an entry may have.
ALLOWED = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "ODC-By-1.0"]
#: An invented manifest of the pages, with an entry for each kind of finding.
ENTRIES = [
    ("example.com/en/", "https://example.com", "CC BY 4.0", "CC-BY-4.0"),
    ("example.net/", "https://example.net", "MIT License", "MIT"),
    ("example.net/de/", "https://example.net", "CC0", "CC0-1.0"),
    ("example.org/", "https://example.org", "cc-by-nc-4.0", "CC-BY-4.0"),
    ("example.com/fr/", "example.com", "MIT License", "MIT"),
    ("example.com/es/", "https://example.com", "", "MIT"),
    ("/example.com/de/", "https://example.com", "MIT License", "MIT"),
    ("example.com/../de/", "https://example.com", "GPL", "GPL-3.0"),
]
_FILE = "regexp_extract(url, '([a-z]+[.][a-z]+/[^?#]*)', 1)"
_PROBLEMS = f"list_filter([CASE WHEN path = '' OR source = '' OR shown = '' OR id = '' THEN 'missing field' END, CASE WHEN starts_with(path, '/') OR contains('/' || path, '/../') THEN 'path' END, CASE WHEN id NOT IN ({', '.join(repr(a) for a in ALLOWED)}) THEN 'licence not allowed' END, CASE WHEN len({_denied_sql('shown')}) > 0 THEN 'denied terms ' || array_to_string({_denied_sql('shown')}, ' ') END, CASE WHEN NOT regexp_matches(source, '^https?://') THEN 'source' END], lambda x: x IS NOT NULL)"


@query("manifest_checks", f"""WITH m(path, source, shown, id) AS (VALUES {', '.join(map(str, ENTRIES))}), c AS (SELECT *, {_PROBLEMS} AS found FROM m), p AS (SELECT path, CASE WHEN found[1] = 'missing field' THEN found[1:1] ELSE found END AS found FROM c),
v AS (SELECT path FROM p WHERE len(found) = 0), x AS (SELECT DISTINCT {_FILE} AS f FROM pages)
SELECT 'entry' AS finding, path AS subject, unnest(found) AS detail, 1 AS n FROM p UNION ALL SELECT 'overlap', b.path, a.path, 1 FROM v AS a JOIN v AS b ON starts_with(b.path, a.path) AND a.path <> b.path
UNION ALL SELECT 'uncovered', split_part(f, '/', 1) || '/', '', count(*) FROM x WHERE NOT EXISTS (SELECT 1 FROM v WHERE starts_with(f, v.path)) GROUP BY 2""")
def manifest_checks(spark, d):
    """Findings on a manifest of the pages' files: faulty entries (which cover nothing), entries inside one another, and files that no
    valid entry covers. A file meets an entry by equality with one of its folders, so no pair of a file and an entry is tried."""
    m = spark.createDataFrame(ENTRIES, "path string, source string, shown string, id string")
    denied = denied_terms(F.col("shown"))
    missing = F.exists(F.array("path", "source", "shown", "id"), lambda x: x.isNull() | (x == ""))
    rest = [F.when(F.col("path").startswith("/") | F.concat(F.lit("/"), "path").contains("/../"), "path"), F.when(~F.col("id").isin(ALLOWED), "licence not allowed")]
    rest += [F.when(F.size(denied) > 0, F.concat(F.lit("denied terms "), F.array_join(denied, " "))), F.when(~F.col("source").rlike("^https?://"), "source")]
    p = m.select("path", F.when(missing, F.array(F.lit("missing field"))).otherwise(F.array_compact(F.array(*rest))).alias("found"))
    valid = p.where(F.size("found") == 0).select("path")
    parts = F.split("of", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i < F.size(parts), F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))).otherwise(F.col("of")))
    inside = lambda df: df.select("of", F.explode(F.array_distinct(folders)).alias("path"))
    files = table(spark, d, "pages").select(F.regexp_extract("url", "([a-z]+[.][a-z]+/[^?#]*)", 1).alias("of")).distinct()
    covered = inside(files).join(valid, "path", "left_semi").select("of").distinct()
    uncovered = files.join(covered, "of", "left_anti").groupBy(F.concat(F.substring_index("of", "/", 1), F.lit("/")).alias("subject")).agg(F.count("*").alias("n"))
    nested = inside(valid.select(F.col("path").alias("of"))).where("of <> path").join(valid, "path")
    out = p.select(F.lit("entry").alias("finding"), F.col("path").alias("subject"), F.explode("found").alias("detail"), F.lit(1).cast("bigint").alias("n"))
    out = out.union(nested.select(F.lit("overlap"), "of", "path", F.lit(1)))
    return out.union(uncovered.select(F.lit("uncovered"), "subject", F.lit(""), "n"))


#: What rows that are flagged or trivial weigh, and the share of a task's weight that its trivial rows keep at least.
FLAG_WEIGHT, TRIVIAL_WEIGHT, TRIVIAL_FLOOR = 0.25, 0.5, 0.1
_MARGINS = """mg AS (SELECT doc_id, track, gold, pg, pg - CASE gold WHEN 0 THEN greatest(p1, p2) WHEN 1 THEN greatest(p0, p2) ELSE greatest(p0, p1) END AS margin FROM sc WHERE model = 'm1'),
ct AS (SELECT track, margin AS cut FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY margin) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM mg) WHERE i = least(n - 1, floor(0.75::DOUBLE * n))),
tv AS (SELECT mg.*, margin >= cut AND margin > 0 AS trivial FROM mg JOIN ct USING (track))"""


def margins(rows):
    """Scored rows with `margin` (the label's probability less the highest other) and `trivial`: in the top quarter of its track, and right.
    The cut is the margin at which the running count of ties, from the top, reaches the quarter."""
    others = F.filter("probs", lambda x, i: i != F.col("gold"))
    mg = rows.withColumn("margin", F.get("probs", F.col("gold")) - F.array_max(others))
    ties = M._ties(mg.select("track", F.col("margin").alias("confidence"), "hit"), ["track"])
    wanted = F.col("all") - F.least(F.col("all") - 1, F.floor(F.lit(0.75) * F.col("all")))
    cut = ties.where(F.col("rows") >= wanted).groupBy("track").agg(F.max("confidence").alias("cut"))
    return mg.join(cut, "track").withColumn("trivial", (F.col("margin") >= F.col("cut")) & (F.col("margin") > 0)).drop("cut")


@query("trivial_rows", f"WITH {ANSWERS}, {_MARGINS} SELECT doc_id, track FROM tv WHERE trivial")
def trivial_rows(spark, d):
    return margins(scored(spark, d).where("model = 'm1'")).where("trivial").select("doc_id", "track")


@query("row_weights", f"WITH {ANSWERS}, {_MARGINS}, fl AS (SELECT *, pg < 0.1 AS flagged FROM tv), w0 AS (SELECT doc_id, track, trivial AND NOT flagged AS easy, CASE WHEN flagged THEN {FLAG_WEIGHT}::DOUBLE WHEN trivial THEN {TRIVIAL_WEIGHT}::DOUBLE ELSE 1.0::DOUBLE END AS w FROM fl), t AS (SELECT track, sum(CASE WHEN easy THEN w ELSE 0 END) < {TRIVIAL_FLOOR}::DOUBLE * sum(w) AS bound FROM w0 GROUP BY 1) SELECT doc_id, CASE WHEN easy AND bound THEN 1.0::DOUBLE ELSE w END AS weight FROM w0 JOIN t USING (track)")
def row_weights(spark, d):
    """Weights of training rows: flagged ones and trivial ones weigh less, unless a track's trivial rows would keep too small a share."""
    m = margins(scored(spark, d).where("model = 'm1'"))
    flagged = F.get("probs", F.col("gold")) < 0.1
    w = m.select("doc_id", "track", (F.col("trivial") & ~flagged).alias("easy"), F.when(flagged, FLAG_WEIGHT).when(F.col("trivial"), TRIVIAL_WEIGHT).otherwise(1.0).alias("w"))
    bound = w.groupBy("track").agg((F.sum(F.when(F.col("easy"), F.col("w")).otherwise(0.0)) < TRIVIAL_FLOOR * F.sum("w")).alias("bound"))
    return w.join(bound, "track").select("doc_id", F.when(F.col("easy") & F.col("bound"), 1.0).otherwise(F.col("w")).alias("weight"))


@query("memorised", f"WITH {ANSWERS}, m AS (SELECT model, track, median(brier) FILTER (WHERE {u('split', 'doc_id')} >= 0.2) AS trained, median(brier) FILTER (WHERE {u('split', 'doc_id')} < 0.2) AS unseen FROM sc GROUP BY 1, 2), r AS (SELECT *, trained / greatest(unseen, 1e-9) AS ratio FROM m WHERE trained IS NOT NULL AND unseen IS NOT NULL) SELECT model, track, round(trained, 6) AS trained, round(unseen, 6) AS unseen, round(ratio, 6) AS ratio, 2 * count(*) FILTER (WHERE ratio < 0.5) OVER (PARTITION BY model) > count(*) OVER (PARTITION BY model) AS memorised FROM r")
def memorised(spark, d):
    """Median Brier scores on trained and on unseen rows of each track; a model has memorised if they differ twofold on most tracks."""
    unseen = unit("split", "doc_id") < 0.2
    m = scored(spark, d).groupBy("model", "track").agg(F.median(F.when(~unseen, F.col("brier"))).alias("trained"), F.median(F.when(unseen, F.col("brier"))).alias("unseen"))
    r = m.dropna().withColumn("ratio", F.col("trained") / F.greatest("unseen", F.lit(1e-9)))
    most = 2 * F.count_if(F.col("ratio") < 0.5).over(W.partitionBy("model")) > F.count("*").over(W.partitionBy("model"))
    return r.select("model", "track", *[F.round(c, 6).alias(c) for c in ("trained", "unseen", "ratio")], most.alias("memorised"))


@query("mining", f"WITH {ANSWERS}, t AS (SELECT track, predicted, count(*) AS n, count(*) FILTER (WHERE {u('split', 'doc_id')} >= 0.2) AS train FROM s WHERE model = 'm2' GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, predicted) AS k, sum(n) OVER (PARTITION BY track) AS total FROM t) SELECT track, predicted AS majority, round(n / total::DOUBLE, 6) AS share, CAST(least(300, greatest(20, floor(train * 0.7::DOUBLE / (1 - 0.7::DOUBLE)))) AS BIGINT) AS target FROM m WHERE k = 1")
def mining(spark, d):
    """Of each template (track) the majority answer and how many rows with another answer are to be mined, within bounds."""
    t = scored(spark, d).where("model = 'm2'").groupBy("track", "predicted").agg(F.count("*").alias("n"), F.count_if(unit("split", "doc_id") >= 0.2).alias("train"))
    m = t.withColumns({"k": F.row_number().over(W.partitionBy("track").orderBy(F.desc("n"), "predicted")), "total": F.sum("n").over(W.partitionBy("track"))}).where("k = 1")
    wanted = F.floor(F.col("train") * 0.7 / (1 - F.lit(0.7)))
    return m.select("track", F.col("predicted").alias("majority"), F.round(F.col("n") / F.col("total"), 6).alias("share"), F.least(F.lit(300), F.greatest(F.lit(20), wanted)).cast("bigint").alias("target"))


_REVIEW = f"""r0 AS (SELECT doc_id, track, model, predicted AS proposed, {h("catch", "doc_id")} % 10 = 0 AS caught_unit, {h("flag", "doc_id")} % 15 = 0 AS flagged, {u("review", "doc_id")} AS r FROM s),
rv AS (SELECT *, (proposed + 1) % 3 AS shown, CASE WHEN flagged THEN NULL WHEN caught_unit AND r < 0.3 THEN (proposed + 1) % 3 WHEN r > 0.8 THEN (proposed + 2) % 3 ELSE proposed END AS answer FROM r0)"""


@query("review_report", f"WITH {ANSWERS}, {_REVIEW} SELECT track, model, count(*) FILTER (WHERE NOT caught_unit AND answer IS NOT NULL) AS answered, round(avg(CASE WHEN NOT caught_unit AND answer IS NOT NULL THEN CASE WHEN answer = proposed THEN 1.0 ELSE 0.0 END END), 6) AS agrees, count(*) FILTER (WHERE caught_unit) AS catch_items, count(*) FILTER (WHERE caught_unit AND answer = proposed) AS caught, count(*) FILTER (WHERE caught_unit AND answer = shown) AS took_the_wrong_answer FROM rv GROUP BY 1, 2")
def review_report(spark, d):
    """How often the reviewer agrees with what is proposed, and on catch items (shown with a wrong answer) whether they found the right
    one or took the wrong one; flagged units count for neither."""
    p, r = F.col("predicted"), F.col("r")
    x = scored(spark, d).select("track", "model", "predicted", unit("review", "doc_id").alias("r"), (F.pmod(keyed("catch", "doc_id"), F.lit(10)) == 0).alias("c"), (F.pmod(keyed("flag", "doc_id"), F.lit(15)) == 0).alias("flagged"))
    answer = F.when(~F.col("flagged"), F.when(F.col("c") & (r < 0.3), (p + 1) % 3).when(r > 0.8, (p + 2) % 3).otherwise(p))
    x = x.withColumn("answer", answer)
    c, agree = F.col("c"), F.col("answer") == p
    plain = ~c & F.col("answer").isNotNull()
    return x.groupBy("track", "model").agg(F.count_if(plain).alias("answered"), F.round(F.avg(F.when(plain, agree.cast("double"))), 6).alias("agrees"), F.count_if(c).alias("catch_items"), F.count_if(c & agree).alias("caught"), F.count_if(c & (F.col("answer") == (p + 1) % 3)).alias("took_the_wrong_answer"))


_DEV = "SELECT metric AS block, id, v FROM (SELECT a.doc_id AS id, unnest(['accuracy', 'brier']) AS metric, unnest([(a.hit - b.hit)::DOUBLE, a.brier - b.brier]) AS v FROM dv AS a JOIN dv AS b ON a.doc_id = b.doc_id AND a.model = 'm1' AND b.model = 'm3')"


def _dev_sql():
    from .scoring import DRAWS, _boot_sql

    return f"WITH {ANSWERS}, dv AS (SELECT * FROM sc WHERE {u('dev', 'doc_id')} < 0.3), {_boot_sql(DRAWS, 'dev', _DEV)}, o AS (SELECT block, avg(v) AS difference, count(*) AS n FROM x GROUP BY 1) SELECT block AS metric, n, round(difference, 6) AS difference, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m JOIN o USING (block) GROUP BY 1, 2, 3, o.difference"


@query("dev_compare", _dev_sql())
def dev_compare(spark, d):
    """A model and a panel (m1, m3) against the same human answers: paired differences of accuracy and Brier score with intervals from shared draws."""
    from .scoring import DRAWS

    dev = scored(spark, d).where(unit("dev", "doc_id") < 0.3)
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c).cast("double")))
    gains = F.array(*[F.struct(F.lit(n).alias("metric"), (of("m1", c) - of("m3", c)).alias("gain")) for n, c in (("accuracy", "hit"), ("brier", "brier"))])
    x = dev.groupBy("doc_id").agg(gains.alias("g")).select("doc_id", F.explode("g").alias("g")).select("doc_id", "g.*").where("gain IS NOT NULL")
    out = M.paired(x, ["metric"], "doc_id", "gain", DRAWS, "dev").join(x.groupBy("metric").agg(F.count("*").alias("n")), "metric")
    return out.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])


SHUFFLES = 2000
_RUNS = f"""p0 AS (SELECT doc_id, list(struct_pack(p := {h("place", "model || ':' || CAST(doc_id AS VARCHAR)")} % 3, c := hit) ORDER BY model) AS r FROM sc GROUP BY 1),
ob AS (SELECT doc_id, i, r[i].p AS p, r[i].c AS c FROM p0, range(1, 4) AS g(i)),
sx AS (SELECT doc_id, r, k, sha256('shuffle:' || CAST(k AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS hex FROM p0, range({SHUFFLES}) AS s(k)),
sh AS (SELECT k, unnest(list_transform(list_sort([struct_pack(u := substr(hex, 1, 8), p := r[1].p), struct_pack(u := substr(hex, 9, 8), p := r[2].p), struct_pack(u := substr(hex, 17, 8), p := r[3].p)]), lambda x: x.p)) AS p, unnest([r[1].c, r[2].c, r[3].c]) AS c FROM sx),
ct AS (SELECT -1 AS k, p, c, count(*)::DOUBLE AS o FROM ob GROUP BY 1, 2, 3 UNION ALL SELECT k, p, c, count(*) FROM sh GROUP BY 1, 2, 3),
al AS (SELECT k, p, c, coalesce(o, 0) AS o FROM (SELECT * FROM (SELECT DISTINCT k FROM ct), range(3) AS a(p), range(2) AS b(c)) AS g LEFT JOIN ct USING (k, p, c)),
ex AS (SELECT k, o, sum(o) OVER (PARTITION BY k, p) * sum(o) OVER (PARTITION BY k, c) / sum(o) OVER (PARTITION BY k) AS e, sum(o) OVER (PARTITION BY k) AS n FROM al),
cv AS (SELECT k, sqrt(sum(CASE WHEN e > 0 THEN (o - e) * (o - e) / e ELSE 0 END) / max(n)) AS v FROM ex GROUP BY 1)"""


@query("permutation_p", f"WITH {ANSWERS}, {_RUNS} SELECT round(max(CASE WHEN k < 0 THEN v END), 6) AS v, (1 + (SELECT count(*) FROM cv AS y WHERE y.k >= 0 AND y.v >= (SELECT v FROM cv AS z WHERE z.k < 0) - 1e-12)) / {SHUFFLES + 1}::DOUBLE AS p FROM cv")
def permutation_p(spark, d):
    """Does the gold answer's position decide whether a run is right? Cramer's V of the table of position by right, and its p by shuffles of the
    positions within each question. A shuffle orders a question's runs by parts of one hash; its table is counted as six partial sums."""
    places, right = range(3), range(2)
    runs = F.sort_array(F.collect_list(F.struct("model", F.pmod(keyed("place", "model", "doc_id"), F.lit(3)).cast("int").alias("p"), F.col("hit").alias("c"))))
    q = scored(spark, d).groupBy("doc_id").agg(runs.alias("r"))
    return M.position_effect(q, "doc_id", "r", list(places), list(right), SHUFFLES, "shuffle").select(F.round("v", 6).alias("v"), "p")

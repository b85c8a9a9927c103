"""Queries that make rows from texts: screens, subsamples, pairs, batches, indices of runs, archives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import keyed, unit
from ..operators import sampling
from ..sources import files
from .pipelines import _COUNTS, _counts, scratch
from .registry import h, query, table, u

_POOL = f"CASE WHEN {u('pool', 'doc_id')} < 0.2 THEN 'eval' ELSE 'train' END"
_HELD = f"{h('held', 'source')} % 4 = 0"
_ORDER = h("prefix", "source || ':' || CAST(doc_id AS VARCHAR)")


@query("shuffle_prefix", f"SELECT doc_id, source, CAST(k AS BIGINT) AS place, CASE WHEN held THEN 'heldout_task' WHEN pool = 'eval' THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}, doc_id) AS k FROM (SELECT doc_id, source, {_HELD} AS held, {_POOL} AS pool FROM documents) WHERE NOT held OR pool = 'eval') WHERE k <= 7")
def shuffle_prefix(spark, d):
    """A template's (source's) first texts in its own fixed order, each with its row's split; a larger number extends the same prefix.
    Templates that are held out see evaluation texts only."""
    x = table(spark, d, "documents").select("doc_id", "source", (F.pmod(keyed("held", "source"), F.lit(4)) == 0).alias("held"), (unit("pool", "doc_id") < 0.2).alias("eval")).where("eval OR NOT held")
    first = sampling._rank(x, ["source"], keyed("prefix", "source", "doc_id"), F.col("doc_id"), name="place").where("place <= 7")
    return first.select("doc_id", "source", F.col("place").cast("bigint").alias("place"), F.when(F.col("held"), "heldout_task").when(F.col("eval"), "validation").otherwise("train").alias("split"))


def refuse_if_any(df, shared, message: str):
    """df; the job fails if `shared` has a row."""
    found = shared.agg(F.count("*").alias("_found"))
    refused = F.when(F.col("_found") > 0, F.raise_error(F.concat(F.col("_found").cast("string"), F.lit(f" {message}"))).cast("boolean")).otherwise(True)
    return df.join(F.broadcast(found)).where(refused).drop("_found")


_SPLIT = f"CASE WHEN {u('promote', 'doc_id')} < 0.1 THEN 'validation' WHEN {u('promote', 'doc_id')} < 0.2 THEN 'heldout_task' ELSE 'train' END"


@query("promote_assert_disjoint", f"WITH x AS (SELECT doc_id, md5(text) AS k, length(text) >= 60 AS allowed, {_SPLIT} AS split FROM documents), r AS (SELECT * FROM x WHERE split = 'train' OR k NOT IN (SELECT k FROM x WHERE split = 'train' AND allowed)) SELECT split, count(*) FILTER (WHERE allowed) AS promoted, count(*) FILTER (WHERE NOT allowed) AS dropped_by_current_filters FROM r GROUP BY 1")
def promote_assert_disjoint(spark, d):
    """Rows filtered under the current rules, by split; refused if an evaluation row then shares a text with train. (The query's rows
    have lost such texts before; `refuse_if_any` is what checks.)"""
    x = sampling.hash_split(table(spark, d, "documents"), "doc_id", "promote", {"validation": 0.1, "heldout_task": 0.1, "train": 0.8})
    x = x.select("split", F.md5(F.col("text").cast("binary")).alias("k"), (F.length("text") >= 60).alias("allowed"))
    train = x.where("split = 'train' AND allowed").select("k")
    rows = x.where("split = 'train'").unionByName(x.where("split <> 'train'").join(train, "k", "left_anti"))
    counts = rows.groupBy("split").agg(F.count_if("allowed").alias("promoted"), F.count_if(~F.col("allowed")).alias("dropped_by_current_filters"))
    return refuse_if_any(counts, rows.where("split <> 'train' AND allowed").join(train, "k", "left_semi"), "evaluation rows share a text with train")


_TWO = f"""k0 AS (SELECT doc_id, lang, md5(text) AS k, {_SPLIT} AS split FROM documents), k1 AS (SELECT split, k, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM k0 GROUP BY 1, 2),
ev AS (SELECT * FROM k1 WHERE split = 'heldout_task' UNION ALL SELECT * FROM k1 WHERE split = 'validation' AND k NOT IN (SELECT k FROM k1 WHERE split = 'heldout_task')),
tr AS (SELECT * FROM k1 WHERE split = 'train' AND k NOT IN (SELECT k FROM ev)), sz AS (SELECT lang, count(*) AS size FROM tr GROUP BY 1),
ex AS (SELECT lang, 200 * size / sum(size) OVER ()::DOUBLE AS exact FROM sz), pl AS (SELECT *, floor(exact) AS f, row_number() OVER (ORDER BY exact - floor(exact) DESC, lang) AS j FROM ex),
qu AS (SELECT lang, f + CASE WHEN j <= 200 - sum(f) OVER () THEN 1 ELSE 0 END AS share FROM pl),
tk AS (SELECT tr.*, row_number() OVER (PARTITION BY lang ORDER BY {h('two', 'doc_id')}, doc_id) AS r FROM tr),
al AS (SELECT split, doc_id FROM ev UNION ALL SELECT split, doc_id FROM tk JOIN qu USING (lang) WHERE r <= share)"""


@query("two_pass_subsample", f"WITH {_TWO} SELECT split, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM al JOIN documents USING (doc_id) GROUP BY 1, 2")
def two_pass_subsample(spark, d):
    """Evaluation splits made disjoint first, then train's keys and labels read alone, freed of duplicates and leaks and sampled by label;
    only the rows chosen are read in full. The leak check is repeated on what comes out."""
    keys = table(spark, d, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("k"))
    keys = sampling.hash_split(keys, "doc_id", "promote", {"validation": 0.1, "heldout_task": 0.1, "train": 0.8})
    keys = keys.groupBy("split", "k").agg(F.min(F.struct("doc_id", "lang")).alias("f")).select("split", "k", "f.*")
    of = lambda s: keys.where(F.col("split") == s)
    ev = of("heldout_task").unionByName(of("validation").join(of("heldout_task").select("k"), "k", "left_anti").select(keys.columns))
    train = of("train").join(ev.select("k"), "k", "left_anti").select(keys.columns)
    taken = ev.unionByName(sampling.stratified_take(train, "lang", "doc_id", "two", 200).select(keys.columns))
    rows = table(spark, d, "documents").select("doc_id", "text").join(taken.select("doc_id", "split", "lang", "k"), "doc_id")
    leaks = taken.where("split = 'train'").join(ev.select("k"), "k", "left_semi")
    return refuse_if_any(rows.groupBy("split", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), leaks, "train rows share a text with an evaluation split")


@query("mix_recount", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {h('mix', 'doc_id')}, doc_id) AS k FROM documents), m AS (SELECT doc_id, source, lang FROM r WHERE k <= 30), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {h('cut', 'doc_id')}, doc_id) AS j FROM m), x AS (SELECT * FROM f WHERE source NOT IN ('src1', 'src2') OR floor(j * 0.5::DOUBLE) > floor((j - 1) * 0.5::DOUBLE)), t AS (SELECT source, count(*) AS n FROM x GROUP BY 1), p AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT x.source AS task, x.lang AS file, count(*) AS n, max(t.n) AS task_rows, max(t.n) = max(CASE WHEN x.source IN ('src1', 'src2') THEN floor(least(p.n, 30) * 0.5::DOUBLE) ELSE least(p.n, 30) END) AS as_recorded FROM x JOIN t ON x.source = t.source JOIN p ON x.source = p.source GROUP BY 1, 2")
def mix_recount(spark, d):
    """A mix made again (at most 30 rows of a task, of some tasks half), counted by task and file, against the totals on record: those
    that the cap and the fractions give."""
    x = table(spark, d, "documents").select("doc_id", "source", "lang")
    half = F.col("source").isin("src1", "src2")
    record = F.least(F.count("*"), F.lit(30))
    recorded = x.groupBy("source").agg(record.alias("r")).select("source", F.when(half, F.floor(F.col("r") * 0.5)).otherwise(F.col("r")).alias("recorded"))
    mixed = sampling.cap_per_group(x, "source", "doc_id", "mix", 30)
    mixed = sampling.systematic_fraction(mixed.where(half), "source", "doc_id", "cut", 0.5).unionByName(mixed.where(~half | F.col("source").isNull()))
    cells = mixed.groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("task_rows", F.sum("n").over(W.partitionBy("source")))
    out = sampling._match(cells, recorded, ["source"])
    return out.select(F.col("source").alias("task"), F.col("lang").alias("file"), "n", "task_rows", (F.col("task_rows") == F.col("recorded")).alias("as_recorded"))


#: What a written text may hold in brackets, and patterns that it may not hold. The lists are short and invented; both are parameters.
PLACEHOLDERS = ["NAME", "CITY", "DATE"]
SCREENS = {"real name": "(?i)\\b(acme|contoso|globex)\\b", "gambling": "(?i)\\b(casino|jackpot|roulette)\\b", "pointer": "(?i)\\b(see above|click here)\\b"}
_BRACKETS = "\\[([^\\[\\]\\n]{1,30})\\]"
_WRITTEN = f"SELECT q.conv_id, q.turn, 'Q: ' || q.text || chr(10) || 'A: ' || r.text || CASE {h('odd', 'q.conv_id')} % 12 WHEN 1 THEN ' [NAME]' WHEN 2 THEN ' [X9]' WHEN 3 THEN ' at the Casino' WHEN 4 THEN ' by ACME' WHEN 5 THEN ' click here' ELSE '' END AS text FROM conversations AS q JOIN conversations AS r ON q.conv_id = r.conv_id AND r.turn = q.turn + 1 AND q.role = 'user' AND r.role = 'assistant'"


def screen(text, placeholders: list[str], patterns: dict[str, str], low: int = 15, high: int = 1500, answer: str = "\nA: "):
    """Column: why a written text is dropped, or null."""
    unknown = F.exists(F.regexp_extract_all(text, F.lit(_BRACKETS), F.lit(1)), lambda x: ~F.trim(x).isin(placeholders))
    reason = F.when(~F.length(text).between(low, high), "length").when(unknown, "unknown bracket")
    for name, pattern in patterns.items():
        reason = reason.when(text.rlike(pattern), name)
    said = F.substring_index(text, answer, -1)
    return reason.when(text.contains(answer) & (F.size(F.regexp_extract_all(said, F.lit("[^ \\n]+"), F.lit(0))) < 4), "stub")


@query("text_screen", f"WITH x AS ({_WRITTEN}) SELECT conv_id, turn, CASE WHEN length(text) NOT BETWEEN 15 AND 1500 THEN 'length' WHEN len(list_filter(regexp_extract_all(text, '{_BRACKETS}', 1), lambda b: trim(b) NOT IN ('NAME', 'CITY', 'DATE'))) > 0 THEN 'unknown bracket' {' '.join(f'WHEN regexp_matches(text, {p!r}) THEN {n!r}' for n, p in SCREENS.items()).replace(chr(92) * 2, chr(92))} WHEN len(regexp_extract_all(string_split(text, chr(10) || 'A: ')[-1], '[^ \\n]+')) < 4 THEN 'stub' END AS reason FROM x")
def text_screen(spark, d):
    turns = table(spark, d, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    odd = F.create_map(*[F.lit(x) for k, t in enumerate([" [NAME]", " [X9]", " at the Casino", " by ACME", " click here"], 1) for x in (k, t)])
    added = F.coalesce(F.try_element_at(odd, F.pmod(keyed("odd", "conv_id"), F.lit(12)).cast("int")), F.lit(""))
    x = turns.where("role = 'user'").join(answers, ["conv_id", "turn"]).select("conv_id", "turn", F.concat(F.lit("Q: "), "text", F.lit("\nA: "), "a", added).alias("text"))
    return x.select("conv_id", "turn", screen(F.col("text"), PLACEHOLDERS, SCREENS).alias("reason"))


RUN, SHORT = 10, 5
_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _runs_sql(table_, key):
    return f"(SELECT {key} AS id, array_to_string(w[i:i + {RUN - 1}], ' ') AS run, i FROM (SELECT *, unnest(range(1, len(w) - {RUN - 2})) AS i FROM (SELECT {key}, {_W} AS w FROM {table_}) WHERE len(w) >= {RUN}))"


def _short_sql(table_, key):
    return f"(SELECT {key} AS id, array_to_string(w, ' ') AS run FROM (SELECT {key}, {_W} AS w FROM {table_}) WHERE len(w) BETWEEN {SHORT} AND {RUN - 1})"


@query("shingle_lookup", f"WITH ix AS (SELECT run, min(id) AS owner FROM {_runs_sql('benchmark', 'item_id')} WHERE run NOT IN (SELECT run FROM {_runs_sql('conversations', 'conv_id')}) GROUP BY 1), wh AS (SELECT run, min(id) AS owner FROM {_short_sql('benchmark', 'item_id')} WHERE run NOT IN (SELECT run FROM {_short_sql('conversations', 'conv_id')}) GROUP BY 1) SELECT id AS doc_id, owner, count(*) AS runs, false AS whole FROM {_runs_sql('documents', 'doc_id')} JOIN ix USING (run) GROUP BY 1, 2 UNION ALL SELECT id, owner, 1, true FROM {_short_sql('documents', 'doc_id')} JOIN wh USING (run)")
def shingle_lookup(spark, d):
    """What documents hold of texts that must not ship (the benchmark): ten-word runs, and texts of five to nine words as wholes. Runs that
    are public anyway (in conversations) are taken out of the index first. Runs meet as 64-bit hashes."""
    words = lambda name, key: table(spark, d, name).select(F.col(key).alias("id"), T.tokens("text").alias("w"))
    runs = lambda x: x.select("id", F.explode(T.gram_hashes("w", RUN)).alias("run"))
    short = lambda x: x.where(F.size("w").between(SHORT, RUN - 1)).select("id", F.xxhash64("w").alias("run"))
    held, public, docs = words("benchmark", "item_id"), words("conversations", "conv_id"), words("documents", "doc_id")
    out = []
    for cut, whole in ((runs, False), (short, True)):
        index = cut(held).groupBy("run").agg(F.min("id").alias("owner")).join(cut(public).distinct(), "run", "left_anti")
        out.append(cut(docs).join(index, "run").groupBy(F.col("id").alias("doc_id"), "owner").agg(F.count("*").alias("runs")).withColumn("whole", F.lit(whole)))
    return out[0].unionByName(out[1])


BUDGET, ROWS = 4096, 16
_N = "greatest(len(regexp_extract_all(text, '[^ \\n]+')), 1)"


@query("length_batches", f"""WITH RECURSIVE t AS (SELECT doc_id, CAST({_N} AS BIGINT) AS n FROM documents), hs AS (SELECT n, count(*) AS c, greatest(1, least({ROWS}, {BUDGET} // n)) AS k, row_number() OVER (ORDER BY n) AS r FROM t GROUP BY n),
w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS n, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS b0, CAST(0 AS BIGINT) AS c0, CAST(0 AS BIGINT) AS b1, CAST(0 AS BIGINT) AS c1
  UNION ALL SELECT hs.r, hs.n, hs.k, CASE WHEN w.c1 >= hs.k THEN w.b1 + 1 ELSE w.b1 END, CASE WHEN w.c1 >= hs.k THEN 0 ELSE w.c1 END,
    CASE WHEN w.c1 >= hs.k THEN w.b1 + 1 + (hs.c - 1) // hs.k ELSE w.b1 + (w.c1 + hs.c - 1) // hs.k END, CASE WHEN w.c1 >= hs.k THEN (hs.c - 1) % hs.k + 1 ELSE (w.c1 + hs.c - 1) % hs.k + 1 END FROM w JOIN hs ON hs.r = w.r + 1)
SELECT CAST(b0 + (c0 + i) // k AS BIGINT) AS batch, count(*) AS n, max(x.n) AS width, min(doc_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY doc_id) - 1 AS i FROM t) AS x JOIN w ON w.n = x.n AND w.r > 0 GROUP BY 1""")
def length_batches(spark, d):
    """Documents by length into batches of at most BUDGET padded tokens and ROWS rows, greedily. The greedy walk goes over the counts
    of the lengths, not over rows: within one length all batches but the first and last are full, so a row's batch is arithmetic."""
    t = table(spark, d, "documents").select("doc_id", F.greatest(F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))), F.lit(1)).cast("bigint").alias("n"), F.lit(1).alias("one"))
    walked = t.groupBy("n").agg(F.count("*").alias("c")).groupBy().applyInPandas(_walk, "n bigint, k bigint, b bigint, filled bigint")
    x = sampling.running(t, "n", "doc_id", "one").join(walked, "n")
    return x.groupBy((F.col("b") + F.floor((F.col("filled") + F.col("before")) / F.col("k"))).alias("batch")).agg(F.count("*").alias("n"), F.max("n").alias("width"), F.min("doc_id").alias("first_id"))


def _walk(lengths):
    """For each length: rows to a batch, the batch open when it begins and the rows already in it."""
    out, batch, filled = [], 0, 0
    for n, c in lengths.sort_values("n")[["n", "c"]].itertuples(index=False):
        k = max(1, min(ROWS, BUDGET // n))
        if filled >= k:
            batch, filled = batch + 1, 0
        out.append((n, k, batch, filled))
        batch, filled = batch + (filled + c - 1) // k, (filled + c - 1) % k + 1
    return pd.DataFrame(out, columns=["n", "k", "b", "filled"])


_STEMS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1), lambda w: substr(w, 1, 4)))"
_ITEMS = "it AS (SELECT item_id, s[1] AS question, list_transform(s[2:6], lambda x: lower(trim(x))) AS o FROM (SELECT item_id, list_filter(string_split_regex(text, '[.,]'), lambda x: trim(x) <> '') AS s FROM benchmark) WHERE len(s) >= 4)"


@query("item_flaws", f"WITH {_ITEMS}, p AS (SELECT item_id, max(len(list_intersect({_STEMS.format(x='o[i]')}, {_STEMS.format(x='o[j]')}))::DOUBLE / greatest(1, len(list_distinct(list_concat({_STEMS.format(x='o[i]')}, {_STEMS.format(x='o[j]')}))))) AS ov FROM it, range(1, 6) AS a(i), range(1, 6) AS b(j) WHERE i < j AND j <= len(o) GROUP BY 1) SELECT item_id, array_to_string(list_filter([CASE WHEN len(list_distinct(o)) < len(o) THEN 'repeated option' END, CASE WHEN list_max(list_transform(o, lambda x: length(x))) > 4 * list_min(list_transform(o, lambda x: length(x))) THEN 'length ratio' END, CASE WHEN len(list_filter(o, lambda x: length(x) > 3 AND contains(lower(question), x))) > 0 THEN 'named in the question' END, CASE WHEN ov > 0.5 THEN 'options overlap' END], lambda x: x IS NOT NULL), ',') AS flaws FROM it JOIN p USING (item_id)")
def item_flaws(spark, d):
    """Flaws of items as they are written: an option twice, one far longer than another, one named in the question, two of nearly the same
    stems. An item's first clause is its question, up to five more are its options."""
    s = F.filter(F.split("text", "[.,]"), lambda x: F.trim(x) != "")
    it = table(spark, d, "benchmark").select("item_id", s.alias("s")).where(F.size("s") >= 4)
    it = it.select("item_id", F.lower(F.get("s", F.lit(0))).alias("q"), F.transform(F.slice("s", 2, 5), lambda x: F.lower(F.trim(x))).alias("o"))
    stems = lambda x: F.array_distinct(F.transform(F.filter(T.tokens(x), lambda w: F.length(w) > 1), lambda w: F.substring(w, 1, 4)))
    it = it.withColumns({"st": F.transform("o", stems), "l": F.transform("o", F.length)})
    near = lambda x, y: F.size(F.array_intersect(x, y)) > 0.5 * F.size(F.array_union(x, y))
    overlap = F.exists(F.transform("st", lambda x, i: F.exists(F.slice("st", i + 2, F.size("st")), lambda y: near(x, y))), lambda b: b)
    flaws = {"repeated option": F.size(F.array_distinct("o")) < F.size("o"), "length ratio": F.array_max("l") > 4 * F.array_min("l"), "named in the question": F.exists("o", lambda x: (F.length(x) > 3) & F.col("q").contains(x)), "options overlap": overlap}
    return it.select("item_id", F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in flaws.items()])), ",").alias("flaws"))


@query("read_archive_member", _COUNTS)
def read_archive_member(spark, d):
    """Documents out of zip archives, one for each partition of the table."""
    path = scratch(spark)
    docs = table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "lang", "text")).alias("line"))
    docs.mapInPandas(files.zipped(path, "documents.jsonl"), "archive string").write.format("noop").mode("overwrite").save()
    rows = files.archive_lines(spark, path, "documents.jsonl").select(F.from_json("line", "doc_id long, lang string, text string").alias("r")).select("r.*")
    return _counts(rows)


@query("pinned_download", "SELECT 'nation' AS name, true AS ok UNION ALL SELECT 'region', false")
def pinned_download(spark, d):
    """Files against the digests that they are pinned to: nation to its own, region to another's."""
    read = lambda name: spark.read.format("binaryFile").load(f"{d}/{name}.parquet").select(F.sha2("content", 256)).first()[0]
    pin = read("nation")
    ok = [files.verified(spark, f"{d}/{name}.parquet", {f"{name}.parquet": pin}).select(F.lit(name).alias("name"), "ok") for name in ("nation", "region")]
    return ok[0].unionByName(ok[1])


_STEM = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4), lambda w: substr(w, 1, 5)))"
#: Postings longer than this are no keyword; pairs of a site and questions in all that are drawn.
MAX_DF, SITE_CAP, QUESTIONS = 50, 3, 60


@query("positive_negative_rows", f"""WITH pr AS (SELECT CAST(q.conv_id * 1000 + q.turn AS BIGINT) AS id, q.conv_id AS site, q.text AS q, r.text AS a, md5(r.text) AS ah FROM conversations AS q JOIN conversations AS r ON q.conv_id = r.conv_id AND r.turn = q.turn + 1 AND q.role = 'user' AND r.role = 'assistant'),
ps AS (SELECT id, site, ah, unnest({_STEM.format(x='a')}) AS s FROM pr), df AS (SELECT s, count(*) AS df FROM ps GROUP BY 1), n AS (SELECT count(*) AS n FROM pr),
sa AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {h('ask', 'id')}, id) AS o FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {h('ask', 'id')}, id) AS k FROM pr) WHERE k <= {SITE_CAP}) WHERE o <= {QUESTIONS}),
qs AS (SELECT id, site, ah, unnest({_STEM.format(x='q')}) AS s FROM sa),
sc AS (SELECT qs.id, ps.id AS j, max(CASE WHEN qs.site = ps.site THEN 0 ELSE 1 END) AS kind, sum(1000000 * n // df) AS score FROM qs JOIN ps USING (s) JOIN df USING (s), n WHERE ps.id <> qs.id AND ps.ah <> qs.ah AND (ps.site = qs.site OR df <= {MAX_DF}) GROUP BY 1, 2),
c AS (SELECT id, j, kind, -score AS w FROM sc UNION ALL SELECT sa.id, pr.id, 2, {h('any', 'pr.id')} FROM sa JOIN pr ON sa.site = pr.site AND sa.id <> pr.id AND sa.ah <> pr.ah
  UNION ALL SELECT id, j, 3, o FROM (SELECT sa.id, pr.id AS j, row_number() OVER (PARTITION BY sa.id ORDER BY {h('any', 'pr.id')}, pr.id) AS o FROM sa JOIN pr ON sa.site <> pr.site AND sa.ah <> pr.ah) WHERE o = 1),
b AS (SELECT id, j, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, w, j) AS k FROM c) WHERE k = 1)
SELECT id AS question, id AS answer, 1.0 AS target, 'own' AS kind FROM b UNION ALL SELECT id, j, 0.0, CASE kind WHEN 0 THEN 'same_site' WHEN 1 THEN 'keyword' WHEN 2 THEN 'same_site_any' ELSE 'random' END FROM b""")
def positive_negative_rows(spark, d):
    """Each sampled question with its own answer and its hardest negative: of the same site by shared rare stems, else of another site by
    a keyword, else any of the site, else the first in hash order that will do. The questions drawn are a bounded set, held against all answers."""
    turns = table(spark, d, "conversations")
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    pr = turns.where("role = 'user'").join(said, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("site"), F.col("text").alias("q"), "a", F.md5(F.col("a").cast("binary")).alias("ah"))
    stems = lambda c: F.explode(F.array_distinct(F.transform(F.filter(T.tokens(c), lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 5)))).alias("s")
    asked = sampling.hash_order_limit(sampling.cap_per_group(pr, "site", "id", "ask", SITE_CAP), "id", "ask", QUESTIONS)
    ps = pr.select(F.col("id").alias("j"), F.col("site").alias("jsite"), F.col("ah").alias("jah"), stems("a"))
    qs = F.broadcast(asked.select("id", "site", "ah", stems("q")))  # QUESTIONS questions
    df = ps.groupBy("s").agg(F.count("*").alias("df")).join(qs.select("s").distinct(), "s", "left_semi")
    n = pr.agg(F.count("*").alias("n"))
    idf = df.join(F.broadcast(n)).select("s", "df", F.floor(1000000 * F.col("n") / F.col("df")).alias("idf"))
    other = F.expr("j <> id AND jah <> ah")
    shared = ps.join(qs, "s").where(other).join(idf, "s").where(F.expr("jsite = site") | (F.col("df") <= MAX_DF))
    ranked = shared.groupBy("id", "j").agg(F.max(F.expr("CASE WHEN site = jsite THEN 0 ELSE 1 END")).alias("kind"), (-F.sum("idf")).alias("w"))
    few, every = F.broadcast(asked.select("id", "site", "ah")), pr.select(F.col("id").alias("j"), F.col("site").alias("jsite"), F.col("ah").alias("jah"))
    near = every.join(few, F.expr("jsite = site")).where(other).select("id", "j", F.lit(2).alias("kind"), keyed("any", "j").alias("w"))
    first = every.withColumn("h", keyed("any", "j")).join(few, F.expr("jsite <> site AND jah <> ah")).groupBy("id").agg(F.min(F.struct("h", "j")).alias("m")).select("id", "m.j", F.lit(3).alias("kind"), F.lit(1).cast("bigint").alias("w"))
    best = ranked.unionByName(near).unionByName(first).groupBy("id").agg(F.min(F.struct("kind", "w", "j")).alias("b"))
    kinds = F.array(*[F.lit(k) for k in ("same_site", "keyword", "same_site_any", "random")])
    pos = best.select(F.col("id").alias("question"), F.col("id").alias("answer"), F.lit(1.0).alias("target"), F.lit("own").alias("kind"))
    return pos.unionByName(best.select(F.col("id").alias("question"), F.col("b.j").alias("answer"), F.lit(0.0).alias("target"), F.get(kinds, F.col("b.kind")).alias("kind")))


PARTY_TOTAL, PARTY_CAP = 120, 0.2
_PARTY = f"""tn AS (SELECT doc_id, source AS party, lang AS cell, text, len(regexp_extract_all(text, '[.!?]')) > 0 AS eligible FROM documents),
pc AS (SELECT party, cell, count(*) AS n, count(*) FILTER (WHERE eligible) AS room FROM tn GROUP BY 1, 2),
pn AS (SELECT party, least(floor({PARTY_TOTAL} * sum(n) / (SELECT count(*) FROM tn)::DOUBLE), floor({PARTY_TOTAL} * {PARTY_CAP}::DOUBLE)) AS quota FROM pc GROUP BY 1),
ce AS (SELECT pc.*, quota, quota * n / sum(n) OVER (PARTITION BY party)::DOUBLE AS exact FROM pc JOIN pn USING (party)),
cq AS (SELECT *, floor(exact) AS f, row_number() OVER (PARTITION BY party ORDER BY exact - floor(exact) DESC, cell) AS j FROM ce),
cs AS (SELECT party, cell, room, least(room, f + CASE WHEN j <= quota - sum(f) OVER (PARTITION BY party) THEN 1 ELSE 0 END) AS share FROM cq),
ovl AS (SELECT DISTINCT id FROM {_runs_sql('documents', 'doc_id')} WHERE run IN (SELECT run FROM {_runs_sql('benchmark', 'item_id')})),
rk AS (SELECT tn.doc_id, tn.party, tn.cell, share, row_number() OVER (PARTITION BY tn.party, tn.cell ORDER BY {h('draw', 'tn.doc_id')}, tn.doc_id) AS r FROM tn JOIN cs ON tn.party = cs.party AND tn.cell = cs.cell WHERE eligible),
rs AS (SELECT *, row_number() OVER (PARTITION BY party, cell ORDER BY r) AS k FROM rk WHERE r <= share + greatest(2, ceil(share * 0.5::DOUBLE)) AND doc_id NOT IN (SELECT id FROM ovl))"""


@query("parliament_draw", f"WITH {_PARTY} SELECT doc_id, party, cell, r > share AS reserve FROM rs WHERE k <= share")
def parliament_draw(spark, d):
    """A draw of turns (documents) by party (source) and cell (language). A party's quota follows its turns, capped; its cells share the
    quota by largest remainder, each up to its eligible turns. Each cell has a pool of its share and a reserve in hash order; turns that
    overlap the benchmark in a ten-word run leave it, and the reserve moves up."""
    docs = table(spark, d, "documents")
    tn = docs.select("doc_id", F.col("source").alias("party"), F.col("lang").alias("cell"), F.col("text").rlike("[.!?]").alias("eligible"))
    pc = tn.groupBy("party", "cell").agg(F.count("*").alias("n"), F.count_if("eligible").alias("room"))
    by = W.partitionBy("party")
    turns = F.sum("n").over(by)
    quota = F.least(F.floor(PARTY_TOTAL * turns / F.sum("n").over(W.partitionBy())), F.lit(int(PARTY_TOTAL * PARTY_CAP)))
    ce = pc.withColumns({"quota": quota, "turns": turns}).withColumn("exact", F.col("quota") * F.col("n") / F.col("turns")).withColumn("f", F.floor("exact"))
    cq = ce.withColumns({"j": F.row_number().over(by.orderBy(F.desc(F.col("exact") - F.col("f")), "cell")), "left": F.col("quota") - F.sum("f").over(by)})
    cs = cq.select("party", "cell", F.least("room", F.col("f") + (F.col("j") <= F.col("left")).cast("int")).alias("share"))
    ranked = sampling._match(sampling.hash_rank(tn.where("eligible").drop("eligible"), ["party", "cell"], "draw", "doc_id"), cs, ["party", "cell"])
    pool = ranked.where("share > 0 AND _rank <= share + greatest(2, ceil(share * 0.5D))")
    runs = lambda x: x.select("id", F.explode(T.gram_hashes("w", RUN)).alias("run"))
    held = runs(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.tokens("text").alias("w"))).select("run").distinct()
    drawn = docs.select("doc_id", "text").join(pool.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), T.tokens("text").alias("w"))
    overlapping = runs(drawn).join(held, "run", "left_semi").select(F.col("id").alias("doc_id")).distinct()
    left = pool.join(overlapping, "doc_id", "left_anti").withColumn("k", F.row_number().over(W.partitionBy("party", "cell").orderBy("_rank")))
    return left.where("k <= share").select("doc_id", "party", "cell", (F.col("_rank") > F.col("share")).alias("reserve"))


#: A word in at least FREQUENT places may be part of a glued one, which has at least GLUED letters and fewer than RARE places.
FREQUENT, GLUED, RARE = 50, 6, 5
_GLUE = f"""wc AS (SELECT w, count(*) AS n FROM (SELECT unnest({_W}) AS w FROM documents) GROUP BY 1), fq AS (SELECT w AS part FROM wc WHERE n >= {FREQUENT} AND length(w) >= 2),
ra AS (SELECT w FROM wc WHERE n < {RARE} AND length(w) >= {GLUED}), sp AS (SELECT w, b, b + length(part) AS e FROM (SELECT w, unnest(range(0, length(w))) AS b FROM ra), fq WHERE substr(w, b + 1, length(part)) = part),
re AS (SELECT w, CAST(0 AS BIGINT) AS p, 0 AS parts FROM ra UNION SELECT re.w, CAST(sp.e AS BIGINT), re.parts + 1 FROM re JOIN sp ON sp.w = re.w AND sp.b = re.p),
gl AS (SELECT w, max(parts) AS parts FROM re WHERE p = length(w) GROUP BY 1 HAVING max(parts) >= 2)"""


def glued_words(texts):
    """(w, parts): rare words that are two or more frequent ones run together, and the most there can be. Pieces of rare words meet the
    frequent words by equality; a walk over the pieces of a word that are left finds whether they cover it."""
    w = texts.select(F.explode(T.tokens("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    frequent = w.where((F.col("n") >= FREQUENT) & (F.length("w") >= 2)).select(F.col("w").alias("part"))
    longest = frequent.agg(F.max(F.length("part")).alias("longest"))
    rare = w.where((F.col("n") < RARE) & (F.length("w") >= GLUED)).select("w").join(F.broadcast(longest)).select("w", "longest", F.explode(F.sequence(F.lit(0), F.length("w") - 2)).alias("b"))
    pieces = rare.select("w", "b", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.col("longest"), F.length("w") - F.col("b"))))).alias("l")).select("w", "b", (F.col("b") + F.col("l")).alias("e"), F.expr("substring(w, b + 1, l)").alias("part"))
    found = pieces.join(frequent, "part", "left_semi").groupBy("w").agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("spans"))

    @F.pandas_udf("int")
    def parts(word: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for x, found_in in zip(word, spans):
            most = {0: 0}
            for span in found_in:
                if span["b"] in most:
                    most[span["e"]] = max(most.get(span["e"], 0), most[span["b"]] + 1)
            out.append(most.get(len(x), 0))
        return pd.Series(out, dtype="int32")

    return found.select("w", parts("w", "spans").alias("parts")).where("parts >= 2")


@query("ocr_glued", f"WITH RECURSIVE {_GLUE} SELECT w, parts FROM gl")
def ocr_glued(spark, d):
    return glued_words(table(spark, d, "documents"))


#: Patterns of sentences that are said in every session: short lists for the corpus's languages; a parameter.
PROCEDURAL = {"thanks": "thank|merci|danke|gracias", "greeting": "welcome|bonjour|willkommen|bienvenid", "chair": "the floor|la parole|das wort|la palabra", "vote": "all in favour|vote|stimmen|votación"}
_S = "regexp_replace(trim(raw), '\\s+', ' '{g})"
#: (reason, test in SQL): the first that holds is a sentence's reason; MATCH and {g} stand for what differs between engines.
REJECTS = [
    ("page_header", "MATCH(raw, '\\n[ ]*[0-9]+[ ]*\\n')"),
    ("hyphen_wrap", "MATCH(raw, '\\p{L}-\\n|\\x{AD}')"),
    ("ocr_spacing", "MATCH(s, '(^| )(\\p{L} ){4,}')"),
    ("stage_note", "MATCH(lower(s), '[(](applause|laughter|beifall|risas)[)]')"),
    ("speaker_line", "MATCH(s, '^\\p{Lu}[\\p{L} ]{2,40}:')"),
    ("capitals", "2 * length(regexp_replace(s, '[^\\p{Lu}]', ''{g})) > length(regexp_replace(s, '[^\\p{L}]', ''{g}))"),
    ("opening", "MATCH(lower(s), '^(dear|madame|meine damen|estimad)')"),
    *[(name, f"MATCH(lower(s), '{pattern}')") for name, pattern in PROCEDURAL.items()],
    ("start", "NOT MATCH(s, '^[\\p{Lu}0-9“\"‘«]')"),
    ("unfinished", "NOT MATCH(s, '[.!?][”\"’»]*$') OR MATCH(s, '([.][.]|…)[”\"’»]*$')"),
    ("unbalanced", "length(replace(s, '“', '')) <> length(replace(s, '”', '')) OR length(replace(s, '(', '')) <> length(replace(s, ')', ''))"),
    ("short", "length(s) - length(replace(s, ' ', '')) + 1 < 8"),
    ("long", "length(s) - length(replace(s, ' ', '')) + 1 > 40"),
    ("ocr_glued", "glued OR MATCH(s, '\\p{L}[0-9]+\\p{L}')"),
    ("names_person", "MATCH(s, '[^.!?] \\p{Lu}\\p{Ll}+ \\p{Lu}\\p{Ll}+')"),
]
_RAW = "[^.!?]+[.!?]*"


def _reject(match: str, g: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in REJECTS).replace("MATCH", match).replace("{g}", g) + " END"


@query("sentence_reject", f"WITH RECURSIVE {_GLUE}, st AS (SELECT doc_id, i, l[i] AS raw, {_S.replace('{g}', ', ' + repr('g')).replace('raw', 'l[i]')} AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_RAW}') AS l FROM documents)) WHERE trim(l[i], ' ' || chr(10)) <> ''), gs AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+')) AS w FROM st) WHERE w IN (SELECT w FROM gl)), j AS (SELECT st.*, gs.i IS NOT NULL AS glued FROM st LEFT JOIN gs USING (doc_id, i)) SELECT coalesce({_reject('regexp_matches', ', ' + repr('g'))}, 'kept') AS reason, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM j GROUP BY 1")
def sentence_reject(spark, d):
    """The first reason that holds against each sentence, from page headers to names."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    st = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_RAW), F.lit(0))).alias("i", "raw")).where("trim(' \n' FROM raw) <> ''").withColumn("s", F.regexp_replace(F.trim("raw"), "\\s+", " "))
    words = st.select("doc_id", "i", F.explode(F.array_distinct(T.tokens("s"))).alias("w"))
    gs = words.join(glued_words(docs).select("w"), "w", "left_semi").select("doc_id", "i").distinct().withColumn("glued", F.lit(True))
    j = sampling._match(st, gs, ["doc_id", "i"], "left").withColumn("glued", F.coalesce("glued", F.lit(False)))
    reason = F.expr(_reject("regexp", "").replace("\\", "\\\\"))
    return j.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))

"""Queries over the corpus: filters, deduplication, splits, samples, joins and contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import content_id, keyed, unit
from ..operators import dedupe, overlap, sampling
from ..operators.cut import spread
from .registry import h, query, table, u


def docs(spark, d):
    return table(spark, d, "documents")


def texts(spark, d):
    """doc_id and text of documents, on all cores."""
    return spread(docs(spark, d).select("doc_id", "text"), "doc_id")


def labelled(spark, d):
    """documents with their labels, those that have them."""
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id")


LABELLED = "(SELECT * FROM documents JOIN labels USING (doc_id))"
NORM = "trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


@query("filter_length", "SELECT doc_id, length(text) AS chars, substr(text, 1, 200) AS head FROM documents WHERE length(text) BETWEEN 60 AND 1500")
def filter_length(spark, d):
    return docs(spark, d).where(F.length("text").between(60, 1500)).select("doc_id", F.length("text").cast("bigint").alias("chars"), F.substring("text", 1, 200).alias("head"))


_REASONS = [("stub", "length(text) < 100", "length(text) < 100"), ("markup", "text rlike '[#*]{3}'", "regexp_matches(text, '[#*]{3}')"), ("table", "text rlike ' [|] '", "regexp_matches(text, ' [|] ')"), ("mojibake", "text rlike '�|Ã.'", "regexp_matches(text, '�|Ã.')"), ("licence_line", "text rlike 'License'", "regexp_matches(text, 'License')")]


@query("filter_quality_rules", f"SELECT reason, count(*) AS n FROM (SELECT CASE {' '.join(f'WHEN {s} THEN {chr(39)}{n}{chr(39)}' for n, _, s in _REASONS)} ELSE 'kept' END AS reason FROM documents) GROUP BY reason")
def filter_quality_rules(spark, d):
    reason = F.expr(f"CASE {' '.join(f'WHEN {w} THEN {chr(39)}{n}{chr(39)}' for n, w, _ in _REASONS)} ELSE 'kept' END")
    return docs(spark, d).select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _votes_sql(lang):
    words = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS[lang])
    return f"len(list_filter(w, lambda x: x IN ({words})))"


@query("lang_filter", "WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), c AS (SELECT doc_id, lang, " + ", ".join(f"{_votes_sql(x)} AS {x}" for x in T.FUNCTION_WORDS) + " FROM t) SELECT lang, count(*) AS n, count(*) FILTER (WHERE en >= 2 AND en >= greatest(fr, de, es)) AS n_english FROM c GROUP BY lang")
def lang_filter(spark, d):
    t = docs(spark, d).select("lang", T.tokens("text").alias("w"))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.language_vote("w", "en")).alias("n_english"))


@query("content_removals", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) ")
def content_removals(spark, d):
    return docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("clean_text", f"SELECT doc_id, md5({NORM.replace('lower(text)', 'text')}) AS cleaned FROM documents")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.squash("text").cast("binary")).alias("cleaned"))


@query("mask_pii", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '<EMAIL>', 'g'), 'https?://[^ \n]+', '<URL>', 'g'), '[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){3,7}', '<IBAN>', 'g'), '\+[0-9][0-9 ().-]{6,}[0-9]', '<PHONE>', 'g'), '@[A-Za-z0-9_]{3,}', '<HANDLE>', 'g')) AS masked FROM documents")
def mask_pii(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.mask_pii("text").cast("binary")).alias("masked"))


_LUHN = "list_sum(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(r)[i] AS INTEGER) WHEN CAST(reverse(r)[i] AS INTEGER) > 4 THEN 2 * CAST(reverse(r)[i] AS INTEGER) - 9 ELSE 2 * CAST(reverse(r)[i] AS INTEGER) END)) % 10 = 0"


@query("pii_detect", r"WITH k AS (SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]') THEN 'email' END, CASE WHEN regexp_matches(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') THEN 'ip' END, CASE WHEN regexp_matches(text, '\+[0-9][0-9 ().-]{6,}[0-9]') THEN 'phone' END, CASE WHEN len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda r: length(r) BETWEEN 13 AND 19 AND " + _LUHN + ")) > 0 THEN 'card' END) AS kinds FROM documents) SELECT * FROM k WHERE kinds <> ''")
def pii_detect(spark, d):
    return docs(spark, d).select("doc_id", T.pii_kinds("text").alias("kinds")).where("kinds <> ''")


@query("hygiene", r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '�') THEN 'replacement' END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0E-\x1F]') THEN 'control' END, CASE WHEN regexp_matches(text, '&(amp|lt|gt|quot|#[0-9]+);') THEN 'entity' END, CASE WHEN regexp_matches(text, '\\[nrt]') THEN 'escaped' END, CASE WHEN regexp_matches(text, '\{\{|\}\}') THEN 'template' END, CASE WHEN regexp_matches(text, '[​‎‏﻿]') THEN 'invisible' END) AS flaws FROM documents""")
def hygiene(spark, d):
    return docs(spark, d).select("doc_id", T.hygiene("text").alias("flaws"))


@query("split_sentences")
def split_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.sentences("text")).alias("at", "sentence")).select("doc_id", "at", F.length("sentence").alias("chars"))


@query("content_ids", "SELECT doc_id, sha256(source || chr(0) || text) AS row_id FROM documents")
def content_ids(spark, d):
    return docs(spark, d).select("doc_id", content_id("source", "text").alias("row_id"))


@query("hash_split", f"SELECT split, lang, count(*) AS n, min(doc_id) AS first_id FROM (SELECT *, CASE WHEN {u('split', 'doc_id')} < 0.1 THEN 'validation' WHEN {u('split', 'doc_id')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY split, lang")
def hash_split(spark, d):
    s = sampling.hash_split(docs(spark, d), "doc_id", "split", {"validation": 0.1, "test": 0.1, "train": 0.8})
    return s.groupBy("split", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("fold_of", f"SELECT doc_id, CAST({h('fold', 'doc_id')} % 5 AS INTEGER) AS fold FROM documents")
def fold_of(spark, d):
    return sampling.fold_of(docs(spark, d), "doc_id", "fold", 5).select("doc_id", "fold")


@query("dedupe_exact_text", f"SELECT min(doc_id) AS doc_id, min(toxic) AS toxic, count(*) AS copies FROM {LABELLED} GROUP BY text HAVING count(DISTINCT toxic) <= 1")
def dedupe_exact_text(spark, d):
    return dedupe.exact_text(labelled(spark, d), "text", "toxic", "doc_id")


@query("dedupe_normalised", f"SELECT doc_id, split FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY CASE split WHEN 'validation' THEN 0 ELSE 1 END, doc_id) AS k FROM (SELECT doc_id, {NORM} AS norm, CASE WHEN {u('carve', 'doc_id')} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM documents)) WHERE k = 1")
def dedupe_normalised(spark, d):
    s = sampling.hash_split(docs(spark, d), "doc_id", "carve", {"validation": 0.1, "train": 0.9}).select("doc_id", "split", T.squash(F.lower("text")).alias("norm"))
    return dedupe.split_leaks(s, "norm", "split", "doc_id", {"validation": 0, "train": 1}).select("doc_id", "split")


@query("remove_split_leaks", f"SELECT split, count(*) AS n, min(doc_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, doc_id) AS k FROM (SELECT doc_id, lower(trim(text)) AS norm, CASE WHEN {u('leak', 'doc_id')} < 0.2 THEN 'test' WHEN {u('leak', 'doc_id')} < 0.4 THEN 'validation' ELSE 'train' END AS split FROM documents)) WHERE k = 1 GROUP BY split")
def remove_split_leaks(spark, d):
    s = sampling.hash_split(docs(spark, d), "doc_id", "leak", {"test": 0.2, "validation": 0.2, "train": 0.6}).select("doc_id", "split", F.lower(F.trim("text")).alias("norm"))
    return dedupe.split_leaks(s, "norm", "split", "doc_id", {"test": 0, "validation": 1, "train": 2}).groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("unique_rows", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)")
def unique_rows(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


@query("dedupe_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(spark, d):
    return dedupe.first_by(docs(spark, d), ["text"], ["source", "doc_id"]).select("doc_id")


@query("near_dup_pairs")
def near_dup_pairs(spark, d):
    return overlap.near_pairs(texts(spark, d), "doc_id", "text")


@query("dedupe_near_greedy")
def dedupe_near_greedy(spark, d):
    once = dedupe.first_by(docs(spark, d), ["text"], ["doc_id"])
    return dedupe.greedy_keep(once.select(F.col("doc_id").alias("id")), overlap.near_pairs(once, "doc_id", "text").select("a", "b")).select(F.col("id").alias("doc_id"))


@query("minhash_signature")
def minhash_signature(spark, d):
    return overlap.minhash(docs(spark, d), "doc_id", "text").select("doc_id", F.array_min("sig").alias("least"), F.array_max("sig").alias("most"))


_JACC = "WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM w GROUP BY item_id), s AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS c FROM w AS a JOIN w AS b ON a.t = b.t AND a.item_id < b.item_id GROUP BY 1, 2)"


@query("jaccard_selfjoin", _JACC + " SELECT s.a, s.b, round(c / (x.n + y.n - c)::DOUBLE, 6) AS jaccard FROM s JOIN n AS x ON s.a = x.item_id JOIN n AS y ON s.b = y.item_id WHERE c / (x.n + y.n - c)::DOUBLE >= 0.08")
def jaccard_selfjoin(spark, d):
    return _token_pairs(spark, d, 0.08).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _token_pairs(spark, d, least):
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens("text"))).alias("t"))
    n = w.groupBy("item_id").agg(F.count("*").alias("n"))
    s = w.alias("x").join(w.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.item_id") < F.col("y.item_id"))).groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).agg(F.count("*").alias("c"))
    s = s.join(n.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
    return s.withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).where(F.col("jaccard") >= least)


@query("connected_components")
def connected_components(spark, d):
    return dedupe.connected(_token_pairs(spark, d, 0.1))


def _gram_sql(name, key, source, n=8):
    return f"{name}_t AS (SELECT {key} AS id, list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1]) AS w FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source})), {name}_p AS (SELECT id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM {name}_t WHERE len(w) >= {n}), {name} AS (SELECT id, len(w) AS n, i - 1 AS pos, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM {name}_p)"


_HITS = f"WITH {_gram_sql('r', 'item_id', 'benchmark')}, {_gram_sql('g', 'doc_id', 'documents')}, hit AS (SELECT g.id AS doc_id, g.pos, g.n, r.id AS item_id, r.pos AS ref_pos, r.n AS ref_n FROM g JOIN r ON g.gram = r.gram)"
_COVER = "(SELECT {by}, count(DISTINCT {pos} + k) / max({n})::DOUBLE AS share FROM hit, range(8) AS o(k) GROUP BY {by})"
_BY_DOC, _BY_REF = _COVER.format(by="doc_id", pos="pos", n="n"), _COVER.format(by="doc_id, item_id", pos="ref_pos", n="ref_n")


@query("ngram_overlap_fraction", f"{_HITS} SELECT doc_id, round(share, 6) AS fraction FROM {_BY_DOC}")
def ngram_overlap_fraction(spark, d):
    hits = overlap.shared_grams(texts(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id")
    return overlap.coverage(hits, ["doc_id"], "pos", "n_tok").select("doc_id", F.round("fraction", 6).alias("fraction"))


@query("covers_reference", f"{_HITS} SELECT doc_id, item_id, round(share, 6) AS fraction FROM {_BY_REF} WHERE share > 0.5")
def covers_reference(spark, d):
    hits = overlap.shared_grams(texts(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id")
    return overlap.coverage(hits, ["doc_id", "item_id"], "ref_pos", "ref_n_tok").where("fraction > 0.5").select("doc_id", "item_id", F.round("fraction", 6).alias("fraction"))


@query("ngram_join", f"{_HITS} SELECT doc_id, count(DISTINCT item_id) AS n_refs, count(DISTINCT pos) AS n_grams FROM hit GROUP BY doc_id")
def ngram_join(spark, d):
    hits = overlap.shared_grams(texts(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id")
    return hits.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_refs"), F.count_distinct("pos").alias("n_grams"))


@query("contaminated_documents", f"{_HITS} SELECT doc_id, CAST(NULL AS BIGINT) AS item_id, 'ngram' AS rule, round(share, 6) AS share FROM {_BY_DOC} WHERE share > 0.5 UNION ALL SELECT doc_id, item_id, 'covers_reference', round(share, 6) FROM {_BY_REF} WHERE share > 0.5 UNION ALL SELECT a.id, b.id, 'whole', 1.0 FROM g_t AS a JOIN r_t AS b ON array_to_string(a.w, ' ') = array_to_string(b.w, ' ') AND len(a.w) > 0")
def contaminated_documents(spark, d):
    return overlap.contaminated(texts(spark, d), table(spark, d, "benchmark")).select("doc_id", "item_id", "rule", F.round("share", 6).alias("share"))


@query("set_rule", f"{_HITS}, c AS (SELECT item_id, count(DISTINCT ref_pos + k) / max(ref_n)::DOUBLE AS share FROM hit, range(8) AS o(k) GROUP BY item_id) SELECT (SELECT count(*) FROM benchmark) AS n_refs, count(*) AS n_over, count(*) / (SELECT count(*) FROM benchmark)::DOUBLE > 0.02 AS fails FROM c WHERE share > 0.5")
def set_rule(spark, d):
    return overlap.set_share(texts(spark, d), table(spark, d, "benchmark"))


@query("apply_removals", f"{_HITS} SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {_BY_DOC} WHERE share > 0.5) GROUP BY lang")
def apply_removals(spark, d):
    hits = overlap.shared_grams(texts(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id")
    bad = overlap.coverage(hits, ["doc_id"], "pos", "n_tok").where("fraction > 0.5").select("doc_id")
    return docs(spark, d).select("doc_id", "lang").join(bad, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@query("gram_cooccurrence_selfjoin", f"WITH {_gram_sql('g', 'doc_id', 'documents')}, d AS (SELECT DISTINCT id, gram FROM g), c AS (SELECT gram FROM d GROUP BY gram HAVING count(*) BETWEEN 2 AND 20), k AS (SELECT id, gram FROM d JOIN c USING (gram)), n AS (SELECT id, count(*) AS n FROM d GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM k AS a JOIN k AS b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2) SELECT a, b, shared, round(shared / least(x.n, y.n)::DOUBLE, 6) AS ratio FROM p JOIN n AS x ON a = x.id JOIN n AS y ON b = y.id WHERE shared / least(x.n, y.n)::DOUBLE >= 0.3")
def gram_cooccurrence_selfjoin(spark, d):
    """Grams as 64-bit hashes, distinct within their text at the source; lists of at most 20 texts for each gram give the pairs."""
    g = texts(spark, d).select("doc_id", F.array_distinct(T.gram_hashes(T.collapse_runs(T.tokens("text")), overlap.GRAM)).alias("g"))
    each = g.select(F.struct("doc_id", F.size("g").alias("n")).alias("x"), F.explode("g").alias("gram"))
    rare = each.groupBy("gram").agg(F.count("*").alias("c")).where("c BETWEEN 2 AND 20").select("gram")
    lists = each.join(rare, "gram").groupBy("gram").agg(F.sort_array(F.collect_list("x")).alias("l"))
    later = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = lists.select(F.explode(later).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared")).select("a.doc_id", F.col("b.doc_id").alias("b_id"), "shared", F.least("a.n", "b.n").alias("least")).toDF("a", "b", "shared", "least")
    ratio = F.col("shared") / F.col("least")
    return p.where(ratio >= 0.3).select("a", "b", "shared", F.round(ratio, 6).alias("ratio"))


@query("inverted_index_topk", "WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM documents), f AS (SELECT t, count(*) AS df FROM w GROUP BY t HAVING count(*) <= 0.02 * (SELECT count(*) FROM documents)), s AS (SELECT item_id, doc_id, count(*) AS shared, sum(CAST(1000000 / df AS BIGINT)) AS score FROM q JOIN f USING (t) JOIN w USING (t) GROUP BY 1, 2) SELECT item_id, doc_id, shared, CAST(score AS BIGINT) AS score, k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s) WHERE k <= 3".replace("1000000 / df", "floor(1000000 / df)"))
def inverted_index_topk(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens("text"))).alias("t"))
    w = texts(spark, d).select("doc_id", F.explode(F.array_distinct(T.tokens("text"))).alias("t"))
    total = docs(spark, d).agg(F.count("*").alias("total"))
    f = w.groupBy("t").agg(F.count("*").alias("df")).join(F.broadcast(total)).where("df <= 0.02 * total").select("t", F.floor(1000000 / F.col("df")).cast("bigint").alias("idf"))
    s = q.join(f, "t").join(w, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.sum("idf").alias("score"))
    return sampling._rank(s, ["item_id"], F.desc("score"), F.col("doc_id"), name="k").where("k <= 3").withColumn("k", F.col("k").cast("bigint"))


@query("substring_join", "WITH p AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.] ?')) AS piece FROM benchmark) SELECT item_id, doc_id, count(*) AS pieces FROM p JOIN documents AS d ON length(piece) >= 30 AND len(regexp_extract_all(piece, '[\\p{L}\\p{N}]+')) >= 5 AND contains(d.text, piece) GROUP BY 1, 2 HAVING count(*) >= 2".replace("regexp_split_to_array", "string_split_regex"))
def substring_join(spark, d):
    """Pieces (of five words or more) of an item inside a text: documents must first share three inner words of the piece."""
    p = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "[.] ?")).alias("piece")).where("length(piece) >= 30").distinct()
    anchor = lambda w: F.xxhash64(F.slice(w, 1, 3))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    p = p.withColumn("_w", words(F.col("piece"))).where(F.size("_w") >= 5).withColumn("a", F.xxhash64(F.slice("_w", 2, 3)))
    w = docs(spark, d).select("doc_id", words(F.col("text")).alias("_t")).where(F.size("_t") >= 3).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_t") - 2), lambda i: F.xxhash64(F.slice("_t", i, 3))))).alias("a"))
    p = p.select("item_id", "piece", "a")
    near = w.join(overlap._small(p, p.count()), "a").select("item_id", "piece", "doc_id").distinct()
    return near.join(docs(spark, d).select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("piece"))).groupBy("item_id", "doc_id").agg(F.count("*").alias("pieces")).where("pieces >= 2")


@query("join_exact_hash", "SELECT a.doc_id, min(b.doc_id) AS first_id FROM documents AS a JOIN documents AS b ON md5(trim(a.text)) = md5(trim(b.text)) AND b.source < a.source GROUP BY a.doc_id")
def join_exact_hash(spark, d):
    """Documents whose text an earlier source has, with the least such document: a row for each (text, source), so a hot text costs its sources, not its pairs."""
    from pyspark.sql import Window as W

    x = docs(spark, d).select("doc_id", "source", F.md5(F.trim("text").cast("binary")).alias("k"))
    per = x.groupBy("k", "source").agg(F.min("doc_id").alias("least"))
    first = per.withColumn("first_id", F.min("least").over(W.partitionBy("k").orderBy("source").rowsBetween(W.unboundedPreceding, -1)))
    return x.join(first.where("first_id IS NOT NULL").select("k", "source", "first_id"), ["k", "source"]).select("doc_id", "first_id")


@query("semi_joins", "SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_semi, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_anti FROM documents")
def semi_joins(spark, d):
    ids, known = docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id")
    n = lambda how, name: ids.join(known, "doc_id", how).agg(F.count("*").alias(name))
    return n("left_semi", "n_semi").join(n("left_anti", "n_anti"))


@query("union_sources", "SELECT origin, count(*) AS n FROM (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY origin")
def union_sources(spark, d):
    parts = [table(spark, d, t).select(F.lit(t).alias("origin"), "text") for t in ("documents", "benchmark", "conversations")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("origin").agg(F.count("*").alias("n"))


@query("intersect_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect_ids(spark, d):
    return docs(spark, d).select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("except_seen", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_seen(spark, d):
    return docs(spark, d).select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


SIZES = "(SELECT source, count(*) AS size FROM documents GROUP BY source)"


def sizes(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("size"))


@query("apportion", f"WITH e AS (SELECT source, size, 137 * size / sum(size) OVER ()::DOUBLE AS exact FROM {SIZES}), k AS (SELECT *, floor(exact) AS f, row_number() OVER (ORDER BY exact - floor(exact) DESC, source) AS k FROM e) SELECT source, size, CAST(f + CASE WHEN k <= 137 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM k")
def apportion(spark, d):
    return sampling.apportion(sizes(spark, d), "source", "size", 137)


@query("water_fill", f"WITH s AS (SELECT source, size FROM {SIZES}), c AS (SELECT max(x.c) AS cap FROM range(212) AS x(c) WHERE (SELECT sum(least(size, x.c)) FROM s) <= 211), k AS (SELECT source, size, least(size, cap) AS take, row_number() OVER (ORDER BY size DESC, source) AS j FROM s, c) SELECT source, size, CAST(take + CASE WHEN size > take AND j <= 211 - sum(take) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM k")
def water_fill(spark, d):
    return sampling.water_fill(sizes(spark, d), "source", "size", 211)


def _ranked(by, salt, where="", source="documents", key="doc_id"):
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {h(salt, key)}, {key}) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {source} {where})"


@query("mix_cap_per_task", f"SELECT doc_id, source FROM {_ranked('source', 'mix')} WHERE k <= 30")
def mix_cap_per_task(spark, d):
    return sampling.cap_per_group(docs(spark, d), "source", "doc_id", "mix", 30).select("doc_id", "source")


@query("cap_per_group_sample", f"SELECT doc_id FROM (SELECT *, row_number() OVER (ORDER BY {h('site', 'doc_id')}, doc_id) AS j FROM {_ranked('source', 'site')} WHERE k <= 10) WHERE j <= 100")
def cap_per_group_sample(spark, d):
    return sampling.hash_order_limit(sampling.cap_per_group(docs(spark, d), "source", "doc_id", "site", 10), "doc_id", "site", 100).select("doc_id")


@query("hash_order_limit", f"SELECT doc_id FROM documents ORDER BY {h('order', 'doc_id')}, doc_id LIMIT 50")
def hash_order_limit(spark, d):
    return sampling.hash_order_limit(docs(spark, d), "doc_id", "order", 50).select("doc_id")


@query("systematic_fraction", f"SELECT doc_id FROM {_ranked('lang', 'sys')} WHERE floor(k * 0.3::DOUBLE) > floor((k - 1) * 0.3::DOUBLE)")
def systematic_fraction(spark, d):
    return sampling.systematic_fraction(docs(spark, d), "lang", "doc_id", "sys", 0.3).select("doc_id")


@query("stratified_carve", f"SELECT doc_id, CASE WHEN k <= CASE WHEN n >= 2 THEN least(greatest(floor(n * 0.1::DOUBLE + 0.5::DOUBLE), 1), n - 1) ELSE 0 END THEN 'held' ELSE 'kept' END AS part FROM {_ranked('source', 'carve')}")
def stratified_carve(spark, d):
    return sampling.stratified_carve(docs(spark, d), "source", "doc_id", "carve", 0.1).select("doc_id", "part")


@query("stratified_take", f"WITH e AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), x AS (SELECT lang, 100 * size / sum(size) OVER ()::DOUBLE AS exact FROM e), k AS (SELECT *, floor(exact) AS f, row_number() OVER (ORDER BY exact - floor(exact) DESC, lang) AS j FROM x), q AS (SELECT lang, f + CASE WHEN j <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS share FROM k) SELECT doc_id FROM {_ranked('lang', 'take')} AS r JOIN q USING (lang) WHERE r.k <= share")
def stratified_take(spark, d):
    return sampling.stratified_take(docs(spark, d), "lang", "doc_id", "take", 100).select("doc_id")


@query("alternate_halves", f"SELECT doc_id, CASE WHEN k % 2 = 1 THEN 'public' ELSE 'private' END AS half FROM {_ranked('source', 'half')}")
def alternate_halves(spark, d):
    return sampling.alternate_halves(docs(spark, d), "source", "doc_id", "half").select("doc_id", "half")


@query("matched_cells", f"WITH c AS (SELECT lang, toxic, count(*) AS n FROM {LABELLED} GROUP BY 1, 2), l AS (SELECT lang, min(n) AS least FROM c GROUP BY lang HAVING count(*) = (SELECT count(DISTINCT toxic) FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY lang, toxic ORDER BY {h('cell', 'doc_id')}, doc_id) AS k FROM {LABELLED}) SELECT doc_id, lang, toxic FROM r JOIN l USING (lang) WHERE k <= least")
def matched_cells(spark, d):
    return sampling.matched_cells(labelled(spark, d), "lang", "toxic", "doc_id", "cell").select("doc_id", "lang", "toxic")


@query("cap_top_share", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY {h('cap', 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY lang, quality) AS n, count(*) OVER (PARTITION BY lang) AS total FROM {LABELLED}) SELECT doc_id, lang, quality FROM r WHERE k <= CASE WHEN n > 0.7::DOUBLE * total THEN floor(0.7::DOUBLE * (total - n) / (1 - 0.7::DOUBLE) + 1e-9) ELSE n END")
def cap_top_share(spark, d):
    return sampling.cap_top_share(labelled(spark, d), "lang", "quality", "doc_id", "cap", 0.7).select("doc_id", "lang", "quality")


@query("balanced_class_draw", f"WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {h('draw', 'doc_id')}, doc_id) AS k FROM labels) SELECT doc_id, toxic FROM r WHERE k <= (SELECT least(min(n), 30) FROM c) AND (SELECT count(*) FROM c) > 1")
def balanced_class_draw(spark, d):
    return sampling.balanced_class_draw(table(spark, d, "labels"), "toxic", "doc_id", "draw", 60).select("doc_id", "toxic")


@query("paired_draw", f"WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {h('pair', 'doc_id')}, doc_id) AS k FROM labels) SELECT a.k AS pair, a.doc_id AS positive, b.doc_id AS negative FROM r AS a JOIN r AS b ON a.k = b.k AND a.toxic = 1 AND b.toxic = 0 WHERE a.k <= 20")
def paired_draw(spark, d):
    return sampling.paired_draw(table(spark, d, "labels"), "toxic", "doc_id", "pair", 20).withColumn("pair", F.col("pair").cast("bigint"))


@query("stratified_round_robin", f"SELECT doc_id, source, k AS turn FROM {_ranked('source', 'robin')} WHERE k <= 3")
def stratified_round_robin(spark, d):
    return sampling.round_robin(docs(spark, d), "source", "doc_id", "robin").where("turn <= 3").select("doc_id", "source", F.col("turn").cast("bigint").alias("turn"))


@query("balanced_unit_halves")
def balanced_unit_halves(spark, d):
    units = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("size"), F.max("role").alias("stratum"))
    return sampling.balanced_unit_halves(units, "stratum", "conv_id", "size", "unit")


@query("round_robin_batches", f"SELECT batch, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 7 AS batch FROM documents) GROUP BY batch")
def round_robin_batches(spark, d):
    b = sampling.running(docs(spark, d).select("doc_id", "source", F.lit(1).alias("one")), "source", "doc_id", "one").withColumn("batch", F.col("before") % 7)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("topk_per_group", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 5")
def topk_per_group(spark, d):
    return sampling._rank(docs(spark, d), ["source"], F.desc("n_chars"), F.col("doc_id")).where("_rank <= 5").select("source", "doc_id", "n_chars")


@query("count_by", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((), (lang), (lang, source))")
def count_by(spark, d):
    docs(spark, d).createOrReplaceTempView("_count_by")
    return spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM _count_by GROUP BY GROUPING SETS ((), (lang), (lang, source))")


@query("tier_mixture", f"SELECT tier, count(*) AS n FROM (SELECT CASE WHEN {u('tier', 'event_id')} < 0.6 THEN 'A' WHEN {u('tier', 'event_id')} < 0.9 THEN 'B' ELSE 'C' END AS tier FROM events) GROUP BY tier")
def tier_mixture(spark, d):
    return sampling.hash_split(table(spark, d, "events"), "event_id", "tier", {"A": 0.6, "B": 0.3, "C": 0.1}).groupBy(F.col("split").alias("tier")).agg(F.count("*").alias("n"))


@query("token_shards", "WITH t AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \\n]+')) + 1 AS n FROM documents), c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS before FROM t) SELECT source, CAST(floor(before / 5000) AS BIGINT) AS shard, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY 1, 2")
def token_shards(spark, d):
    t = docs(spark, d).select("doc_id", "source", (F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))) + 1).cast("bigint").alias("n"))
    c = sampling.running(t, "source", "doc_id", "n")
    return c.groupBy("source", F.floor(F.col("before") / 5000).cast("bigint").alias("shard")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


@query("journal", "SELECT user_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last_type, count(*) AS n FROM events GROUP BY user_id")
def journal(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))


@query("reference_registry", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id")
def reference_registry(spark, d):
    turns = table(spark, d, "conversations").where("coalesce(text, '') <> ''")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


@query("rotate_options", f"SELECT doc_id, arg_min(o, {h('opt', 'key')}) AS first_option FROM (SELECT doc_id, o, CAST(doc_id AS VARCHAR) || ':' || o AS key FROM documents, (VALUES ('a'), ('b'), ('c'), ('d')) AS x(o)) GROUP BY doc_id")
def rotate_options(spark, d):
    options = F.array(*[F.struct(keyed("opt", "doc_id", F.lit(o)).alias("h"), F.lit(o).alias("o")) for o in "abcd"])
    return docs(spark, d).select("doc_id", F.array_min(options)["o"].alias("first_option"))


@query("drop_rare_labels_reindex", f"WITH s AS (SELECT source, CASE WHEN {u('rare', 'doc_id')} < 0.1 THEN 'test' ELSE 'train' END AS split FROM documents), b AS (SELECT source FROM s GROUP BY source HAVING count(DISTINCT split) = 2) SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS label FROM b")
def drop_rare_labels_reindex(spark, d):
    from pyspark.sql import Window as W

    s = sampling.hash_split(docs(spark, d), "doc_id", "rare", {"test": 0.1, "train": 0.9}).groupBy("source").agg(F.count_distinct("split").alias("n")).where("n = 2")
    return s.select("source", (F.dense_rank().over(W.orderBy("source")) - 1).cast("bigint").alias("label"))


@query("surface_features", r"SELECT doc_id, regexp_matches(text, '[0-9]') AS digits, regexp_matches(text, '\?') AS question, contains(text, chr(10)) AS lines, length(text) > 1000 AS long FROM documents")
def surface_features(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", t.rlike("[0-9]").alias("digits"), t.contains("?").alias("question"), t.contains("\n").alias("lines"), (F.length(t) > 1000).alias("long"))


@query("date_cells", "SELECT cell, count(*) AS n FROM (SELECT CASE WHEN month(o_orderdate) >= 10 THEN printf('%d-%d/%02d', year(o_orderdate), year(o_orderdate) + 1, month(o_orderdate)) ELSE printf('%d-%d/%02d', year(o_orderdate) - 1, year(o_orderdate), month(o_orderdate)) END AS cell FROM orders) GROUP BY cell")
def date_cells(spark, d):
    y = F.year("o_orderdate") - (F.month("o_orderdate") < 10).cast("int")
    return table(spark, d, "orders").groupBy(F.format_string("%d-%d/%02d", y, y + 1, F.month("o_orderdate")).alias("cell")).agg(F.count("*").alias("n"))


@query("data_card_counts", f"SELECT source, count(*) AS n, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def data_card_counts(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.count_distinct("lang").alias("langs"))

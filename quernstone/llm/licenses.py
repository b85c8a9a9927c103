"""License scan: an exact set-similarity join of license templates with the text blocks of all documents.

A block is a line; its set, like a template's, is of lower-cased words. A block meets a template T if it holds at least
ceil(THRESHOLD * |T|) of T's words (containment), whatever else it holds.

The join is prefix-filtered: words are ordered by their frequency over all blocks, rarest first, and a block that
meets T must hold one of the first |T| - ceil(THRESHOLD * |T|) + 1 words of T in that order. An index leads from each such
word to the templates that have it in their prefix, and only those are looked at. The length filter (as many template
words as T needs) and the positional filter (enough of them from the first shared prefix word on) follow, then the count
itself. Templates are a constant of bounded size, so they and their index are part of the plan and the join moves no
rows: the frequencies, one number for each template word, are all that is gathered.

Notices that wrap have no such line. Of a document whose words meet T together, the runs of as many words as T's text
has, over lines that follow one another without one that holds no word, are compared with T too, at the same threshold.
A run counts where none of its lines meets T alone; one that overlaps a run of a wider template is no finding.

Beside it, fixed phrases are found wherever their words follow one another, across lines and punctuation.

Defined results: a null or empty text has no words, no labels and the score 0; first_word and last_word are null
without a phrase; equal rows get equal results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scope, Staged, let, lower_ascii, passing

#: Word characters, before and after lower-casing A-Z.
W = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
NOT_W = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
THRESHOLD = 0.9
#: Phrases and the labels that they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels and license notices as their publishers word them, in the words that the scan compares.
TEMPLATES = [tuple(x.split("\t")) for x in Path(__file__).with_name("license_templates.tsv").read_text().splitlines() if x]
#: Words of all templates together; they are part of the plan, so a longer list is to be scanned for in parts.
TEMPLATE_WORDS = 20_000


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    need: int
    #: Words of the text, with repeats: the length of a run over several lines.
    length: int
    #: Places in the list of the templates whose words include all of this one's: where they meet, this one is no finding.
    above: tuple[int, ...] = ()


def templates(listed: list[tuple[str, str]], threshold: float) -> list[Template]:
    if sum(len(text.split()) for _, text in listed) > TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {TEMPLATE_WORDS} words")
    out = []
    for label, text in listed:
        words = tuple(dict.fromkeys(text.split()))
        out.append(Template(label, words, math.ceil(threshold * len(words) - 1e-9), len(text.split())))
    inside = lambda t: tuple(i for i, o in enumerate(out) if set(t.words) < set(o.words))
    return [replace(t, above=inside(t)) for t in out]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _phrase(phrase: str) -> str:
    return f"(?i)(?<!{W})" + f"{NOT_W}++".join(phrase.split()) + f"(?!{W})"


def _n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"{W}+"), F.lit(0))).cast("long")


def word_blocks(docs: DataFrame, listed: list[Template], text: str = "text") -> DataFrame:
    """docs with n_words, _blocks: of each line that has enough template words for some template, those words, and
    _wrapped: (label, score) of the templates that runs over several lines meet."""
    vocabulary = _strings(sorted({w for t in listed for w in t.words}))
    lines = F.transform(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda x: F.regexp_extract_all(x, F.lit(f"{W}+"), F.lit(0)))
    least = min(t.need for t in listed)
    out = docs.withColumn("_lines", lines)
    n_words = F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + F.size(x))
    held = F.transform("_lines", lambda x: F.array_intersect(x, vocabulary))
    blocks = lambda h: F.filter(h, lambda b: F.size(b) >= least)
    found = let(held, lambda h: F.struct(blocks(h).alias("blocks"), wrapped(F.col("_lines"), h, listed).alias("wrapped")))
    out = out.withColumns({"n_words": n_words, "_found": found})
    return out.withColumns({"_blocks": F.col("_found.blocks"), "_wrapped": F.col("_found.wrapped")}).drop("_lines", "_found")


def wrapped(lines: Column, held: Column, listed: list[Template]) -> Column:
    """Of one document, from the words of its lines and the template words of each: an array of (label, score) of the
    templates that are met by a run of words over several lines."""
    table = F.array(*[F.struct(F.lit(t.label).alias("label"), _strings(t.words).alias("words"), F.lit(t.need).alias("need"), F.lit(t.length).alias("length"), F.lit(i).alias("i"), F.array(*[F.lit(a) for a in t.above]).cast("array<int>").alias("above")) for i, t in enumerate(listed)])
    shares = lambda b, t: F.size(F.array_intersect(b, t["words"]))
    possible = let(F.array_distinct(F.flatten(held)), lambda b: F.filter(table, lambda t: shares(b, t) >= t["need"]))

    def runs(flat: Column, t: Column) -> Column:
        starts = F.filter(F.transform(flat, lambda x, i: F.when(F.array_contains(t["words"], x["w"]), i)), lambda i: i.isNotNull())

        def run(part: Column, i: Column) -> Column:
            first, last = F.get(part, F.lit(0))["line"], F.element_at(part, -1)["line"]
            over = F.when(last > first, let(F.array_distinct(part["line"]), lambda at: (F.size(at) == last - first + 1) & ~F.exists(at, lambda k: shares(F.get(held, k), t) >= t["need"])))
            n = F.when(over, shares(part["w"], t))
            return F.when(n >= t["need"], F.struct(t["label"].alias("label"), (n / F.size(t["words"])).alias("score"), t["i"].alias("i"), t["above"].alias("above"), i.alias("at"), (i + t["length"]).alias("end")))

        return F.filter(F.transform(starts, lambda i: let(F.slice(flat, i + 1, t["length"]), lambda part: run(part, i))), lambda m: m.isNotNull())

    def widest(m: Column) -> Column:
        return F.filter(m, lambda s: ~F.exists(m, lambda o: F.array_contains(s["above"], o["i"]) & (s["at"] < o["end"]) & (o["at"] < s["end"])))

    flat = F.flatten(F.transform(lines, lambda x, k: F.transform(x, lambda w: F.struct(w.alias("w"), k.alias("line")))))
    met = lambda ts: let(flat, lambda f: let(F.flatten(F.transform(ts, lambda t: runs(f, t))), widest))
    each = lambda ts: F.array_distinct(F.transform(met(ts), lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score"))))
    none = F.array().cast("array<struct<label:string,score:double>>")
    return F.when(F.size(lines) > 1, let(possible, lambda ts: F.when(F.size(ts) > 0, each(ts)).otherwise(none))).otherwise(none)


def frequency_order(blocked: DataFrame, listed: list[Template]) -> list[str]:
    """The template words, the rarest over all blocks first; one row for each comes to the driver."""
    counts = blocked.select(F.explode(F.flatten("_blocks")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r["w"]: r["n"] for r in counts.collect()}
    return sorted({w for t in listed for w in t.words}, key=lambda w: (n.get(w, 0), w))


def matches(blocks: Column, order: list[str], listed: list[Template]) -> Column:
    """Of one document: an array of (label, containment) of the templates that some block meets."""
    rank = {w: i for i, w in enumerate(order)}
    rows, index = [], {}
    for i, t in enumerate(listed):
        words = sorted(t.words, key=rank.__getitem__)
        prefix = words[: len(words) - t.need + 1]
        for w in prefix:
            index.setdefault(w, []).append(i)
        rows.append(F.struct(F.lit(t.label).alias("label"), _strings(words).alias("words"), _strings(prefix).alias("prefix"), F.lit(t.need).alias("need"), F.lit(i).alias("i"), F.array(*[F.lit(a) for a in t.above]).cast("array<int>").alias("above")))
    table, ordered, any_prefix = F.array(*rows), _strings(order), _strings(sorted(index, key=rank.__getitem__))
    leads = F.create_map(*[x for w in sorted(index) for x in (F.lit(w), F.array(*[F.lit(i) for i in index[w]]))])

    def meets(b: Column) -> Column:
        first = lambda t: F.array_position(b, F.get(F.array_intersect(b, t["prefix"]), F.lit(0)))
        found = lambda t: F.when((F.size(b) >= t["need"]) & F.arrays_overlap(b, t["prefix"]), F.when(F.size(b) - first(t) + 1 >= t["need"], F.size(F.array_intersect(b, t["words"]))))
        led = F.transform(F.array_distinct(F.flatten(F.transform(F.array_intersect(b, any_prefix), lambda w: F.element_at(leads, w)))), lambda i: F.get(table, i))
        scored = F.transform(led, lambda t: F.struct(t["label"].alias("label"), (F.when(found(t) >= t["need"], found(t)) / F.size(t["words"])).alias("score"), t["i"].alias("i"), t["above"].alias("above")))
        widest = lambda m: F.filter(m, lambda s: ~F.arrays_overlap(s["above"], F.transform(m, lambda o: o["i"])))
        return F.transform(let(F.filter(scored, lambda s: s["score"].isNotNull()), widest), lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")))

    near = F.transform(F.filter(blocks, lambda b: F.arrays_overlap(b, any_prefix)), lambda b: F.array_intersect(ordered, b))
    return F.flatten(F.transform(near, meets))


def _places(text: Column, phrase: str, label: str) -> Column:
    """Struct of a phrase's places in a text that holds it, from what stands between them; n_words: of the text."""

    def read(parts: Column) -> Column:
        last = F.col("n_words") - _n_words(F.element_at(parts, -1)) - len(phrase.split())
        first = _n_words(F.get(parts, F.lit(0)))
        return F.struct(F.lit(label).alias("label"), (F.size(parts) - 1).cast("long").alias("places"), first.alias("first_word"), last.alias("last_word"))

    return let(F.split(text, _phrase(phrase), -1), read)


def scan(docs: DataFrame, text: str = "text", listed: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs, less the text, with n_words, phrases (label, places, first_word, last_word of each phrase found) and licenses (label, containment)."""
    with passing() as scope:
        return _scan(docs, text, templates(TEMPLATES if listed is None else listed, threshold), scope)


def _scan(docs: DataFrame, text: str, listed: list[Template], scope: Scope) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    blocked = word_blocks(docs, listed, text)
    found = [F.when(t.rlike(_phrase(phrase)), _places(t, phrase, label)) for phrase, label in PHRASES.items()]
    blocked = blocked.withColumn("phrases", F.filter(F.array(*found), lambda x: x.isNotNull()))
    blocked = scope.keep(Staged(blocked.select(*keep, "n_words", "phrases", "_blocks", "_wrapped")))
    order = frequency_order(blocked, listed)
    return blocked.withColumn("licenses", F.concat(matches(F.col("_blocks"), order, listed), "_wrapped")).drop("_blocks", "_wrapped")


def op6_licenses(docs: DataFrame) -> DataFrame:
    s = scan(docs.select("doc_id", "text"))
    base = F.transform("phrases", lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return s.select(
        "doc_id",
        "n_words",
        F.aggregate("phrases", F.lit(0).cast("long"), lambda a, x: a + x["places"]).alias("n_base"),
        F.array_min(F.transform("phrases", lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform("phrases", lambda x: x["last_word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("licenses", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.when(F.size("phrases") > 0, F.lit(1.0)), F.array_max(F.transform("licenses", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    rows = ", ".join(f"('{t.label}', [{', '.join(repr(w) for w in t.words)}], {t.need}, {i}, CAST({list(t.above)} AS INTEGER[]))" for i, t in enumerate(templates(TEMPLATES, THRESHOLD)))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    words = r"regexp_extract_all(translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, {words % 't'} AS w FROM d),
p AS (SELECT * FROM (VALUES {phrases}) AS p(phrase, label, n)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
hit AS (SELECT doc_id, label, i - 1 AS place FROM pos, p WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
h AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM hit GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
b AS (SELECT doc_id, row_number() OVER () AS block, list_distinct({words % 'line'}) AS b FROM lines),
tm AS (SELECT * FROM (VALUES {rows}) AS t(label, words, need, i, above)),
m AS (SELECT doc_id, block, label, len(list_intersect(b, words)) AS n, len(words) AS size, need, i, above FROM b, tm WHERE len(b) >= need),
met AS (SELECT * FROM m WHERE n >= need),
l AS (SELECT doc_id, label, 1.0 * n / size AS score FROM met AS x WHERE NOT EXISTS (SELECT 1 FROM met AS y WHERE y.block = x.block AND list_contains(x.above, y.i))),
every AS (SELECT doc_id, label FROM hit UNION SELECT doc_id, label FROM l),
hb AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM hit) GROUP BY doc_id),
ha AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS score FROM l GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN hb ON w.doc_id = hb.doc_id LEFT JOIN ha ON w.doc_id = ha.doc_id LEFT JOIN sc ON w.doc_id = sc.doc_id
"""

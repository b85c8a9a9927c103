"""Personal data by bootstrapped contextual extraction.

Seeds are what four base patterns find. The words before a seed are its lexical pattern; the same patterns stand before
other identifier-like tokens (with digits or an @) that no base pattern matches. Patterns and instances (the shapes of
the tokens) form a bipartite graph of counts, scored in rounds: a pattern's confidence for a kind is the mean score of
its instances, shrunk by SHRINK, an instance's score the mean confidence of its patterns, and seeds stay at 1. Tokens
that fit a kind's form and stand after a pattern of at least CONFIDENCE, which SUPPORT seeds back, are found too, as
`ctx_<kind>`. The graph holds counts of (pattern, shape), summed before they are shuffled, not occurrences.

Offsets are code points: regexp_extract_all gives the matches of a text, split what stands between them, and their
lengths add up to the places. Patterns are possessive, so their matching neither recurses nor backtracks.

Defined results: a null or empty text has no spans, counts 0 and the digest of the empty string; base kinds are matched
independently and may overlap, found spans overlap no base span; repeated rows get equal results, and rows that share an
id, or have none, each the spans of their own text; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, let, passing, small

_SP, _NSP = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Local parts and digit runs are entered at their start, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
_IP_OK = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Private-use characters that stand for a seed's text, one for each kind; in texts they give way to another one.
MARKS = {k: chr(0xE000 + i) for i, k in enumerate(KINDS)}
OTHER = chr(0xE004)
CANDIDATE = rf"(?<!{_NSP})(?={_NSP}*(?:[0-9@\x{{E000}}-\x{{E003}}]|\(at\)|\[at\])){_NSP}++"
ROUNDS = 3
CONFIDENCE, SUPPORT, SHRINK = 0.7, 5, 1.0
#: The form a found token has to have, by kind; cores are tokens without the punctuation around them.
FORMS = {
    "email": r"^[A-Za-z0-9._%+-]++(?:@|\(at\)|\[at\])[A-Za-z0-9.-]++$",
    "ip": r"^[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[-./]?[0-9]){11,18}$",
    "phone": r"^[(+]*[0-9](?:[-./()]*[0-9]){6,14}$",
}
_EDGE_FRONT, _EDGE_BACK = r"^[^A-Za-z0-9+(\[]+", r"[^A-Za-z0-9)\]]+$"
#: Matches of one text that are placed in one fold.
BLOCK = 512


def spans(text: Column, pattern: str) -> Column:
    """The pattern's matches: array of (start, end, text, before), before: what stands between the match and the one before it."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    zipped = let(both, lambda b: F.transform(b["m"], lambda m, i: F.struct(m.alias("text"), F.get(b["gaps"], i).alias("before"))))
    # a fold that appends copies what it has, so it runs over blocks, whose starts come from a fold over their lengths
    last = lambda z: F.floor((F.size(z) - 1) / BLOCK).cast("int")
    blocked = lambda z: F.when(F.size(z) > 0, F.transform(F.sequence(F.lit(0), last(z)), lambda k: F.slice(z, k * BLOCK + 1, F.lit(BLOCK))))
    length = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + F.length(x["before"]) + F.length(x["text"]))
    starts = lambda blocks: F.aggregate(blocks, F.expr("array(0)"), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + length(b))))

    def place(b: Column) -> Column:
        return F.flatten(F.transform(b["blocks"], lambda x, k: F.aggregate(x, F.struct(F.get(b["starts"], k).alias("at"), _none().alias("out")), _add)["out"]))

    with_starts = let(let(zipped, blocked), lambda blocks: F.struct(blocks.alias("blocks"), starts(blocks).alias("starts")))
    return F.coalesce(let(with_starts, place), _none())


def _add(acc: Column, x: Column) -> Column:
    start = acc["at"] + F.length(x["before"])
    end = start + F.length(x["text"])
    return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["before"].alias("before")))).alias("out"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: d.cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_IP_OK),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def _guard(kind: str, text: Column) -> Column:
    """Cheap and necessary for any match of the kind."""
    return {"email": text.contains("@"), "ip": F.col("_digit"), "card": F.col("_digit"), "phone": text.contains("+") & F.col("_digit")}[kind]


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start: int, end: int, text: string, before: string>>)")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with a column for each kind: its valid spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_digit", t.rlike("[0-9]"))
    kinds = {k: F.when(_guard(k, t), _valid(spans(t, BASE[k]), k)).otherwise(_none()) for k in KINDS}
    return out.withColumns(kinds)


def _valid(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: VALID[kind](s["text"]))


def _masked(based: DataFrame, text: str, plain: Column) -> DataFrame:
    """based, whose column `text` gets every valid seed in marks of the same length; a projection for each kind, so that no text is made twice. plain: the column without marks."""
    based = based.withColumn(text, plain)
    for kind in KINDS:
        both = F.struct(F.regexp_extract_all(F.col(text), F.lit(BASE[kind]), F.lit(0)).alias("m"), F.split(F.col(text), BASE[kind], -1).alias("gaps"))
        based = based.withColumn(text, F.when(F.size(kind) > 0, let(both, _filler(kind, MARKS[kind]))).otherwise(F.col(text)))
    return based


def _filler(kind: str, mark: str):
    def one(m: Column) -> Column:
        return F.when(VALID[kind](m), F.repeat(F.lit(mark), F.length(m))).otherwise(m)

    return lambda b: F.array_join(F.transform(b["gaps"], lambda g, i: F.concat(g, F.coalesce(one(F.get(b["m"], i)), F.lit("")))), "")


def _short(key: Column, most: int) -> Column:
    return F.when(F.length(key) > most, F.sha1(key)).otherwise(key)


def candidates(based: DataFrame, text: str = "text") -> DataFrame:
    """based, less the text, with `cands`: identifier-like tokens as (start, end, seed, core, shape, l1, l2); l1, l2: the one and two words before it."""
    keep = [c for c in based.columns if c not in (text, "_digit")]
    possible = F.col("_digit") | F.col(text).rlike(r"@|\(at\)|\[at\]")
    masked = _masked(based.withColumn("_m", F.when(possible, F.col(text))), "_m", F.translate("_m", "".join(MARKS.values()), OTHER * len(MARKS)))
    found = F.when(F.col("_m").isNotNull(), spans(F.col("_m"), CANDIDATE)).otherwise(_none())

    def shape(x: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(x, "[0-9]+", "9"), r"\p{L}+", "a")
        return _short(s, 60)

    def describe(s: Column) -> Column:
        seed = F.lit(None).cast("string")
        for k in KINDS:
            seed = F.when(s["text"].contains(MARKS[k]), F.lit(k)).otherwise(seed)
        words = F.trim(F.regexp_replace(F.lower(s["before"]), f"{_SP}+", " "))
        l1 = F.when(words == "", F.lit("<id>")).otherwise(_short(F.substring_index(words, " ", -1), 40))
        l2 = F.when(words == "", F.lit("<id>")).otherwise(_short(F.substring_index(words, " ", -2), 80))
        front = F.regexp_extract(s["text"], _EDGE_FRONT, 0)
        core = F.regexp_replace(F.regexp_replace(s["text"], _EDGE_FRONT, ""), _EDGE_BACK, "")
        start = s["start"] + F.length(front)
        return F.struct(
            start.alias("start"), (start + F.length(core)).alias("end"), seed.alias("seed"), F.when(seed.isNull(), core).alias("core"),
            F.coalesce(F.concat(F.lit("seed:"), seed), shape(core)).alias("shape"), F.concat(F.lit("1 "), l1).alias("l1"), F.concat(F.lit("2 "), l2).alias("l2"),
        )

    return masked.withColumn("cands", F.transform(found, describe)).select(*keep, "cands")


def trusted_patterns(cands: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """cands(cands) -> (pattern, kind, confidence) of the patterns to be trusted."""
    each = cands.select(F.explode("cands").alias("c")).select(F.explode(F.array("c.l1", "c.l2")).alias("pattern"), "c.shape", "c.seed")
    edges = Staged(each.groupBy("pattern", "shape", "seed").agg(F.count("*").cast("double").alias("n"))).df
    own = [F.when(F.col("seed") == k, 1.0).otherwise(0.0) for k in KINDS]
    confidence = None
    for _ in range(rounds):
        if confidence is None:
            scored = edges.withColumn("s", F.array(*own))
        else:
            by_shape = edges.where("seed IS NULL").join(confidence, "pattern").groupBy("shape").agg(*[F.sum(F.col("n") * F.col("conf")[i]).alias(f"k{i}") for i in range(len(KINDS))])
            total = edges.where("seed IS NULL").groupBy("shape").agg(F.sum("n").alias("total"))
            by_shape = Staged(total.join(by_shape, "shape").select("shape", F.array(*[F.col(f"k{i}") / F.col("total") for i in range(len(KINDS))]).alias("given"))).df
            scored = edges.join(small(by_shape, by_shape.count()), "shape", "left").withColumn("s", F.when(F.col("seed").isNotNull(), F.array(*own)).otherwise(F.coalesce("given", F.array(*[F.lit(0.0)] * len(KINDS)))))
        sums = [F.sum(F.col("n") * F.col("s")[i]).alias(f"k{i}") for i in range(len(KINDS))]
        support = [F.sum(F.when(F.col("seed") == k, F.col("n")).otherwise(0.0)).alias(f"b{i}") for i, k in enumerate(KINDS)]
        grouped = scored.groupBy("pattern").agg(F.sum("n").alias("total"), *sums, *support)
        confidence = Staged(grouped.select("pattern", F.array(*[F.col(f"k{i}") / (F.col("total") + SHRINK) for i in range(len(KINDS))]).alias("conf"), F.array(*[F.col(f"b{i}") for i in range(len(KINDS))]).alias("backing"))).df
    best = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("conf")[i].alias("confidence"), F.col("backing")[i].alias("backing")) for i, k in enumerate(KINDS)]))
    return confidence.select("pattern", best.alias("b")).select("pattern", "b.*").where((F.col("confidence") >= CONFIDENCE) & (F.col("backing") >= SUPPORT)).select("pattern", "kind", "confidence")


_FOUND = "cast(array() as array<struct<kind: string, start: int, end: int>>)"


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(doc_id, text) -> doc_id, a column of spans for each base kind, and `found`: array of (kind, start, end) that the contexts add."""
    with passing() as scope:
        return scope.keep(Staged(_extract(docs.select("doc_id", F.col(text).alias("text")))))


def _extract(docs: DataFrame) -> DataFrame:
    # a row is known by a number of its own, written with it, as ids may be null or repeat with other texts
    based = base_spans(docs.withColumn("_row", F.monotonically_increasing_id()))
    staged = Staged(candidates(based).withColumns({k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS})).df
    trusted = Staged(trusted_patterns(staged)).df
    n = trusted.count()
    if not n:
        return staged.select("doc_id", *KINDS, F.expr(_FOUND).alias("found"))
    fits = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN core rlike r'{FORMS[k]}'" for k in KINDS) + " END")
    open_tokens = staged.select("_row", F.explode(F.filter("cands", lambda c: c["seed"].isNull())).alias("c")).select("_row", "c.start", "c.end", "c.core", F.explode(F.array("c.l1", "c.l2")).alias("pattern"))
    hits = open_tokens.join(small(trusted, n), "pattern").where(fits)
    best = hits.groupBy("_row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    per_row = best.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct(F.col("b.kind").alias("kind"), "start", "end"))).alias("found"))
    return staged.join(per_row, "_row", "left").select("doc_id", *KINDS, F.coalesce("found", F.expr(_FOUND)).alias("found"))


def op1_pii(docs: DataFrame) -> DataFrame:
    x = extract(docs)
    listed = lambda kind: F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat(*[listed(k) for k in KINDS])
    found = F.flatten(F.array(*[_listed_found(k) for k in KINDS]))
    return x.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, found), ",").alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def _listed_found(kind: str) -> Column:
    own = F.filter("found", lambda s: s["kind"] == kind)
    return F.transform(own, lambda s: F.concat_ws(":", F.lit(f"ctx_{kind}"), s["start"].cast("string"), s["end"].cast("string")))

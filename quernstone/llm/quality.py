"""Quality rules as a bitmask ledger.

Every document's measurements are taken once; every rule is evaluated once on them and leaves one bit in `fail_bits`.
A policy is a named, versioned set of rules, that is another bitmask, so that judging, re-judging under another policy
and ablating a policy are bitwise operations over the ledger and never read the text again.

Defined results: a null or empty text has no words, all measures are 0 and it fails `few_words`; equal rows get equal
results; an empty table gives an empty ledger; extra columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: name -> condition of failure over the struct of measures; the position in this list is the rule's bit, so only append.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20),
    ("symbols", lambda m: m["n_symbols"] * 100 > m["n_words"] * 10),
    ("duplicate_lines", lambda m: m["n_dup_lines"] * 100 > m["n_lines"] * 40),
    ("short_words", lambda m: m["word_chars"] < m["n_words"] * 2),
    ("long_words", lambda m: m["word_chars"] > m["n_words"] * 20),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(BITS)))}


def repeated_positions(windows: Column) -> Column:
    """Starts, ascending, of the windows whose hash occurs more than once; windows: hashes in text order."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    return F.sort_array(F.transform(let(pairs, twice), lambda x: x["i"]))


def covered(starts: Column, width: int) -> Column:
    """Positions that lie in any of the intervals of `width` at the ascending starts."""
    gaps = lambda s: F.transform(s, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1) - x, F.lit(width))))
    return F.aggregate(let(starts, gaps), F.lit(0).cast("long"), lambda a, x: a + x)


def measures(text: Column) -> Column:
    """Struct of MEASURES (long). Every part is bound once, so the optimizer may move the whole but never repeat it for an element."""
    t = F.coalesce(text, F.lit(""))
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
    repeated = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(repeated_positions(h), WINDOW)).otherwise(F.lit(0).cast("long"))

    def of_words(w: Column) -> Column:
        n_repeat = F.when(F.size(w) >= WINDOW, let(hashes(w), repeated)).otherwise(F.lit(0).cast("long"))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_repeat.alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of_words)
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long")
    parts = F.struct(words.alias("w"), lines.alias("l"), symbols.alias("n_symbols"))
    return let(parts, lambda p: F.struct(p["w"]["n_words"].alias("n_words"), p["w"]["word_chars"].alias("word_chars"), p["n_symbols"].alias("n_symbols"), p["l"]["n_lines"].alias("n_lines"), p["l"]["n_dup_lines"].alias("n_dup_lines"), p["w"]["n_repeat_words"].alias("n_repeat_words")))


def fail_bits(m: Column) -> Column:
    """One bit for each rule that the measures fail."""
    bits = [F.when(fails(m), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, fails in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES and fail_bits in place of the text: the one pass over the texts. Columns of these names give way."""
    rest = [c for c in docs.columns if c not in (text, *MEASURES, "fail_bits")]
    judged = let(measures(F.col(text)), lambda m: F.struct(*[m[k].alias(k) for k in MEASURES], fail_bits(m).alias("fail_bits")))
    return docs.select(*rest, judged.alias("_m")).select(*rest, "_m.*")


def keep_good(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, that the policy does not reject."""
    return docs.where(let(measures(F.col(text)), fail_bits).bitwiseAND(F.lit(policy.mask)) == 0)


def judge(ledger: DataFrame, policy: Policy) -> DataFrame:
    """ledger with policy_version and kept."""
    return ledger.withColumn("policy_version", F.lit(policy.version)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """One row for each rule of the policy: rejected, rejected_alone (kept again if the rule went), rejected_with_others, any_bits (OR of what failed beside it)."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    aggs = []
    for r in policy.rules:
        b = F.lit(BITS[r]).cast("long")
        with_rule = hit.bitwiseAND(b) != 0
        aggs.append(
            F.struct(
                F.lit(r).alias("rule"),
                F.count_if(with_rule).alias("rejected"),
                F.count_if(hit == b).alias("rejected_alone"),
                F.count_if(with_rule & (hit != b)).alias("rejected_with_others"),
                F.coalesce(F.bit_or(F.when(with_rule, hit)), F.lit(0).cast("long")).alias("any_bits"),
            )
        )
    return ledger.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def op9_quality(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The query's digest of the ledger."""
    base = F.lit(BASE.mask).cast("long")
    failed = F.col("fail_bits").bitwiseAND(base) != 0
    judged = judge(ledger(docs.select("doc_id", "text")), policy)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "n_lines", "fail_bits", "policy_version")


_LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM pos),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM win, range(5) AS o(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN ln ON d.doc_id = ln.doc_id),
b AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
{select}
"""
OP9_SQL = _LEDGER_SQL.replace("{select}", """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
  n_lines, fail_bits, 'v1' AS policy_version FROM b""")
ABLATION_SQL = _LEDGER_SQL.replace(
    "{select}",
    f""", r AS (SELECT * FROM (VALUES {', '.join(f"('{name}', {bit}::BIGINT)" for name, bit in BITS.items())}) AS r(rule, bit))
SELECT rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS rejected, count(*) FILTER (WHERE fail_bits = bit) AS rejected_alone,
  count(*) FILTER (WHERE fail_bits & bit <> 0 AND fail_bits <> bit) AS rejected_with_others,
  coalesce(bit_or(CASE WHEN fail_bits & bit <> 0 THEN fail_bits END), 0) AS any_bits FROM r, b GROUP BY rule""",
)

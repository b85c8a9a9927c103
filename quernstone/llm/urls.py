"""URL filter over a sorted digest array.

A list is a table of entries (a host and the start of a path), verdicts (allow or block) and kinds (rule or listed). It is
kept as ascending arrays of 64-bit xxhash keys beside arrays of the full strings; executors memory-map both and probe
whole batches by vectorised binary search. A URL's probes are all its host's suffixes at label borders, each with the path
cut at every length that some entry's path has, so any entry that fits is probed. A key that is found counts only if the
stored string is equal, so collisions never decide. The longest entry of each kind wins; both kinds share one index, so
the pages are read and probed once.

The list comes to the driver in order, SEGMENT_ENTRIES at a time; each segment is four files in the shared folder, named
by their content, which Spark sends to every executor that asks (a replaced executor too). They are mapped, not read, so
memory stays bounded, and a list that was sent before is not sent again.

Defined results: a null URL, or one without ://, has an empty host and path, which no entry fits, and the verdict
`allow`; of equal entries of one kind `block` counts; null or empty entries fit nothing; equal URLs get equal results; an
empty table or list gives an empty result or no findings; other columns, also those named host, path, rule or listed, are
not looked at. Page ids pass through Arrow as they are.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, shared_dir

#: Rules as (host/path, verdict).
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: The list that comes with the operator: entry, tab, verdict.
LIST_FILE = Path(__file__).with_name("url_list.tsv")
SEGMENT_ENTRIES = 4_000_000
#: Kinds and verdicts, as bits of an entry's flags.
FLAGS = {("rule", "allow"): 1, ("rule", "block"): 2, ("listed", "allow"): 4, ("listed", "block"): 8}


def key(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode("utf-8", "surrogatepass"))


class DigestArray:
    """One segment: entries ascending by key, memory-mapped from <name>.keys, .ends, .text and .flags."""

    PARTS = ("keys", "ends", "text", "flags")

    def __init__(self, name: str):
        at = {p: SparkFiles.get(f"{name}.{p}") for p in self.PARTS}
        self.keys = np.memmap(at["keys"], np.uint64, "r")
        self.ends = np.memmap(at["ends"], np.int64, "r")
        self.text = np.memmap(at["text"], np.uint8, "r")
        self.flags = np.memmap(at["flags"], np.uint8, "r")

    @staticmethod
    def write(spark: SparkSession, entries: list[tuple[str, int]]) -> str:
        """Writes a segment of (entry, flags) to the shared folder and hands it to Spark; returns its name."""
        ordered = sorted((key(e), e.encode("utf-8", "surrogatepass"), f) for e, f in entries)
        data = {
            "keys": np.array([k for k, _, _ in ordered], np.uint64),
            "ends": np.cumsum([0] + [len(e) for _, e, _ in ordered]).astype(np.int64),
            "text": np.frombuffer(b"".join(e for _, e, _ in ordered), np.uint8),
            "flags": np.array([f for _, _, f in ordered], np.uint8),
        }
        digest = xxhash.xxh3_128()
        for part in DigestArray.PARTS:
            digest.update(data[part].tobytes())
        name, sc = f"digests-{digest.hexdigest()}", spark.sparkContext
        if any(f.endswith(f"{name}.{DigestArray.PARTS[-1]}") for f in sc.listFiles):
            return name
        path, shared = sc._jvm.org.apache.hadoop.fs.Path, shared_dir(spark)
        files = path(shared).getFileSystem(sc._jsc.hadoopConfiguration())
        with tempfile.TemporaryDirectory(prefix="quernstone-") as folder:
            for part in DigestArray.PARTS:
                data[part].tofile(own := os.path.join(os.path.abspath(folder), f"{name}.{part}"))
                files.copyFromLocalFile(True, True, path(f"file://{own}"), path(f"{shared}/{name}.{part}"))
                sc.addFile(f"{shared}/{name}.{part}")
        return name

    def entry(self, i: int) -> bytes:
        return self.text[self.ends[i] : self.ends[i + 1]].tobytes()

    def find(self, probes: list[bytes], keys: np.ndarray) -> np.ndarray:
        """The place of each probe, or -1."""
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(probes), -1, np.int64)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.entry(j) == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path of the URL."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    out = pages.withColumn("_rest", rest)
    host = lower_ascii(F.regexp_extract("_rest", r"^[^/?#]*+", 0))
    path = F.regexp_extract("_rest", r"^[^/?#]*+([^?#]*+)", 1)
    return out.withColumn("host", host).withColumn("path", path).drop("_rest")


_COLUMNS = [("rule", pa.string()), ("rule_blocks", pa.bool_()), ("listed", pa.string()), ("listed_blocks", pa.bool_())]


def _probe(names: list[str], lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = [DigestArray(n) for n in names]
        for batch in batches:
            probes, owner = [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                cuts = [path[:m] for m in lengths if m <= len(path)]
                at = 0
                while host and at >= 0:
                    suffix = host[at:] if at else host
                    probes += [(suffix + p).encode("utf-8", "surrogatepass") for p in cuts]
                    owner += [i] * len(cuts)
                    dot = host.find(".", at)
                    at = dot + 1 if dot >= 0 else -1
            best: dict[str, list[tuple[int, str, bool] | None]] = {kind: [None] * len(batch) for kind, _ in FLAGS}
            keys = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
            for s in segments if probes else ():
                places = s.find(probes, keys)
                for j in np.flatnonzero(places >= 0):
                    entry, flags = probes[j].decode("utf-8", "surrogatepass"), int(s.flags[places[j]])
                    for (kind, verdict), flag in FLAGS.items():
                        if flags & flag:
                            found, had = (len(entry), entry, verdict == "block"), best[kind][owner[j]]
                            if had is None or found > had:
                                best[kind][owner[j]] = found
            made = [x for kind in best for x in ([b and b[1] for b in best[kind]], [b and b[2] for b in best[kind]])]
            arrays = [pa.array(x, t) for x, (_, t) in zip(made, _COLUMNS, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(n for n, _ in _COLUMNS)])

    return run


def listed_entries(spark: SparkSession, rules: list[tuple[str, str]] | None = None, listed: DataFrame | None = None) -> DataFrame:
    """(entry, verdict, kind): rules and a list(entry, verdict); by default those that come with the operator."""
    if listed is None:
        listed = spark.createDataFrame([tuple(x.split("\t")) for x in LIST_FILE.read_text().splitlines() if x], "entry string, verdict string")
    ruled = spark.createDataFrame(RULES if rules is None else rules, "entry string, verdict string")
    return ruled.withColumn("kind", F.lit("rule")).union(listed.select("entry", "verdict", F.lit("listed")))


def judge(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """pages(<id columns>, url) with host, path and, of the longest entry of each kind that fits, rule, rule_blocks, listed and listed_blocks (else null)."""
    spark = pages.sparkSession
    flag = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("verdict") == v), F.lit(f)) for (k, v), f in FLAGS.items()])
    ordered = entries.where("entry <> ''").select("entry", flag.alias("f")).where("f IS NOT NULL").groupBy("entry").agg(F.bit_or("f").alias("f")).orderBy("entry")
    names, lengths, held = [], set(), []
    for e, f in ordered.toLocalIterator():
        held.append((e, f))
        lengths.add(len(e) - e.index("/") if "/" in e else 0)
        if len(held) == SEGMENT_ENTRIES:
            names.append(DigestArray.write(spark, held))
            held = []
    if held:
        names.append(DigestArray.write(spark, held))
    parts = with_parts(pages, url)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in parts.schema.fields)}, rule string, rule_blocks boolean, listed string, listed_blocks boolean"
    return parts.mapInArrow(_probe(names, sorted(lengths)), schema)


def op4_url_filter(pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Rules first; where none fits, the method's list."""
    judged = judge(pages.select("page_id", "url"), listed_entries(pages.sparkSession, listed=listed))
    blocked = F.coalesce("rule_blocks", "listed_blocks", F.lit(False))
    return judged.select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "listed")


def oracle_sql() -> str:
    rows = [(e, v, "rule") for e, v in RULES] + [(*x.split("\t"), "listed") for x in LIST_FILE.read_text().splitlines() if x]
    entries = ", ".join(f"('{e}', '{e.partition('/')[0]}', '{e[len(e.partition('/')[0]) :]}', '{v}', '{k}')" for e, v, k in rows)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
e AS (SELECT * FROM (VALUES {entries}) AS e(entry, eh, ep, verdict, kind)),
fit AS (SELECT page_id, entry, verdict, kind, row_number() OVER (PARTITION BY page_id, kind ORDER BY length(entry) DESC, entry DESC, verdict DESC) AS k
  FROM p, e WHERE (host = eh OR host LIKE '%.' || eh) AND starts_with(path, ep))
SELECT p.page_id, host, path, r.entry AS rule, coalesce(r.verdict, l.verdict, 'allow') AS verdict, l.entry AS listed
FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1 AND kind = 'rule') AS r ON p.page_id = r.page_id LEFT JOIN (SELECT * FROM fit WHERE k = 1 AND kind = 'listed') AS l ON p.page_id = l.page_id
"""

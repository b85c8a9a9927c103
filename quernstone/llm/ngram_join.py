"""Grouped prefix join of documents by the Jaccard similarity of their word n-grams, with connected components.

1. Arrow functions turn each text into its set of 64-bit shingle hashes. Shingles that repeat within any block of
   documents are counted over all blocks; the most frequent come last in the global token order, which keeps them out of
   prefixes (an order, not a filter: nothing is dropped).
2. Documents with equal sets are one node. Nodes with the same size and the same prefix are one group, and postings
   (token -> group) hold groups.
3. Links are looked for in rounds. A star round compares the members of a token's groups, or of one group, with one of
   them only, so its candidates are linear in the postings. Verified links give components. The last round is exact: pairs
   of *groups* that share a token and a band of sizes, and pass the size and position filters, are opened into their
   members, as is each group with itself; members of *different* components whose parity sketches allow it are verified.
   Pairs within one component need no look, so a family of n near copies is never expanded into its n * n pairs.
4. Verification reads the texts of the candidates again and compares whole sets.

A parity sketch is a bitmap whose bit b is the parity of the set's hashes in class b. It differs between two sets in at
most as many bits as the sets differ in members, so the filter loses no pair.

Defined results: a null or empty text, or one without words, has an empty set, n_shingles 0 and its own component;
fewer words than n give the whole sequence as the one shingle; repeated rows and equal texts link (their similarity is
1). Rows that share a doc_id are one document, which links wherever one of its sets does; rows without one have that set
size and link with nothing, component_id null. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, passing, small
from .components import components, merged

N = 3
#: Similarity as a fraction: intersection / union >= NUM / DEN.
NUM, DEN = 9, 10
SKETCH_LONGS = 4
#: Sets above this size also have a sketch of 4,096 bits, as a small one is full; it filters pairs, not postings.
WIDE_FROM = 600
#: Block of documents within which a shingle is counted, in shingles, and the count from which it is reported.
BLOCK, REPORT = 2_000_000, 2
#: Shingles that the order knows as frequent, at most; a bound on what is broadcast, not on what is compared.
ORDERED = 1 << 19
STAR_ROUNDS = 2
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Base of the words' polynomial hash, odd, and its inverse modulo 2**64.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; one longer text is worked on alone.
CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, for as many bytes as were asked for."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = []
            for base in (_BASE, _INVERSE):
                x = np.full(max(n, CHUNK + 1), base, np.uint64)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


def shingle_sets(texts: list[str | None], n: int, powers: _Powers) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order.

    Words are the runs of bytes between ASCII white space, A-Z lower-cased. The bytes of many texts are hashed at once:
    a word's hash is its share of the running sum of byte x base**place, divided by base**start, and then mixed."""
    encoded: list[bytes] = []
    held = 0
    for text in texts:
        b = (text or "").encode("utf-8", "surrogatepass")
        if encoded and held + len(b) > CHUNK:
            yield from _chunk(encoded, n, powers)
            encoded, held = [], 0
        encoded.append(b)
        held += len(b) + 1
    if encoded:
        yield from _chunk(encoded, n, powers)


def _chunk(encoded: list[bytes], n: int, powers: _Powers) -> Iterator[np.ndarray]:
    b = _LOWER[np.frombuffer(b" " + b" ".join(encoded) + b" ", np.uint8)]
    edges = np.diff(_BLANK[b].view(np.int8))
    starts, ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
    up, down = powers.upto(len(b))
    total = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up)
    h = (total[ends - 1] - total[starts - 1]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(29)
    bounds = np.cumsum([1] + [len(x) + 1 for x in encoded])
    at = np.searchsorted(starts, bounds)
    grams = h.copy()
    grams *= _A
    for k in range(1, n):
        grams[:-k] = (grams[:-k] ^ (grams[:-k] >> np.uint64(31)) ^ h[k:]) * _A + _B if len(h) > k else grams[:-k]
    grams ^= grams >> np.uint64(30)
    grams *= _C
    for i in range(len(encoded)):
        lo, hi = at[i], at[i + 1]
        if lo == hi:
            yield np.empty(0, np.uint64)
        elif hi - lo < n:
            yield np.array([xxhash.xxh64_intdigest(h[lo:hi].tobytes(), seed=1)], np.uint64)
        else:
            s = np.sort(grams[lo : hi - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def _frequent(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, count, seen = _Powers(), [], 0, set()

        def report():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= REPORT
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], ["token", "df"])

        for batch in batches:
            for s in shingle_sets(_texts(batch), n, powers):
                # copies are one node, so they do not make their shingles frequent
                digest = xxhash.xxh128_digest(s.tobytes())
                if digest in seen:
                    continue
                seen.add(digest)
                held.append(s)
                count += len(s)
                if count >= BLOCK:
                    yield report()
                    held, count = [], 0
                    seen.clear()
        if held:
            yield report()

    return run


def _late(seen: DataFrame, room: int = ORDERED) -> np.ndarray:
    """The most frequent tokens of seen(token, df), the least frequent of them first: room at most. Of the class of
    frequencies that does not fit whole, the hash of a token decides. The driver gets a count for each class (16 to a
    doubling) and those tokens, as Arrow."""
    level, part = F.floor(F.log2("df") * 16).cast("int"), F.pmod(F.xxhash64("token"), F.lit(1 << 20))
    last, below, left = None, 0, room
    for r in sorted(seen.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        last, below = r["level"], (1 << 20) * min(left, r["n"]) // r["n"]
        if left <= r["n"]:
            break
        left -= r["n"]
    if last is None:
        return np.empty(0, np.uint64)
    found = seen.where((level > last) | (level == last) & (part < below)).toArrow()
    token, df = found.column("token").to_numpy(), found.column("df").to_numpy()
    return token[np.lexsort((token, -df))[:room][::-1]].view(np.uint64)


def _sketch(s: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((s >> np.uint64(shift)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in arrays]).astype(np.int32)
    full = [x for x in arrays if x is not None]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(full) if full else np.empty(0, np.int64)), mask=pa.array([x is None for x in arrays], pa.bool_()))


def _prefixes(n: int, num: int, den: int, late: np.ndarray):
    """late: frequent tokens, the least frequent first."""
    order = np.argsort(late)
    late_sorted = late[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            rows = []
            for s in shingle_sets(_texts(batch), n, powers):
                size = len(s)
                key = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
                probe = size - (num * size + den - 1) // den + 1 if size else 0
                at = np.searchsorted(late_sorted, s)
                at[at == len(late_sorted)] = 0
                is_late = late_sorted[at] == s if len(late_sorted) else np.zeros(size, bool)
                early = s[~is_late][:probe]
                if len(early) < probe:
                    rest = s[is_late]
                    rest = rest[np.argsort(order[at[is_late]], kind="stable")]
                    early = np.concatenate([early, rest[: probe - len(early)]])
                group = np.frombuffer(xxhash.xxh128_digest(early.tobytes()), np.int64)
                rows.append((size, key, group, early.view(np.int64), _sketch(s, 56, 64 * SKETCH_LONGS), _sketch(s, 52, 4096) if size > WIDE_FROM else None))
            sizes, keys, groups, early, sketch, wide = zip(*rows, strict=True) if rows else [[]] * 6
            longs = lambda pairs, i: pa.array([int(x[i]) for x in pairs], pa.int64())
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int32()), longs(keys, 0), longs(keys, 1), longs(groups, 0), longs(groups, 1), _lists(early), _lists(sketch), _lists(wide)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "k0", "k1", "p0", "p1", "prefix", "sketch", "wide"])

    return run


def _sets(n: int, keys: list[str], name: str):
    """Rows with a text -> their keys and the set of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(_texts(batch), n, powers)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), sets], [*keys, name])

    return run


def _verify(num: int, den: int):
    """Pairs with both sets -> linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("su"), batch.column("sv"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both) and both > 0)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def links(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> Staged:
    """Of the candidate pairs (u, v) of documents, those that are linked. Their texts are read again: a pair moves u's set once, v's set moves once for all its pairs."""
    pairs = Staged(pairs).df
    centres = pairs.select(F.col("v").alias("doc_id")).distinct()
    mine = docs.join(small(pairs, pairs.count()), docs["doc_id"] == pairs["u"]).select("u", "v", "text").mapInArrow(_sets(n, ["u", "v"], "su"), "u bigint, v bigint, su binary")
    theirs = docs.join(small(centres, centres.count()), "doc_id", "left_semi").select(F.col("doc_id").alias("v"), "text").mapInArrow(_sets(n, ["v"], "sv"), "v bigint, sv binary")
    return Staged(mine.join(theirs, "v").select("u", "v", "su", "sv").mapInArrow(_verify(num, den), "u bigint, v bigint"), batch=200)


def _far(a: str, b: str) -> Column:
    """Bits in which the sketches a and b differ."""
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_LONGS)))


class _Rule:
    """Similarity num / den: the filters of a pair, as SQL over two structs or aliases with size (and pos, sketch)."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.both = num, den, num + den

    def need(self, a: str, b: str) -> str:
        """Members that the two sets have to share."""
        return f"(({self.num} * ({a}.size + {b}.size) + {self.both - 1}) div {self.both})"

    def sizes(self, a: str, b: str) -> str:
        return f"{self.den} * least({a}.size, {b}.size) >= {self.num} * greatest({a}.size, {b}.size)"

    def places(self, a: str, b: str) -> str:
        """Of a token that both prefixes hold; a has the smaller size, or the smaller gid at equal sizes."""
        return (
            f"({a}.size < {b}.size OR {a}.size = {b}.size AND {a}.gid < {b}.gid) AND {self.den} * {a}.size >= {self.num} * {b}.size "
            f"AND {a}.pos <= {a}.size - ((2 * {self.num} * {a}.size + {self.both - 1}) div {self.both}) AND least({a}.size - {a}.pos, {b}.size - {b}.pos) >= {self.need(a, b)}"
        )

    def most(self, a: str, b: str) -> Column:
        """Members in which the two sets may differ, and with them their sketches."""
        return F.expr(f"{a}.size + {b}.size - 2 * {self.need(a, b)}")

    def band(self, size: str) -> Column:
        """Sizes that allow a link are in one band or in two that follow one another."""
        return F.floor(F.ln(size) / math.log(self.den / self.num * 1.000001)).cast("int")


def cluster(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, n_copies (rows with the same set, 1 for an empty one), a row for each of docs."""
    with passing() as scope:
        return scope.keep(Staged(_cluster(docs, n, _Rule(num, den))))


def _cluster(docs: DataFrame, n: int, rule: _Rule) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seen = Staged(docs.select("text").mapInArrow(_frequent(n), "token bigint, df bigint").groupBy("token").agg(F.sum("df").alias("df")), batch=1000).df
    late = _late(seen)
    made = Staged(docs.mapInArrow(_prefixes(n, rule.num, rule.den, late), "doc_id bigint, n_shingles int, k0 bigint, k1 bigint, p0 bigint, p1 bigint, prefix array<bigint>, sketch array<bigint>, wide array<bigint>"), batch=1000).df
    whole = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a node is a document that stands for all that have its set; one whose rows have several sets stands for each of them
    keys = Staged(whole.groupBy("k0", "k1").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))).df
    several = Staged(whole.groupBy("doc_id").agg(F.min("k0").alias("a"), F.max("k0").alias("b"), F.min("k1").alias("c"), F.max("k1").alias("d")).where("a <> b OR c <> d").select("doc_id")).df
    slim = whole.select("doc_id", F.col("n_shingles").alias("size"), "p0", "p1", "sketch", "k0", "k1")
    nodes = Staged(slim.join(keys, ["k0", "k1"]).where("doc_id = node").dropDuplicates(["k0", "k1"]).select("node", "size", "p0", "p1", "sketch", "copies")).df
    groups = nodes.groupBy("size", "p0", "p1").agg(F.min("node").alias("first"), F.count("*").alias("members"), F.max(F.struct(F.col("copies"), (-F.col("node")).alias("minus_node"))).alias("lead"))
    groups = Staged(groups.select("size", "p0", "p1", F.xxhash64("size", "p0", "p1", "first").alias("gid"), "first", "members", (-F.col("lead.minus_node")).alias("leader"))).df
    member_of = Staged(nodes.join(groups.select("size", "p0", "p1", "gid", "leader"), ["size", "p0", "p1"]).select("node", "gid", "leader", "size", "sketch")).df
    # a group's sketch is its leader's; no member's is farther from it than the radius
    shape = Staged(member_of.where("node = leader").dropDuplicates(["gid"]).select("gid", F.col("sketch").alias("lead"))).df
    shape = Staged(member_of.join(shape, "gid").groupBy("gid").agg(F.first("lead").alias("lead"), F.max(_far("sketch", "lead")).alias("radius"))).df
    # every token of every group's prefix; those of one group only end here, with 16 bytes moved for each: the pairs within
    # a group do not need them
    of_group = groups.select("gid", F.col("first").alias("doc_id"), F.col("size").alias("n_shingles"), "p0", "p1")
    tokens = whole.join(of_group, ["doc_id", "n_shingles", "p0", "p1"]).select("gid", F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.min("gid").alias("a"), F.max("gid").alias("b")).where("a <> b").select("token")
    posts = tokens.join(shared, "token").dropDuplicates(["token", "gid", "pos"])
    posts = Staged(posts.join(groups.select("gid", "size", "members", "leader"), "gid").select("token", "pos", "gid", "size", "members", "leader")).df
    wide = made.where("wide IS NOT NULL").join(several, "doc_id", "left_anti").dropDuplicates(["doc_id"]).select("doc_id", F.struct(F.col("n_shingles").alias("size"), "wide").alias("a"))

    def check(pairs: DataFrame) -> Staged:
        return links(_wide(pairs, wide, rule), docs, n, rule.num, rule.den)

    # first star: members with their group's leader, groups' leaders with their tokens' centres
    with passing() as scope:
        centres = posts.groupBy("token").agg(F.max(F.struct("members", F.xxhash64("token", "leader").alias("h"), "leader")).alias("m")).select("token", F.col("m.leader").alias("centre"))
        pairs = member_of.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).union(posts.join(centres, "token").where("leader <> centre").select("leader", "centre"))
        found = check(_nearest(_sketched(pairs.distinct(), member_of, rule))).df
        found = found.union(whole.join(several, "doc_id", "left_semi").join(keys, ["k0", "k1"]).where("doc_id <> node").select("doc_id", "node"))
        comps = scope.keep(Staged(components(found)))
    for k in range(STAR_ROUNDS):
        with passing() as scope:
            named = Staged(member_of.join(comps, "node", "left").select("node", "gid", "size", "sketch", F.coalesce("component", "node").alias("comp"))).df
            spread = Staged(named.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))).df
            mixed = posts.select("token", "gid").join(spread, "gid").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
            opened = Staged(posts.join(mixed, "token").select("token", "pos", "gid", "size")).df
            pairs = _across(opened, spread, shape, named, rule) if k == STAR_ROUNDS - 1 else _nearest(_sketched(_stars(opened, spread, named), member_of, rule))
            found = check(pairs).df
            if not found.isEmpty():
                comps = scope.keep(Staged(merged(comps, found)))
    of_key = keys.join(comps, "node", "left").select("k0", "k1", "copies", F.coalesce("component", "node").alias("component_id"))
    full = made.select("doc_id", "n_shingles", "k0", "k1").join(of_key, ["k0", "k1"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return full.select("doc_id", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"))


def _stars(opened: DataFrame, spread: DataFrame, named: DataFrame) -> DataFrame:
    """Candidates (u, v) of a star round: of each group one member of each component stands for the others, and meets one
    member of the token's, or of its own group's, groups."""
    some = named.groupBy("gid", "comp").agg(F.min(F.struct(F.xxhash64("gid", "node").alias("h"), "node")).alias("m")).select("gid", "comp", F.col("m.node").alias("node"), F.col("m.h").alias("h"))
    met = opened.select("token", "gid").join(some, "gid")
    centre = met.groupBy("token").agg(F.min(F.struct(F.xxhash64("token", "node").alias("h"), "node", "comp")).alias("m")).select("token", "m")
    pairs = met.join(centre, "token").where("comp <> m.comp").select(F.col("node").alias("u"), F.col("m.node").alias("v"))
    inner = some.join(spread.where("lo <> hi").select("gid"), "gid")
    inner = inner.join(inner.groupBy("gid").agg(F.min(F.struct("h", "node", "comp")).alias("m")), "gid").where("comp <> m.comp").select("node", "m.node")
    return pairs.union(inner).distinct()


def _across(opened: DataFrame, spread: DataFrame, shape: DataFrame, named: DataFrame, rule: _Rule) -> DataFrame:
    """The last round's pairs (u, v) of nodes of different components: pairs of *groups* that meet in a posting and pass
    the size, position and sketch filters, and each group with itself, are opened into their members, whose own sketches
    are compared. Sketches of members differ in no fewer bits than those of their groups, less both radii. Pairs of groups
    that lie in one and the same component are not opened."""
    posts = opened.join(spread, "gid").join(shape, "gid").withColumn("band", rule.band("size"))
    left = posts.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    apart = F.expr(f"{rule.places('a', 'b')} AND (a.lo <> a.hi OR b.lo <> b.hi OR a.lo <> b.lo)") & (_far("a.lead", "b.lead") - F.col("a.radius") - F.col("b.radius") <= rule.most("a", "b"))
    groups = left.alias("a").join(posts.alias("b"), ["token", "band"]).where(apart).select(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb")).distinct()
    groups = groups.union(spread.where("lo <> hi").select("gid", "gid"))
    x = named.select(F.col("gid").alias("ga"), F.struct("node", "size", "sketch", "comp").alias("a"))
    y = named.select(F.col("gid").alias("gb"), F.struct("node", "size", "sketch", "comp").alias("b"))
    pairs = groups.join(x, "ga").join(y, "gb").where(F.expr("a.comp <> b.comp AND (ga <> gb OR a.node < b.node)") & (_far("a.sketch", "b.sketch") <= rule.most("a", "b")))
    return pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def _sketched(pairs: DataFrame, member_of: DataFrame, rule: _Rule) -> DataFrame:
    """Of the pairs (u, v) of nodes, those that sizes and sketches allow, with the distance that the sketches show."""
    x = member_of.select(F.col("node").alias("u"), F.struct("size", "sketch").alias("a"))
    y = member_of.select(F.col("node").alias("v"), F.struct("size", "sketch").alias("b"))
    far = _far("a.sketch", "b.sketch")
    return pairs.join(x, "u").join(y, "v").where(F.expr(rule.sizes("a", "b")) & (far <= rule.most("a", "b"))).select("u", "v", far.alias("far"))


def _wide(pairs: DataFrame, wide: DataFrame, rule: _Rule) -> DataFrame:
    """Of the pairs (u, v) of nodes, those that the wide sketches (doc_id, a) allow, where both have one."""
    x, y = wide.withColumnRenamed("doc_id", "u"), wide.toDF("v", "b")
    far = F.aggregate(F.zip_with("a.wide", "b.wide", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    return pairs.join(x, "u", "left").join(y, "v", "left").where(F.col("a").isNull() | F.col("b").isNull() | (far <= rule.most("a", "b"))).select("u", "v")


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each u the v that looks nearest; what this leaves out, the last round sees if it would join components."""
    return pairs.groupBy("u").agg(F.min(F.struct("far", "v")).alias("m")).select("u", F.col("m.v").alias("v"))


def keep_one(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of docs, less all but those of the smallest doc_id of each component; of rows that repeat that doc_id, one stays. Rows without an id stay."""
    with passing() as scope:
        found = cluster(docs, n, num, den).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
        drop = scope.keep(Staged(found.where("doc_id <> component_id OR rows > 1").selectExpr("doc_id", "doc_id <> component_id AS gone")))
    gone, again = drop.where("gone").select("doc_id"), drop.where("NOT gone").select("doc_id")
    kept = docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
    if not (n_again := again.count()):
        return kept
    again = small(again, n_again)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def op10_ngram_join(docs: DataFrame) -> DataFrame:
    return cluster(docs)

"""Every operator of the subpackage against a brute-force version or an exact property, and the edge cases of each."""

import hashlib
import itertools
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import decontam, licenses, mixing, ngram_join, pii, quality, secrets, sharding, toxicity, urls
from quernstone.llm.common import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "same text here " * 4), (7, "same text here " * 4), (8, "É😀 naïve " * 30),
    (9, "x" * 5000), (10, "a b c d e f g h i j k l " * 400), (11, "# $ % " * 20), (12, "line of words\nline of words\nline of words\nline of words"),
]


def frame(spark, rows=EDGE, source="s"):
    """Rows with an extra column whose name clashes with what operators make."""
    return spark.createDataFrame([(i, t, source, 7) for i, t in rows], "doc_id long, text string, source string, n_words int")


def empty(spark):
    return frame(spark).limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_matches_brute_force(spark):
    rng = random.Random(1)
    rows = EDGE + [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(80)]
    got = by_id(quality.op9_quality(frame(spark, rows)))
    for i, text in rows:
        w = WORDS.findall(text or "")
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cov = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(cov), len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r.base_failed == (len(w) < 10 or 100 * len(cov) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.op9_quality(empty(spark)).count() == 0


def test_quality_ablation_and_filter(spark):
    led = quality.ledger(frame(spark).select("doc_id", "text"))
    policy = quality.POLICIES["v1"]
    rows = led.collect()
    for a in quality.ablation(led, policy).collect():
        bit = quality.BITS[a["rule"]]
        assert a["rejected"] == sum(bool(r.fail_bits & bit) for r in rows)
        assert a["rejected_alone"] == sum((r.fail_bits & policy.mask) == bit for r in rows)
    kept = quality.keep_good(frame(spark), policy)
    assert kept.columns == ["doc_id", "text", "source", "n_words"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.fail_bits & policy.mask}


def test_sharding_moves_only_into_the_new_shard(spark):
    rows = [(i, f"text {i % 50}") for i in range(2000)] + [(5, "text 5")]
    got = sharding.op2_sharding(frame(spark, rows)).collect()
    assert len(got) == 2001
    slots = {}
    for r in got:
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r.grown_shard == 24 for r in got) < 200
    edge = by_id(sharding.op2_sharding(frame(spark)))
    for i, t in EDGE:
        b = (t or "").encode()
        assert (edge[i].size, edge[i].text_crc32) == (len(b) + 8, zlib.crc32(b))
    assert sharding.op2_sharding(empty(spark)).count() == 0


def test_sharding_follows_weights(spark):
    got = Counter(r.shard for r in sharding.shard(spark.range(20000).withColumnRenamed("id", "k"), "k", {0: 1.0, 1: 3.0}).collect())
    assert 2.7 < got[1] / got[0] < 3.3


def test_mixing_targets_and_reruns(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "c", None])) for i in range(1500)]
    rows = [r if r[2] != "c" or k % 9 == 0 else (r[0], r[1], "a") for k, r in enumerate(rows)] + [(3, "w w w", "a"), (9999, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op3_mixing(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.op3_mixing(docs).collect()), key=str)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in order)
    assert mixing.op3_mixing(docs.limit(0)).count() == 0
    assert mixing.repeat_rows(docs).count() == sum(r.copies for r in got)


def test_mixing_keeps_expectations(spark):
    """Over seeds, a document is taken as often as its source's ratio says."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i < 30 else "b") for i in range(60)], "doc_id long, text string, source string")
    total = Counter()
    for seed in range(12):
        for r in mixing.mix(docs, f"s{seed}").collect():
            total[r.source] += r.copies
    assert abs(total["a"] / 12 / 30 - 10 / 7) < 0.2 and abs(total["b"] / 12 / 30 - 4 / 7) < 0.2


def _judged(url, rules, listed):
    """(host, path, rule, verdict, listed) of one URL, entry by entry."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = lambda e: (host == e.partition("/")[0] or host.endswith("." + e.partition("/")[0])) and path.startswith(e[len(e.partition("/")[0]) :])
    rule, own = (max((e for e in entries if fits(e)), key=lambda e: (len(e), e), default=None) for entries in (rules, listed))
    return host, path, rule, rules[rule] if rule else listed[own] if own else "allow", own


def test_urls_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urls, "SEGMENT_ENTRIES", 7)
    urls_ = [None, "no scheme", "http://EN.Example.com/en/7?x", "https://example.com/en/8", "ftp://a.net/de/", "http://example.net/de/8#a", "http://x.free-bets.example.com/fr", "http://notexample.com", "a://b://c/en/", "http://org/es/", "://", "://", "http://free-bets.example.com/responsible/x", "http://a.example.com/spam/1", "http://a.example.com/spam", "https://" + "s." * 400 + "example.org/casino/" + "x" * 3000]
    rows = list(enumerate(urls_)) + [(None, urls_[2]), (2**53 + 1, urls_[3]), (2**53 + 3, urls_[4])]
    listed = dict(x.split("\t") for x in urls.LIST_FILE.read_text().splitlines())
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.listed) for r in urls.op4_url_filter(df).collect()), key=str)
    assert got == sorted(((i, *_judged(u, dict(urls.RULES), listed)) for i, u in rows), key=str)
    assert urls.op4_url_filter(df.limit(0)).count() == 0


def test_urls_of_a_list_from_a_table(spark, monkeypatch):
    """Two thousand hosts and paths in many segments, with repeats that disagree."""
    monkeypatch.setattr(urls, "SEGMENT_ENTRIES", 100)
    rng = random.Random(11)
    entries = {f"h{rng.randrange(500)}.example.{rng.choice(['com', 'net'])}" + rng.choice(["", "/", "/a", "/a/b", "/a/bc/"]): rng.choice(["allow", "block"]) for _ in range(2000)}
    pages = [(i, f"https://{rng.choice(['', 'www.', 'x.y.'])}h{rng.randrange(600)}.example.{rng.choice(['com', 'net'])}{rng.choice(['', '/', '/a/b', '/a/bc/d?e', '/z'])}") for i in range(500)]
    table = [*entries.items(), *[(e, "allow") for e in list(entries)[:50]], (None, "block"), ("", "block"), ("example.com", None)]
    listed = spark.createDataFrame(table, "entry string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in urls.op4_url_filter(spark.createDataFrame(pages, "page_id long, url string"), listed).collect()}
    assert got == {i: _judged(u, dict(urls.RULES), entries) for i, u in pages}


def test_url_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(urls, "key", lambda e: 5)
    name = urls.DigestArray.write(spark, [("a.com/x", 2), ("b.com/y", 1)])
    found = urls.DigestArray(name).find([b"a.com/x", b"b.com/y", b"c.com/z"], np.array([5, 5, 5], np.uint64))
    assert found[2] == -1 and set(found[:2]) == {0, 1}


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(9, 30)))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    items += [(60 + m, " ".join(rng.choice(vocab) for _ in range(m))) for m in range(3, 8)] + [(70, items[3][1])]
    rows = list(EDGE)
    for n in range(120):
        i, t = items[rng.randrange(12) if n % 3 else rng.randrange(15, 20)]
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 5 + 1))):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
        around = [rng.choice(vocab) for _ in range(40)]
        rows.append((1000 + n, " ".join(around[:20] + w + around[20:])))
    rows.append((5000, "Too, SHORT!"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in decontam.op5_decontamination(frame(spark, rows), bench).collect()}
    want = {}
    for d, t in rows:
        w = decontam.words_of(t)
        for i, it in items:
            m = decontam.words_of(it)
            if len(m) < 3:
                if m and w == m:
                    want[d, i] = 0
                continue
            k = len(m) // 5 if len(m) >= 8 else 0
            best = min((decontam.edit_distance(w[s : s + len(m)], m, k) for s in range(max(1, len(w) - len(m) + 1))), default=k + 1)
            if best <= k:
                want[d, i] = best
    assert got == want
    assert decontam.op5_decontamination(empty(spark), bench).count() == 0
    assert decontam.op5_decontamination(frame(spark), bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontam.decontaminate(frame(spark, rows), bench).collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_decontamination_recall_by_length(spark):
    """Items of 3 to 200 words inside longer texts, each with as many edits as are tolerated: every one is found; the distances of ties, null and large ids too."""
    rng = random.Random(9)
    items, rows = [], []
    for i in range(140):
        m = (3, 4, 5, 6, 7, 8, 11, 20, 45, 90, 140, 200, 15, 30)[i % 14]
        item = [f"i{rng.randrange(10**6)}" for _ in range(m)]
        items.append((2**53 + i, " ".join(item)))
        w = list(item)
        for p in rng.sample(range(m), m // 5 if m >= 8 else 0):
            w[p] = f"n{rng.randrange(10**6)}"
        rows.append((2**53 + i, " ".join([*["x"] * rng.randint(0, 9), *w, "y", *w, *["z"] * 5])))
    docs = frame(spark, [*rows, (None, rows[0][1]), (None, None)])
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontam.op5_decontamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, d) for d, _ in rows} | {(None, rows[0][0])}
    texts = dict(rows)
    assert all(r.start_word == texts[r.item_id].split().index(next(x for x in texts[r.item_id].split() if x != "x")) for r in got)


def test_decontamination_finds_long_items_at_the_limit(spark):
    """Short items have the smallest ids; each long item is planted with as many edits as are tolerated."""
    rng = random.Random(8)
    items = [(i, " ".join(f"s{rng.randrange(10**6)}" for _ in range(9))) for i in range(70)]
    rows = []
    for i in range(100, 140):
        m = (30, 120, 250)[i % 3]
        item = [f"i{rng.randrange(10**6)}" for _ in range(m)]
        items.append((i, " ".join(item)))
        w = list(item)
        for p in sorted(rng.sample(range(1, m - 1), m // 10), reverse=True):
            del w[p]
        for _ in range(m // 10):
            w.insert(rng.randrange(1, len(w)), f"n{rng.randrange(10**6)}")
        rows.append((i, " ".join(["x"] * 5 + w + ["y"] * 5)))
    got = {(r.doc_id, r.item_id): r for r in decontam.op5_decontamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(d, d) for d, _ in rows}
    by_item, texts = dict(items), dict(rows)
    for (d, i), r in list(got.items())[:6]:
        w, item = texts[d].split(), by_item[i].split()
        k = len(item) // 5
        assert (r.edit_distance, r.start_word) == min((decontam.edit_distance(w[s : s + len(item)], item, k), s) for s in range(len(w) - len(item) + 1))


def _components(rows, n=3, num=90, den=100):
    """(doc_id, text) -> per row (doc_id, set size, component); rows of one id are one document, rows without one link with nothing."""
    sets, parent = [], {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append((d, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [x for x in sets if x[0] is not None]
    for i, (d, a) in enumerate(known):
        for e, b in known[:i]:
            both = len(a & b)
            if both and den * both >= num * (len(a) + len(b) - both):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else find(d) if s else d) for d, s in sets), key=str)


def _joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_ngram_join_matches_brute_force(spark):
    rng = random.Random(4)
    base = ["v%d" % rng.randrange(500) for _ in range(120)]
    rows = list(EDGE)
    for n in range(150):
        w = list(base) if n % 3 else ["v%d" % rng.randrange(500) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "z%d" % rng.randrange(50)
        rows.append((100 + n, " ".join(w)))
    rows += [(900, "A  b\tC"), (901, "a b c"), (902, "one"), (903, "ONE TWO")]
    want = _components(rows)
    assert _joined(ngram_join.op10_ngram_join(frame(spark, rows))) == want
    kept = ngram_join.keep_one(frame(spark, rows + [(100, rows[12][1])]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})
    assert kept.columns == ["doc_id", "text", "source", "n_words"]
    assert ngram_join.op10_ngram_join(empty(spark)).count() == 0


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 8, 10)])
def test_ngram_join_matches_brute_force_on_many_families(spark, n, num, den):
    """Small families of small edits, most of them of equal size, whose tokens no other family has."""
    rng = random.Random(n)
    rows = []
    for f in range(60):
        family = [["f%d-%d" % (f, rng.randrange(10**6)) for _ in range(rng.randint(12, 70))]]
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(family))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "z%d" % rng.randrange(10**6)
            family.append(w)
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate(family)]
    assert _joined(ngram_join.cluster(frame(spark, rows), n, num, den)) == _components(rows, n, num, den)


def test_ngram_join_of_null_large_and_repeated_ids(spark):
    far = 2**53
    same = " ".join("t%d" % i for i in range(40))
    other = " ".join("u%d" % i for i in range(40))
    rows = [(None, same), (far + 1, same), (far + 3, same), (None, None), (5, same), (5, other), (9, other), (12, other + " more"), (5, "alone"), (7, "alone"), (8, "lonely"), (None, "lonely")]
    want = _components(rows)
    assert _joined(ngram_join.op10_ngram_join(frame(spark, rows))) == want
    assert (far + 1, 38, 5) in want and (12, 39, 5) in want and (7, 1, 5) in want and (8, 1, 8) in want
    kept = [r.doc_id for r in ngram_join.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == [5, 8, None, None, None]


def test_ngram_join_links_members_of_one_group_past_their_leader(spark):
    """Three texts of equal size and prefix, whose tokens no other text has: the first is below 0.9 to both others."""
    rng = random.Random(7)
    powers = ngram_join._Powers()
    while True:
        first = ["q%d" % rng.randrange(10**6) for _ in range(52)]
        second = first[:25] + ["mid%d" % rng.randrange(10**6)] + first[26:]
        third = second[:-1] + ["end%d" % rng.randrange(10**6)]
        rows = [(i, " ".join(w)) for i, w in enumerate((first, second, third), 1)]
        sets = list(ngram_join.shingle_sets([t for _, t in rows], 3, powers))
        if len({tuple(s[:6]) for s in sets}) == 1 and {len(s) for s in sets} == {50}:
            break
    assert _joined(ngram_join.op10_ngram_join(frame(spark, rows))) == _components(rows) == [(1, 50, 1), (2, 50, 2), (3, 50, 2)]


def test_licenses_match_brute_force(spark):
    rows = EDGE + [(20, "Licensed under the Apache License, Version 2.0. All rights\nreserved"), (21, "cc-by cc by CC BY-NC-ND"), (22, "ccc by"), (23, "Released under the MIT License\nReleased under the license"), (24, "Licensed under CC BY-NC 4.0"), (25, "general public  license general")]
    got = by_id(licenses.op6_licenses(frame(spark, rows)))
    listed = licenses.templates(licenses.TEMPLATES, licenses.THRESHOLD)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for i, t in rows:
        w = words(t)
        hits = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base = {label for _, label in hits}
        every = set(base)
        for line in (t or "").split("\n"):
            s = set(words(line))
            met = [k for k, x in enumerate(listed) if len(s & set(x.words)) >= x.need]
            every |= {listed[k].label for k in met if not set(listed[k].above) & set(met)}
        r = got[i]
        at = [k for k, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(every)))
    assert licenses.op6_licenses(empty(spark)).count() == 0


def test_licenses_find_notices_that_wrap(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software)"
    rows = [
        (1, "Some text\n\n" + mit), (2, " * " + mit.replace("\n", "\n * ")), (3, mit.replace("\n", "\n\n")), (4, "Released under\nthe MIT License"),
        (5, "released\nwords " + "in between " * 9 + "under the\nMIT license"), (6, "Licensed under CC BY\nNC 4.0"), (7, "Licensed under\nthe Apache License,\nVersion 2.0"), (8, "plain\ntext"),
    ]
    got = by_id(licenses.op6_licenses(frame(spark, rows)))
    assert [got[i].labels for i, _ in rows] == ["mit", "mit", "", "mit", "", "cc-by,cc-by-nc-4.0", "apache-2.0", ""]
    assert [got[i].score for i in (1, 2, 3, 4, 5, 7, 8)] == [1, 1, 0, 1, 0, 1, 0]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_pii_matches_brute_force(spark):
    rng = random.Random(5)
    parts = ["a", "b.", "1", "255", "256", ".", ".", "@", "-", " ", "+", "(", "4111111111111111", "é", "😀", "\n", "1.2.3.4", "0001", "a@b.c", "+1 555 123 4567"]
    rows = EDGE + [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(400)] + [(2000, "1 " * 3000), (2001, "a@b.c " * 1200)]
    got = by_id(pii.op1_pii(frame(spark, rows)))
    for i, t in rows:
        spans, counts = [], []
        for kind, p in PII.items():
            found = [m for m in re.finditer(p, t or "") if _valid(kind, m[0])]
            counts.append(len(found))
            spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert r.spans.startswith(",".join(spans))
    assert pii.op1_pii(empty(spark)).count() == 0


def test_pii_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words tel no: +1 555 123 {1000 + i} and more") for i in range(20)] + [(100 + i, f"others tel no: 555-123-{1000 + i}, ok") for i in range(5)] + [(200, "no tel: 555-123-9999 here")]
    got = by_id(pii.op1_pii(frame(spark, rows)))
    assert all("ctx_phone:15:27" in got[100 + i].spans for i in range(5))
    assert got[200].spans == "" and all(got[i].n_found == 0 for i in range(20))


def test_pii_contexts_by_row_and_kind(spark):
    """Rows that share an id, private-use characters that look like marks, long gaps, and every kind behind its own words."""
    card = lambda i: next(c for k in range(10) if _valid("card", c := f"45320151{1000 + i}311{k}"))
    gap = "x" * 300
    rows = [(i, f"reach me via mail: user{i}@host{i}.org or so, card no: {card(i)} fine, node addr: 10.0.{i}.1 up, call tel no: +1 555 123 {1000 + i} now") for i in range(20)]
    rows += [(300, "nothing at all"), (300, "see tel no: 555-123-4444 ok"), (None, "old tel no: 555-123-4445 ok"), (None, "no number"), (301, "x \ue003 tel no: 555-123-4446"), (302, f"{gap} tel no: 555-123-4447")]
    rows += [(303, "via mail: john.doe(at)example.org ok"), (304, "card no: 4532.0151.1283.0366 ok"), (305, "node addr: 10-0-7-1 ok")]
    rows += [(400 + i, "words \ue003\ue003 here zip: \ue003 12345-678") for i in range(20)] + [(450, "zip: 555-123-4448")]
    got = {}
    for r in pii.op1_pii(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.spans)
    assert sorted(got[300]) == ["", "ctx_phone:12:24"] and sorted(got[None]) == ["", "ctx_phone:12:24"]
    assert (got[301], got[302]) == (["ctx_phone:12:24"], ["ctx_phone:309:321"])
    assert (got[303], got[304], got[305]) == (["ctx_email:10:33"], ["ctx_card:9:28"], ["ctx_ip:11:19"])
    assert all(got[400 + i] == [""] for i in range(20)) and got[450] == [""]
    assert all("ctx" not in got[i][0] for i in range(20))


def test_secrets_base_and_lexing(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = EDGE + [(30, f'token = "abcd1234efgh" {key} ' + "0f" * 20), (31, "Password:short api_key=longenough1"), (32, 'VALUE = "A9f83hfKq02LmZx"\nx = 1\nclient_secret_key = VALUE'), (33, "the token: it is"), (34, '{"auth_token": "ab12cd34ef56gh"}')]
    got = by_id(secrets.op7_secrets(frame(spark, rows)))
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in rows:
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t or "") if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert "named:9:24" in got[32].spans and "named:16:30" in got[34].spans and "named" not in got[33].spans
    assert secrets.op7_secrets(empty(spark)).count() == 0
    big = [(None, rows[-1][1]), (2**53 + 1, rows[-2][1]), (2**53 + 3, rows[-3][1])]
    assert {(r.doc_id, r.spans) for r in secrets.op7_secrets(frame(spark, big)).collect()} == {(i, got[j].spans) for (i, _), j in zip(big, (34, 33, 32), strict=True)}


def test_secrets_named_spans_of_generated_sources():
    """Programs of known names and literals in every syntax; what is to be found follows from how they were made."""
    rng = random.Random(12)
    sensitive, plain = ["db_password", "clientSecret", "auth_token", "AWS_SECRET_KEY", "private_key"], ["width", "title", "colour", "retries", "mode"]
    strong = lambda: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(20))
    for _ in range(300):
        text, want = "", set()

        def put(piece, secret=False):
            nonlocal text
            if secret:
                want.add((len(text), len(text) + len(piece)))
            text += piece

        for _ in range(rng.randint(1, 6)):
            hot, form, literal = rng.random() < 0.6, rng.randrange(9), strong()
            name = rng.choice(sensitive if hot else plain)
            if form == 0:
                put(f'{name} = "'), put(literal, hot), put('"\n')
            elif form == 1:
                put(f"{name}: "), put(literal + "/x+y==", hot), put("\n")
            elif form == 2:
                put(f'{{"{name}": "'), put(literal, hot), put('", "other": 3}\n')
            elif form == 3:
                put(f"'{name}' => '"), put(literal, hot), put("',\n")
            elif form == 4:
                put(f'a{len(text)} = {name} = b = "'), put(literal, hot), put('"\n')
            elif form == 5:
                put(f"V{len(text)}X = '"), put(literal, hot), put("'\n")
                put(f"{name} = {text[: text.rindex(' = ')].splitlines()[-1]}\n")
            elif form == 6:
                later = f"LATER{len(text)}"
                put(f"{name} = {later}\nplain words here\n{later} := \""), put(literal, hot), put('"\n')
            elif form == 7:
                put(f'{name} = "'), put(literal[:9], hot), put("\" + '"), put(literal[9:], hot), put("'\n")
            else:
                put(f'{name} = """'), put(literal + "\nno operator in this line\n" + literal, hot), put('"""\n')
            put(rng.choice(["\n", "some prose without signs\n", f"{name}()\n", ""]))
        assert {(a, b) for a, b, _ in secrets.named(text)} == want, text


def test_secrets_names_in_circles():
    text = 'token_a = token_b\ntoken_b = token_a\nsecret_c = secret_c\n' + "".join(f"k{i} = k{i + 1}\n" for i in range(5000)) + 'k5000 = "Zx81mPq0Lr7TgW2s"\nauth_token = k0\n'
    start = text.index("Zx81")
    assert (start, start + 16) in {(a, b) for a, b, _ in secrets.named(text)}
    assert secrets.named("password = load_value(1)\nsecret_key = None") == []


def test_toxicity_decoding_is_the_best_reading():
    """Viterbi against all readings of short lattices, under language models of random counts."""
    rng = random.Random(13)
    for trial in range(120):
        decoder = toxicity.Decoder(np.array([rng.choice((0, 0, 1, 5, 40)) for _ in range(toxicity.SYMBOLS**3)]))
        apart = trial % 2 == 0
        word = "".join(rng.choice("abst1035@$!") * rng.choice((1, 1, 1, 3)) for _ in range(rng.randint(1, 4)))[:5]
        if trial % 5 == 1:
            word = word[:2] + "*"

        def score(choice):
            total, a, b = 0.0, 0, 0
            for letters, p in choice:
                total += p
                for c in letters:
                    k = 0 if c == " " else toxicity.symbol(c)
                    total += decoder.log[a][b][k]
                    a, b = (0, 0) if c == " " else (b, k)
            return total + decoder.log[a][b][0]

        best = max(itertools.product(*decoder.arcs(word, apart)), key=score)
        got = decoder.decode(word, apart)
        readings = [score(c) for c in itertools.product(*decoder.arcs(word, apart)) if "".join(x for x, _ in c) == got]
        assert max(readings) == pytest.approx(score(best))


def test_toxicity_decodes_words_of_any_length():
    counts = np.zeros((toxicity.SYMBOLS,) * 3, np.int64)
    for w in ["idiot", "you", "are", "an"] * 50 + ["x" * 30]:
        s = [0, 0, *map(toxicity.symbol, w), 0]
        for t in zip(s, s[1:], s[2:], strict=False):
            counts[t] += 1
    decoder = toxicity.Decoder(counts.reshape(-1))
    assert {"you", "idiot"} <= decoder.words("y o u i d i o t")
    assert {"you", "are", "an", "idiot"} <= decoder.words("say y.o.u.a.r.e.a.n.i.d.i.o.t now")
    assert "idiot" in decoder.words("iii" * 20 + "d1" + "o" * 30 + "ttt")
    assert "".join(c for c in decoder.restore("i d 1 o t " * 3000) if c != " ") == "idiot" * 3000
    assert decoder.words(None) == decoder.words("") == set()


def test_toxicity_restores_and_learns(spark):
    rng = random.Random(6)
    calm = ["river", "stone", "garden", "window", "paper", "light", "table", "music"]
    rows, labels = list(EDGE), []
    for i in range(300):
        w = [rng.choice(calm) for _ in range(20)]
        if i % 3 == 0:
            w[rng.randrange(20)] = rng.choice(["idiot", "1d10t", "i d i o t"])
        rows.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, 1, int(i % 3 == 0)))
    lab = spark.createDataFrame([*labels, (77777, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.op8_toxicity(frame(spark, rows), lab))
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert toxicity.op8_toxicity(empty(spark), lab).count() == 0
    big = [(None, "you idiot"), (2**53 + 1, "river idiot"), (2**53 + 3, "river")]
    more = {r.doc_id: r.predicted for r in toxicity.op8_toxicity(frame(spark, [*rows, *big]), lab.withColumn("text", F.lit("idiot"))).collect()}
    assert (more[None], more[2**53 + 1], more[2**53 + 3]) == (1, 1, 0) and len(more) == len(rows) + 3
    none = toxicity.op8_toxicity(frame(spark), lab.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)


def _shard(key, weights):
    """Rendezvous by hand; Spark hashes a list of values by using each one's hash as the seed of the next."""

    def score(shard, weight):
        h = xxhash.xxh64_intdigest(b"rendezvous-1", 42)
        h = h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
        return weight / -math.log(((h >> 11) + 0.5) / 2**53)

    return max(weights, key=lambda s: (score(s, weights[s]), s))


def test_sharding_matches_the_hash_rule(spark):
    keys = [None, 0, -5, 2**53 + 1, 2**62, *range(1, 300)]
    weights = {0: 1.0, 1: 2.5, 7: 0.5, 23: 4.0}
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert {r.k: r.shard for r in sharding.shard(df, "k", weights).collect()} == {k: _shard(k, weights) for k in keys}
    got = by_id(sharding.op2_sharding(frame(spark, [(k, "t") for k in keys])))
    assert all((got[k].shard, got[k].grown_shard) == (_shard(k, dict.fromkeys(range(24), 1.0)), _shard(k, dict.fromkeys(range(25), 1.0))) for k in keys)


def _good(text):
    w = WORDS.findall(text or "")
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w) >= 10 and 5 * len(repeated) <= len(w) and 10 * symbols <= len(w) and 100 * (len(lines) - len(set(lines))) <= 40 * len(lines) and 2 * len(w) <= chars <= 20 * len(w)


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(14)
    items = [(i, " ".join(f"b{i}w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 40)))) for i in range(6)]
    rows = [(i, t, "en", "s0", 1) for i, t in EDGE] + [(None, "without an id " + " ".join(f"n{k}" for k in range(12)), "en", None, 1)]
    for f in range(40):
        base = [f"f{f}w{rng.randrange(10**6)}" for _ in range(rng.randint(12, 60))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                w[5:5] = rng.choice(items)[1].split()
            rows.append((1000 + len(rows), " ".join(w), "en", rng.choice(["s0", "s1", "s2", "s3", None]), 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns + ["shard"] * (name == "sharding")
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(sorted(map(tuple, docs.collect()), key=str))
    want = sorted((r for r in rows if _good(r[1])), key=str)
    assert outs[0] == want
    component = {d: c for d, _, c in _components([r[:2] for r in want], 5, 8, 10)}
    want = [r for r in want if r[0] is None or component[r[0]] == r[0]]
    assert outs[1] == want and len(want) < len(outs[0])

    def leaks(text):
        w = decontam.words_of(text)
        return any(decontam.edit_distance(w[s : s + len(m)], m, k) <= k for _, it in items for m in [decontam.words_of(it)] for k in [len(m) // 5 if len(m) >= 8 else 0] for s in range(max(1, len(w) - len(m) + 1)))

    want = [r for r in want if r[0] is None or not leaks(r[1])]
    assert outs[2] == want and len(want) < len(outs[1])
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(want, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert outs[3] == sorted((r for r in want for _ in range(copies[r[0]])), key=str)
    assert all(n <= 3 for n in copies.values())
    assert outs[4] == sorted(((*r, _shard(r[0], dict.fromkeys(range(24), 1.0))) for r in outs[3]), key=str)
    held = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect()), key=str) == outs[4]
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - held
    # the result, and what its plan would have read again
    assert len(left) <= 2


def test_pipeline_of_no_documents(spark, sf, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0

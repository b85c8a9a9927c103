"""The library's queries against DuckDB at the smallest scale, and the semantics that are easy to get wrong."""

import hashlib
import math
import random
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import votes
from quernstone.operators import dedupe, metrics, overlap, sampling
from quernstone.plans import catalog, curation
from quernstone.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; all of them are compared at a larger scale outside the tests.
COMPARED = [
    "contaminated_documents", "set_rule", "dedupe_exact_text", "dedupe_normalised", "remove_split_leaks", "hash_split", "apportion", "stratified_take", "matched_cells",
    "cap_top_share", "systematic_fraction", "mask_pii", "lang_filter", "read_csv_tsv", "journal_stream", "windowed_events", "accuracy", "macro_f1", "ece_binned", "augrc",
    "item_gold_join", "join_qrels", "confusion_guard", "saturated_datasets", "pack_windows", "canonical_json", "half_half_quota_select", "join_exact_hash", "paired_draw", "water_fill",
    "audit_sample", "audit_report", "replace_vote", "row_validation", "licence_predicate", "manifest_checks", "trivial_rows", "row_weights", "memorised", "mining", "review_report",
    "dev_compare", "permutation_p", "shuffle_prefix", "promote_assert_disjoint", "two_pass_subsample", "mix_recount", "text_screen", "shingle_lookup", "length_batches", "item_flaws",
    "read_archive_member", "pinned_download", "positive_negative_rows", "parliament_draw", "pii_detect", "ocr_glued", "sentence_reject", "paired_bootstrap", "stratified_carve",
    "temperature_fit", "isotonic_abstain_map", "contamination_stream", "candidate_overlap", "stems_jaccard", "alternate_halves", "balanced_class_draw", "round_robin_batches", "token_shards",
    "coverage_at_risk", "bootstrap_ci", "geometric_mean_board", "confident_flags", "parse_distribution", "collect_gold", "result_diff", "substring_join", "gram_cooccurrence_selfjoin",
]


def _rows(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float")) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_names_are_registered():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES


def test_greedy_keeps_both_ends_of_a_chain(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert sorted(r.id for r in dedupe.greedy_keep(nodes, edges).collect()) == [1, 3, 4]
    assert {(r.node, r.root) for r in dedupe.connected(edges).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_coverage_counts_tokens_not_grams(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h x y z w q r s t"), (2, "a a a b c d e f g h"), (3, ""), (4, "A b")], "doc_id long, text string")
    refs = spark.createDataFrame([(7, "a b c d e f g h"), (8, "a B")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.rule): r.share for r in overlap.contaminated(docs, refs).collect()}
    assert got == {(1, 7, "covers_reference"): 1.0, (2, None, "ngram"): 1.0, (2, 7, "covers_reference"): 1.0, (2, 7, "whole"): 1.0, (4, 8, "whole"): 1.0}


def test_near_pairs_finds_what_is_near(spark):
    """Pairs of five-word shingles at similarities around 0.8, against all pairs."""
    rng = random.Random(1)
    rows = []
    for i in range(0, 300, 2):
        w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        v = list(w)
        for p in rng.sample(range(120), 1 + i % 6):
            v[p] = f"x{rng.randrange(10**6)}"
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    want = {(i, i + 1) for i in range(0, 300, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    got = {(r.a, r.b) for r in overlap.near_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 0


def test_hash_rank_matches_one_window(spark):
    """Groups of any size, nulls among them, against a rank in one window."""
    rows = [(None if i % 3 == 0 else "ab"[i % 2], i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long")
    got = {r.i: (r._rank, r._total) for r in sampling.hash_rank(df, ["g"], "s", "i").collect()}
    want = {r.i: (r._rank, sum(g == r.g for g, _ in rows)) for r in sampling._rank(df, ["g"], sampling.keyed("s", "i"), F.col("i")).collect()}
    assert got == want and len(got) == 400


def test_running_keeps_groups_without_a_name(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3)], "g string, i long, n long")
    assert sorted((r.i, r.before, r.total) for r in sampling.running(df, "g", "i", "n").collect()) == [(1, 0, 5), (2, 2, 5)]


def test_resampling_draws_like_poisson(spark):
    items = spark.createDataFrame([("a", i, float(i)) for i in range(200)], "b string, i long, v double")
    means = [r.v for r in metrics.resample(items, ["b"], "i", ["v"], 800, "s").collect()]
    assert len(means) == 800 and abs(sum(means) / 800 - 99.5) < 1
    spread = (sum((m - 99.5) ** 2 for m in means) / 800) ** 0.5
    assert 0.85 < spread / (57.73 / 200**0.5) < 1.15


def _position_effect(questions, shuffles, salt):
    """(v, p) run by run: questions of key -> runs (place of three, right)."""

    def v(runs):
        table = [[sum(r == (i, j) for r in runs) for j in range(2)] for i in range(3)]
        e = [[sum(table[i]) * sum(x[j] for x in table) / len(runs) for j in range(2)] for i in range(3)]
        return math.sqrt(sum((table[i][j] - e[i][j]) ** 2 / e[i][j] for i in range(3) for j in range(2) if e[i][j]) / len(runs))

    def dealt(k, key, runs):
        words = hashlib.sha256(f"{salt}:{k}:{key}".encode()).hexdigest()
        order = sorted((words[8 * i : 8 * i + 8], p) for i, (p, _) in enumerate(runs))
        return [(p, c) for (_, p), (_, c) in zip(order, runs, strict=True)]

    seen = v([r for runs in questions.values() for r in runs])
    hits = sum(v([r for key, runs in questions.items() for r in dealt(k, key, runs)]) >= seen - 1e-12 for k in range(shuffles))
    return seen, (1 + hits) / (shuffles + 1)


def test_shuffles_of_places_run_by_run(spark):
    rng = random.Random(7)

    def got(questions, shuffles=60):
        df = spark.createDataFrame(list(questions.items()), "q string, r array<struct<p: int, c: int>>")
        return metrics.position_effect(df, "q", "r", [0, 1, 2], [0, 1], shuffles, "s")

    mixed = {f"q{i}": [(rng.randrange(3), rng.randrange(2)) for _ in range(1 + i % 8)] for i in range(120)}
    uneven = {k: [(p, int(p == 0 or c)) for p, c in runs] for k, runs in mixed.items()}
    for questions in (mixed, uneven, {"three": [(0, 1), (1, 0), (2, 0)]}):
        assert got(questions).first() == pytest.approx(_position_effect(questions, 60, "s"), abs=1e-12)
    # no shuffle changes these, so all reach the observed table; without questions there is none
    alike = {"right": [(0, 1), (1, 1)], "wrong": [(2, 0), (1, 0), (0, 0)], "place": [(1, 0), (1, 1)]}
    assert got(alike).first() == pytest.approx((_position_effect(alike, 60, "s")[0], 1.0), abs=1e-12)
    assert tuple(got({}).first()) == (None, 1 / 61)


def test_shuffles_are_rows_of_questions_that_they_change(spark):
    rows = [("a", [(0, 1), (1, 0), (2, 0)]), ("b", [(0, 1), (1, 1), (2, 1)]), ("c", [(2, 0), (2, 1), (2, 0)])]
    df = metrics.position_effect(spark.createDataFrame(rows, "q string, r array<struct<p: int, c: int>>"), "q", "r", [0, 1, 2], [0, 1], 50, "s")
    # a function with a lambda is evaluated element by element, which for each question and shuffle took most of the time
    above, explode, _ = df._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")
    assert explode and "lambda" not in above
    df.collect()
    made, todo = [], [df._jdf.queryExecution().executedPlan().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        made += [node.metrics().apply("numOutputRows").value()] if node.nodeName() == "Generate" else []
    assert made == [50]


def test_promotion_refuses_shared_texts(spark):
    rows, none = spark.createDataFrame([(1,), (2,)], "a long"), spark.createDataFrame([], "k string")
    assert curation.refuse_if_any(rows, none, "shared").count() == 2
    with pytest.raises(Exception, match="1 shared"):
        curation.refuse_if_any(rows, spark.createDataFrame([("x",)], "k string"), "shared").collect()


def test_archives_of_both_kinds(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.txt", "one\ntwo\u2028still two\n")
        z.writestr("other.txt", "no")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in/x.txt")
        info.size = 5
        t.addfile(info, io.BytesIO(b"three"))
    got = files.archive_lines(spark, str(tmp_path), "in/x.txt").collect()
    assert sorted((r.archive.rsplit("/", 1)[1], r.line) for r in got) == [("a.zip", "one"), ("a.zip", "two\u2028still two"), ("b.tar.gz", "three")]
    with pytest.raises(Exception, match="has no"):
        files.archive_lines(spark, str(tmp_path), "absent.txt").collect()


def test_running_sums_over_bins(spark):
    rows = [(g, i * 37 % 1000 - 200, i % 5) for i in range(500) for g in ("a", "b")]
    got = {(r.g, r.i): (r.before, r.total) for r in sampling.running(spark.createDataFrame(rows, "g string, i long, n long"), "g", "i", "n", 16).collect()}
    assert got == {(g, i): (sum(n for h, j, n in rows if h == g and j < i), sum(n for h, _, n in rows if h == g)) for g, i, _ in rows}


def test_water_fill_and_apportion(spark):
    sizes = spark.createDataFrame([("a", 2), ("b", 10), ("c", 10)], "g string, n long")
    assert {r.g: r.share for r in sampling.water_fill(sizes, "g", "n", 13).collect()} == {"a": 2, "b": 6, "c": 5}
    assert {r.g: r.share for r in sampling.water_fill(sizes, "g", "n", 99).collect()} == {"a": 2, "b": 10, "c": 10}
    assert sum(r.share for r in sampling.apportion(sizes, "g", "n", 7).collect()) == 7


def test_letters_and_responses(spark):
    tokens = [" A", "a", "(B", "C.", "(d.)", "ab", "", "ı", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(votes.letter(F.col("t")).alias("x")).collect()]
    assert got == ["A", "A", "B", "C", "D", "", "", "", None]
    row = lambda top: '{"choices": [{"logprobs": {"content": [{"top_logprobs": ' + top + "}]}}]}"
    said = [row('[{"token": "A", "logprob": -0.05}, {"token": "x", "logprob": -9}]'), row('[{"token": "A", "logprob": -1}]'), row("[]"), row("null"), row('[{"token": "A"}]'), "{}", "no JSON", None]
    got = [r.r for r in spark.createDataFrame([(t,) for t in said], "t string").select(votes.distribution("t", 2).alias("r")).collect()]
    assert [r.reason for r in got] == [None, "low mass"] + ["no logprobs"] * 6
    assert got[0].probs == [1.0, 0.0] and abs(got[0].off_mass - (1 - math.exp(-0.05))) < 1e-9 and got[1].probs is None


def test_confident_flags_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        p = [rng.choice([1, 2, 3, 5, 9]) for _ in range(3)]
        rows.append(("t", i, rng.choice([0, 0, 0, 1]) if i % 3 else 2, [x / sum(p) for x in p]))
    label = {i: g for _, i, g, _ in rows}
    probs = {i: p for _, i, _, p in rows}
    of = {g: [i for i in label if label[i] == g] for g in range(3)}
    bar = {g: math.fsum(probs[i][g] for i in of[g]) / len(of[g]) for g in of}
    guess = {i: max(((p, k) for k, p in enumerate(probs[i]) if p >= bar[k]), default=(0, None))[1] for i in label}
    want = set()
    for g in of:
        counted = [i for i in of[g] if guess[i] is not None]
        for k in set(range(3)) - {g}:
            quota = round(sum(guess[i] == k for i in counted) / len(counted) * len(of[g]))
            ranked = sorted(((probs[i][k] - probs[i][g], i) for i in of[g]), reverse=True)
            want |= {i for m, i in ranked[:quota] if m > 0}
    got = metrics.confident(spark.createDataFrame(rows, "task string, id long, gold int, probs array<double>"), "task", "id")
    assert {r.id for r in got.collect()} == want and 0 < len(want) < 600


def test_label_conflict_drops_every_copy(spark):
    rows = spark.createDataFrame([(1, "x", 0), (2, "x", 1), (3, "y", 1), (4, "y", 1)], "id long, t string, l int")
    assert [(r.id, r.copies) for r in dedupe.exact_text(rows, "t", "l", "id").collect()] == [(3, 2)]


def test_metrics_ties_and_null_gold(spark):
    rows = spark.createDataFrame([([0.5, 0.5], 0), ([0.2, 0.8], 0), ([0.9, 0.1], None)], "probs array<double>, gold int")
    s = metrics.scored(rows).orderBy("confidence").collect()
    assert [(r.predicted, r.hit) for r in s] == [(0, 1), (1, 0)]
    assert abs(s[1].brier - 1.28) < 1e-9 and abs(s[1].nll - math.log(5)) < 1e-9
    assert [round(x, 6) for x in rows.select(metrics.temper(F.array(F.lit(0.0), F.lit(1.0)), 2.0).alias("x")).first().x] == [0.0, 1.0]


def test_text_functions(spark):
    row = spark.createDataFrame([("Ab ab  ab c İI",)], "t string").select(T.collapse_runs(T.tokens("t")).alias("w"), T.squash("t").alias("s"), T.tokens("t", "tr").alias("tr"), T.grams(T.tokens("t"), 9).alias("none")).first()
    assert row.w[:2] == ["ab", "c"] and row.s == "Ab ab ab c İI" and row.tr[-1] == "iı" and row.none == []


def test_style_leak_reads_whole_texts(spark, tmp_path):
    """The only mark of a class stands behind 2,500 characters that all texts share."""
    rows = [(i, "word " * 500 + ("!?" * 40 if i % 2 else "calm end " * 9)) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.label: r.recall for r in catalog.QUERIES["style_leak"](spark, str(tmp_path)).collect()}
    assert got == {0.0: 1.0, 1.0: 1.0}


def test_stems_jaccard_compares_documents_with_items(spark, tmp_path):
    docs = [(1, "Gardens gardening that Windows", "en"), (2, "Gardens gardening that Windows", "fr"), (3, "nothing here alike", "en"), (4, None, "en"), (5, "windows", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "that garden, a window or paper"), (8, "that stone"), (9, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): round(r.jaccard, 6) for r in catalog.QUERIES["stems_jaccard"](spark, str(tmp_path)).collect()}
    assert got == {(1, 7): 0.666667, (2, 7): 0.5, (5, 7): 0.333333}


def test_library_does_not_need_the_subpackage():
    code = "import sys; sys.modules['quernstone.llm'] = None; sys.modules['corpus_pipeline'] = None; from quernstone.plans import catalog; print(len(catalog.QUERIES))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 100

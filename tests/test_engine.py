"""Scenarios of retrieval, fusion, evaluation, training, models, validation and outputs."""

import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.operators import evaluation as E, features as P, fusion, models as M, packs, retrieval as R, training as T, validation as V
from matchloom.plans import pipeline
from matchloom.sources import files
from matchloom.streaming import batches

ROW = "entity_id string, business_name string, business_address string, country string, seq long"


def recs(spark, *rows):
    return files.records(spark.createDataFrame([(i, n, a, c, k) for k, (i, n, a, c) in enumerate(rows)], ROW))


def ids(df):
    return [r.candidate_id for r in df.orderBy("rank").collect()]


def test_tfidf_finds_the_same_name_among_many(spark):
    c = recs(spark, *((f"S2-{i}", f"company number {i} solutions", "", "us") for i in range(100)))
    q = recs(spark, ("S1-1", "company number 50 solutions", "", "us"))
    got = R.tfidf(q, R.tfidf_fit(c, "name", R.word_terms, 0.5, min_df=1), "name", 5, R.word_terms, None)
    assert ids(got)[0] == "S2-50"
    assert got.orderBy("rank").first().score > 0.8


def test_tfidf_by_hand(spark):
    c = recs(spark, ("S2-1", "aa bb", "", "us"), ("S2-2", "aa cc", "", "us"), ("S2-3", "dd cc", "", "us"))
    idf = {r.term: r.idf for r in R.tfidf_fit(c, "name", R.word_terms, 1.0)[0].collect()}
    assert idf == pytest.approx({"aa": math.log(4 / 3) + 1, "cc": math.log(4 / 3) + 1})
    w = {(r.candidate_id, r.term): r.w for r in R.tfidf_fit(c, "name", R.word_terms, 1.0)[1].collect()}
    assert w == pytest.approx({("S2-1", "aa"): 1.0, ("S2-2", "aa"): 0.5**0.5, ("S2-2", "cc"): 0.5**0.5, ("S2-3", "cc"): 1.0})


def test_short_words_give_one_term(spark):
    df = spark.createDataFrame([("a bc def",)], "t string").select(R.char_terms(F.col("t")).alias("x"))
    assert sorted(df.first().x) == sorted([" a ", " bc", "bc ", " bc ", " de", "def", "ef ", " def", "def "])


def test_empty_vocabulary_gives_no_rows(spark):
    c, q = recs(spark, ("S2-1", "aa", "", "us")), recs(spark, ("S1-1", "aa", "", "us"))
    assert R.tfidf(q, R.tfidf_fit(c, "name"), "name", 5).count() == 0


def test_bm25_ranks_shared_tokens_first(spark):
    c = recs(spark, ("S2-1", "acme corporation", "elm street", "us"), ("S2-2", "globex industries", "oak avenue", "us"))
    assert ids(R.bm25(recs(spark, ("S1-1", "acme logistics", "elm road", "us")), R.bm25_fit(c)))[0] == "S2-1"


def test_exact_counts_a_repeated_token_twice(spark):
    c = recs(spark, ("S2-1", "acme acme works", "", "us"))
    got = R.exact(recs(spark, ("S1-1", "acme acme works", "", "us")), c, indexes=("country_distinctive",)).first()
    assert got.score == 1.5 * (2 * 2 + 1)


def test_exact_keeps_the_first_of_a_key(spark):
    c = recs(spark, *((f"S2-{i:03}", f"x{i}", f"{i} A St, 12345", "us") for i in range(40)))
    got = R.exact(recs(spark, ("S1-1", "other", "9 B St, 12345", "us")), c, indexes=("country_postal",))
    assert ids(got) == [f"S2-{i:03}" for i in range(25)]


def test_country_fallback(spark):
    two = spark.createDataFrame([("S2-1", "a", "", "us", 0), ("S2-2", "b", "", "in", 1)], ROW)
    assert [r.entity_id for r in files.in_country(two, "us").collect()] == ["S2-1"]
    assert files.in_country(two, "unknown").count() == 2
    assert files.in_country(two, "unknown", fallback=False).count() == 0
    three = spark.createDataFrame([("S3-1", "c", "", "us", 0)], ROW)
    assert files.in_country(three, "unknown", existing=files.in_country(two, "unknown")).count() == 2


def test_rarer_tokens_have_larger_idf(spark):
    c = recs(spark, ("S2-1", "RareTokenX Enterprise", "", ""), ("S2-2", "CommonToken Enterprise", "", ""), ("S3-1", "CommonToken Corp", "", ""))
    idf = {r.token: r.idf for r in P.rarity_fit(c).collect()}
    assert idf["raretokenx"] > idf["commontoken"]
    assert idf["commontoken"] == pytest.approx(math.log(3 / 3))


CASES = [
    ("exact", "Microsoft Corporation", "One Microsoft Way, Redmond, WA 98052", "us"), ("suffix", "Infosys Private Limited", "Electronics City, Bangalore 560100", "in"), ("typo", "Reliance Retail", "Maker Chambers, Mumbai 400021", "in"),
    ("addr-abbr", "Starbucks Coffee", "2401 Utah Ave South, Seattle, WA 98134", "us"), ("reorder", "Express Global Logistics", "12 Dock Rd, Chennai 600001", "in"), ("no-postal", "Blue Dart Aviation", "Airport Road, Mumbai", "in"),
    ("distractor", "Redmond Bakery", "One Microsoft Way, Redmond, WA 98052", "us"), ("french", "Boulangerie Paul", "12 Rue de la Paix, 75002 Paris", "fr"), ("hindi", "Laxmi General Store", "MG Road, Pune 411001", "in"), ("cross-country", "Amazon Services", "Seattle, WA 98109", "us"),
]
ASKED = [
    ("exact", "Microsoft Corporation", "One Microsoft Way, Redmond, WA 98052", "us"), ("suffix", "Infosys Pvt Ltd", "Electronics City, Bangalore 560100", "in"), ("typo", "Relience Retail", "Maker Chambers, Mumbai 400021", "in"),
    ("addr-abbr", "Starbucks Coffee", "2401 Utah Avenue South, Seattle, WA 98134", "us"), ("reorder", "Logistics Global Express", "12 Dock Road, Chennai 600001", "in"), ("no-postal", "Blue Dart Aviation", "Airport Road, Mumbai", "in"),
    ("french", "Boulangerie Paul SARL", "12 Rue de la Paix, 75002 Paris", "fr"), ("hindi", "Lakshmi General Store", "MG Road, Pune 411001", "in"), ("cross-country", "Amazon Services", "Bangalore 560001", "in"),
]


def test_edge_cases_are_retrieved(spark):
    c = recs(spark, *((f"S2-{k}", n, a, co) for k, n, a, co in CASES), ("S3-1", "Filler Works", "1 X St", "us")).persist()
    q = recs(spark, *((f"S1-{k}", n, a, co) for k, n, a, co in ASKED)).persist()
    kept, _ = fusion.generate(q, c)
    got = {}
    for r in kept.orderBy("s1_id", "rank").collect():
        got.setdefault(r.s1_id, []).append(r.candidate_id)
    for k in ("exact", "suffix", "typo", "addr-abbr", "reorder", "no-postal", "french", "hindi"):
        assert f"S2-{k}" in got[f"S1-{k}"], k
    assert "S2-cross-country" not in got.get("S1-cross-country", [])
    mine = got["S1-exact"]
    assert "S2-distractor" not in mine or mine.index("S2-exact") < mine.index("S2-distractor")
    assert all(len(v) == len(set(v)) <= 40 for v in got.values())


def test_feature_names():
    assert len(P.names()) == 60 and len(P.names(True)) == 63 and P.names() == sorted(P.names())


def test_quotas(spark):
    rows = [("S1-1", f"{s}-{i:02}", "bm25", i + 1, 1.0) for s in ("S2", "S3") for i in range(30)]
    found = spark.createDataFrame(rows, "s1_id string, candidate_id string, channel string, rank int, score double").drop("channel")
    kept = fusion.compress(fusion.merged({"bm25": found}), s2=5, s3=7, most=10)
    n = {r.candidate_source: r["count"] for r in kept.groupBy("candidate_source").count().collect()}
    assert kept.count() == 10 and n["S2"] <= 5 and n["S3"] <= 7


def test_rerank_budget_and_fusion(spark):
    rows = [(f"S1-{e}", f"S2-{j}", 0.45 + 0.02 * j) for e in range(50) for j in range(5)]
    s = spark.createDataFrame(rows, "s1_id string, candidate_id string, score double")
    some = M.ambiguous(s, per_row=5, batch=10, fraction=0.5, left=15)
    assert some.count() == 10
    assert M.ambiguous(s, left=0).count() == 0
    texts = spark.createDataFrame([(f"S1-{e}", "a") for e in range(50)] + [(f"S2-{j}", "b") for j in range(5)], "entity_id string, record_text string")
    fused = M.fuse(s, M.rerank(some, texts, lambda a, b: a.map(len) * 0.0))
    assert fused.count() == 250 and fused.where("abs(score - (0.4 * 0.5 + 0.6 * 0.5)) < 0.03").count() >= 10


TRUTH = "s1_id string, matches array<string>"


def gate_data(spark):
    truth = spark.createDataFrame([("S1-1", ["S2-1", "S3-1"]), ("S1-2", ["S2-2"])], TRUTH)
    one = lambda rows: fusion.merged({"bm25": spark.createDataFrame(rows, "s1_id string, candidate_id string, rank int, score double")}).withColumn("rank", F.col("bm25_rank"))
    final = one([("S1-1", "S2-1", 1, 1.0), ("S1-2", "S2-2", 1, 1.0)])
    raw = one([("S1-1", "S2-1", 1, 1.0), ("S1-1", "S3-1", 2, 1.0), ("S1-2", "S2-2", 1, 1.0)])
    return truth, final, raw


def test_recall_gate(spark):
    truth, final, raw = gate_data(spark)
    r = E.recall_gate(final, truth, raw, 5).first()
    assert (r.raw_recall_ceiling, r.recall_ceiling, r.country_filter_hits) == (1.0, pytest.approx(2 / 3), 5)
    assert r.quota_retention_rate == pytest.approx(2 / 3) and r.channel_bm25 == pytest.approx(2 / 3) and r.channel_exact == 0
    assert E.staged(r.asDict())["stage_C_pre_rrf_union"] == 1.0


def test_incremental_gate_is_the_full_gate(spark):
    truth, final, raw = gate_data(spark)
    gate = E.IncrementalGate(truth)
    for e in ("S1-1", "S1-2"):
        gate.update(final.where(F.col("s1_id") == e), raw.where(F.col("s1_id") == e))
    full = E.recall_gate(final, truth, raw, 5).first().asDict()
    assert gate.summary(5) == pytest.approx(full)


def test_f05(spark):
    truth = spark.createDataFrame([("a", []), ("b", []), ("c", ["x"]), ("d", ["x", "y"])], TRUTH)
    p = spark.createDataFrame([("b", "z"), ("d", "x"), ("d", "w"), ("d", "x")], "s1_id string, candidate_id string")
    f = {r.s1_id: r.f05 for r in E.entity_f05(p, truth).collect()}
    assert f == pytest.approx({"a": 1, "b": 0, "c": 0, "d": 1.25 * 0.25 / (0.25 * 0.5 + 0.5)})
    m = E.macro_f05(p, truth).first()
    assert (m.singleton_accuracy, m.total_singletons, m.total_matched) == (0.5, 2, 2)
    assert E.macro_f05(p, truth.where("s1_id = 'c'")).first().singleton_accuracy == 1.0


def test_threshold_is_the_lowest_of_the_best(spark):
    truth = spark.createDataFrame([("a", ["x"]), ("b", [])], TRUTH)
    s = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.2), ("b", "z", 0.4)], "s1_id string, candidate_id string, score double")
    t, best = M.best_threshold(s, truth, [i / 10 for i in range(11)])
    assert (t, best) == (0.5, 1.0)
    assert len(M.grid(0, 1, 0.01)) == 101


def test_splits_and_samples(spark):
    truth = spark.createDataFrame([(f"S1-{i}", ["S2-1"] if i % 2 else []) for i in range(105)], TRUTH)
    n = {r.part: r["count"] for r in T.split(truth).groupBy("part").count().collect()}
    assert n == {"holdout": 10, "calibration": 10, "train": 85}
    s1 = spark.createDataFrame([(f"S1-{i}", "", "", "us" if i % 3 else "", i) for i in range(105)], ROW)
    assert T.stratified(s1, truth, 20).select("entity_id").distinct().count() == 20


def test_negatives(spark):
    truth = spark.createDataFrame([("a", ["c1"]), ("b", [])], TRUTH)
    pairs = spark.createDataFrame([(s, f"c{i}", i) for s in "ab" for i in range(1, 9)], "s1_id string, candidate_id string, rank int")
    n = {r.s1_id: r["count"] for r in T.negatives(pairs, truth).groupBy("s1_id").count().collect()}
    assert n == {"a": 4, "b": 2}
    own, rest = T.training_pairs(pairs, truth)
    assert own.count() + rest.count() == 16 and own.where("label = 1").count() == 1 and own.where("s1_id = 'b'").count() == 4
    hard = T.hard_negatives(pairs.withColumn("score", 1.0 / F.col("rank")), truth, 0.3, 2)
    assert sorted((r.s1_id, r.candidate_id) for r in hard.collect()) == [("a", "c2"), ("a", "c3"), ("b", "c1"), ("b", "c2")]


def test_ranker_calibrator_roundtrip(spark, tmp_path):
    rows = [(f"a{i}", f"c{i}", float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(210)]
    df = spark.createDataFrame(rows, "s1_id string, candidate_id string, f double, g double, label int")
    r = M.Ranker(["g", "f"], trees=5, depth=2).fit(df, df)
    s = r.predict(df)
    assert s.where("(score > 0.5) <> (label = 1)").count() == 0 and r.importance()[0][0] == "f"
    r.save(str(tmp_path / "r"))
    assert M.Ranker(["f", "g"]).load(str(tmp_path / "r")).predict(df).count() == 210
    for method in ("isotonic", "platt"):
        c = M.Calibrator(method).fit(s)
        assert c.apply(s).where("score < 0 or score > 1").count() == 0
        c.save(str(tmp_path / method))
        x = M.Calibrator(method).load(str(tmp_path / method)).apply(s).orderBy("f").collect()
        assert all(a.score <= b.score + 1e-9 for a, b in zip(x, x[1:]))
    assert M.Calibrator().apply(s) is s


def test_validation_rules(spark, tmp_path):
    lines = ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1,S2-1", "S1-1\t", "S1-2\tS1-9", "S1-3\tX-1", "S1-4\tS2-9", "S1-8\t", "junk", ""]
    (tmp_path / "m.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-4\tS2-1\n")
    (tmp_path / "bad.tsv").write_text("a,b\n")
    need = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 6)], "entity_id string")
    valid = spark.createDataFrame([("S2-1",)], "entity_id string")
    got = {r.rule: r for r in V.validate(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv"), need, valid).where("file = 'matches'").collect()}
    assert set(got) == {"V2_malformed_row", "V3_duplicate_row", "V4_repeated_id", "V5_self_match", "V6_wrong_prefix", "V7_unknown_id", "V8_missing", "V8_extra", "V9_outside_candidates"}
    assert got["V8_missing"].examples == "S1-5" and got["V9_outside_candidates"].severity == "warning"
    rules = {r.rule for r in V.validate(spark, str(tmp_path / "bad.tsv"), str(tmp_path / "none.tsv"), need).collect()}
    assert rules == {"V1_comma-separated", "V10_no_candidates", "V10_ids_not_checked"}


def test_consistency(spark):
    c = recs(spark, ("S2-1", "acme works", "1 A St, 12345", "us"), ("S3-1", "acme works", "1 A St, 12345", "us"), ("S3-2", "zzz", "", "us"))
    pairs = spark.createDataFrame([("S1-1", x) for x in ("S2-1", "S3-1", "S3-2")], "s1_id string, candidate_id string")
    assert {r.candidate_id: r.consistency for r in fusion.consistency(pairs, c).collect()} == {"S2-1": 1.0, "S3-1": 1.0, "S3-2": 0.0}


def test_dense_finds_itself(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = spark.createDataFrame([(f"S2-{i}", v.tolist()) for i, v in enumerate(x)], "candidate_id string, v array<double>")
    q = c.limit(1).select(F.lit("S1-1").alias("s1_id"), "v")
    assert R.dense(q, c, 3).orderBy("rank").first().candidate_id == c.first().candidate_id
    assert S.dot


def _tsv(path, rows):
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows))


def test_scan(spark, tmp_path):
    _tsv(tmp_path / "a.tsv", [("S1-1", "NA", "x", "US"), ("S1-1", "second", "", "null")])
    df = files.scan_source(spark, str(tmp_path / "a.tsv"))
    assert sorted(tuple(r) for r in df.collect()) == [("S1-1", "", "x", "US"), ("S1-1", "second", "", "")]
    assert files.last_wins(files.with_seq(df)).first().business_name == "second"
    (tmp_path / "b.tsv").write_text("entity_id\tx\n1\t2\n")
    with pytest.raises(ValueError):
        files.scan_source(spark, str(tmp_path / "b.tsv"))
    assert [r.entity_id for r in files.scan_ids(spark, str(tmp_path / "a.tsv")).collect()] == ["S1-1"]


def test_train_infer_validate(spark, tmp_path):
    """30 rows of S1, with matches in S2 and S3 for the even ones, and 10 distractors in either."""
    co = ("us", "in", "")
    mk = lambda s, i: (f"{s}-{i}", f"Brand{i:02} Trading Ltd", f"{i + 1} Maple St, Springfield {10000 + i}", co[i % 3])
    odd = lambda s, i: (f"{s}-x{i}", f"Other{i:02} Foods Inc", f"{i + 50} Oak Ave, Riverton {20000 + i}", co[i % 3])
    for mode in ("train", "test"):
        for s in ("S1", "S2", "S3"):
            own = [mk(s, i) for i in range(30 if mode == "train" or s != "S1" else 10) if s == "S1" or i % 2 == 0]
            _tsv(tmp_path / f"{mode}_{s}.tsv", own + ([] if s == "S1" else [odd(s, i) for i in range(10)]))
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{f'S2-{i},S3-{i}' if i % 2 == 0 else ''}\n" for i in range(30)))
    paths = {"base_dir": str(tmp_path), "train_ground_truth": "truth.tsv", **{f"{m}_source{i}": f"{m}_S{i}.tsv" for m in ("train", "test") for i in (1, 2, 3)}}
    config = {"paths": paths, "training": {"hard_negative_mining": {"iterations": 1}}}
    model, out = str(tmp_path / "model"), str(tmp_path / "out")
    m = pipeline.train(spark, config, model, trees=3)
    assert len(m["feature_names"]) == 60 and m["recall_gate"]["recall_ceiling"] == 1.0
    pipeline.infer(spark, config, model, out)
    n = spark.read.csv(f"{out}/matching_results", sep="\t", header=True).count()
    assert n == 10
    pipeline.infer(spark, config, model, out)  # all rows are there: nothing is added
    assert spark.read.csv(f"{out}/candidate_pairs", sep="\t", header=True).count() == 10
    assert V.passed(pipeline.validate(spark, config, out))


def test_stream_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        _tsv(folder / f"{i}.tsv", [(f"S1-{i}", "n", "a", "us")])
    seen = []
    run = lambda: batches.process(batches.stream_source(spark, str(folder)), lambda df, _: seen.extend(r.entity_id for r in df.collect()), str(tmp_path / "cp"))
    run()
    assert sorted(seen) == ["S1-0", "S1-1", "S1-2"]
    _tsv(folder / "3.tsv", [("S1-3", "n", "a", "us")])
    run()
    assert sorted(seen) == ["S1-0", "S1-1", "S1-2", "S1-3"]


def _small_run(tmp_path):
    co = ("us", "in", "")
    mk = lambda s, i: (f"{s}-{i}", f"Brand{i:02} Trading Ltd", f"{i + 1} Maple St, Springfield {10000 + i}", co[i % 3])
    for mode in ("train", "test"):
        for s in ("S1", "S2", "S3"):
            _tsv(tmp_path / f"{mode}_{s}.tsv", [mk(s, i) for i in range(24) if s == "S1" or i % 2 == 0])
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{f'S2-{i},S3-{i}' if i % 2 == 0 else ''}\n" for i in range(24)))
    return {"base_dir": str(tmp_path), "train_ground_truth": "truth.tsv", **{f"{m}_source{i}": f"{m}_S{i}.tsv" for m in ("train", "test") for i in (1, 2, 3)}}


def letter_encoder():
    def encode(texts):
        import numpy as np

        return np.array([[t.lower().count(c) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz0123456789"] for t in texts])

    return encode


def test_a_run_that_broke_off_is_mended(spark, tmp_path, monkeypatch):
    """With an encoder and a reranker; the run ends between the two writes of its second batch, and goes on."""
    config = {"paths": _small_run(tmp_path), "inference": {"batches": 3}, "features": {"semantic": {"enabled": True}}, "reranking": {"enabled": True, "fraction": 0.5}}
    model, out = str(tmp_path / "model"), str(tmp_path / "out")
    scorer = lambda a, b: (a.str.len() - b.str.len()).abs() * -0.1
    with pytest.raises(ValueError):
        pipeline.train(spark, config, model, trees=2, scorer=scorer)  # no encoder
    m = pipeline.train(spark, config, model, trees=2, encoder=letter_encoder(), scorer=scorer)
    assert len(m["feature_names"]) == 63 and m["semantic"]
    with pytest.raises(ValueError):
        pipeline.infer(spark, {**config, "features": {}}, model, out)
    write, calls = files.write_matches, []

    def broken(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        write(*args)

    monkeypatch.setattr(files, "write_matches", broken)
    with pytest.raises(RuntimeError):
        pipeline.infer(spark, config, model, out, encoder=letter_encoder(), scorer=scorer)
    a, b = (files.read_output(spark, f"{out}/{n}").count() for n in ("candidate_pairs", "matching_results"))
    assert a > b
    pipeline.infer(spark, config, model, out, encoder=letter_encoder(), scorer=scorer)
    assert V.passed(pipeline.validate(spark, config, out))
    assert [files.read_output(spark, f"{out}/{n}").count() for n in ("candidate_pairs", "matching_results")] == [24, 24]


def test_bytes_that_are_not_utf8_fail(spark, tmp_path):
    (tmp_path / "m.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\t\xff\xfe\n")
    need = spark.createDataFrame([("S1-1",)], "entity_id string")
    assert not V.passed(V.validate(spark, str(tmp_path / "m.tsv"), None, need))


def test_vector_index(spark):
    import numpy as np

    from matchloom.operators import vectors as D

    assert D.select(1000, 90_000) == ("ivfpq", 25) and D.select(200, 200) == ("ivfflat", 5) and D.select(50, 50) == ("flat", 1) and D.select(100_000, 10**6) == ("ivfpq", 1000)
    x = np.random.default_rng(0).standard_normal((300, 384))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of = lambda rows: spark.createDataFrame([(f"S2-{i}", x[i].tolist()) for i in rows], "candidate_id string, v array<double>")
    for n in (50, 300):
        index = D.train(of(range(n)), probes=2).add(of(range(n // 2))).add(of(range(n // 2, n)))
        q = of([0, n - 1]).select(F.concat(F.lit("S1"), F.substring("candidate_id", 3, 9)).alias("s1_id"), "v")
        got = {r.s1_id: r for r in index.search(q, 3).where("rank = 1").collect()}
        assert {k: r.candidate_id for k, r in got.items()} == {"S1-0": "S2-0", f"S1-{n - 1}": f"S2-{n - 1}"} and got["S1-0"].score == pytest.approx(1)
    with pytest.raises(ValueError):
        D.train(of(range(5))).search(of([0]), 1)


def test_blank_texts_are_encoded_as_empty(spark):
    from matchloom.operators import vectors as D

    df = spark.createDataFrame([("a", " "), ("b", None), ("c", "<empty>"), ("d", "xx")], "entity_id string, t string")
    got = {r.entity_id: r.v for r in D.encode(df, {"v": F.col("t")}, letter_encoder()).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] and sum(v * v for v in got["d"]) == pytest.approx(1)


def test_first_of_a_key_by_histograms(spark):
    from matchloom.operators import blocks

    rows = [("a", i * 37 % 1001 * 10**9) for i in range(1001)] + [("b", 5)] * 3 + [("c", 1), ("c", 2), ("c", 2), ("c", 3)]
    df = spark.createDataFrame(rows, "k string, x long")
    got = [(r.k, r.x) for r in blocks.first(df, 2, "k", F.col("x")).collect()]
    assert sorted(got) == [("a", 0), ("a", 10**9), ("b", 5), ("b", 5), ("b", 5), ("c", 1), ("c", 2), ("c", 2)]


def test_most_frequent_terms(spark):
    from matchloom.operators.retrieval import most_frequent

    rows = [("p", f"t{i:03}", 5 if i < 3 else 2) for i in range(100)] + [("q", "é", 1), ("q", "a", 1), ("q", "z", 1)]
    df = spark.createDataFrame(rows, "part string, term string, total long").withColumn("docs", F.lit(9))
    got = {(r.part, r.term) for r in most_frequent(df, 10).collect()}
    assert got == {("p", f"t{i:03}") for i in range(10)} | {("q", "é"), ("q", "a"), ("q", "z")}
    assert {r.term for r in most_frequent(df.where("part = 'q'"), 2).collect()} == {"a", "z"}


def test_corpus_leaves_s1_out_unless_nothing_remains(spark):
    both = recs(spark, ("S1-1", "a", "", ""), ("S2-1", "b", "", ""))
    assert [r.entity_id for r in P.corpus(both).collect()] == ["S2-1"]
    assert [r.entity_id for r in P.corpus(both.where("source = 'S1'")).collect()] == ["S1-1"]


def test_texts_of_missing_files_are_skipped(spark, tmp_path):
    _tsv(tmp_path / "a.tsv", [("S2-1", "n", "a", "us")])
    got = files.scan_texts(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "none.tsv")])
    assert [tuple(r) for r in got.collect()] == [("S2-1", "n", "a")] and files.scan_texts(spark, [str(tmp_path / "none.tsv")]).count() == 0


def test_packs_find_the_best_of_all_shards(spark, monkeypatch):
    """Against brute force, over several shards and blocks, texts that many records share and ties between them; no posting is shuffled."""
    monkeypatch.setattr(packs, "SHARD", 7)
    monkeypatch.setattr(packs, "BLOCK", 5)
    name = lambda i: f"acme{i % 5} works{i % 7} group{i % 11} x{i % 3} x{i % 3}"
    part = lambda i: "us" if i % 4 else "india"
    c = recs(spark, *((f"S2-{i}", name(i), f"{i % 6} oak", part(i)) for i in range(150)))
    q = recs(spark, *((f"S1-{i}", name(i + i % 2), f"{i % 6} elm", part(i)) for i in range(40)))
    fitted = R.tfidf_fit(c, "name", R.word_terms, 0.9)
    of = lambda df: {(r.part, r.term): r.idf for r in df.collect()}
    idf, names = of(fitted.idf), {r.entity_id: (r.part, r.name) for r in c.select("entity_id", "part", "name").unionByName(q.select("entity_id", "part", "name")).collect()}

    def vector(i):
        p, t = names[i]
        w = t.split()
        n = Counter(x for x in [*w, *map(" ".join, zip(w, w[1:]))] if len(x) > 1 and (p, x) in idf)
        v = {x: (1 + math.log(k)) * idf[p, x] for x, k in n.items()}
        return {x: y / math.hypot(*v.values()) for x, y in v.items()}

    vectors, want = {i: vector(i) for i in names}, {}
    for a in (i for i in names if i.startswith("S1")):
        each = [(sum(y * vectors[b].get(x, 0) for x, y in vectors[a].items()), b) for b in names if b.startswith("S2") and names[b][0] == names[a][0]]
        for k, (score, b) in enumerate(sorted((x for x in each if x[0] > 0.05), key=lambda x: (-round(x[0], 9), x[1]))[:6]):
            want[a, k + 1] = (b, round(score, 6))
    got = R.tfidf(q, fitted, "name", 6, R.word_terms, None)
    assert {(r.s1_id, r["rank"]): (r.candidate_id, round(r.score, 6)) for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_one_batch_of_queries_at_a_time(spark, monkeypatch):
    """The kept pairs, and the flags of all, are those of one batch, however many there are."""
    row = lambda s, i: (f"{s}-{i}", f"acme{i % 5} works{i % 7} x{i % 3}", f"{i % 6} oak road, {10000 + i % 9}", "us" if i % 4 else "")
    q, c = recs(spark, *(row("S1", i) for i in range(60))), recs(spark, *(row(f"S{2 + i % 2}", i) for i in range(90)))
    pairs = lambda df: sorted(tuple(r) for r in df.select("s1_id", "candidate_id", "rank", F.round("rrf_score", 9)).collect())
    flags = lambda df: sorted(tuple(r) for r in df.select("s1_id", "candidate_id", "found_by_exact", "found_by_bm25", "found_by_char_tfidf").collect())
    whole, found = fusion.generate(q, c, found=fusion.channels(q, c), raw=True)
    whole, found, hits = pairs(whole), flags(found), sorted(map(tuple, fusion.country_hits(q, c).collect()))
    monkeypatch.setattr(fusion, "BATCH", 30)
    got, every = fusion.generate(q, c, raw=True)
    assert pairs(got) == whole and flags(every) == found and pairs(fusion.generate(q, c)[0]) == whole
    assert sorted(map(tuple, fusion.country_hits(q, c).collect())) == hits and sum(h[1] for h in hits) > 0


def test_shuffles_of_a_batch_of_queries_are_dropped(spark, tmp_path):
    q = recs(spark, *((f"S1-{i}", f"acme{i % 5}", f"{i % 6} oak road", "us") for i in range(60)))
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    held = []
    for some in fusion.batches(q, 30):
        held.append(shuffles())
        some.groupBy("name").count().select("count").distinct().write.parquet(str(tmp_path / str(len(held))))
        del some
    time.sleep(1)  # Spark drops them in a thread of its own
    assert len(held) == 2 and shuffles() <= held[0]


def test_shuffles_of_a_channel_are_dropped_before_the_next(spark):
    q = recs(spark, *((f"S1-{i}", f"acme{i % 5}", f"{i % 6} oak road", "us") for i in range(60)))
    held = []

    def channel(some):
        time.sleep(1)
        held.append(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size())
        return some.groupBy(F.col("entity_id").alias("s1_id")).agg(F.max("name").alias("candidate_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    for _, drop in fusion.parts(q, 30):
        fusion._met({c: channel for c in ("exact", "bm25", "char_tfidf")}, q, drop)
        break
    assert len(held) == 3 and max(held) <= held[0]


def test_texts_are_shuffled_and_not_their_terms(spark):
    c = recs(spark, *((f"S2-{i}", f"acme{i % 5} works{i % 7}", f"{i % 6} oak road", "us") for i in range(60)))
    own = packs.texts(c, F.col("name"))
    idf = spark.createDataFrame([("us", "acme1", 1.0)], "part string, term string, idf double")
    plan = packs._packed(own, packs._sizes(own, 20), 5, idf, R._in_all(R.char_terms), packs._shard(False))._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("AS terms") < plan.find("RepartitionByExpression")
    rows = np.array([0, 3, 70, 2, 2, 9, 60_000, 1])
    assert (packs._unsteps(*packs._steps(rows)) == rows).all() and len(packs._unsteps(*packs._steps(rows[:0]))) == 0
    posting = np.arange(50_000)
    assert len(packs._payload(packs._steps(posting))) < 5_000 and (packs._unsteps(*packs._data(pa.py_buffer(packs._payload(packs._steps(posting))))) == posting).all()

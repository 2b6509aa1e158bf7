"""Training and inference over TSV sources, and the checks of their outputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation as E, features as P, fusion, models as M, training as T, validation as V, vectors as D
from ..operators.blocks import dense
from ..shared import written
from ..shipping import ship
from ..sources import files

#: Texts of pairs to scores before the sigmoid; see models.rerank().
Scorer = M.Scorer


def _corpus(spark: SparkSession, config: dict, mode: str) -> tuple[DataFrame, DataFrame]:
    """Normalised records of S1, and of S2 and then S3."""
    s = files.scan_sources(spark, config, mode)
    one = files.records(files.last_wins(files.with_seq(s["S1"])))
    rest = files.with_seq(s["S2"]).unionByName(files.with_seq(s["S3"], 1 << 62), allowMissingColumns=True)
    return written(one, "s1"), written(files.records(files.last_wins(rest)), "s2s3")


def _options(config: dict) -> dict:
    c = config.get("candidate_compression", {})
    return {"k": c.get("rrf", {}).get("k", 60), "s2": c.get("s2_max_candidates", 20), "s3": c.get("s3_max_candidates", 20), "most": c.get("max_candidates_per_entity", 40)}


def _semantic(config: dict) -> bool:
    return config.get("features", {}).get("semantic", {}).get("enabled", False)


def _vectors(config: dict, one: DataFrame, rest: DataFrame, encoder: D.Encoder | None) -> DataFrame | None:
    """Vectors of all records, if semantic features are enabled: then there must be an encoder."""
    return written(D.record_vectors(one.unionByName(rest), encoder), "vectors") if _semantic(config) else None


def _pairs(config: dict, one: DataFrame, rest: DataFrame, vectors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    r = config.get("retrieval", {})
    found = fusion.channels(one, rest, {"bm25": r.get("bm25", {}).get("top_k", 20)}, r.get("tfidf", {}).get("max_features", 25_000))
    if vectors is not None:
        of = lambda records, key, f: records.select(F.col("entity_id").alias(key)).join(vectors.select(F.col("entity_id").alias(key), F.col(f"{f}_vec").alias("v")), key)
        found |= {f"{f}_ann": dense(of(one, "s1_id", f), of(rest, "candidate_id", f), fusion.LIMITS[f"{f}_ann"]) for f in D.FIELDS}
    return fusion.generate(one, rest, r.get("filter_country_mismatch", True), found, raw=True, with_dense=vectors is not None, **_options(config))


def _reranked(config: dict, scored: DataFrame, one: DataFrame, rest: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Scores with those of the ambiguous pairs fused with a reranker's, if reranking is enabled: then there must be one."""
    c = config.get("reranking", {})
    if not c.get("enabled", False):
        return scored
    if scorer is None:
        raise ValueError("reranking needs a scorer")
    scored = written(scored, "scored")
    texts = one.select("entity_id", "record_text").unionByName(rest.select("entity_id", "record_text"))
    some = M.ambiguous(scored, c.get("low", 0.3), c.get("high", 0.8), c.get("margin", 0.15), c.get("max_per_entity", 10), c.get("max_per_batch", 50), c.get("fraction", 0.01), c.get("max_total", 50_000))
    return M.fuse(scored, M.rerank(some, texts, scorer), c.get("ranker_weight", 0.4), c.get("cross_weight", 0.6))


def train(spark: SparkSession, config: dict, out: str, sample: int | None = None, seed: int = 42, trees: int = 40, encoder: D.Encoder | None = None, scorer: Scorer | None = None) -> dict:
    """Fits and saves ranker, calibrator, rarity table and threshold under `out`; returns the manifest. Calibration
    rows stop the trees, calibrate and choose the threshold; the holdout rows only measure. encoder: for the dense channels
    and the cosines, scorer: for reranking, where the config enables these."""
    ship(spark)
    one, rest = _corpus(spark, config, "train")
    paths = config["paths"]
    truth = files.parse_truth(files.scan_truth(spark, os.path.join(paths.get("base_dir", ""), paths["train_ground_truth"])))
    if sample:
        one = T.stratified(one, truth, sample, seed)
        truth = truth.join(one.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
        rest = T.limit_distractors(rest, truth, 5 * sample)
    idf = files.read_through(spark, f"{out}/rarity", lambda: P.rarity_fit(rest))
    middle = P.median_idf(idf)
    vectors = _vectors(config, one, rest, encoder)
    semantic = vectors is not None
    pairs, raw = _pairs(config, one, rest, vectors)
    spill = f"{out}/cache/pairs"
    x = P.pair_features(pairs, one, rest, idf, middle, semantic, vectors)
    T.labelled(x, truth).join(T.split(truth, seed=seed), "s1_id").write.mode("overwrite").parquet(spill)
    x = spark.read.parquet(spill)
    gate = E.recall_gate(pairs, truth, raw).first().asDict()
    fit, pool = T.training_pairs(x.where("part = 'train'"), truth)
    cal = x.where("part = 'calibration'")
    ranker = M.Ranker(P.names(semantic), trees=trees, seed=seed).fit(fit, cal)
    mining = config.get("training", {}).get("hard_negative_mining", {})
    for _ in range(mining.get("iterations", 1) if mining.get("enabled", True) else 0):
        hard = T.hard_negatives(ranker.predict(pool), truth, mining.get("score_threshold", 0.35), mining.get("top_k_hard_negatives", 5))
        fit = fit.unionByName(hard.select(*fit.columns))  # a pair may be mined in several rounds
        ranker.fit(fit, cal)
    score = lambda rows: _reranked(config, ranker.predict(rows).select("s1_id", "candidate_id", "rank", "label", "score"), one, rest, scorer)
    scored = score(cal)
    method = config.get("calibration", {}).get("method", "isotonic")
    calibrator = M.Calibrator(method).fit(scored)
    search = config.get("decision", {}).get("threshold_search", {})
    of = lambda p: truth.join(T.split(truth, seed=seed).where(F.col("part") == p), "s1_id", "left_semi")
    threshold, best = M.best_threshold(calibrator.apply(scored), of("calibration"), M.grid(search.get("start", 0.30), search.get("stop", 0.95), search.get("step", 0.01)))
    held = E.macro_f05(M.decide(calibrator.apply(score(x.where("part = 'holdout'"))), threshold), of("holdout")).first().asDict()
    ranker.save(f"{out}/ranker")
    calibrator.save(f"{out}/calibrator")
    files.save_json({"threshold": threshold}, f"{out}/optimal_threshold.json")
    manifest = {
        "holdout": held, "calibration_macro_f05": best, "threshold": threshold, "feature_names": P.names(semantic), "recall_gate": gate, "stages": E.staged(gate), "calibration": method,
        "median_idf": middle, "semantic": semantic,
    }
    files.save_json(manifest, f"{out}/run_manifest.json")
    return manifest


def infer(spark: SparkSession, config: dict, model: str, out: str, sample: int | None = None, encoder: D.Encoder | None = None, scorer: Scorer | None = None) -> dict[str, str]:
    """Writes candidates and matches of the test S1 rows that aren't in both outputs yet; returns their paths.

    Rows are done in `inference.batches` parts (by a hash of the id; 1 unless the config says otherwise), each appended to both
    outputs. A run that broke off goes on: outputs that disagree are first cut down to the ids that both have."""
    ship(spark)
    manifest = files.load_json(f"{model}/run_manifest.json")
    if manifest.get("semantic", False) != _semantic(config):
        raise ValueError("the model was trained with features.semantic.enabled the other way")
    one, rest = _corpus(spark, config, "test")
    paths = {n: f"{out}/{n}" for n in ("candidate_pairs", "matching_results")}
    todo = one.orderBy("seq").limit(sample) if sample else one
    done = files.mend(spark, *paths.values())
    if done is not None:
        todo = written(todo.join(done, F.col("entity_id") == F.col("source1_entity_id"), "left_anti"), "todo")
    vectors = _vectors(config, one, rest, encoder)
    idf = spark.read.parquet(f"{model}/rarity")
    semantic = vectors is not None
    ranker = M.Ranker(P.names(semantic)).load(f"{model}/ranker")
    calibrator = M.Calibrator(manifest["calibration"]).load(f"{model}/calibrator")
    n = max(1, config.get("inference", {}).get("batches", 1))
    for i in range(n):
        part = todo.where(F.pmod(F.xxhash64("entity_id"), F.lit(n)) == i)
        pairs, _ = _pairs(config, part, rest, vectors)
        x = P.pair_features(pairs, part, rest, idf, manifest["median_idf"], semantic, vectors)
        scored = _reranked(config, ranker.predict(x).select("s1_id", "candidate_id", "rank", "score"), part, rest, scorer)
        scored = written(calibrator.apply(scored).select("s1_id", "candidate_id", "rank", "score"), "scores")
        mode = "overwrite" if done is None and not i else "append"
        files.write_candidates(part, scored, paths["candidate_pairs"], mode)
        files.write_matches(part, M.decide(scored, manifest["threshold"]), paths["matching_results"], mode)
    return paths


def validate(spark: SparkSession, config: dict, out: str, check_ids: bool = True) -> DataFrame:
    s = files.scan_sources(spark, config, "test")
    valid = s["S2"].select("entity_id").unionByName(s["S3"].select("entity_id")) if check_ids else None
    return V.validate(spark, f"{out}/matching_results", f"{out}/candidate_pairs", s["S1"], valid)

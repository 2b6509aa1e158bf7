"""Further registered queries: scans and outputs, vectors, splits and labels, reranking, the running gate, validation."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import shared
from ..functions import vocab
from ..operators import evaluation as E, features as P, fusion, models as M, training as T, validation as V, vectors as D
from ..sources import files
from ..streaming import batches
from . import fixtures, oracles as O
from .queries import _AMB, _NEAR, _top, batched, both, compressed, every, query, simple_scores, tidy

HIT = "list_contains(matches, candidate_id)"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared.folder(spark)}/matchloom-scratch-{uuid.uuid4().hex}"


def tsv(df: DataFrame, path: str) -> str:
    df.write.csv(path, sep="\t", header=True, emptyValue="")
    return path


# Scans and outputs

_FIELDS = "entity_id, business_name, business_address, country"
_MISSING = "[" + ", ".join(f"'{m}'" for m in vocab.MISSING) + "]"
_DIRTY = "CASE WHEN seq % 7 = 0 THEN 'NA' WHEN seq % 7 = 1 THEN 'null' ELSE business_name END"


@query(f"SELECT entity_id, CASE WHEN list_contains({_MISSING}, n) THEN '' ELSE n END AS business_name, business_address, country FROM (SELECT *, {_DIRTY} AS n FROM raw)")
def er_tsv_scan(spark, sf_dir):
    """S1, S2 and S3 written as files and scanned by a config."""
    top = scratch(spark)
    for s in ("S1", "S2", "S3"):
        rows = fixtures.rows(spark, sf_dir, s).withColumn("business_name", F.expr(_DIRTY))
        tsv(rows.selectExpr(*_FIELDS.split(", ")), f"{top}/{s}")
    paths = {"base_dir": top, **{f"test_source{i}": f"S{i}" for i in (1, 2, 3)}}
    s1, s2, s3 = files.scan_sources(spark, {"paths": paths}, "test").values()
    return s1.unionByName(s2).unionByName(s3)


@query("SELECT s1_id, array_to_string(matches, ',') AS matches FROM truth")
def er_truth_scan(spark, sf_dir):
    t = fixtures.truth(spark, sf_dir).select(F.col("s1_id").alias("source1_entity_id"), F.array_join("matches", " , ").alias("matched_entity_ids"))
    got = files.parse_truth(files.scan_truth(spark, tsv(t, scratch(spark))))
    return got.select("s1_id", F.array_join("matches", ",").alias("matches"))


@query("SELECT entity_id FROM raw WHERE source <> 'S1'")
def er_id_scan(spark, sf_dir):
    """Of a file that has each id twice."""
    rows = fixtures.rows(spark, sf_dir, "S2", "S3").select("entity_id", "country")
    return files.scan_ids(spark, tsv(rows.unionByName(rows), scratch(spark)))


@query("SELECT entity_id, business_name, business_address FROM raw WHERE source <> 'S1'")
def er_texts_scan(spark, sf_dir):
    """Names and addresses of the files that are there; one of three isn't."""
    top = scratch(spark)
    for s in ("S2", "S3"):
        tsv(fixtures.rows(spark, sf_dir, s).selectExpr(*_FIELDS.split(", ")), f"{top}/{s}")
    return files.scan_texts(spark, [f"{top}/{s}" for s in ("S2", "S3", "S4")])


@query("SELECT token, df, round(idf, 6) AS idf FROM idf")
def er_rarity_cached(spark, sf_dir):
    """The rarity table of all records (S1 is left out), made once and then read."""
    path = scratch(spark)
    make = lambda: P.rarity_fit(P.corpus(every(spark, sf_dir)))
    files.read_through(spark, path, make)
    return tidy(files.read_through(spark, path, lambda: 1 / 0))


@query("SELECT entity_id AS source1_entity_id, '' AS candidate_entity_ids, '' AS matched_entity_ids FROM rec WHERE source = 'S1' AND seq % 2 = 0 AND seq % 3 <> 0")
def er_resume_mended(spark, sf_dir):
    """Outputs that disagree, cut down to the ids that both have."""
    top = scratch(spark)
    s1 = fixtures.rows(spark, sf_dir, "S1").select(F.col("entity_id").alias("source1_entity_id"), "seq")
    paths = f"{top}/candidates", f"{top}/matches"
    tsv(s1.where("seq % 2 = 0").select("source1_entity_id", F.lit("").alias("candidate_entity_ids")), paths[0])
    tsv(s1.where("seq % 3 <> 0").select("source1_entity_id", F.lit("").alias("matched_entity_ids")), paths[1])
    files.mend(spark, *paths)
    a, b = (files.read_output(spark, p) for p in paths)
    return a.join(b, "source1_entity_id", "full")


@query("SELECT entity_id, lower(trim(country)) AS country FROM raw WHERE source = 'S1'")
def er_stream_batches(spark, sf_dir):
    """S1 as a stream of files, each batch normalised and appended."""
    top = scratch(spark)
    rows = fixtures.rows(spark, sf_dir, "S1").selectExpr(*_FIELDS.split(", "))
    tsv(rows.repartition(3), f"{top}/in")

    def handle(df: DataFrame, n: int) -> None:
        # a batch that is done again replaces what it wrote
        files.records(files.with_seq(df.fillna(""))).select("entity_id", "country").write.mode("overwrite").parquet(f"{top}/out/batch={n}")

    for _ in range(2):  # the second run finds nothing new
        batches.process(batches.stream_source(spark, f"{top}/in"), handle, f"{top}/checkpoint")
    return spark.read.parquet(f"{top}/out").drop("batch")


# Vectors

_VECTORS = """SELECT entity_id, CAST(n.embedding AS DOUBLE[]) AS name_vec, CAST(a.embedding AS DOUBLE[]) AS address_vec, CAST(r.embedding AS DOUBLE[]) AS record_vec FROM rec
  JOIN embeddings n ON n.vec_id = seq % 400 JOIN embeddings a ON a.vec_id = (seq * 7) % 400 JOIN embeddings r ON r.vec_id = (seq * 3 + 1) % 400"""
O.CTES["vecs"] = _VECTORS
_COSINES = ", ".join(f"round(CASE WHEN {on} THEN list_dot_product(x.{f}_vec, y.{f}_vec) ELSE 0.0 END, 6) AS {f}_cosine" for f, on in (
    ("name", "a_name <> '' AND b_name <> ''"), ("address", "a_address <> '' AND b_address <> ''"), ("record", "(a_name <> '' AND b_name <> '') OR (a_address <> '' AND b_address <> '')"),
))


@query(f"SELECT s1_id, candidate_id, {_COSINES} FROM sided JOIN vecs x ON x.entity_id = s1_id JOIN vecs y ON y.entity_id = candidate_id")
def er_semantic_features(spark, sf_dir):
    q, c, pairs = compressed(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rec = q.select("entity_id", "seq").unionByName(c.select("entity_id", "seq"))
    for name, at in (("name_vec", F.col("seq") % 400), ("address_vec", F.col("seq") * 7 % 400), ("record_vec", (F.col("seq") * 3 + 1) % 400)):
        rec = rec.withColumn("vec_id", at).join(e.withColumnRenamed("v", name), "vec_id").drop("vec_id")
    return tidy(P.semantic(P.sided(pairs, q, c), rec).select("s1_id", "candidate_id", *P.SEMANTIC))


_SHOWN = "CASE WHEN trim(name) = '' THEN '<empty>' ELSE name END"


@query(f"SELECT entity_id, round(n / l, 6) AS x, round(a / l, 6) AS y, round(1 / l, 6) AS z FROM (SELECT *, sqrt(n * n + a * a + 1) AS l FROM (SELECT entity_id, CAST(length(t) AS DOUBLE) AS n, CAST(length(t) - length(replace(t, 'a', '')) AS DOUBLE) AS a FROM (SELECT entity_id, {_SHOWN} AS t FROM rec)))")
def er_encoded_vectors(spark, sf_dir):
    """Unit vectors of names by an encoder that counts letters."""
    def encoder(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count("a"), 1.0] for t in texts])

    v = D.encode(every(spark, sf_dir), {"v": F.col("name")}, encoder)
    return tidy(v.select("entity_id", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate("xyz"))))


_SIZES = "SELECT 40 * i * i AS training, 2000 * i * i AS total FROM range(0, 60) AS g(i)"


@query(f"SELECT training, total, CASE WHEN training >= 256 THEN 'ivfpq' WHEN training >= 100 THEN 'ivfflat' ELSE 'flat' END AS kind, CASE WHEN training < 100 THEN 1 ELSE greatest(1, least(4096, greatest(32, CAST(floor(sqrt(total)) AS BIGINT)), training // 39)) END AS lists FROM ({_SIZES})")
def er_index_selection(spark, sf_dir):
    sizes = [(40 * i * i, 2000 * i * i) for i in range(60)]
    return spark.createDataFrame([(a, b, *D.select(a, b)) for a, b in sizes], "training long, total long, kind string, lists long")


@query(_top(f"({_NEAR})", 10))
def er_index_topk(spark, sf_dir):
    """An index to which the vectors are added in two parts; looking into all lists, its results are exact."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    named = lambda on, s, name: e.where(on).select(F.concat(F.lit(f"{s}-"), F.col("vec_id").cast("string")).alias(name), F.col("embedding").alias("v"))
    c = lambda on: named(f"vec_id % 100 <> 0 and {on}", "S2", "candidate_id")
    index = D.train(c("true"), probes=1 << 20).add(c("vec_id % 2 = 0")).add(c("vec_id % 2 = 1"))
    return tidy(index.search(named("vec_id % 100 = 0", "S1", "s1_id"), 10))


# Training sets

def _drawn(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 15) AS BIGINT)"


def _split(holdout: float, calibration: float, seed: int) -> str:
    places = f"SELECT s1_id, row_number() OVER (ORDER BY {_drawn('s1_id', seed)}, s1_id) AS place, count(*) OVER () AS n FROM truth"
    a = f"CAST(floor(n * {holdout}) AS BIGINT)"
    return f"SELECT s1_id, CASE WHEN place <= {a} THEN 'holdout' WHEN place <= {a} + CAST(floor(n * {calibration}) AS BIGINT) THEN 'calibration' ELSE 'train' END AS part FROM ({places})"


@query(_split(0.1, 0.1, 42))
def er_train_split(spark, sf_dir):
    return T.split(fixtures.truth(spark, sf_dir))


@query(_split(0.2, 0.0, 7))
def er_two_way_split(spark, sf_dir):
    return T.split(fixtures.truth(spark, sf_dir), 0.2, 0.0, 7)


_STRATA = f"SELECT entity_id, country || '_' || CASE WHEN len(matches) > 0 THEN 'true' ELSE 'false' END AS stratum, {_drawn('entity_id', 42)} AS h FROM s1 LEFT JOIN truth ON s1_id = entity_id"
_QUOTAS = f"SELECT *, floor(share) AS own, row_number() OVER (ORDER BY floor(share) - share, stratum) AS place FROM (SELECT stratum, least(100, sum(count(*)) OVER ()) * count(*) / sum(count(*)) OVER () AS share, least(100, sum(count(*)) OVER ()) AS n FROM ({_STRATA}) GROUP BY stratum)"


@query(f"SELECT entity_id, stratum FROM (SELECT entity_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY h, entity_id) AS k FROM ({_STRATA})) JOIN (SELECT stratum, own + CASE WHEN place <= n - sum(own) OVER () THEN 1 ELSE 0 END AS quota FROM ({_QUOTAS})) USING (stratum) WHERE k <= quota")
def er_stratified_sample(spark, sf_dir):
    truth = fixtures.truth(spark, sf_dir)
    got = T.stratified(fixtures.rows(spark, sf_dir, "S1"), truth, 100)
    has = truth.select(F.col("s1_id").alias("entity_id"), (F.size("matches") > 0).cast("string").alias("has"))
    return got.join(has, "entity_id").select("entity_id", F.concat_ws("_", "country", "has").alias("stratum"))


@query(f"SELECT s1_id, candidate_id, rank FROM kept JOIN truth USING (s1_id) WHERE {HIT}")
def er_positive_pairs(spark, sf_dir):
    return tidy(T.positives(compressed(spark, sf_dir)[2], fixtures.truth(spark, sf_dir)).select("s1_id", "candidate_id", "rank"))


@query(f"SELECT s1_id, candidate_id, CAST(CASE WHEN {HIT} THEN 1 ELSE 0 END AS BIGINT) AS label FROM kept JOIN truth USING (s1_id)")
def er_calibration_labels(spark, sf_dir):
    return batched(spark, sf_dir, lambda pairs, q, c, truth: tidy(T.labelled(pairs, truth).select("s1_id", "candidate_id", "label")))


@query(f"SELECT s1_id, candidate_id, score FROM scored JOIN truth USING (s1_id) WHERE score >= 0.4 AND NOT {HIT} QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, candidate_id) <= 3")
def er_hard_negatives_memory(spark, sf_dir):
    return batched(spark, sf_dir, lambda pairs, q, c, truth: tidy(T.hard_negatives(simple_scores(pairs), truth, 0.4, 3).select("s1_id", "candidate_id", "score")))


@query("SELECT entity_id FROM (SELECT r.entity_id, source, seq, t.c IS NOT NULL AS m FROM rec r LEFT JOIN (SELECT DISTINCT unnest(matches) AS c FROM truth) t ON t.c = r.entity_id WHERE source <> 'S1') QUALIFY m OR row_number() OVER (PARTITION BY source, m ORDER BY seq) <= 50")
def er_distractor_limit_all(spark, sf_dir):
    """With the whole truth."""
    return T.limit_distractors(both(spark, sf_dir)[1], fixtures.truth(spark, sf_dir), 50).select("entity_id")


# Decisions and measures

_SOME = f"SELECT s1_id, candidate_id, score FROM ({_AMB}) WHERE n <= 10 AND (score BETWEEN 0.3 AND 0.8 OR (k >= 2 AND score > 0.3 AND top - score < 0.15)) ORDER BY abs(score - 0.5), s1_id, candidate_id LIMIT (SELECT least(50, greatest(1, CAST(floor(count(*) * 0.01) AS BIGINT))) FROM scored)"


@query(f"SELECT s1_id, candidate_id, round(ce, 6) AS ce_score, round(0.4 * score + 0.6 * ce, 6) AS score FROM (SELECT s1_id, candidate_id, score, 1 / (1 + exp(-(length(a.name || ' ' || a.address) - length(b.name || ' ' || b.address)) / 10.0)) AS ce FROM ({_SOME}) JOIN rec a ON a.entity_id = s1_id JOIN rec b ON b.entity_id = candidate_id)")
def er_reranked_scores(spark, sf_dir):
    q, c = both(spark, sf_dir)
    s = fusion.each(q, c, lambda pairs, own: simple_scores(pairs))
    texts = q.select("entity_id", "record_text").unionByName(c.select("entity_id", "record_text"))
    again = shared.written(M.rerank(M.ambiguous(s), texts, lambda a, b: (a.str.len() - b.str.len()) / 10.0), "again")
    s = s.join(F.broadcast(again.select("s1_id", "candidate_id")), ["s1_id", "candidate_id"], "left_semi")  # 50 pairs at most
    return tidy(M.fuse(s, again).join(again.select("s1_id", "candidate_id", "ce_score"), ["s1_id", "candidate_id"]).select("s1_id", "candidate_id", "ce_score", "score"))


_SEEN = "SELECT s1_id, len(matches) AS actual, count(*) AS candidates, " + ", ".join(
    f"count(*) FILTER ({HIT}{on}) AS {n}" for n, on in (("c", ""), ("c10", " AND rank <= 10"), ("c20", " AND rank <= 20"), ("c40", " AND rank <= 40"))
) + " FROM truth JOIN kept USING (s1_id) GROUP BY s1_id, matches"


@query("SELECT CAST(t AS BIGINT) AS total_true_matches, CAST(c AS BIGINT) AS covered_matches, round(c / t, 6) AS recall_ceiling, round(c10 / t, 6) AS recall_at_10, round(c20 / t, 6) AS recall_at_20, round(c40 / t, 6) AS recall_at_40, round(k / n, 6) AS avg_candidates FROM (SELECT sum(actual) AS t, sum(c) FILTER (actual > 0) AS c, sum(c10) FILTER (actual > 0) AS c10, sum(c20) FILTER (actual > 0) AS c20, sum(c40) FILTER (actual > 0) AS c40, sum(candidates) FILTER (actual > 0) AS k, count(*) AS n "
       f"FROM ({_SEEN}))")  # fmt: skip
def er_incremental_gate(spark, sf_dir):
    """The gate over two batches of entities."""
    _, _, pairs = compressed(spark, sf_dir)
    pairs = shared.written(pairs, "kept")
    gate = E.IncrementalGate(fixtures.truth(spark, sf_dir))
    for odd in (0, 1):
        gate.update(pairs.where(F.substring("s1_id", 4, 20).cast("long") % 2 == odd))
    keep = ("total_true_matches", "covered_matches", "recall_ceiling", "recall_at_10", "recall_at_20", "recall_at_40", "avg_candidates")
    got = gate.summary()
    return tidy(spark.createDataFrame([tuple(got[k] for k in keep)], ", ".join(f"{k} {'long' if k.endswith('matches') else 'double'}" for k in keep)))


# Validation

_CAND = "SELECT s1_id, list(candidate_id) AS c FROM kept GROUP BY s1_id"


@query(f"SELECT 'warning' AS severity, 'V9_outside_candidates' AS rule, 'matches' AS file, count(*) AS n, array_to_string(list_sort(list(s1_id))[1:5], ',') AS examples FROM ({_CAND}) WHERE CAST(substr(s1_id, 4) AS BIGINT) % 7 = 0 HAVING count(*) > 0")
def er_outside_candidates(spark, sf_dir):
    """Matches of which some rows have an id that isn't among their candidates."""
    pairs = shared.written(compressed(spark, sf_dir)[2].select("s1_id", "candidate_id", "rank"), "kept")
    c = pairs.groupBy("s1_id").agg(F.collect_list("candidate_id").alias("ids"))
    few = pairs.where("rank <= 3").groupBy("s1_id").agg(F.collect_list("candidate_id").alias("ids"))
    m = few.withColumn("ids", F.when(F.substring("s1_id", 4, 20).cast("long") % 7 == 0, F.concat("ids", F.array(F.lit("S2-none")))).otherwise(F.col("ids")))
    return tidy(V.outside_candidates(m, c))


_NOTES = (("comma-separated", "a,b"), ("unexpected header", "a\tb"), ("empty", None), ("not UTF-8", b"source1_entity_id\tmatched_entity_ids\n\xff\n"), ("file not found", ...))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', 'error', 'V1_{p.replace(' ', '_')}', 'matches', CAST(1 AS BIGINT), '')" for p, _ in _NOTES)
       + ", " + ", ".join(f"('{p}', 'warning', '{r}', '{f}', CAST(1 AS BIGINT), '')" for p, _ in _NOTES for r, f in (("V10_no_candidates", "candidates"), ("V10_ids_not_checked", "matches"))) + ") AS t(given, severity, rule, file, n, examples)")
def er_validate_headers(spark, sf_dir):
    """Files that aren't there, are empty or begin with another line, and checks that can't be made."""
    need, out = fixtures.rows(spark, sf_dir, "S1").select("entity_id"), None
    top = scratch(spark)
    for i, (problem, text) in enumerate(_NOTES):
        path = f"{top}/{i}"
        if text is not ...:
            fs, p = files.file_system(spark, path)
            file = fs.create(p, True)
            file.write(bytearray(text if isinstance(text, bytes) else f"{text}\n".encode() if text else b""))
            file.close()
        one = V.validate(spark, path, f"{top}/none", need).withColumn("given", F.lit(problem))
        out = one if out is None else out.unionByName(one)
    return tidy(out)

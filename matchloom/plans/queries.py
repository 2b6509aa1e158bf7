"""Registered queries: a DataFrame of each operator, and DuckDB SQL with its rows.

Doubles are rounded to six places on both sides; counts and ranks are BIGINT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import similarity as S, text as X
from ..operators import evaluation as E, features as P, fusion, models as M, retrieval as R, training as T, validation as V
from ..shared import Growing, written
from ..sources import files
from . import fixtures, oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(final: str | None = None):
    """Registers a function by its name, with the final SELECT of its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if final:
            ORACLES[f.__name__] = O.sql(final)
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, integers long."""
    return df.select(*(F.round(F.col(n).cast("double"), 6).alias(n) if t == "double" else F.col(n).cast("long").alias(n) if t in ("int", "bigint") else F.col(n) for n, t in df.dtypes))


def both(spark, sf_dir):
    return fixtures.queries_and_candidates(spark, sf_dir)


def every(spark, sf_dir) -> DataFrame:
    return files.records(fixtures.rows(spark, sf_dir, "S1", "S2", "S3"))


def compressed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, c = both(spark, sf_dir)
    return q, c, fusion.generate(q, c)[0]


def batched(spark, sf_dir, then: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """then(kept pairs, queries, candidates, truth) of a batch of queries after the other."""
    q, c = both(spark, sf_dir)
    truth = fixtures.truth(spark, sf_dir)
    return fusion.each(q, c, lambda pairs, own: then(pairs, own(q, "entity_id"), c, own(truth)))


def simple_scores(pairs: DataFrame) -> DataFrame:
    """A score without a model: the fused one, scaled."""
    return pairs.select("s1_id", "candidate_id", "rank", F.least(F.lit(1.0), F.round(F.col("rrf_score") * 8, 6)).alias("score"))


# Names and addresses

@query("SELECT entity_id, name FROM rec")
def er_name_normalize(spark, sf_dir):
    return every(spark, sf_dir).select("entity_id", "name")


@query("SELECT entity_id, compact_name FROM rec")
def er_name_compact(spark, sf_dir):
    return every(spark, sf_dir).select("entity_id", "compact_name")


@query("SELECT entity_id, coalesce(string_agg(substr(c, i, n), '|' ORDER BY n, i), '') AS ngrams FROM (SELECT entity_id, replace(name, ' ', '') AS c FROM rec), (VALUES (3), (4)) AS g(n), unnest(range(1, length(c) - n + 2)) AS t(i) GROUP BY entity_id")
def er_name_ngrams(spark, sf_dir):
    return every(spark, sf_dir).select("entity_id", F.array_join(X.char_ngrams(F.col("name")), "|").alias("ngrams"))


@query("SELECT entity_id, address FROM rec")
def er_address_normalize(spark, sf_dir):
    return every(spark, sf_dir).select("entity_id", "address")


@query("SELECT entity_id, postal_code FROM rec")
def er_postal_extract(spark, sf_dir):
    return every(spark, sf_dir).select("entity_id", "postal_code")


@query("SELECT entity_id, house_number FROM rec")
def er_house_number(spark, sf_dir):
    return every(spark, sf_dir).select("entity_id", "house_number")


@query("SELECT entity_id, city, state FROM rec")
def er_city_state(spark, sf_dir):
    return every(spark, sf_dir).select("entity_id", "city", "state")


@query("SELECT entity_id, landmark FROM rec")
def er_landmark(spark, sf_dir):
    return every(spark, sf_dir).select("entity_id", "landmark")


@query("SELECT entity_id, array_to_string(numeric_tokens, ' ') AS numeric_tokens FROM rec")
def er_numeric_tokens(spark, sf_dir):
    return every(spark, sf_dir).select("entity_id", F.array_join("numeric_tokens", " ").alias("numeric_tokens"))


# Retrieval

def _top(name: str, k: int) -> str:
    return f"SELECT s1_id, candidate_id, round(CAST(score AS DOUBLE), 6) AS score, rank FROM ({O.top(name, k)})"


@query(_top("(SELECT s1_id, candidate_id, sum(weight) AS score FROM hits WHERE idx = 'country_postal' GROUP BY 1, 2)", 40))
def er_block_country_postal(spark, sf_dir):
    return tidy(R.exact(*both(spark, sf_dir), 40, ("country_postal",)))


@query(_top("(SELECT s1_id, candidate_id, sum(weight) AS score FROM hits WHERE idx IN ('country_postal', 'country_tokens') GROUP BY 1, 2)", 10))
def er_block_evidence_topk(spark, sf_dir):
    return tidy(R.exact(*both(spark, sf_dir), 10, ("country_postal", "country_tokens")))


@query(_top("exact_scores", 40))
def er_exact_topk(spark, sf_dir):
    return tidy(R.exact(*both(spark, sf_dir)))


@query(_top("bm25_scores", 30))
def er_bm25_topk(spark, sf_dir):
    q, c = both(spark, sf_dir)
    return tidy(R.bm25(q, R.bm25_fit(c), 30))


@query(_top("word_tfidf_scores", 15))
def er_tfidf_word_topk(spark, sf_dir):
    q, c = both(spark, sf_dir)
    return tidy(R.tfidf(q, R.tfidf_fit(c, "name", R.word_terms, 0.5), "name", 15, R.word_terms, None))


@query(_top("char_tfidf_scores", 20))
def er_tfidf_char_topk(spark, sf_dir):
    q, c = both(spark, sf_dir)
    return tidy(R.tfidf(q, R.tfidf_fit(c, "name"), "name", 20))


@query(_top("address_tfidf_scores", 15))
def er_tfidf_address_topk(spark, sf_dir):
    q, c = both(spark, sf_dir)
    return tidy(R.tfidf(q, R.tfidf_fit(c, "address"), "address", 15))


_VEC = "SELECT 'S1-' || CAST(vec_id AS VARCHAR) AS s1_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0"
_NEAR = f"SELECT s1_id, 'S2-' || CAST(vec_id AS VARCHAR) AS candidate_id, list_sum(list_transform(range(1, len(q) + 1), lambda i: CAST(q[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS score FROM ({_VEC}), embeddings WHERE vec_id % 100 <> 0"


@query(_top(f"({_NEAR})", 10))
def er_embedding_topk(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0").select(F.concat(F.lit("S1-"), F.col("vec_id").cast("string")).alias("s1_id"), F.col("embedding").alias("v"))
    c = e.where("vec_id % 100 <> 0").select(F.concat(F.lit("S2-"), F.col("vec_id").cast("string")).alias("candidate_id"), F.col("embedding").alias("v"))
    return tidy(R.dense(q, c, 10))


# Fusion

@query("SELECT s1_id, candidate_id, candidate_source, CAST(votes AS BIGINT) AS retrieval_votes, round(CAST(rrf_score AS DOUBLE), 6) AS rrf_score FROM pairs2")
def er_rrf_fusion(spark, sf_dir):
    q, c = both(spark, sf_dir)
    pairs, _ = fusion.same_country(fusion.merged(fusion.channels(q, c)), q, c)
    return tidy(pairs.select("s1_id", "candidate_id", "candidate_source", "retrieval_votes", fusion.rrf().alias("rrf_score")))


@query("SELECT s1_id, candidate_id, round(CAST(rrf_score AS DOUBLE), 6) AS rrf_score, rank FROM kept")
def er_source_quota_topk(spark, sf_dir):
    return tidy(compressed(spark, sf_dir)[2].select("s1_id", "candidate_id", "rrf_score", "rank"))


@query("SELECT channel, count(*) AS found, count(*) FILTER (a.country <> '' AND b.country <> '' AND a.country <> b.country) AS country_filter_hits FROM found JOIN rec a ON a.entity_id = s1_id JOIN rec b ON b.entity_id = candidate_id GROUP BY channel")
def er_country_filter(spark, sf_dir):
    return fusion.country_hits(*both(spark, sf_dir))


# Features

@query("SELECT token, df, round(idf, 6) AS idf FROM idf")
def er_token_idf(spark, sf_dir):
    return tidy(P.rarity_fit(both(spark, sf_dir)[1]))


def rarities(c: DataFrame) -> tuple[DataFrame, float]:
    """Tokens' idf, counted once for all batches, and its median."""
    idf = written(P.rarity_fit(c), "rarities")
    return idf, P.median_idf(idf)


def _cols(exprs: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in exprs.items())


@query(f"SELECT s1_id, candidate_id, {_cols(O.LEXICAL)} FROM sided")
def er_lexical_features(spark, sf_dir):
    return batched(spark, sf_dir, lambda pairs, q, c, _: tidy(P.lexical(P.sided(pairs, q, c)).select("s1_id", "candidate_id", *P.LEXICAL)))


@query(f"SELECT s1_id, candidate_id, {_cols(O.STRUCTURAL)} FROM sided")
def er_structural_features(spark, sf_dir):
    q, c, pairs = compressed(spark, sf_dir)
    return tidy(P.structural(P.sided(pairs, q, c)).select("s1_id", "candidate_id", *P.STRUCTURAL))


@query(f"SELECT s1_id, candidate_id, {_cols({n: f'coalesce({n}, 0.0)' for n in O.RARITY})} FROM sided LEFT JOIN rare USING (s1_id, candidate_id)")
def er_rarity_features(spark, sf_dir):
    q, c = both(spark, sf_dir)
    idf, middle = rarities(c)
    return fusion.each(q, c, lambda pairs, own: tidy(P.rarity(P.sided(pairs, some := own(q, "entity_id"), c), idf, middle, some).select("s1_id", "candidate_id", *P.RARITY)))


@query(f"SELECT s1_id, candidate_id, {_cols(O.RETRIEVAL)} FROM kept")
def er_retrieval_features(spark, sf_dir):
    return tidy(P.retrieval(compressed(spark, sf_dir)[2]).select("s1_id", "candidate_id", *P.RETRIEVAL))


@query(f"SELECT s1_id, candidate_id, rank, {_cols({**O.LEXICAL, **O.STRUCTURAL, **O.RETRIEVAL, **{n: f'coalesce({n}, 0.0)' for n in O.RARITY}})} FROM sided LEFT JOIN rare USING (s1_id, candidate_id)")
def er_pair_features_60(spark, sf_dir):
    q, c = both(spark, sf_dir)
    idf, middle = rarities(c)
    return fusion.each(q, c, lambda pairs, own: tidy(P.pair_features(pairs, own(q, "entity_id"), c, idf, middle)))


@query(f"SELECT a.entity_id AS s1_id, b.entity_id AS candidate_id, round(CAST({O.jaro_winkler('a.name', 'b.name')} AS DOUBLE), 6) AS sim FROM rec a JOIN rec b ON a.postal_code = b.postal_code AND a.source = 'S1' AND b.source <> 'S1' AND a.postal_code <> ''")
def er_jaro_winkler(spark, sf_dir):
    return tidy(S.with_jaro_winkler(_by_postal(spark, sf_dir), "a", "b", "sim").drop("a", "b"))


@query(f"SELECT a.entity_id AS s1_id, b.entity_id AS candidate_id, round(CAST({O._lev('a.name', 'b.name')} AS DOUBLE), 6) AS sim FROM rec a JOIN rec b ON a.postal_code = b.postal_code AND a.source = 'S1' AND b.source <> 'S1' AND a.postal_code <> ''")
def er_levenshtein(spark, sf_dir):
    return tidy(_by_postal(spark, sf_dir).select("s1_id", "candidate_id", S.levenshtein(F.col("a"), F.col("b")).alias("sim")))


def _by_postal(spark, sf_dir):
    q, c = both(spark, sf_dir)
    a = q.where("postal_code <> ''").select("postal_code", F.col("entity_id").alias("s1_id"), F.col("name").alias("a"))
    return a.join(c.select("postal_code", F.col("entity_id").alias("candidate_id"), F.col("name").alias("b")), "postal_code").drop("postal_code")


_TRI = f"""SELECT x.s1_id, x.candidate_id AS c2, y.candidate_id AS c3, least(1.0, {O.jaro_winkler('a.name', 'b.name')} + CASE WHEN a.postal_code <> '' AND a.postal_code = b.postal_code THEN 0.1 ELSE 0.0 END) AS sim FROM kept x JOIN kept y USING (s1_id) JOIN rec a ON a.entity_id = x.candidate_id JOIN rec b ON b.entity_id = y.candidate_id
WHERE x.candidate_source = 'S2' AND y.candidate_source = 'S3' AND (a.country = '' OR b.country = '' OR a.country = b.country)"""


@query(f"SELECT s1_id, c2 AS candidate_id, round(CAST(max(sim) AS DOUBLE), 6) AS consistency FROM ({_TRI}) GROUP BY 1, 2 UNION ALL SELECT s1_id, c3, round(CAST(coalesce(max(CASE WHEN sim >= 0.8 THEN sim END), 0.0) AS DOUBLE), 6) FROM ({_TRI}) GROUP BY 1, 2")
def er_triangle_consistency(spark, sf_dir):
    _, c, pairs = compressed(spark, sf_dir)
    return tidy(fusion.consistency(pairs, c))


# Training sets

@query("SELECT s1_id, array_to_string(matches, ',') AS matches, len(matches) AS n FROM truth")
def er_ground_truth(spark, sf_dir):
    t = fixtures.truth(spark, sf_dir)
    raw = t.select(F.col("s1_id").alias("source1_entity_id"), F.concat(F.lit(" "), F.array_join("matches", " , ")).alias("matched_entity_ids"))
    return tidy(files.parse_truth(raw).select("s1_id", F.array_join("matches", ",").alias("matches"), F.size("matches").alias("n")))


@query("SELECT s1_id, candidate_id, label FROM (SELECT s1_id, candidate_id, rank, CAST(CASE WHEN list_contains(matches, candidate_id) THEN 1 ELSE 0 END AS BIGINT) AS label, len(matches) AS m FROM kept JOIN truth USING (s1_id)) WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY rank) <= CASE WHEN m > 0 THEN 4 * m ELSE 2 END")
def er_negative_sampling(spark, sf_dir):
    return batched(spark, sf_dir, lambda pairs, q, c, truth: tidy(T.negatives(pairs, truth).select("s1_id", "candidate_id", "label")))


@query("SELECT s1_id, candidate_id, label FROM (SELECT *, sum(label) OVER (PARTITION BY s1_id) AS p, row_number() OVER (PARTITION BY s1_id, label ORDER BY rank) AS n FROM (SELECT s1_id, candidate_id, rank, CAST(CASE WHEN list_contains(matches, candidate_id) THEN 1 ELSE 0 END AS BIGINT) AS label FROM kept JOIN truth USING (s1_id))) WHERE label = 1 OR n <= 4 * greatest(p, 1)")
def er_training_pairs(spark, sf_dir):
    return tidy(T.training_pairs(compressed(spark, sf_dir)[2], fixtures.truth(spark, sf_dir))[0].select("s1_id", "candidate_id", "label"))


@query("SELECT s1_id, candidate_id, score FROM scored JOIN truth USING (s1_id) WHERE score >= 0.35 AND NOT list_contains(matches, candidate_id) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, candidate_id) <= 5")
def er_hard_negatives(spark, sf_dir):
    return tidy(T.hard_negatives(simple_scores(compressed(spark, sf_dir)[2]), fixtures.truth(spark, sf_dir)).select("s1_id", "candidate_id", "score"))


@query("SELECT s1_id, unnest(matches) AS candidate_id FROM truth EXCEPT SELECT s1_id, candidate_id FROM kept")
def er_missed_positives(spark, sf_dir):
    return batched(spark, sf_dir, lambda pairs, q, c, truth: T.missed(pairs, truth))


@query("SELECT entity_id FROM (SELECT r.entity_id, source, seq, t.c IS NOT NULL AS m FROM rec r LEFT JOIN (SELECT DISTINCT unnest(matches) AS c FROM truth WHERE CAST(substr(s1_id, 4) AS INT) % 3 = 0) t ON t.c = r.entity_id WHERE source <> 'S1') QUALIFY m OR row_number() OVER (PARTITION BY source, m ORDER BY seq) <= 50")
def er_distractor_limit(spark, sf_dir):
    _, c = both(spark, sf_dir)
    some = fixtures.truth(spark, sf_dir).where(F.substring("s1_id", 4, 20).cast("int") % 3 == 0)
    return T.limit_distractors(c, some, 50).select("entity_id")


# Models and decisions

_AMB = "SELECT s1_id, candidate_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, candidate_id) AS n, max(score) OVER (PARTITION BY s1_id) AS top, count(*) OVER (PARTITION BY s1_id) AS k FROM scored"


@query(f"SELECT s1_id, candidate_id, score FROM ({_AMB}) WHERE n <= 10 AND (score BETWEEN 0.3 AND 0.8 OR (k >= 2 AND score > 0.3 AND top - score < 0.15)) ORDER BY abs(score - 0.5), s1_id, candidate_id LIMIT (SELECT least(50, greatest(1, CAST(floor(count(*) * 0.01) AS BIGINT))) FROM scored)")
def er_ambiguous_pairs(spark, sf_dir):
    return tidy(M.ambiguous(simple_scores(compressed(spark, sf_dir)[2])).select("s1_id", "candidate_id", "score"))


@query("SELECT s1_id, candidate_id, round(CASE WHEN rank % 2 = 0 THEN 0.4 * score + 0.6 * (1.0 / rank) ELSE score END, 6) AS score FROM scored")
def er_fused_scores(spark, sf_dir):
    s = simple_scores(compressed(spark, sf_dir)[2])
    return tidy(M.fuse(s, s.where("rank % 2 = 0").withColumn("ce_score", 1.0 / F.col("rank"))).select("s1_id", "candidate_id", "score"))


_GRID = "SELECT i, round(i * 0.05, 2) AS t FROM range(0, 21) AS g(i)"


@query(f"SELECT CAST(t AS DOUBLE) AS threshold, round(avg({O.F05}), 6) AS macro_f05 FROM (SELECT g.t, truth.s1_id, len(matches) AS actual, count(candidate_id) AS predicted, count(*) FILTER (list_contains(matches, candidate_id)) AS tp FROM ({_GRID}) g CROSS JOIN truth LEFT JOIN scored s ON s.s1_id = truth.s1_id AND s.score >= g.t GROUP BY ALL) GROUP BY t")
def er_threshold_grid(spark, sf_dir):
    s = simple_scores(compressed(spark, sf_dir)[2])
    return tidy(M.threshold_curve(s, fixtures.truth(spark, sf_dir), [round(i * 0.05, 2) for i in range(21)]))


@query("SELECT s1_id, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted, CAST(actual AS BIGINT) AS actual, round(f05, 6) AS f05 FROM entity")
def er_entity_f05(spark, sf_dir):
    return batched(spark, sf_dir, lambda pairs, q, c, truth: tidy(E.entity_f05(M.decide(simple_scores(pairs), 0.5), truth)))


@query("SELECT round(avg(f05), 6) AS macro_f05, round(coalesce(avg(f05) FILTER (actual = 0), 1.0), 6) AS singleton_accuracy, round(coalesce(avg(f05) FILTER (actual > 0), 0.0), 6) AS matched_entity_f05, count(*) AS total_entities, count(*) FILTER (actual = 0) AS total_singletons, count(*) FILTER (actual > 0) AS total_matched FROM entity")
def er_macro_f05(spark, sf_dir):
    s = M.decide(simple_scores(compressed(spark, sf_dir)[2]), 0.5)
    return tidy(E.macro_f05(s, fixtures.truth(spark, sf_dir)))


_GOT = "SELECT s1_id, matches, coalesce(got, []) AS got FROM truth LEFT JOIN (SELECT s1_id, list(DISTINCT candidate_id) AS got FROM kept GROUP BY s1_id) USING (s1_id)"


@query(f"SELECT CAST(t AS BIGINT) AS total_true_matches, CAST(c AS BIGINT) AS covered_matches, CAST(g AS BIGINT) AS total_candidates_generated, round(c / t, 6) AS recall_ceiling, round(g / n, 6) AS avg_candidates_per_entity, round(1 - g / (n * 1000000.0), 6) AS reduction_ratio FROM (SELECT sum(len(matches)) AS t, sum(len(list_intersect(matches, got))) AS c, sum(len(got)) AS g, count(*) AS n FROM ({_GOT}))")
def er_blocking_quality(spark, sf_dir):
    return tidy(E.blocking_quality(compressed(spark, sf_dir)[2], fixtures.truth(spark, sf_dir), 1_000_000))


_HIT = "SELECT s1_id, matches, candidate_id, rank, exact_found, char_tfidf_rank, word_tfidf_rank, address_tfidf_rank, bm25_rank FROM truth JOIN {0} USING (s1_id) WHERE list_contains(matches, candidate_id)"
_FOUND = {"exact": "exact_found > 0", "name_char_tfidf": "char_tfidf_rank > 0", "name_word_tfidf": "word_tfidf_rank > 0", "address_tfidf": "address_tfidf_rank > 0", "bm25": "bm25_rank > 0"}


_RATES = ", ".join(f"round({x}, 6) AS {n}" for n, x in (
    ("recall_ceiling", "h.n / t"), ("recall_at_10", "h.n10 / t"), ("recall_at_20", "h.n20 / t"), ("recall_at_40", "h.n40 / t"), ("raw_recall_ceiling", "r.n / t"), ("quota_retention_rate", "h.n / r.n"),
    ("pct_entities_all_recovered", "a.whole / w"), ("pct_entities_any_recovered", "a.some / w"), *((f"{p}channel_{c}", f"{t}.{c} / t") for c in _FOUND for p, t in (("", "h"), ("raw_", "r"))),
))
_BY_CHANNEL = ", ".join(f"count(*) FILTER ({x}) AS {c}" for c, x in _FOUND.items())
_OF_ALL = "SELECT sum(len(matches)) AS t, count(*) FILTER (len(matches) > 0) AS w FROM truth"
_KEPT = f"SELECT count(*) AS n, count(*) FILTER (rank <= 10) AS n10, count(*) FILTER (rank <= 20) AS n20, count(*) FILTER (rank <= 40) AS n40, {_BY_CHANNEL} FROM ({_HIT.format('kept')})"
_RAW = f"SELECT count(*) AS n, {_BY_CHANNEL} FROM ({_HIT.format('(SELECT *, 0 AS rank FROM pairs2)')})"
_WHOLE = f"SELECT count(*) FILTER (k = m) AS whole, count(*) AS some FROM (SELECT s1_id, count(*) AS k, any_value(len(matches)) AS m FROM ({_HIT.format('kept')}) GROUP BY s1_id)"


@query(f"SELECT CAST(t AS BIGINT) AS total_true_matches, h.n AS covered_matches, {_RATES} FROM ({_OF_ALL}), ({_KEPT}) h, ({_RAW}) r, ({_WHOLE}) a")
def er_recall_gate(spark, sf_dir):
    q, c = both(spark, sf_dir)
    pairs, raw = fusion.generate(q, c, raw=True)
    got = E.recall_gate(pairs, fixtures.truth(spark, sf_dir), raw)
    keep = [n for n in got.columns if not n.endswith("_ann") and n not in ("avg_candidates", "country_filter_hits")]
    return tidy(got.select(*keep))


# Outputs

_LIST = "SELECT a.entity_id AS source1_entity_id, coalesce(ids, '') AS {1} FROM (SELECT DISTINCT entity_id FROM rec WHERE source = 'S1') a LEFT JOIN (SELECT s1_id, string_agg(candidate_id, ',' ORDER BY rank, candidate_id) AS ids FROM {0} GROUP BY s1_id) p ON p.s1_id = a.entity_id"


@query(_LIST.format("kept", "candidate_entity_ids"))
def er_candidate_list(spark, sf_dir):
    return batched(spark, sf_dir, lambda pairs, q, c, _: files.listed(q, pairs, "candidate_entity_ids"))


@query(_LIST.format("(SELECT * FROM scored WHERE score >= 0.5)", "matched_entity_ids"))
def er_match_list(spark, sf_dir):
    return batched(spark, sf_dir, lambda pairs, q, c, _: files.listed(q, M.decide(simple_scores(pairs), 0.5), "matched_entity_ids", True))


@query("SELECT entity_id FROM rec WHERE source = 'S1' AND NOT (seq % 2 = 0 AND seq % 3 = 0)")
def er_resume_antijoin(spark, sf_dir):
    s1 = fixtures.rows(spark, sf_dir, "S1")
    done = s1.select(F.col("entity_id").alias("source1_entity_id"), "seq")
    return files.remaining(s1, done.where("seq % 2 = 0"), done.where("seq % 3 = 0")).select("entity_id")


@query("SELECT entity_id FROM rec WHERE source = 'S2' AND country = '' UNION ALL SELECT entity_id FROM rec WHERE source = 'S3' AND seq % 4 = 0 AND country = ''")
def er_country_fallback(spark, sf_dir):
    s2, s3 = fixtures.rows(spark, sf_dir, "S2"), fixtures.rows(spark, sf_dir, "S3").where("seq % 4 = 0")
    return files.in_country(s3, "unknown", existing=files.in_country(s2, "unknown")).select("entity_id")


@query("SELECT s1.entity_id AS source1_entity_id, CASE WHEN seq % 3 = 0 THEN 'S2-' || CAST(seq AS VARCHAR) ELSE '' END AS matched_entity_ids FROM s1")
def er_baseline_merge(spark, sf_dir):
    s1 = fixtures.rows(spark, sf_dir, "S1")
    base = s1.select(F.col("entity_id").alias("source1_entity_id"), F.lit("").alias("matched_entity_ids"))
    got = s1.where("seq % 3 = 0").select(F.col("entity_id").alias("source1_entity_id"), F.concat(F.lit("S2-"), F.col("seq").cast("string")).alias("matched_entity_ids"))
    return files.merged_baseline(base, got)


_LINES = "SELECT 'S1-' || CAST(k AS VARCHAR) || CASE WHEN k % 10 = 0 THEN '' ELSE {t} || CASE WHEN k % 10 = 1 THEN 'S2-' || CAST(k AS VARCHAR) || ',S2-' || CAST(k AS VARCHAR) WHEN k % 10 = 2 THEN 'S1-' || CAST(k AS VARCHAR) WHEN k % 10 = 3 THEN 'S3-' || CAST(k AS VARCHAR) || ', S2-1' ELSE 'S2-' || CAST(k AS VARCHAR) END END AS value FROM base WHERE k % 10 <> 9 UNION ALL SELECT 'S1-' || CAST(k AS VARCHAR) || {t} FROM base WHERE k % 10 = 4 UNION ALL SELECT 'S1-X' || CAST(k AS VARCHAR) || {t} FROM base WHERE k % 50 = 5"

O.CTES["lines"] = _LINES.format(t="chr(9)")
O.CTES["parsed"] = "SELECT split_part(value, chr(9), 1) AS s1, CASE WHEN trim(split_part(value, chr(9), 2)) = '' THEN [] ELSE string_split(split_part(value, chr(9), 2), ',') END AS ids FROM lines WHERE instr(value, chr(9)) > 0"
O.CTES["vids"] = "SELECT DISTINCT unnest(ids) AS x FROM parsed"


@query("SELECT 'error' AS severity, rule, 'matches' AS file, count(DISTINCT x) AS n, array_to_string(list_sort(list(DISTINCT x))[1:5], ',') AS examples FROM ("
       "SELECT 'V2_malformed_row' AS rule, value AS x FROM lines WHERE instr(value, chr(9)) = 0 UNION ALL SELECT 'V3_duplicate_row', s1 FROM (SELECT s1 FROM parsed GROUP BY s1 HAVING count(*) > 1) UNION ALL SELECT 'V4_repeated_id', s1 FROM parsed WHERE len(ids) <> len(list_distinct(ids)) "
       "UNION ALL SELECT 'V5_self_match', x FROM vids WHERE starts_with(x, 'S1-') UNION ALL SELECT 'V6_wrong_prefix', x FROM vids WHERE NOT regexp_matches(x, '^S[123]-') UNION ALL SELECT 'V7_unknown_id', x FROM vids WHERE regexp_matches(x, '^S[23]-') AND x NOT IN (SELECT entity_id FROM rec WHERE source <> 'S1') "
       "UNION ALL SELECT 'V8_missing', entity_id FROM rec WHERE source = 'S1' AND entity_id NOT IN (SELECT s1 FROM parsed) UNION ALL SELECT 'V8_extra', s1 FROM parsed WHERE s1 NOT IN (SELECT entity_id FROM rec WHERE source = 'S1')) GROUP BY rule")
def er_validate_submission(spark, sf_dir):
    base = spark.sql(fixtures.BASE.replace("FROM customer", "FROM {customer}").replace("JOIN nation", "JOIN {nation}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"), nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    lines = spark.sql(_LINES.format(t="'\\t'").replace("AS VARCHAR", "AS STRING").replace("FROM base", "FROM {base}"), base=base)
    q, c = both(spark, sf_dir)
    return tidy(V.findings(V.parse(lines), q, "matches", c))


# Models (their figures are Spark's own; only rows are compared)

def ranked(spark, sf_dir):
    """Scored pairs with labels, of a ranker trained on the training part and calibrated on another."""
    q, c = both(spark, sf_dir)
    truth = fixtures.truth(spark, sf_dir)
    parts = written(T.split(truth), "split")
    idf, middle = rarities(c)
    kept = Growing(spark, "kept")

    def features(pairs: DataFrame, own: fusion.Own, part: str = "true") -> DataFrame:
        pairs = pairs.join(own(parts).where(part), "s1_id")
        return T.labelled(P.pair_features(pairs, own(q, "entity_id"), c, idf, middle), own(truth)).join(own(parts), "s1_id")

    def learnt(pairs: DataFrame, own: fusion.Own) -> DataFrame:
        kept.add(pairs)
        return T.training_pairs(features(pairs, own, "part = 'train'"), own(truth))[0]

    # all features are never there at once: those to learn from are kept, the others are made again to be scored
    model = M.Ranker(P.names(), trees=8, depth=4).fit(fusion.each(q, c, learnt))
    scored = Growing(spark, "scored")
    for own, _ in fusion.parts(q):
        scored.add(model.predict(features(own(kept.read()), own)).select("s1_id", "candidate_id", "rank", "part", "label", "score"))
    return model, scored.read(), truth


@query()
def er_gbdt_scores(spark, sf_dir):
    return tidy(ranked(spark, sf_dir)[1].select("s1_id", "candidate_id", "part", "label", "score"))


@query()
def er_isotonic_scores(spark, sf_dir):
    _, scored, _ = ranked(spark, sf_dir)
    cal = M.Calibrator().fit(scored.where("part = 'calibration'"))
    return tidy(cal.apply(scored.select("s1_id", "candidate_id", "part", "label", "score")))


@query()
def er_holdout_f05(spark, sf_dir):
    """Macro F0.5 of the holdout part at the threshold that the calibration part chose."""
    _, scored, truth = ranked(spark, sf_dir)
    parts = T.split(truth)
    cal = M.Calibrator().fit(scored.where("part = 'calibration'"))
    done = cal.apply(scored.select("s1_id", "candidate_id", "part", "label", "score"))
    of = lambda p: truth.join(parts.where(F.col("part") == p), "s1_id", "left_semi")
    t, _ = M.best_threshold(done.where("part = 'calibration'"), of("calibration"))
    return tidy(E.macro_f05(M.decide(done.where("part = 'holdout'"), t), of("holdout")))

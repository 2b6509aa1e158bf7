"""Quality measures: entity and macro F0.5, blocking quality, the recall gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fusion

#: The gate's names of the channels' flags.
CHANNELS = {"exact": "exact", "name_char_tfidf": "char_tfidf", "name_word_tfidf": "word_tfidf", "address_tfidf": "address_tfidf", "bm25": "bm25", "name_ann": "name_ann", "address_ann": "address_ann", "record_ann": "record_ann"}


def f05(tp: Column, predicted: Column, actual: Column) -> Column:
    """1.25 P R / (0.25 P + R), which is 1.25 tp / (predicted + 0.25 actual); both empty: 1, one empty: 0."""
    return F.when((actual == 0) & (predicted == 0), 1.0).when((actual == 0) | (predicted == 0) | (tp == 0), 0.0).otherwise(1.25 * tp / (predicted + 0.25 * actual))


def entity_f05(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, tp, predicted, actual, f05) of truth's entities. predictions: s1_id, candidate_id."""
    p = predictions.select("s1_id", "candidate_id").distinct().groupBy("s1_id").agg(F.collect_set("candidate_id").alias("got"))
    x = truth.join(p, "s1_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    x = x.select("s1_id", F.size(F.array_intersect("got", "matches")).alias("tp"), F.size("got").alias("predicted"), F.size(F.array_distinct("matches")).alias("actual"))
    return x.withColumn("f05", f05(F.col("tp"), F.col("predicted"), F.col("actual")))


def macro_f05(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: macro_f05, singleton_accuracy (1 if there are none), matched_entity_f05 (0), and the counts."""
    single = F.col("actual") == 0
    return entity_f05(predictions, truth).agg(
        F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"), F.coalesce(F.avg(F.when(single, F.col("f05"))), F.lit(1.0)).alias("singleton_accuracy"), F.coalesce(F.avg(F.when(~single, F.col("f05"))), F.lit(0.0)).alias("matched_entity_f05"),
        F.count("*").alias("total_entities"), F.count_if(single).alias("total_singletons"), F.count_if(~single).alias("total_matched"),
    )


def blocking_quality(pairs: DataFrame, truth: DataFrame, universe: int | None = None) -> DataFrame:
    """One row: recall ceiling, candidates an entity, and the share of all comparisons that blocking saves."""
    c = pairs.select("s1_id", "candidate_id").distinct().groupBy("s1_id").agg(F.collect_set("candidate_id").alias("got"))
    x = truth.join(c, "s1_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    x = x.agg(F.sum(F.size(F.array_distinct("matches"))).alias("total_true_matches"), F.sum(F.size(F.array_intersect("matches", "got"))).alias("covered_matches"), F.sum(F.size("got")).alias("total_candidates_generated"), F.count("*").alias("_n"))
    x = x.withColumn("recall_ceiling", F.when(F.col("total_true_matches") > 0, F.col("covered_matches") / F.col("total_true_matches")).otherwise(1.0)).withColumn("avg_candidates_per_entity", F.col("total_candidates_generated") / F.greatest("_n", F.lit(1)))
    if universe:
        x = x.withColumn("reduction_ratio", 1 - F.col("total_candidates_generated") / (F.col("_n") * F.lit(universe)))
    return x.drop("_n")


def gate_counts(pairs: DataFrame, truth: DataFrame, raw: DataFrame | None = None, only_seen: bool = False) -> DataFrame:
    """The gate's sums, one row; sums of parts of the entities add up to those of all. pairs: with rank and the
    channels' flags; raw: pairs before fusion. only_seen: count the entities that have candidates."""
    t = truth.withColumn("matches", F.array_distinct("matches"))
    hit = F.array_contains("matches", F.col("candidate_id"))
    flags = lambda p: [F.sum((hit & F.coalesce(f"found_by_{c}", F.lit(False))).cast("long")).alias(f"{p}{name}") for name, c in CHANNELS.items()]
    own = t.join(pairs, "s1_id", "inner" if only_seen else "left").groupBy("s1_id").agg(
        F.first(F.size("matches")).alias("actual"), F.count("candidate_id").alias("candidates"), F.sum(hit.cast("long")).alias("covered"),
        *(F.sum((hit & (F.col("rank") <= k)).cast("long")).alias(f"covered_{k}") for k in (10, 20, 40)), *flags("post_"),
    )
    if raw is not None:
        before = t.join(raw, "s1_id").groupBy("s1_id").agg(F.sum(hit.cast("long")).alias("raw_covered"), *flags("raw_"))
        own = own.join(before, "s1_id", "left")
    some = F.col("actual") > 0
    sums = [c for c in own.columns if c.startswith(("covered", "post_", "raw_"))]
    return own.agg(
        F.count("*").alias("entities"), F.count_if(some).alias("with_matches"), F.sum(F.when(some, F.col("actual"))).cast("long").alias("true_matches"), F.sum(F.when(some, F.col("candidates"))).cast("long").alias("candidates"),
        F.count_if(some & (F.coalesce("covered", F.lit(0)) == F.col("actual"))).alias("all_recovered"), F.count_if(some & (F.col("covered") > 0)).alias("any_recovered"),
        *(F.coalesce(F.sum(F.when(some, F.col(c))), F.lit(0)).cast("long").alias(c) for c in sums),
    )


def gate_rates(counts: DataFrame, country_filter_hits: int = 0) -> DataFrame:
    """The gate's rates of (summed) counts. Candidates of singletons aren't counted, but the entities are."""
    part = lambda a, b="true_matches": F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    has_raw = "raw_covered" in counts.columns
    out = {
        "recall_ceiling": part("covered"), "recall_at_10": part("covered_10"), "recall_at_20": part("covered_20"), "recall_at_40": part("covered_40"),
        "pct_entities_all_recovered": part("all_recovered", "with_matches"), "pct_entities_any_recovered": part("any_recovered", "with_matches"),
        "avg_candidates": F.col("candidates") / F.greatest("entities", F.lit(1)), "raw_recall_ceiling": part("raw_covered") if has_raw else part("covered"),
        "quota_retention_rate": part("covered", "raw_covered") if has_raw else F.lit(1.0), "country_filter_hits": F.lit(country_filter_hits).cast("long"),
        **{f"channel_{n}": part(f"post_{n}") for n in CHANNELS}, **{f"raw_channel_{n}": part(f"{'raw' if has_raw else 'post'}_{n}") for n in CHANNELS},
    }
    return counts.select(F.col("true_matches").alias("total_true_matches"), F.col("covered").alias("covered_matches"), *(c.alias(n) for n, c in out.items()))


def recall_gate(pairs: DataFrame, truth: DataFrame, raw: DataFrame | None = None, country_filter_hits: int = 0) -> DataFrame:
    return gate_rates(gate_counts(pairs, truth, raw), country_filter_hits)


def staged(report: dict) -> dict:
    """The gate's row as a report of five stages."""
    raw = {n: report[f"raw_channel_{n}"] for n in CHANNELS}
    last = {n: report[n] for n in ("recall_ceiling", "recall_at_40", "recall_at_20", "recall_at_10", "quota_retention_rate")}
    return {
        "stage_A_raw_channels": raw, "stage_B_country_filter": {"cross_country_prevented": report["country_filter_hits"], "country_filter_match_loss_rate": 0.0},
        "stage_C_pre_rrf_union": report["raw_recall_ceiling"], "stage_D_post_rrf_ranking": report["recall_ceiling"], "stage_E_post_quota_final": last,
    }


class IncrementalGate:
    """Adds up the counts of batches of entities; see gate_counts(). Entities without candidates don't count."""

    def __init__(self, truth: DataFrame) -> None:
        self.truth, self.parts = truth, []

    def update(self, pairs: DataFrame, raw: DataFrame | None = None) -> None:
        self.parts.append(gate_counts(pairs, self.truth, raw, only_seen=True).first().asDict())

    def counts(self) -> dict:
        return {k: sum(p.get(k) or 0 for p in self.parts) for k in (self.parts[0] if self.parts else {})}

    def summary(self, country_filter_hits: int = 0) -> dict:
        own = self.counts()
        if not own:
            return {}
        spark = self.truth.sparkSession
        df = spark.createDataFrame([tuple(own.values())], ", ".join(f"{k} long" for k in own))
        return gate_rates(df, country_filter_hits).first().asDict()

"""Building training sets: samples, splits, labels, negatives, hard negatives.

What the reference draws at random is drawn here by a hash of the key and a seed, so runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F



def draw(key: str, seed: int) -> Column:
    """60 bits of the MD5 of the seed and the key, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), 1, 15), 16, 10).cast("long")


def stratified(s1: DataFrame, truth: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows of S1, from each stratum (country and whether there are matches) its share: whole rows by largest
    remainder, so the size is exact."""
    x = s1.join(truth.select(F.col("s1_id").alias("entity_id"), (F.size("matches") > 0).alias("_has")), "entity_id", "left").withColumn("_stratum", F.concat_ws("_", "country", F.coalesce("_has", F.lit(False)).cast("string")))
    sizes = {r["_stratum"]: r["count"] for r in x.groupBy("_stratum").count().collect()}  # a row a stratum
    total = sum(sizes.values())
    n = min(n, total)
    share = {k: n * v / total for k, v in sizes.items()}
    quota = {k: int(v) for k, v in share.items()}
    for k in sorted(share, key=lambda k: (quota[k] - share[k], k))[: n - sum(quota.values())]:
        quota[k] += 1
    own = F.coalesce(F.create_map(*(F.lit(v) for kv in quota.items() for v in kv))[F.col("_stratum")], F.lit(0)) if quota else F.lit(0)
    w = Window.partitionBy("_stratum").orderBy(draw("entity_id", seed), "entity_id")
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= own).drop("_n", "_stratum", "_has")


def split(ids: DataFrame, holdout: float = 0.1, calibration: float = 0.1, seed: int = 42, key: str = "s1_id") -> DataFrame:
    """Adds part: the first int(n holdout) ids by hash are `holdout`, the next int(n calibration)
    `calibration`, the others `train`. The places come from sizes of hash buckets, so no task sorts all ids."""
    x = ids.select(key).distinct().withColumn("_h", draw(key, seed)).withColumn("_b", F.shiftright("_h", 48).cast("int"))
    sizes = sorted((r["_b"], r["count"]) for r in x.groupBy("_b").count().collect())  # 4096 rows at most
    before, at = {}, 0
    for b, c in sizes:
        before[b], at = at, at + c
    starts = F.array(*(F.lit(before.get(b, 0)) for b in range(4096)))
    place = F.get(starts, F.col("_b")) + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    a = int(at * holdout)
    b = a + int(at * calibration)
    return x.select(key, F.when(place <= a, "holdout").when(place <= b, "calibration").otherwise("train").alias("part"))


def limit_distractors(candidates: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """Candidates that are some row's match, and of each source the first n others by seq."""
    true = truth.select(F.explode("matches").alias("entity_id")).distinct()
    kept = candidates.join(true, "entity_id", "left_semi")
    w = Window.partitionBy("source").orderBy("seq", "entity_id")
    rest = candidates.join(true, "entity_id", "left_anti").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return kept.unionByName(rest)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: 1 if the candidate is one of the row's matches."""
    t = truth.select("s1_id", F.explode("matches").alias("candidate_id")).distinct().withColumn("_y", F.lit(1))
    return pairs.join(t, ["s1_id", "candidate_id"], "left").withColumn("label", F.coalesce("_y", F.lit(0))).drop("_y")


def positives(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return labelled(pairs, truth).where("label = 1")


def missed(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """True matches that no candidate is."""
    return truth.select("s1_id", F.explode("matches").alias("candidate_id")).join(pairs.select("s1_id", "candidate_id"), ["s1_id", "candidate_id"], "left_anti")


def negatives(pairs: DataFrame, truth: DataFrame, ratio: int = 4, singleton: int = 2) -> DataFrame:
    """The first of each row's non-matches by rank: ratio for each of its matches, or `singleton` if it has none."""
    x = labelled(pairs, truth).where("label = 0").join(truth.select("s1_id", F.size("matches").alias("_m")), "s1_id")
    w = Window.partitionBy("s1_id").orderBy("rank", "candidate_id")
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.when(F.col("_m") > 0, ratio * F.col("_m")).otherwise(singleton)).drop("_n", "_m")


def training_pairs(pairs: DataFrame, truth: DataFrame, ratio: int = 4) -> tuple[DataFrame, DataFrame]:
    """(labelled pairs to learn from, the others): all retrieved matches and the first ratio * max(their number, 1)
    non-matches by rank; what is left is for mining."""
    x = labelled(pairs, truth)
    w = Window.partitionBy("s1_id")
    x = x.withColumn("_p", F.sum("label").over(w)).withColumn("_n", F.row_number().over(Window.partitionBy("s1_id", "label").orderBy("rank", "candidate_id")))
    own = (F.col("label") == 1) | (F.col("_n") <= ratio * F.greatest("_p", F.lit(1)))
    return x.where(own).drop("_p", "_n"), x.where(~own).drop("_p", "_n")


def hard_negatives(scored: DataFrame, truth: DataFrame, threshold: float = 0.35, k: int = 5) -> DataFrame:
    """Each row's k best-scored non-matches of the threshold or more."""
    t = truth.select("s1_id", F.explode("matches").alias("candidate_id"))
    x = scored.where(F.col("score") >= threshold).join(t, ["s1_id", "candidate_id"], "left_anti")
    w = Window.partitionBy("s1_id").orderBy(F.desc("score"), "candidate_id")
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")

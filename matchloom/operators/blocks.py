"""The best candidates of each query by inner product of dense vectors, a block of queries and a shard of candidates at a time.

Candidates are dealt out to shards and queries to blocks, by a hash within their part, so that no task holds more
than SHARD candidates and BLOCK queries, and no pair that isn't among a query's best of a shard leaves the task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Most candidates of a shard and queries of a block (about: a hash deals them out), and cells of a dense product.
SHARD, BLOCK, CELLS = 20_000, 10_000, 1 << 22
#: Scores that agree to so many places tie.
PLACES = 9


def top(df: DataFrame, k: int, score: str = "score", key: str = "s1_id") -> DataFrame:
    """The k best rows of each key by score, ties to the smaller candidate_id, with their rank. Scores that
    agree to nine places tie, whatever order they were summed in."""
    w = Window.partitionBy(key).orderBy(F.round(score, PLACES).desc(), "candidate_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best(scores: np.ndarray, k: int, on: np.ndarray) -> np.ndarray:
    """Places of the k largest scores among on, and of all that tie with the last of them."""
    at = np.flatnonzero(on)
    if len(at) > k:
        own = scores[at]
        last = np.partition(own, len(own) - k)[len(own) - k]
        at = at[own >= last - 2 * 10.0**-PLACES]
    return at


def _out(names: list, scores: list, candidates: list) -> pa.Table:
    cat = lambda x, t: pa.concat_arrays(x).cast(t) if x else pa.array([], t)
    return pa.table({"s1_id": cat(names, pa.string()), "candidate_id": cat(candidates, pa.string()), "score": pa.array(np.concatenate(scores) if scores else np.empty(0))})


def _dealt(queries: DataFrame, candidates: DataFrame, keys: list[str], ids: tuple[str, str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with _shard and _block: each row of one goes to all shards or blocks of its part of the other."""
    q, c = ids
    size = lambda df, i, most, n: df.groupBy(*keys).agg(F.ceil(F.count_distinct(i) / most).cast("int").alias(n))
    sizes = size(queries, q, BLOCK, "_blocks").join(size(candidates, c, SHARD, "_shards"), keys)
    place = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda df, shard, block: df.join(sizes, keys).withColumn("_shard", shard).withColumn("_block", block).drop("_shards", "_blocks")
    return own(queries, every("_shards"), place(q, "_blocks")), own(candidates, place(c, "_shards"), every("_blocks")), [*keys, "_shard", "_block"]


def _dense(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _out([], [], [])
        flat = lambda t: np.asarray(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, -1)
        x, q, ids, names = flat(candidates), flat(queries), candidates["candidate_id"].combine_chunks(), queries["s1_id"].combine_chunks()
        out, scores, found, step = [], [], [], max(1, CELLS // len(x))
        every = np.ones(len(x), bool)
        for a in range(0, len(q), step):
            for j, total in enumerate(q[a : a + step] @ x.T):
                some = best(total, k, every)
                out.append(pa.repeat(names[a + j], len(some)))
                scores.append(total[some])
                found.append(ids.take(pa.array(some)))
        return _out(out, scores, found)

    return run


def dense(queries: DataFrame, candidates: DataFrame, k: int, part: str | None = None) -> DataFrame:
    """(s1_id, candidate_id, score, rank) of the k largest inner products of (s1_id, v) with (candidate_id, v): exact.
    Vectors of other lengths, and those with a null in them, don't meet; nor do those of another `part`, if there is one."""
    keys = [part, "_size"] if part else ["_size"]
    own = lambda df, i: df.select(i, *keys[:-1], F.col("v").cast("array<double>").alias("v")).where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).withColumn("_size", F.size("v"))
    q, c, key = _dealt(own(queries, "s1_id"), own(candidates, "candidate_id"), keys, ("s1_id", "candidate_id"))
    got = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(_dense(k), "s1_id string, candidate_id string, score double")
    return top(got, k)


def first(df: DataFrame, n: int, key: str, by: Column, bits: int = 12) -> DataFrame:
    """The rows of df whose by (a long, 0 or more) is one of the n smallest of their key (and those that tie with the
    last). Histograms tell where the n-th lies, refined by so many bits at a time, so no task sorts a key's rows."""
    own = df.select(key, by.alias("_by"))
    sizes = own.groupBy(key).agg(F.count("*").alias("_n"), F.max("_by").alias("_most")).where(F.col("_n") > n)
    large = sizes.agg(F.max("_most")).first()[0]
    if large is None:  # no key has more
        return df
    shift = -(-max(int(large).bit_length(), 1) // bits) * bits
    at = sizes.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_prefix"), F.lit(n).cast("long").alias("_left"))
    while shift:
        near = own.join(at, (F.col(key) == F.col("_key")) & (F.shiftright("_by", shift) == F.col("_prefix")))
        shift -= bits
        hist = near.groupBy("_key", "_left", F.shiftright("_by", shift).alias("_b")).agg(F.count("*").alias("_n"))  # 2^bits rows a key at most
        upto = hist.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_key").orderBy("_b")))
        end = upto.where(F.col("_upto") >= F.col("_left")).groupBy("_key").agg(F.min_by(F.struct("_b", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left")), "_b").alias("_e"))
        at = end.select("_key", F.col("_e._b").alias("_prefix"), F.col("_e._left").alias("_left"))
    cut = at.select(F.col("_key").alias(key), F.col("_prefix").alias("_cut"))
    return df.join(cut, key, "left").where(F.col("_cut").isNull() | (by <= F.col("_cut"))).drop("_cut")

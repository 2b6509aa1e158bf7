"""Operator 1: nearest neighbours by inner product, with an inverted file of coarse centroids and
product-quantised residuals, asymmetric distance tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, shuffle_parts

#: Bounds of the fit: numbers (vectors times dimension) of the sample that trains the index, and lists. There are
#: DENSE times the square root of the vectors' number of them, so that they hold few vectors and prune more.
SAMPLE, LISTS, DENSE = 1 << 22, 16_384, 8
#: Dimensions of a subspace, and its codewords.
SUB, WORDS, ROUNDS = 4, 256, 8
#: Rows of a shard (some lists, or a part of a large one), least and most; queries that meet them in one call.
CHUNKS, QUERIES = (512, 8192), 128
#: Share of its neighbours in the sample that a sampled query must find in the lists it looks into (this tells
#: how many lists these are), how many such queries, and rows of a shard that a query reranks exactly.
FOUND, TRIED, RERANK = 0.93, 512, 100


@dataclass
class Index:
    centroids: np.ndarray
    books: np.ndarray  # subspace, codeword, SUB
    probes: int

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.books.shape[0] * SUB - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list, and its residual's codes."""
        at = nearest(x, self.centroids)
        r = self.pad(x - self.centroids[at])
        return at, np.stack([nearest(r[:, SUB * s : SUB * s + SUB], b) for s, b in enumerate(self.books)], 1).astype(np.uint8)

    def looks(self, q: np.ndarray) -> np.ndarray:
        """Which lists each query looks into: those whose centroids have the largest inner products with it."""
        near = q @ self.centroids.T
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, np.argsort(-near, axis=1, kind="stable")[:, : self.probes], True, 1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with every codeword: query, subspace, codeword."""
        p = self.pad(q).reshape(len(q), -1, SUB)
        return np.einsum("qsd,swd->qsw", p, self.books)


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    half = (to**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ to.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from distinct rows; an empty cluster takes a random row."""
    own = np.unique(x, axis=0)
    c = own[rng.permutation(len(own))[:k]].copy()
    for _ in range(rounds if len(own) > k else 0):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c, dtype=np.float64)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))]).astype(np.float32)
    return c


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, rng: np.random.Generator) -> int:
    """How many lists a query must look into, by inner product with their centroids, to find FOUND of its k nearest
    in the sample. The sample's neighbours are farther than those among all vectors, so this errs on the safe side."""
    tried = rng.permutation(len(sample))[:TRIED]
    at, q = nearest(sample, centroids), sample[tried]
    near = q @ sample.T
    near[np.arange(len(q)), tried] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centroids)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ centroids.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None], 1)
    needed = np.sort(np.take_along_axis(rank, at[top], 1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(FOUND * len(needed)))]) + 1


def fit(sample: np.ndarray, total: int, lists: int | None = None, k: int = 20, seed: int = 7) -> Index:
    """An index trained on sample, for about total distinct vectors and queries for k neighbours."""
    rng = np.random.default_rng(seed)
    n = max(1, min(lists or min(LISTS, round(DENSE * total**0.5)), len(sample) // 2))
    c = kmeans(sample, n, rng)
    index = Index(c, np.zeros((-(-sample.shape[1] // SUB), 1, SUB), np.float32), probes_for(sample, c, k, rng))
    r = index.pad(sample - c[nearest(sample, c)])
    books = [kmeans(r[:, SUB * s : SUB * s + SUB], WORDS, rng) for s in range(r.shape[1] // SUB)]
    most = max(map(len, books))
    index.books = np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), 0)]) for b in books]).astype(np.float32)
    return index


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)


def _encoded(index: Index, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, codes = index.encode(_vectors(b.column(1), dim))
                yield pa.record_batch([pa.array(at.astype(np.int32)), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "ids", "v", "code"])

    return run


def _asking(index: Index, dim: int, first: np.ndarray, chunks: np.ndarray):
    """Each query and the shards that hold the lists it looks into."""
    lists = np.repeat(np.arange(len(first)), chunks)
    shard = np.repeat(first, chunks) + np.arange(len(lists)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    order = np.argsort(shard, kind="stable")
    names, starts = np.unique(shard[order], return_index=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                on = np.logical_or.reduceat(index.looks(_vectors(b.column(1), dim))[:, lists[order]], starts, axis=1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array([names[x].astype(np.int32) for x in on], pa.list_(pa.int32()))], ["q", "v", "shards"])

    return run


def _search(index: Index, dim: int, keep: int, rerank: int):
    """Shard after shard: its rows come first and are held, then the queries that ask it, a batch at a time."""

    def held(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids = rows.column("ids").chunk(0)
        order = np.argsort([i[0] for i in ids.to_pylist()], kind="stable")  # ties go to the smaller id
        v = np.asarray(rows.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(order), -1)
        return v[order], ids.take(pa.array(order)), rows.column("list").to_numpy()[order], codes[order]

    def found(own, queries: pa.RecordBatch) -> pa.RecordBatch:
        x, ids, at, codes = own
        names = queries.column(1).to_pylist()
        q = np.asarray(queries.column(4).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        single = q.astype(np.float32)
        near, t = (single @ index.centroids.T)[:, at], index.tables(single)
        for s in range(codes.shape[1]):
            near += t[:, s][:, codes[:, s]]
        near[~index.looks(single)[:, at]] = -np.inf
        n = min(rerank, near.shape[1])
        top = np.sort(np.argpartition(-near, n - 1, axis=1)[:, :n], axis=1)
        exact = np.stack([(x[rows_of] * q[j]).sum(1) for j, rows_of in enumerate(top)])
        exact[np.isneginf(np.take_along_axis(near, top, 1))] = -np.inf
        out = []
        for j, o in enumerate(np.argsort(-exact, axis=1, kind="stable")[:, :keep]):
            o = o[np.isfinite(exact[j, o])]
            out.append((names[j], exact[j, o], ids.take(pa.array(top[j, o])).to_pylist()))
        return pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.float64())), pa.array([o[2] for o in out], pa.list_(pa.list_(pa.int64())))], ["q", "scores", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, own = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            s, asks = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((s[1:] != s[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, e in zip([0, *cut], [*cut, len(s)]):
                if s[a] != shard:
                    shard, parts, own = s[a], [], None
                if not asks[a]:
                    parts.append(b.slice(a, e - a))
                elif parts:
                    own = own or held(parts)
                    for i in range(a, e, QUERIES):
                        yield found(own, b.slice(i, min(QUERIES, e - i)))

    return run


def shards(sizes: dict[int, int], lists: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Each list's first shard and how many it has: small lists share one, large ones are dealt out."""
    first, chunks, held, k = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
    for i in range(lists):
        n = sizes.get(i, 0)
        if held and held + n > chunk:
            k, held = k + 1, 0
        first[i], chunks[i] = k, max(1, -(-n // chunk))
        if chunks[i] > 1:
            k, held = k + int(chunks[i]), 0
        else:
            held += n
    return first, chunks


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: without vectors that are null, empty or zero or hold null or non-finite numbers."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, every: int = 20, k: int = 20, lists: int | None = None, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by
    `every`, among all other rows of vectors (vec_id, embedding; more columns are ignored).

    Unusable vectors (see usable()) and null ids take no part; where dimensions differ, only the
    commonest one does. Rows equal in id and vector count once. Equal vectors are indexed once, with
    their k + 1 smallest ids: no other copy can be among k nearest, so a vector that a third of the rows
    share costs as much as any other. An empty table gives no rows."""
    spark = vectors.sparkSession
    own = usable(vectors)
    dims = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return own.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim = dims.d
    own = materialize(own.where(F.size("v") == dim).groupBy("v", "vec_id").agg(F.lit(1).alias("one")).select("vec_id", "v"), "op1-own")
    order = Window.partitionBy("v").orderBy("vec_id")
    one = materialize(own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "v"), "op1-distinct")
    total = one.count()
    share = min(1.0, SAMPLE / dim / total)
    sample = one.where(F.pmod(F.xxhash64(F.lit("ann"), F.get("ids", F.lit(0))), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").toArrow().column(0).combine_chunks()
    index = fit(_vectors(sample, dim), total, lists, k)
    if probes:
        index.probes = min(probes, len(index.centroids))
    listed = materialize(one.mapInArrow(_encoded(index, dim), "list int, ids array<long>, v array<double>, code binary"), "op1-index")
    asked = own.where(F.col("vec_id") % every == 0)
    query = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("q")).select("q", "v"), "op1-queries")
    # a row a list, so LISTS at most
    chunk = min(max(total // (2 * shuffle_parts(spark)), CHUNKS[0]), CHUNKS[1])
    first, chunks = shards({r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}, len(index.centroids), chunk)
    known = spark.createDataFrame([(i, int(first[i]), int(chunks[i])) for i in range(len(first))], "list int, first int, chunks int")
    where = (F.col("first") + F.pmod(F.xxhash64(F.get("ids", F.lit(0))), "chunks")).cast("int").alias("shard")
    rows = listed.join(F.broadcast(known), "list").select(where, F.lit(None).cast("long").alias("q"), "list", "ids", "v", "code")
    wanted = query.mapInArrow(_asking(index, dim, first, chunks), "q long, v array<double>, shards array<int>").select(F.explode("shards").alias("shard"), "q", F.lit(None).cast("int").alias("list"), F.lit(None).cast("array<long>").alias("ids"), "v", F.lit(None).cast("binary").alias("code"))
    tasks = int((first + chunks).max())
    tasks = min(tasks, max(4 * shuffle_parts(spark), 1))
    met = rows.unionByName(wanted).repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", F.col("q").asc_nulls_first())
    got = met.mapInArrow(_search(index, dim, k + 1, rerank), "q long, scores array<double>, ids array<array<long>>")
    near = got.select("q", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("q", F.col("x.scores").alias("score"), F.col("x.ids").alias("ids"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    near = near.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id")))
    best = near.select("q", F.explode(each).alias("x")).groupBy("q").agg(F.slice(F.sort_array(F.collect_list("x")), 1, k + 1).alias("best"))
    rows_of = asked.join(query.withColumnRenamed("v", "u"), F.col("v") == F.col("u")).select("vec_id", "q")
    out = rows_of.join(best, "q").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("best"))
    return out.select("query_id", F.posexplode("best").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))

"""Text vectors by a pluggable encoder, and an index of them: exact, or an inverted file for larger sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import dense

#: Texts to vectors: a list of strings to a matrix of a row for each.
Encoder = Callable[[list[str]], np.ndarray]
#: What a blank text is encoded as.
EMPTY = "<empty>"
FIELDS = ("name", "address", "record")
#: Bound of the sample that an index is trained on, and its seed.
SAMPLE, SEED = 100_000, 42


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def encode(rows: DataFrame, texts: dict[str, Column], encoder: Encoder | None) -> DataFrame:
    """entity_id of rows, and for each name of texts its column's vector of unit length (a zero vector stays). Blank and
    null texts are EMPTY. Each distinct text of a batch is encoded once."""
    if encoder is None:
        raise ValueError("dense vectors need an encoder")
    own = rows.select("entity_id", *(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", EMPTY).otherwise(c).alias(n) for n, c in texts.items()))
    names = list(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b.column(0)]
            for i in range(len(names)):
                d = b.column(i + 1).dictionary_encode()
                x = _unit(np.asarray(encoder(d.dictionary.to_pylist()), np.float64)) if len(d.dictionary) else np.empty((0, 1))
                own = x[d.indices.to_numpy()] if len(d) else x
                out.append(pa.array(list(own), pa.list_(pa.float64())))
            yield pa.record_batch(out, ["entity_id", *names])

    return own.mapInArrow(run, "entity_id string, " + ", ".join(f"{n} array<double>" for n in names))


def record_vectors(records: DataFrame, encoder: Encoder | None) -> DataFrame:
    """(entity_id, name_vec, address_vec, record_vec) of normalised records."""
    return encode(records, {"name_vec": F.col("name"), "address_vec": F.col("address"), "record_vec": F.col("record_text")}, encoder)


def select(training: int, total: int, lists: int = 4096, bits: int = 8) -> tuple[str, int]:
    """The kind of index, and its number of lists: `ivfpq` from max(256, 2^bits) training vectors on, `ivfflat` from 100
    on, else `flat`; lists: at most `lists` and about the square root of all vectors, no more than a 39th of the training
    vectors, one at least."""
    own = max(1, min(lists, max(32, int(total**0.5)), training // 39))
    if training >= max(256, 2**bits):
        return "ivfpq", own
    return ("ivfflat", own) if training >= 100 else ("flat", 1)


@dataclass(frozen=True)
class Index:
    """An index of (candidate_id, v). Both kinds of inverted files keep whole vectors here, so scores are exact; only the
    choice of lists is approximate. probes: lists that a query looks into."""

    kind: str
    centroids: np.ndarray | None
    probes: int
    rows: DataFrame | None = None

    def _listed(self, df: DataFrame, most: int) -> DataFrame:
        """df with part: the nearest lists of v (most of them), by inner product."""
        if self.centroids is None:
            return df.withColumn("part", F.lit(0))
        centroids = self.centroids

        @F.pandas_udf("array<int>")
        def near(v):
            score = np.stack(v.to_numpy()) @ centroids.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :most]
            return pd.Series(list(order.astype(np.int32)))

        return df.withColumn("part", F.explode(near("v")))

    def add(self, vectors: DataFrame) -> "Index":
        """The index with further vectors (candidate_id, v)."""
        own = self._listed(vectors.select("candidate_id", F.col("v").cast("array<double>").alias("v")), 1)
        return replace(self, rows=own if self.rows is None else self.rows.unionByName(own))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(s1_id, candidate_id, score, rank): the k largest inner products found for each of queries (s1_id, v)."""
        if self.rows is None:
            raise ValueError("the index has no vectors")
        asked = self._listed(queries.select("s1_id", F.col("v").cast("array<double>").alias("v")), self.probes)
        return dense(asked, self.rows, k, "part")


def train(vectors: DataFrame, total: int | None = None, lists: int = 4096, bits: int = 8, probes: int = 32, sample: int = SAMPLE) -> Index:
    """An empty index for (candidate_id, v), its lists trained on a sample of at most about `sample` of them (a hash of the id
    picks them). total: how many vectors it is for, if not these."""
    n = vectors.count()
    some = vectors.where(F.pmod(F.xxhash64(F.lit(SEED), "candidate_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1)
    kind, own = select(min(n, sample), total or n, lists, bits)
    if kind == "flat":
        return Index(kind, None, 1)
    x = some.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=own, maxIter=10, seed=SEED).fit(x)
    centers = np.array(model.clusterCenters())
    return Index(kind, centers, min(probes, len(centers)))

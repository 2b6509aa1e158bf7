"""Operator 10: mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import materialize

#: Weights of the sources in order of their names, repeating; the mix as a share of all words.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Hash bits that a histogram refines at a time, and how many times.
BITS, LEVELS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources the thresholds are sent to all executors (under 100 bytes each).
SENT = 100_000


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take from each source (in order): its weight's part of share times all words,
    at most `most` times its size; what is above goes to the others by weight, until none is above."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        part = {i: left * weights[i % len(weights)] / total for i in open_}
        full = [i for i in open_ if part[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else part[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def _sized(docs: DataFrame) -> DataFrame:
    """Adds _size (words) and _hash (60 bits, of doc_id and text, so that reruns agree)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "_hash": F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id"), text), 64 - BITS * LEVELS)})


def thresholds(sized: DataFrame) -> DataFrame:
    """(_key, source_size, target, whole, below) of each source: `whole` copies of all its
    documents and one more of those whose _hash is under `below`. sized: source, _size, _hash.

    A histogram of words by source and hash bucket tells in which bucket the rest of the budget
    ends; only that bucket's documents are dealt out again by the next bits. One row a source
    comes to the driver."""
    spark = sized.sparkSession
    rows = sorted(sized.groupBy("source").agg(F.sum("_size").alias("n")).collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r.n for r in rows])
    own = [(r.source, r.n, t, int(t // r.n) if r.n else 0) for r, t in zip(rows, goal)]
    schema = T.StructType([T.StructField(n, t) for n, t in (("_key", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("whole", T.LongType()), ("rest", T.DoubleType()), ("prefix", T.LongType()))])
    at = spark.createDataFrame([(s, n, t, k, t - k * n, 0) for s, n, t, k in own], schema)
    small = F.broadcast if len(own) <= SENT else (lambda x: x)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        bucket = F.shiftright("_hash", shift)
        near = sized.join(small(at), F.col("source").eqNullSafe(F.col("_key")) & (F.shiftright("_hash", shift + BITS) == F.col("prefix")))
        # no more buckets than 2^BITS a source, whatever the number of documents
        hist = near.groupBy(F.col("_key").alias("k"), bucket.alias("b")).agg(F.sum("_size").alias("n"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("b"))
        ends = hist.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("k").agg(F.min_by(F.struct("b", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"), "n"), "b").alias("e"))
        at = materialize(
            at.join(ends, F.col("_key").eqNullSafe(F.col("k")), "left").select(
                "_key", "source_size", "target", "whole", F.coalesce("e.left", F.lit(0.0)).alias("rest"),
                # the last bucket is one hash: it goes in if that brings the words nearer to the target
                F.coalesce(F.col("e.b") + (F.when(F.col("e.left") * 2 > F.col("e.n"), 1).otherwise(0) if level == LEVELS - 1 else 0), F.shiftleft("prefix", BITS)).cast("long").alias("prefix"),
            ),
            f"op10-{level}",
        )
    out = at.select("_key", "source_size", "target", "whole", F.col("prefix").alias("below"))
    return small(out)


def _copies():
    return F.col("whole") + (F.col("_hash") < F.col("below")).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, text, source; more
    columns are ignored). Null texts have no words; a null source is a source of its own, the last.
    A document is taken 0, 1 or 2 times, whole; equal rows (doc_id and text) share one hash and so
    are taken alike. An empty table gives no rows."""
    sized = materialize(_sized(docs.select("doc_id", "text", "source")).drop("text"), "op10-sized")
    return sized.join(thresholds(sized), F.col("source").eqNullSafe(F.col("_key"))).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _copies()).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with docs' own columns.
    Documents without words have size 0 and go along once where their source has any copy."""
    names = docs.columns
    base = docs.select("doc_id", "text", "source")
    sized = materialize(_sized(base).drop("text"), "op10-sized")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), "doc_id", "text", "source")
    out = _sized(held).join(thresholds(sized), F.col("source").eqNullSafe(F.col("_key"))).withColumn("_copy", F.explode(F.expr("sequence(1L, 2L)"))).where(F.col("_copy") <= _copies())
    return out.select("_row.*")

"""Operator 2: bottom-k sketches of shingle hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import shuffle_parts

#: Words of a shingle, hashes a sketch keeps, and the most ranges of doc_id that neighbours are sought in.
SHINGLE, K, RANGES = 5, 128, 4096
_SPACE = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _SPACE, " " * len(_SPACE)), " "), "")


def sketch(w: Column, k: int = K) -> Column:
    """The k least 32-bit hashes of w's shingles, ascending; a text of fewer words is one shingle,
    an empty text none. w must be a plain column: the lambda refers to it for each shingle."""
    n = F.size(w)
    # the words past the end are null, and a null adds nothing to the hash
    one = lambda i: F.shiftright(F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))), 32).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), one)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, k))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of shingles that both have, of those that either has; two empty sketches: 1."""
    u = merged(a, b, k)
    return F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))


def shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << 32)) / (F.element_at(a, -1).cast("double") + float(1 << 31) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; of an empty a: 1."""
    both = resemblance(a, b, k) * shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / shingles(a, k)))


def shown(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


def parse(text: Column) -> Column:
    """A sketch from its text."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.split(text, ",").cast("array<int>"))


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """docs (doc_id, text; more columns are ignored) with text (null: empty) and its sketch fp."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("w", words(F.col("text"))).withColumn("fp", sketch(F.col("w"), k)).drop("w")


def with_next(rows: DataFrame) -> DataFrame:
    """Adds nxt (text, fp) of the row that follows by descending doc_id (nulls last, then by text);
    after the last comes the first. Texts move once, to ranges of doc_id of about equal size; the
    first row of each range is also sent to the range before it, where it follows the last row."""
    spark = rows.sparkSession
    ranges = min(RANGES, 4 * shuffle_parts(spark))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first().c
    cuts = sorted(set(cuts or []))
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col("doc_id"))))
    tagged = rows.withColumn("part", part.cast("int"))
    heads = sorted(tagged.groupBy("part").agg(F.max("doc_id").alias("head")).collect(), reverse=True)  # a row for each range
    if not heads:
        return rows.withColumn("nxt", F.struct("text", "fp"))
    before = {r.part: heads[i - 1].part for i, r in enumerate(heads)}
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("head", T.LongType()), T.StructField("before", T.IntegerType())])
    known = F.broadcast(spark.createDataFrame([(r.part, r.head, before[r.part]) for r in heads], schema))
    # also: whether the row is there only to follow the range's last row
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("also"))
    there = F.struct(F.col("before").alias("part"), F.lit(True).alias("also"))
    sent = tagged.join(known, "part").withColumn("at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, there)).otherwise(F.array(own))))
    sent = sent.select("doc_id", "text", "fp", "at.part", "at.also")
    order = Window.partitionBy("part").orderBy("also", F.col("doc_id").desc_nulls_last(), "text")
    return sent.withColumn("nxt", F.lead(F.struct("text", "fp")).over(order)).where(~F.col("also")).drop("part", "also")


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    n_shingles (estimated) of each row of docs. The edited text has the last floor(n_chars / 2) code
    points replaced by the first as many of the next document. A single document follows itself;
    an empty table gives no rows."""
    x = with_next(sketches(docs, k)).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    x = x.withColumn("new", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("nxt.text", F.lit(1), half)))
    x = x.select("doc_id", "n_chars", F.sha2(F.col("new").cast("binary"), 256).alias("edited_sha256"), "fp", F.col("nxt.fp").alias("fp_next"), words(F.col("new")).alias("w"))
    x = x.withColumn("fp_new", sketch(F.col("w"), k)).drop("w")
    return x.select("doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("fp_new")).alias("edited_fingerprint"), resemblance(F.col("fp"), F.col("fp_new"), k).alias("near_edited"), resemblance(F.col("fp"), F.col("fp_next"), k).alias("near_next"), shingles(F.col("fp"), k).alias("n_shingles"))

"""Operator 4: SimHash near-duplicates, found in a grid of per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import materialize, spread
from .components import components
from .wordblocks import trim

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Bits of a segment, of the grid and of those that refine its crowded cells: a cell is a count of ones by segment.
WIDTHS = (4, 2, 1)
#: Fingerprints in a cell up to which its pairs are verified one by one; the others meet in the next finer grid.
CROWD = 32


def fingerprint(text: bytes) -> int:
    w = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII white-space characters
    n = len(w)
    if not n:
        return 0
    digest, last = xxhash.xxh64_intdigest, max(1, n - SHINGLE + 1)
    h = np.fromiter((digest(b" ".join(w[i : i + SHINGLE]), SEED) for i in range(last)), np.uint64, last)
    on = np.zeros(64, np.int64)
    for i in range(0, last, 1 << 16):
        on += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * on > last, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([fingerprint(x.as_py() or b"") for x in b.column(1)], pa.int64())], ["doc_id", "fp"])
    trim()


def _celled(fps: DataFrame, width: int) -> DataFrame:
    """(fp, cell): each fingerprint's cell and those one step away, as numbers of 64 bits. Bits that differ in d places move
    the bit counts by a Manhattan distance of d at most, so fingerprints within 2 bits are at most 2 steps
    apart, and the cells one step around either share one. With segments of one bit a count is the bit, and
    the distance is that of the fingerprints."""
    bits, segments = width.bit_length(), 64 // width  # counts are 0 to width
    each = segments if bits == 1 else 16  # segments a number
    count = f"bit_count(shiftrightunsigned(fp, {width} * i) & {2**width - 1}L)"
    at = f"{bits} * (i % {each})"
    numbers = range(segments // each)
    own = fps.select("fp", *(F.expr(f"aggregate(sequence({j * each}, {j * each + each - 1}), 0L, (a, i) -> a | shiftleft(cast({count} AS BIGINT), {at}))").alias(f"o{j}") for j in numbers))
    cell = lambda f: "named_struct(" + ", ".join(f"'c{j}', {f(j)}" for j in numbers) + ")"
    moved = lambda step: cell(lambda j: f"if(i div {each} = {j}, o{j} ^ shiftleft(cast({count} ^ ({count} {step}) AS BIGINT), {at}), o{j})")
    near = [f"transform(filter(sequence(0, {segments - 1}), i -> {count} {ok}), i -> {moved(step)})" for ok, step in ((f"< {width}", "+ 1"), ("> 0", "- 1"))]
    return own.select("fp", F.explode(F.expr(f"concat(array({cell(lambda j: f'o{j}')}), {', '.join(near)})")).alias("cell"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of fps' distinct fingerprints at 2 or fewer bits, enough of them that
    every such pair is connected. Pairs that share a cell are verified; those of a crowded cell meet again in
    a finer grid, whose Manhattan distances are closer to the bits'. In the finest the members of a cell
    are within one bit of it, so they are linked to the least of them, and no pairs are made."""
    found, members = [], fps.select("fp")
    for width in WIDTHS:
        placed = _celled(members, width)
        if width == 1:
            least = placed.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
            found.append(placed.join(spread(least), "cell").where("a < fp").select("a", F.col("fp").alias("b")))
            break
        shared = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        near = materialize(placed.join(spread(shared), "cell"), f"op4-cells{width}")
        few = near.where(F.col("n") <= CROWD)
        a, b = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
        found.append(a.join(spread(b), (a["cell"] == b["cell"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)).select("a", "b"))
        members = near.where(F.col("n") > CROWD).select("fp").distinct()
    return reduce(DataFrame.unionByName, found).distinct()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(_fingerprints, "doc_id long, fp long")


def classes(own: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each fingerprint of own (doc_id, fp): root is the
    same for all fingerprints of a component, component_id the smallest doc_id of its rows."""
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "op4-distinct")
    roots = materialize(components(links(fps)), "op4-roots")
    named = roots.join(spread(fps), roots["node"] == fps["fp"]).select("node", "root", "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = named.join(spread(ids), "root").select(F.col("node").alias("fp"), "root", "component_id")
    to = fps.join(spread(moved), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return materialize(to, "op4-classes")  # read plainly by the joins, so that Spark can split a hot fingerprint


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs (doc_id, text; more
    columns are ignored). Null and empty texts, and texts without words, have fingerprint zero
    and are linked like any other. Repeated rows fall together; the smallest doc_id of those that
    aren't null names a component; a null one if all are null. An empty table gives none, and a text may be
    as long as a binary value can be. Only distinct fingerprints are compared, so copies, however many,
    cost nothing beyond their own fingerprint."""
    own = materialize(fingerprints(docs), "op4-fp")
    return own.join(spread(classes(own)), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([fingerprint((x.as_py() or "").encode()) for x in b.column(0).field("text")], pa.int64())], ["_row", "fp"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with docs' own columns: one with the smallest doc_id (a null
    one only if all are; of rows equal in id and fingerprint, one by a hash of the row). Null, empty and very long
    texts are as in near_duplicates(); an empty table gives no rows."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    rows = held.mapInArrow(_carried, T.StructType([held.schema["_row"], T.StructField("fp", T.LongType())]))
    rows = materialize(rows.withColumn("doc_id", F.col("_row.doc_id").cast("long")), "op4-rows")
    own = rows.select("doc_id", "fp")
    first = own.join(spread(classes(own)), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("m")).select(F.col("m.doc_id").alias("id"), F.col("m.fp").alias("own"))
    kept = rows.join(spread(first), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("own")), "left_semi")
    once = Window.partitionBy("doc_id", "fp").orderBy(F.xxhash64("_row"))
    return kept.withColumn("n", F.row_number().over(once)).where("n = 1").select("_row.*")

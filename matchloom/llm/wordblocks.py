"""A global distinct-word exchange for whole texts.

Documents are read once, in blocks of bounded size. A block keeps its documents packed, as ordinals
of its distinct pieces (in order of position, or with their frequencies), and sends each distinct
piece once, hashed into buckets. A bucket sees a piece from every block that has it, so it computes
the piece's value (token ids, a count) exactly once for the whole corpus and sends it back to those
blocks, where the documents are put together again. A frequent piece is one entry a block however
often it occurs, so no key is hot; nothing that grows with the corpus is broadcast or collected.

A bucket holds the pieces of about BUCKET_BYTES of input, so there are more of them the larger the
input is; a task gets its buckets sorted and holds one at a time. Blocks and buckets are dealt out by
number, so tasks get equal shares. Both kinds of rows are written to the shared folder once, so that a
retried task can't number the pieces of a block differently from what the buckets saw.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialize_by, shuffle_parts

#: Bytes of text after which a block is closed, and after which its documents are packed.
BLOCK_BYTES, PACK_BYTES = 24 << 20, 2 << 20
#: Bytes of input for each bucket, and for each task that puts documents together.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 16 << 20
#: Bits of a number that is sent as a piece (a hash): the buckets share them out in ranges.
NUMBER_BITS = 48
#: Numbers of a bucket that are merged at a time.
MERGED = 1 << 19
#: Kinds of rows: packed documents, pieces for a bucket, what a block tells of itself when its documents are put
#: together, and what it adds to the corpus' sums.
DOCS, PIECES, TOLD, ADDED = 0, 1, 2, 3

#: values(pieces, counts): how many numbers each piece has, and these numbers in one array.
Values = Callable[[list, np.ndarray], tuple[np.ndarray, np.ndarray]]


def trim() -> None:
    """Give memory that is no longer used back to the system: a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def pack(obj) -> bytes:
    return zstandard.compress(pickle.dumps(obj, protocol=5), 3)


def unpack(data: bytes):
    return pickle.loads(zstandard.decompress(data))


def planes(a: np.ndarray) -> np.ndarray:
    """The bytes of unsigned 32-bit numbers by place, which compress better than mixed."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unplanes(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p.T).view("<u4").reshape(-1)


def spread(a: np.ndarray) -> np.ndarray:
    """As planes(), of ascending unsigned 64-bit numbers, as their differences."""
    return np.ascontiguousarray(np.diff(a, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unspread(p: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(p.T).view("<u8").reshape(-1), dtype=np.uint64)


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a, ascending, and how many of each."""
    a = np.sort(a)
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
    return a[first], np.diff(np.append(first, len(a)))


class Places:
    """Where numbers of NUMBER_BITS, evenly spread, lie among ascending ones that hold them all."""

    def __init__(self, among: np.ndarray) -> None:
        self.among, self.shift = among, np.uint64(max(NUMBER_BITS - max(len(among), 1).bit_length(), 0))
        starts = np.bincount((among >> self.shift).astype(np.int64), minlength=(1 << NUMBER_BITS >> int(self.shift)) + 1)
        self.starts = np.cumsum(starts) - starts

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        out = self.starts[(numbers >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.among[out] != numbers)
        while len(left):  # a few have others before them
            out[left] += 1
            left = left[self.among[out[left]] != numbers[left]]
        return out


def ragged(offsets: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices into flat values of the given rows, one after the other."""
    n = lens[rows]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(offsets[rows] - (ends - n), n)


def sums(per_word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    total = np.concatenate([np.zeros(1, per_word.dtype), np.cumsum(per_word)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def numbered() -> defaultdict:
    """A dictionary that numbers its keys as they are first asked for."""
    d: defaultdict = defaultdict()
    d.default_factory = d.__len__
    return d


def _murmur(key: int) -> int:
    """Spark's hash of a long column (Murmur3, 32 bits, seed 42), unsigned."""
    m = 0xFFFFFFFF
    h = 42
    for k in (key & m, (key >> 32) & m):
        k = k * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * 0x1B873593 & m
        h = (h << 13 | h >> 19) & m
        h = (h * 5 + 0xE6546B64) & m
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def slot(key: int, parts: int) -> int:
    h = _murmur(key)
    return (h - (1 << 32) if h >> 31 else h) % parts


def block_key(partition: int, nth: int, parts: int) -> int:
    """The number of a task's nth block: such that the blocks of all tasks fall into the parts in turn."""
    want = (partition + nth * (parts * 3 // 8 | 1)) % parts
    at = ((partition << 24) + nth) << 16
    return next(k for k in range(at, at + (1 << 16)) if slot(k, parts) == want) if parts < 1 << 12 else at


class Block:
    """Documents of one block. Subclasses cut a text into words, and say what is kept of a pack of documents,
    what pieces are sent, and what is told."""

    def __init__(self) -> None:
        self.words, self.bytes = numbered(), 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.marks, self.sizes, self.lens, self.seqs, self.open = [], [], [], [], [], 0

    def cut(self, text: bytes) -> list:
        raise NotImplementedError

    def add(self, doc_id, mark, text: bytes) -> None:
        words = self.cut(text)
        self.seqs.append(np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words)))
        self.ids.append(doc_id)
        self.marks.append(mark)
        self.sizes.append(len(text))
        self.lens.append(len(words))
        self.bytes += len(text) + 64
        self.open += len(text) + 64

    def head(self) -> tuple:
        return self.ids, np.array(self.marks, np.int8), np.array(self.sizes, np.int64)

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """Words a document, and the word ordinals of the open documents."""
        return np.array(self.lens, np.int64), np.concatenate(self.seqs).astype(np.int64) if self.seqs else np.empty(0, np.int64)

    def packed(self):
        raise NotImplementedError

    def pieces(self) -> tuple[list, np.ndarray]:
        """The pieces by ordinal, and their counts."""
        raise NotImplementedError

    def numbers(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Further pieces, which are distinct ascending numbers of NUMBER_BITS, and their counts; their values are the
        corpus' counts."""

    def told(self):
        """What goes into the block's row of kind TOLD; None for no such row."""

    def added(self):
        """What goes into the block's row of kind ADDED; None for no such row."""

    def docs(self) -> tuple:
        row = (DOCS, -1, pack(self.packed()))
        self.clear()
        return row

    def rows(self, buckets: int) -> Iterator[tuple]:
        if self.ids:
            yield self.docs()
        pieces, counts = self.pieces()
        place = np.fromiter(map(zlib.crc32, pieces), np.uint32, len(pieces)) % np.uint32(buckets)
        order = np.argsort(place.astype(np.uint16) if buckets <= 1 << 16 else place, kind="stable")
        pieces = [pieces[i] for i in order.tolist()]
        ends = np.searchsorted(place[order], np.arange(buckets + 1))
        numbers, n = self.numbers() or (np.empty(0, np.uint64), np.empty(0, np.int64))
        edges = np.searchsorted(numbers, np.array([(b << NUMBER_BITS) // buckets for b in range(buckets)] + [1 << 63], np.uint64))
        for b in range(buckets):
            own, k = slice(edges[b], edges[b + 1]), order[ends[b] : ends[b + 1]]
            if len(k) or own.start < own.stop:
                yield PIECES, b, pack((planes(np.diff(k, prepend=0)), pieces[ends[b] : ends[b + 1]], counts[k], spread(numbers[own]), n[own].astype(np.uint32)))
        if (told := self.told()) is not None:
            yield TOLD, -1, pack(told)
        if (added := self.added()) is not None:
            yield ADDED, -1, pack(added)


class Cut(Block):
    """Words that are cut further into pieces, each distinct word of the block once."""

    def __init__(self) -> None:
        super().__init__()
        self.items, self.done = numbered(), 0
        self.cut_lens, self.cut_flat = np.empty(0, np.int64), np.empty(0, np.int64)

    def parts(self, words: list[bytes]) -> list[list[bytes]]:
        raise NotImplementedError

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """Pieces a document, and the piece ordinals of the open documents by position."""
        fresh = list(itertools.islice(self.words, self.done, None))
        self.done = len(self.words)
        cut = self.parts(fresh)
        lens = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(map(self.items.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(lens.sum()))
        self.cut_lens, self.cut_flat = np.concatenate([self.cut_lens, lens]), np.concatenate([self.cut_flat, flat])
        per, seq = self.sequence()
        offsets = np.cumsum(self.cut_lens) - self.cut_lens
        return sums(self.cut_lens[seq], per), self.cut_flat[ragged(offsets, self.cut_lens, seq)]

    def pieces(self) -> tuple[list, np.ndarray]:
        return list(self.items), np.zeros(len(self.items), np.int64)


class Positions(Cut):
    """Keeps each document's pieces by position."""

    def packed(self):
        n, at = self.positions()
        return *self.head(), n, planes(at)


class Frequencies(Cut):
    """Keeps each document's distinct pieces with their frequencies."""

    def packed(self):
        n, at = self.positions()
        size = max(len(self.items), 1)
        keys, freq = distinct(np.repeat(np.arange(len(n)), n) * size + at)
        doc = keys // size
        new = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.empty(0, bool)
        step = np.where(new, keys % size, np.diff(keys, prepend=0))  # a document's ordinals ascend
        return *self.head(), np.bincount(doc, minlength=len(n)), planes(step), planes(freq)


_NAMES = ["block", "kind", "bucket", "payload"]


def _batch(key: int, row: tuple) -> pa.RecordBatch:
    return pa.record_batch([pa.array([key], pa.int64()), pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary())], _NAMES)


def _split(make: Callable[[], Block], buckets: int, parts: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        partition, nth = task.partitionId() if task else 0, 0
        block, key = make(), block_key(partition, 0, parts)
        for batch in batches:
            ids, texts, marks = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for i in range(batch.num_rows):  # one text at a time: a batch of long texts isn't copied whole
                block.add(ids[i].as_py(), marks[i], texts[i].as_py() or b"")
                if block.open >= PACK_BYTES:
                    yield _batch(key, block.docs())
                if block.bytes >= most:
                    yield from (_batch(key, r) for r in block.rows(buckets))
                    nth += 1
                    block, key = make(), block_key(partition, nth, parts)
        if block.bytes:
            yield from (_batch(key, r) for r in block.rows(buckets))
        del block
        trim()

    return run


def totals(numbers: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each array of ascending numbers, how much is counted of each number in all of them; a range of about MERGED at a time."""
    out = [np.zeros(len(x), np.int64) for x in numbers]
    some = [x for x in numbers if len(x)]
    if not some:
        return out
    low, high = min(int(x[0]) for x in some), max(int(x[-1]) for x in some) + 1
    steps = -(-sum(map(len, some)) // MERGED)
    edges = [np.searchsorted(x, np.array([low + (high - low) * k // steps for k in range(steps + 1)], np.uint64)) for x in numbers]
    for k in range(steps):
        own = [slice(e[k], e[k + 1]) for e in edges]
        order = np.argsort(keys := np.concatenate([x[s] for x, s in zip(numbers, own)]))
        keys = keys[order]
        group = np.cumsum(np.append(False, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        at = np.empty(len(keys), np.int64)
        at[order] = group
        total = np.bincount(at, np.concatenate([c[s] for c, s in zip(counts, own)]))[at].astype(np.int64)
        start = 0
        for o, s in zip(out, own):
            o[s] = total[start : start + s.stop - s.start]
            start += s.stop - s.start
    return out


def _value(values: Values, told=None):
    def bucket(rows: list[tuple[int, bytes]], place: int) -> Iterator[pa.RecordBatch]:
        index, total, places, numbers, many = numbered(), np.zeros(1024, np.int64), [], [], []
        for _, data in rows:
            _, pieces, counts, own, n = unpack(data)
            numbers.append(unspread(own))
            many.append(n)
            at = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
            if len(index) > len(total):
                total = np.concatenate([total, np.zeros(max(len(total), len(index)), np.int64)])
            total[at] += counts  # a block has a piece once
            places.append(at)
        total = total[: len(index)]
        pieces = list(index)
        lens, flat = values(pieces, total)
        offsets = np.cumsum(lens) - lens
        if told:
            yield pa.record_batch([pa.array([-1], pa.int64()), pa.array([pack(told(pieces, total))], pa.binary())], ["block", "payload"])
        many = totals(numbers, many)
        del numbers
        for (block, data), at, n in zip(rows, places, many):
            value = pack((unpack(data)[0], lens[at].astype(np.uint32), flat[ragged(offsets, lens, at)], place, n))
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([value], pa.binary())], ["block", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None  # of one bucket: they come sorted
        for batch in batches:
            for b, block, payload in zip(*(batch.column(i) for i in range(3))):
                if (now := b.as_py()) != last and rows:
                    yield from bucket(rows, last)
                    rows = []
                last = now
                rows.append((block.as_py(), payload.as_py()))
        if rows:
            yield from bucket(rows, last)
        del rows
        trim()

    return run


def gathered(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, lens, flat): a block's values by piece ordinal, of what the buckets sent; and those of its numbers, in order."""
    rows = sorted(map(unpack, payloads), key=lambda p: p[3])
    parts = [(np.cumsum(unplanes(p[0]), dtype=np.int64), p[1].astype(np.int64), p[2]) for p in rows]
    n = sum(len(p[0]) for p in parts)
    lens, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start = 0
    for k, m, flat in parts:
        lens[k] = m
        offsets[k] = np.cumsum(m) - m + start
        start += len(flat)
    one = lambda some: np.concatenate(some) if some else np.empty(0, np.int64)
    return offsets, lens, one([p[2] for p in parts]), one([p[4] for p in rows])


def input_bytes(docs: DataFrame) -> int:
    """About how large docs is: the optimiser's figure, or the texts' length where it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def exchange(docs: DataFrame, block: Callable[[], Block], values: Values, name: str, told=None, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows (block, kind, payload) of docs (id, text, mark) and the pieces' values, (block, payload).
    told(pieces, counts): of each bucket's distinct pieces, what is sent along in a row of block -1. The
    documents stay where they were written; only pieces and values move."""
    size = input_bytes(docs)
    buckets = max(1, -(-size // bucket_bytes))
    parts = max(shuffle_parts(docs.sparkSession), -(-size // TASK_BYTES))
    read = docs.select(F.col("id").cast("long"), F.col("text").cast("binary"), F.col("mark").cast("byte"))
    rows = materialize_by(read.mapInArrow(_split(block, buckets, parts, block_bytes), "block long, kind int, bucket int, payload binary"), name, parts, "block", "kind")
    sent = rows.where(F.col("kind") == PIECES).select("bucket", "block", "payload")
    tasks = min(buckets, parts)
    dealt = sent.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket")
    return rows, dealt.mapInArrow(_value(values, told), "block long, payload binary")


def assemble(rows: DataFrame, values: DataFrame, finish, schema: str, types: list[pa.DataType], kinds: tuple[int, ...] = (DOCS,)) -> DataFrame:
    """finish(payloads, values): the tables' columns, one list of them for each pack of documents of a block.
    payloads: what the block wrote of the given kinds, as (kind, payload, bucket); values: gathered() ones."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    shape = pa.schema(list(zip(names, types)))

    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        own = list(zip(*(docs.column(n).to_pylist() for n in ("kind", "payload", "bucket"))))
        out = [pa.table(dict(zip(names, columns))).cast(shape) for columns in finish(own, gathered(got.column("payload").to_pylist()))]
        trim()
        return pa.concat_tables(out) if out else shape.empty_table()

    own = rows.where(F.col("kind").isin(*kinds)).select("block", "kind", "payload", "bucket")
    return own.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)

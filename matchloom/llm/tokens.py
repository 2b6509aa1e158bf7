"""Operators 3 and 7: token counts, and byte-level BPE encoding and decoding.

Both cut texts at white space only where the library's own rules can't join what stands on
either side, and each distinct word of a block then into pre-tokens. These are the pieces of the
exchange: their tokens are those they have in any text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .wordblocks import Frequencies, Positions, assemble, exchange, ragged, sums, unpack, unplanes

#: Token limit of op3's over_limit.
LIMIT = 2048
#: White space as the rank files' pattern has it: Python's, but for \x1c-\x1f. White space leads a word.
_LED = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_LEAD = re.compile(r"[^\S\x1c-\x1f]*")
_PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Begins a piece that the library itself must cut: no other piece of operator 3 or 7 begins with it.
WHOLE3, WHOLE7 = b"\x00", b"\xff"


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _library(path).get_added_tokens_decoder().values())


def pre_tokens(words: list[bytes], path: str) -> list[list[bytes]]:
    """The library's pre-tokens of each word. A word with one of its special strings stays whole."""
    t, special = _library(path), _specials(path)
    out: list[list[bytes]] = [[]] * len(words)
    plain = []
    for i, w in enumerate(words):
        if w.isascii() and b"<" not in w:
            plain.append(i)
            continue
        s = w.decode()
        whole = any(x in s for x in special)
        out[i] = [WHOLE3 + w] if whole else [p.encode() for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(s))]
    for k in range(0, len(plain), 1024):  # many at a time: ASCII words keep their places when normalised
        some = plain[k : k + 1024]
        text = b" ".join([words[i] for i in some]).decode()
        normal = t.normalizer.normalize_str(text)
        if len(normal) != len(text):
            for i in some:
                out[i] = [p.encode() for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(words[i].decode()))]
            continue
        at, end, own = 0, len(words[some[0]]), []
        for p, (start, _) in t.pre_tokenizer.pre_tokenize_str(normal):
            while start >= end:
                out[some[at]], own = own, []
                at += 1
                end += 1 + len(words[some[at]])
            own.append(p.encode())
        out[some[at]] = own
    return out


class _Counted(Frequencies):
    def __init__(self, path: str) -> None:
        super().__init__()
        self.path = path

    def cut(self, text: bytes) -> list[bytes]:
        return text.split()

    def parts(self, words: list[bytes]) -> list[list[bytes]]:
        return pre_tokens(words, self.path)


def _tokens_of(path: str):
    def values(pieces: list[bytes], _) -> tuple[np.ndarray, np.ndarray]:
        t = _library(path)
        size = lambda p: len(t.encode(p[1:].decode(), add_special_tokens=False)) if p.startswith(WHOLE3) else len(t.model.tokenize(p.decode()))
        return np.ones(len(pieces), np.int64), np.fromiter(map(size, pieces), np.int64, len(pieces))

    return values


def _counted(packs, values):
    offsets, _, flat, _ = values
    per_piece = flat[offsets]
    for _, data, _ in packs:
        ids, _, sizes, n, step, freq = unpack(data)
        step, freq = unplanes(step).astype(np.int64), unplanes(freq).astype(np.int64)
        total = np.cumsum(step)
        first = np.cumsum(n) - n
        at = total - np.repeat((total - step)[first[n > 0]], n[n > 0])  # a document's ordinals begin anew
        tokens = sums(per_piece[at] * freq, n)
        yield pa.array(ids, pa.int64()), sizes, tokens, tokens > LIMIT


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text; more columns are
    ignored). Null texts count as empty: 0 bytes, 0 tokens. A repeated row comes back as often
    as it occurs; an empty table gives none; a text may be as long as a binary value can be.
    vocabulary: a tokenizer .json whose pre-tokenizer drops white space. Its pieces are counted once for
    each distinct pre-token, and meet each document's frequencies of these; no ids are made."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    rows, values = exchange(docs.select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("mark")), functools.partial(_Counted, path), _tokens_of(path), "op3")
    return assemble(rows, values, _counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", [pa.int64(), pa.int64(), pa.int64(), pa.bool_()])


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: a token's bytes, at the place of its id."""
    own = ranks(path)
    out = [b""] * (max(own.values()) + 1)
    for b, i in own.items():
        out[i] = b
    return pa.array(out, pa.large_binary())


def led_words(text: bytes) -> list[bytes]:
    """White space with what follows it; each boundary has a character other than white space
    on its left, where every match of the pattern ends."""
    return [w.encode() for w in _LED.findall(text.decode())]


def matches(word: bytes) -> list[bytes]:
    """The pattern's matches in a word of led_words(). Python's tables of characters may be newer than the
    library's: what holds a character that isn't assigned in the older ones is left to the library."""
    s = word.decode()
    if word.isascii() or all(unicodedata.category(c) != "Cn" for c in s):
        return [m.encode() for m in _PATTERN.findall(s)]
    n = _LEAD.match(s).end()
    if n and s[n - 1] == " ":  # a single space goes along with what follows
        n -= 1
        cut = [s[:n]]
    else:
        cut = [s[: n - 1], s[n - 1 : n]] if n else []
    return [*(c.encode() for c in cut if c), WHOLE7 + s[n:].encode()]


class _Coded(Positions):
    def cut(self, text: bytes) -> list[bytes]:
        return led_words(text)

    def parts(self, words: list[bytes]) -> list[list[bytes]]:
        return list(map(matches, words))


def encode_pieces(path: str):
    def values(pieces: list[bytes], _) -> tuple[np.ndarray, np.ndarray]:
        e = encoding(path)
        ids = [e.encode_ordinary(p[1:].decode()) if p.startswith(WHOLE7) else e._encode_single_piece(p) for p in pieces]  # a match of the pattern, however long
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return lens, np.fromiter((x for i in ids for x in i), np.uint32, int(lens.sum()))

    return values


def _coded(path: str, whole: bool):
    def finish(packs, values):
        offsets, lens, flat, _ = values
        table = token_bytes(path)
        for _, data, _ in packs:
            doc_ids, _, _, n, at = unpack(data)
            at = unplanes(at).astype(np.int64)
            ids = flat[ragged(offsets, lens, at)].astype("<u4")
            counts = sums(lens[at], n)
            text = table.take(pa.array(ids, pa.uint32()))  # each id meets its bytes
            place = np.frombuffer(text.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
            raw, data = ids.tobytes(), memoryview(text.buffers()[2] or b"") if len(ids) else memoryview(b"")
            ends = np.cumsum(counts)
            bounds = [(int(e - c), int(e)) for c, e in zip(counts, ends)]
            ids_sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in bounds]
            text_sha = [hashlib.sha256(data[place[a] : place[b]]).hexdigest() for a, b in bounds]
            more = ()
            if whole:
                more = pa.array([ids[a:b].astype(np.int32) for a, b in bounds], pa.list_(pa.int32())), pa.array([bytes(data[place[a] : place[b]]) for a, b in bounds], pa.binary())
            yield pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *more

    return finish


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None, whole: bool = False) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (little-endian, 32 bits) and of the bytes they
    decode to, for each row of docs (doc_id, text); with whole, the ids and decoded bytes too.
    Null texts count as empty (0 ids). A repeated row comes back as often as it occurs; an empty table
    gives none. A text may be as long as a binary value can be, and so may a run of white space in it."""
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows, values = exchange(docs.select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("mark")), _Coded, encode_pieces(path), "op7")
    schema, types = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.int64(), pa.string(), pa.string()]
    if whole:
        schema, types = schema + ", ids array<int>, decoded binary", [*types, pa.list_(pa.int32()), pa.binary()]
    return assemble(rows, values, _coded(path, whole), schema, types)

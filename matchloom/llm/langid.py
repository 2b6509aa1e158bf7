"""Operator 8: language of whole texts, and of the spans of mixed ones.

A word's script narrows the languages; character n-grams score it under each of those left;
Viterbi with a switching penalty then labels every word, and the spans follow.
"""

from __future__ import annotations

import bisect
import itertools
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import held_out, materialize
from .wordblocks import trim

#: Bounds of the fit: labelled documents it reads (each language has an equal quota, which a hash of doc_id fills),
#: and n-grams it keeps of each language.
SAMPLE, GRAMS = 20_000, 40_000
#: What a switch of language costs, in the words' score units.
SWITCH = 4.0
#: A language uses a script if at least this share of its letters is in it.
USES = 0.02
#: Words whose scores a task remembers, and words times languages that one Viterbi run holds.
CACHE, CELLS = 250_000, 3_000_000
UND = "und"
_WORDS = re.compile(r"[^\W\d_]+")
#: Numerals that the pattern takes for letters (categories Nl and No): of the first plane, whose set is quick, and all.
_SMALL, _NUMERALS = (re.compile(f"[{''.join(chr(c) for c in range(end) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal())}]") for end in (0x10000, sys.maxunicode + 1))

# Where the ranges of scripts begin (Unicode blocks), and their names; "" is other.
_SCRIPTS = ((0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, ""), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, ""), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""))
_STARTS = [a for a, _ in _SCRIPTS]


def letters(text: str) -> list[str]:
    """The runs of letters (categories L) of a text in lower case."""
    text = text.lower()
    if not text.isascii():
        text = (_SMALL if max(text) < "\U00010000" else _NUMERALS).sub(" ", text)
    return _WORDS.findall(text)


def script(word: str) -> str:
    return _SCRIPTS[bisect.bisect(_STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    n = len(w)
    return [w[i : i + k] for k in (1, 2, 3, 4) for i in range(n - k + 1)] + [w] * (4 < n <= 9)


@dataclass
class Model:
    langs: list[str]
    rows: dict[str, int]  # of table, by n-gram; row 0 is any other
    table: np.ndarray
    scripts: dict[str, np.ndarray]  # penalties of the languages


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    for b in batches:
        for text, lang in zip(b.column(0), b.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(letters(text.as_py() or ""))
    for lang, c in words.items():
        g: Counter = Counter()
        for w, n in c.items():
            for x in grams(w):
                g[x] += n
            g[f"#{script(w)}"] += n * len(w)  # no word holds a #
        yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(list(g), pa.string()), pa.array(list(g.values()), pa.int64())], ["lang", "gram", "n"])
    del words
    trim()


def cuts(hist: list[tuple[str, int, int]], keep: int) -> dict[str, int]:
    """Of each language the count above which no more than `keep` n-grams lie, from (language, count, n-grams)."""
    out: dict[str, int] = {}
    held: Counter = Counter()
    for lang, n, grams_of in sorted(hist, key=lambda h: -h[1]):
        held[lang] += grams_of
        if held[lang] > keep:
            out.setdefault(lang, n)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, keep: int = GRAMS) -> Model | None:
    """A model of the languages of docs (doc_id, text, lang); None if no row has a language.
    At most about `sample` documents are read, an equal share of each language's; a language with fewer has all of its
    own read. Of each language the `keep` commonest n-grams are kept (less those that tie with the first that is
    left out), with their counts in all languages."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    quota = max(1, sample // len(sizes))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, quota / n) * (1 << 20)) + 1)))
    known = known.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")))
    counts = materialize(known.select("text", "lang").mapInArrow(_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "op8-grams")
    script_row = F.col("gram").startswith("#")
    cut = cuts([(r.lang, r.n, r["count"]) for r in counts.where(~script_row).groupBy("lang", "n").count().collect()], keep)
    over = F.element_at(F.create_map(*(F.lit(x) for lang in sizes for x in (lang, cut.get(lang, 0)))), F.col("lang"))
    some = counts.where(script_row | (F.col("n") > over)).select("gram").distinct()
    got = counts.join(some, "gram", "left_semi").select("lang", "gram", "n").orderBy(F.desc("n"), "lang", "gram").toArrow()
    got = list(zip(*(got.column(c).to_pylist() for c in ("lang", "gram", "n"))))
    langs = sorted({lang for lang, _, _ in got})
    if not langs:
        return None
    at = {x: i for i, x in enumerate(langs)}
    rows: dict[str, int] = {}
    for _, gram, _ in got:
        if gram[0] != "#":
            rows.setdefault(gram, len(rows) + 1)
    counts, used = np.zeros((len(rows) + 1, len(langs))), {}
    for lang, gram, n in got:
        if gram[0] == "#":
            used.setdefault(gram[1:], np.zeros(len(langs)))[at[lang]] = n
        else:
            counts[rows[gram], at[lang]] = n
    total = sum(used.values())
    scripts = {s: np.where(u >= USES * np.maximum(total, 1), 0.0, -20.0).astype(np.float32) for s, u in used.items() if (u >= USES * np.maximum(total, 1)).any()}
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts)))
    return Model(langs, rows, (logs - logs.mean(1, keepdims=True)).astype(np.float32), scripts)


def scored(words: list[str], m: Model) -> np.ndarray:
    """Scores of words, up to a constant; the n-grams overlap, so a third of their sum counts."""
    if not words:
        return np.empty((0, len(m.langs)), np.float32)
    ids = [[m.rows.get(g, 0) for g in grams(w)] for w in words]
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(lens.sum()))
    out = np.add.reduceat(m.table[flat], np.cumsum(lens) - lens) / np.float32(3)
    own = np.array([script(w) for w in words])
    for name, penalty in m.scripts.items():
        if penalty.any():
            out[own == name] += penalty
    return out


def viterbi(scores: np.ndarray, lens: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word. scores: of all words, document after document."""
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    path = np.zeros(len(scores), np.int16)
    if not len(scores):
        return path
    longest = int(lens[0])
    active = np.searchsorted(-lens, -np.arange(longest), side="left")  # documents with more than t words
    back = []
    v = np.zeros((len(lens), scores.shape[1]), np.float32)
    for t in range(longest):
        k = active[t]
        own = v[:k]
        if t:
            best = own.argmax(1)
            top = own[np.arange(k), best][:, None] - switch
            stay = own >= top
            back.append((best, stay))
            own = np.where(stay, own, top)
        v[:k] = own + scores[starts[:k] + t]
    at = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        path[starts[:k] + t] = at[:k]
        if t:
            best, stay = back[t - 1]
            at[:k] = np.where(stay[np.arange(k), at[:k]], at[:k], best)
    return path


_SPAN = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])


def _labels(m: Model, switch: float, carried: bool):
    def finish(kept, lens, rows, sizes, table):
        lens = np.array(lens, np.int64)
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        scores, n, k = table[rows], len(lens), len(m.langs)
        path, doc = viterbi(scores, lens, switch), np.repeat(np.arange(n), lens)
        letters = np.bincount(doc * k + path, sizes[rows], n * k).reshape(n, k).astype(float)
        total = np.stack([np.bincount(doc, scores[:, j], n) for j in range(k)], 1).astype(float)
        # most letters first; the whole text's score breaks ties
        best = np.lexsort((np.broadcast_to(-np.arange(len(m.langs)), letters.shape), total, letters), axis=1)[:, -1]
        d = np.arange(len(lens))
        rest = total.copy()
        rest[d, best] = -np.inf
        sure = 1 / (1 + np.exp(-np.clip(total[d, best] - (rest.max(1) if len(m.langs) > 1 else 0.0), -50, 50)))
        share = letters[d, best] / np.maximum(letters.sum(1), 1)
        new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])])) if len(path) else np.empty(0, np.int64)
        per = np.bincount(doc[new], minlength=len(lens))
        starts = np.cumsum(lens) - lens
        spans = pa.StructArray.from_arrays([pa.array([m.langs[x] for x in path[new]], pa.string()), pa.array((new - starts[doc[new]]).astype(np.int32)), pa.array(np.diff(np.append(new, len(path))).astype(np.int32))], fields=list(_SPAN))
        offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        some = lens > 0
        return pa.record_batch([pa.concat_arrays(kept), pa.array([m.langs[b] if x else UND for b, x in zip(best, some)], pa.string()), pa.array(np.where(some, share * np.maximum(sure, 0.5), 0.0)), pa.ListArray.from_arrays(offsets, spans)], ["kept", "lang_pred", "score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(1000, CELLS // len(m.langs))
        cache: dict[str, int] = {}
        table, sizes = np.empty((0, len(m.langs)), np.float32), np.empty(0)
        kept, lens, rows, fresh, held = [], [], [], [], 0

        def close():
            nonlocal cache, table, sizes, kept, lens, rows, fresh, held
            table = np.concatenate([table, scored(fresh, m)])
            sizes = np.concatenate([sizes, np.fromiter(map(len, fresh), float, len(fresh))])
            out = finish(kept, lens, rows, sizes, table)
            kept, lens, rows, fresh, held = [], [], [], [], 0
            if len(cache) >= CACHE:
                cache, table, sizes = {}, table[:0], sizes[:0]
            return out

        for b in batches:
            since = 0  # rows of the batch that are already out
            own = b.column(0)
            for i, t in enumerate(own.field("text") if carried else b.column(1)):
                words = letters(t.as_py() or "")
                for w in words:
                    if w not in cache:
                        cache[w] = len(cache)
                        fresh.append(w)
                lens.append(len(words))
                rows.append(np.fromiter(map(cache.__getitem__, words), np.int64, len(words)))
                held += len(words) + 1
                if held >= limit or len(cache) >= CACHE:
                    kept.append(own.slice(since, i + 1 - since))
                    since = i + 1
                    yield close()
            kept.append(own.slice(since))
        if lens:
            yield close()
        cache, table, sizes, kept, lens, rows, fresh = {}, table[:0].copy(), sizes[:0].copy(), [], [], [], []
        trim()

    return run


def detect(docs: DataFrame, model: Model | None, kept: Column | None = None, switch: float = SWITCH) -> DataFrame:
    """kept (doc_id, or a struct with text among its fields), lang_pred, score, spans (language, first word, words) of each
    row of docs (doc_id, text). A null text, or one without letters (Unicode's L), is `und` with score 0 and no
    spans; without a model every text is. A repeated row comes back as often, an empty table gives none, and a text may
    be as long as a string can be. score: the share of the letters in the language's
    spans times how much likelier it is for the whole text than the next one."""
    own = docs.select(F.col("doc_id").cast("long").alias("kept"), F.col("text").alias("_text")) if kept is None else docs.select(kept.alias("kept"))
    spans = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())]))
    if model is None:
        return own.select("kept", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(spans).alias("spans"))
    schema = T.StructType([own.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", spans)])
    return own.mapInArrow(_labels(model, switch, kept is not None), schema)


def fit_unheld(docs: DataFrame) -> Model | None:
    """fit() on documents whose crc32(doc_id as text) mod 3 is not 1."""
    return fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of each row of docs (more columns are ignored); see detect() for nulls,
    empty and long texts, repeated rows and empty tables."""
    got = detect(docs, fit_unheld(docs)).withColumnRenamed("kept", "doc_id")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def in_a_language(docs: DataFrame) -> DataFrame:
    """The rows of docs whose texts are in some language: all but `und`, with docs' own columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return detect(docs, fit_unheld(docs), row).where(F.col("lang_pred") != UND).select("kept.*")

"""Operator 9: language-model scores of whole texts.

The model is one causal self-attention layer over subword ids, trained in numpy: it begins on a
bounded sample, then learns from all training documents, a block a task, and the blocks' weights are averaged; its output is a class and then an id of the class, and every id that occurs has an
input and an output. A text is scored in windows that overlap: each has CONTEXT tokens on the left and
scores each of its other tokens, so every token is scored once, by batched masked attention, with at least
CONTEXT tokens before it where the text has them.

What is gathered from the corpus grows with it, by a global exchange of a block's distinct words and
pairs of neighbouring words (by a hash): how often all training documents have them. The counts of words give
the base score; in score a word's probability mixes the network's (the product over its subwords) with the
frequencies of the word and of the pair, and a training document's own occurrences are left out of these.
"""

from __future__ import annotations

import copy
import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import held_out, materialize, shuffle_parts
from .tokens import encoding, ranks
from .wordblocks import ADDED, DOCS, NUMBER_BITS, PIECES, TOLD, Block, Places, assemble, distinct, exchange, planes, ragged, sums, trim, unpack, unplanes, unspread

#: Fold of the documents that are never learnt from: crc32(doc_id as text) mod 10 is 0.
FOLDS, FOLD = 10, 0
#: Context and scored tokens of a window (as many, so that a window's context is the one before it); heads, width, inner width.
CONTEXT, SCORED, HEADS, WIDTH, INNER = 32, 32, 1, 32, 48
#: Ids of an output class at least, and the share of all commoner ids that a class has (one in so many): classes of
#: common ids are small.
CLASS, SPREAD = 16, 6
#: Rounds in which all training documents are learnt from (each is in one of them), the first one's rate, and chunks a step.
ROUNDS, RATE, CHUNKS = 2, 0.003, 256
#: Bounds of the sample that the network begins on, in documents (a hash of doc_id picks them) and code points of
#: each; steps, and windows a step.
SAMPLE, SNIPPET, STEPS, BATCH = 2_000, 20_000, 1_000, 256
#: Windows that attend together, tokens whose outputs are scored together, and smoothing of the base and of ids.
TOGETHER, OUTPUTS, SMOOTH = 64, 16384, 0.1
#: Shares of the pair's frequency (less after rare words: those of WEIGHT occurrences get half of it), and of the
#: word's own, in its probability.
PAIRS, WEIGHT, ALONE = 0.3, 4.0, 0.1
#: Bytes of text of a block, and of input for each bucket.
BLOCK, BUCKET = 8 << 20, 2 << 20
#: Distance from each scored token back to each token of its window; negative: ahead of it.
_BACK = CONTEXT + np.arange(SCORED)[:, None] - np.arange(CONTEXT + SCORED)[None, :]
_AHEAD = np.where(_BACK < 0, -1e9, 0.0).astype(np.float32)
_ONES = np.ones(1024, np.float32)
_SCALE = np.float32((WIDTH // HEADS) ** -0.5)
_OTHER = regex.compile(r"[^\S ]")


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z and ASCII white space only


@functools.cache
def _spaced(path: str) -> np.ndarray:
    """Which tokens begin with a space, by id."""
    own = ranks(path)
    out = np.zeros(max(own.values()) + 1, bool)
    out[[i for b, i in own.items() if b[:1] == b" "]] = True
    return out


def subwords(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has as it stands after a space, and these. Many words are encoded as one text,
    where a token that begins with a space begins a word; where some have other white space, each is encoded alone."""
    e, lens, flat = encoding(path), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(words), 4096):
        some = words[k : k + 4096]
        text = b" ".join(some).decode()
        if text.isascii() or not _OTHER.search(text):
            ids = np.asarray(e.encode_ordinary(" " + text), np.int64)
            lens.append(np.diff(np.append(np.flatnonzero(_spaced(path)[ids]), len(ids))))
        else:
            own = [e.encode_ordinary(" " + w.decode()) for w in some]
            ids = np.fromiter(itertools.chain.from_iterable(own), np.int64)
            lens.append(np.fromiter(map(len, own), np.int64, len(own)))
        flat.append(ids)
    return np.concatenate(lens), np.concatenate(flat)


class _Counting(Block):
    """Words by position; pieces are words, and pairs of them as numbers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path, self.size = path, max(ranks(path).values()) + 1
        self.lens_of, self.flat, self.hashes = [], [], np.empty(0, np.uint64)
        self.done, self.learnt, self.pairs = 0, [], []

    def cut(self, text: bytes) -> list[bytes]:
        return lower_words(text)

    def packed(self):
        fresh = list(itertools.islice(self.words, self.done, None))
        self.done = len(self.words)
        lens, flat = subwords(fresh, self.path)
        self.lens_of.append(lens)
        self.flat.append(flat)
        self.hashes = np.append(self.hashes, hashes(fresh))
        per, seq = self.sequence()
        on = np.array(self.marks, bool)
        self.learnt.append(np.bincount(seq[np.repeat(on, per)], minlength=self.done))
        keys, on = pairs(self.hashes, seq, per), np.repeat(on, per + 1)
        self.pairs.append((keys[on], distinct(keys[~on])[0]))
        return *self.head(), per, planes(seq)

    def pieces(self) -> tuple[list, np.ndarray]:
        words = np.zeros(len(self.words), np.int64)
        for c in self.learnt:
            words[: len(c)] += c
        lens, flat = np.concatenate(self.lens_of), np.concatenate(self.flat)
        ids = np.bincount(flat, np.repeat(words, lens), self.size).astype(np.int64)
        some = np.flatnonzero(ids)
        self.tells, self.adds = (lens, planes(flat)), (np.append(some, _TOTAL), np.append(ids[some], words.sum()))
        return list(self.words), words

    def numbers(self):
        learnt, n = distinct(np.concatenate([k for k, _ in self.pairs]))
        keys, _ = distinct(np.concatenate([learnt, *(k for _, k in self.pairs)]))
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, learnt)] = n
        return keys, counts

    def told(self):
        return self.tells

    def added(self):
        return self.adds


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pairs(of: np.ndarray, seq: np.ndarray, per: np.ndarray) -> np.ndarray:
    """A number of each word and the end after what is before it (a word, or the text's begin). of: hashes by word."""
    first, last = gaps(per)
    before, now = np.full(len(first), 1, np.uint64), np.full(len(first), 2, np.uint64)
    before[~first] = now[~last] = of[seq]
    h = (before ^ (before >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + now
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(64 - NUMBER_BITS)


def gaps(per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word and end of texts of so many words: whether nothing is before it, and whether it is the end."""
    ends = np.cumsum(per + 1)
    first, last = np.zeros(int((per + 1).sum()), bool), np.zeros(int((per + 1).sum()), bool)
    first[ends - per - 1] = True
    last[ends - 1] = True
    return first, last


#: Key, beside subword ids, of the sum over the corpus of words.
_TOTAL = -1


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p in b.column(0).to_pylist():
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in unpack(p)], ["key", "n"])


def _distinct(pieces: list[bytes], counts: np.ndarray) -> int:
    """Words of a bucket that training documents have."""
    return int((counts > 0).sum())


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array([unpack(p) for p in b.column(0).to_pylist()], pa.int64())], ["n"])


@dataclass
class Vocabulary:
    local: np.ndarray  # of each subword id: its output, or other
    spelling: np.ndarray  # log of each id's share of the other ids; 0 for those with an output
    counts: np.ndarray  # of each output
    end: int
    other: int

    @property
    def begin(self) -> int:
        return len(self.counts)


def vocabulary(counts: np.ndarray, ends: int) -> Vocabulary:
    """Outputs for the ids that occur, the end and all others (one symbol), of the corpus' subword counts."""
    order = np.argsort(-counts, kind="stable")
    own = order[: int((counts > 0).sum())]
    local = np.full(len(counts), len(own) + 1, np.int64)
    local[own] = np.arange(len(own))
    rest = local == len(own) + 1
    spelling = np.where(rest, np.log((counts + SMOOTH) / (counts[rest].sum() + SMOOTH * max(rest.sum(), 1))), 0.0)
    return Vocabulary(local, spelling, np.concatenate([counts[own], [ends, counts[rest].sum()]]) + SMOOTH, len(own), len(own) + 1)


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of these, with the largest taken off only where it must be."""
    e = np.exp(z)
    total = e.sum(1)
    if not (np.isfinite(total).all() and (total > 0).all()):
        z = z - z.max(1, keepdims=True)
        e = np.exp(z)
        total = e.sum(1)
    return z, e, total


class Network:
    def __init__(self, v: Vocabulary, seed: int = 5) -> None:
        rng, n = np.random.default_rng(seed), len(v.counts)
        starts = [0]
        while starts[-1] < n:
            starts.append(min(n, starts[-1] + max(CLASS, starts[-1] // SPREAD)))
        self.v, self.starts, self.classes = v, np.array(starts), len(starts) - 1
        self.of = np.repeat(np.arange(self.classes), np.diff(starts)).astype(np.uint16)
        g = lambda *s, scale=1.0: (rng.standard_normal(s) * scale / np.sqrt(s[-1])).astype(np.float32)
        by = np.bincount(self.of, v.counts, self.classes)
        w = WIDTH
        self.p = {
            "E": g(n + 1, w), "R": np.zeros((HEADS, CONTEXT + SCORED), np.float32), "Q": g(w, w), "K": g(w, w), "V": g(w, w), "O": g(w, w, scale=0.5),
            "A": g(w, INNER), "a": np.zeros(INNER, np.float32), "B": g(INNER, w, scale=0.5), "C": g(self.classes, w, scale=0.3), "c": np.log(by / by.sum()).astype(np.float32),
            "D": g(n, w, scale=0.3), "d": np.log(v.counts / by[self.of]).astype(np.float32),
        }
        self.p["R"][0] = -0.05 * np.arange(CONTEXT + SCORED)  # one head begins by looking at what is near

    def _attend(self, q, k, v, pad):
        """Of each head: masked attention's exponentials, their sums, and the values they weigh; q, k, v: a list of heads."""
        first, got = np.flatnonzero(pad[:, CONTEXT - 1]), []
        for i in range(HEADS):
            s = q[i] @ k[i].transpose(0, 2, 1)
            s += self.p["R"][i][np.maximum(_BACK, 0)] + _AHEAD
            if len(first):
                s[first] += np.where(pad[first], np.float32(-1e9), np.float32(0))[:, None, :]
            with np.errstate(over="ignore"):
                e = np.exp(s)
            total = e.sum(2, keepdims=True)
            if not (np.isfinite(total).all() and (total > 0).all()):  # large scores: the same, with each row's largest taken off
                e = np.exp(s - s.max(2, keepdims=True))
                total = e.sum(2, keepdims=True)
            a = e @ v[i]
            a /= total
            got.append((e, total, a))
        return got

    def hidden(self, x: np.ndarray, pad: np.ndarray):
        """States of the scored tokens of windows x; pad: cells before the text begins."""
        p = self.p
        h = p["E"][x]
        own = h[:, CONTEXT:]
        q, k, v = (np.split(t, HEADS, 2) for t in (own @ (p["Q"] * _SCALE), h @ p["K"], h @ p["V"]))
        got = self._attend(q, k, v, pad)
        a = np.concatenate([g[2] for g in got], 2)
        h2 = own + a @ p["O"]
        z = np.maximum(h2 @ p["A"] + p["a"], 0)
        return h2 + z @ p["B"], (h, own, q, k, v, got, a, h2, z)

    def tables(self) -> None:
        """Inputs, queries, keys and values by id (a token's only depend on its id), and exponentials of the distances' bias."""
        p = self.p
        split = lambda t: [np.ascontiguousarray(x) for x in np.split(t, HEADS, 1)]
        self.t = p["E"], split(p["E"] @ (p["Q"] * _SCALE)), split(p["E"] @ p["K"]), split(p["E"] @ p["V"])
        far = lambda t: float(np.sqrt((t.astype(float) ** 2).sum(1).max()))
        self.calm = [far(a) * far(b) < 60 for a, b in zip(self.t[1], self.t[2])]  # no score is larger
        # of the classes, then of each class' ids: the longest vector, and the largest bias
        spans = [(p["C"], p["c"]), *((p["D"][a:b], p["d"][a:b]) for a, b in zip(self.starts, self.starts[1:]))]
        self.reach = [(far(w), float(np.abs(b).max())) for w, b in spans]
        self.near = [np.exp(p["R"][i][np.maximum(_BACK, 0)] + _AHEAD) for i in range(HEADS)]

    def states(self, x: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """As hidden(), from tables(): a row for each token of x but the first CONTEXT, which only are context. A window's
        context is the chunk before it, so keys and values are looked up once. alone: windows that have no context."""
        p, (e, q, k, v), n, w = self.p, self.t, len(alone), WIDTH // HEADS
        own, got = x[CONTEXT:], []
        for i in range(HEADS):
            keys = np.ascontiguousarray(k[i].take(x, 0).reshape(n + 1, SCORED, w).transpose(0, 2, 1))
            values, asked = v[i].take(x, 0).reshape(n + 1, SCORED, w), q[i].take(own, 0).reshape(n, SCORED, w)
            before, now = asked @ keys[:-1], asked @ keys[1:]
            if not self.calm[i] and max(np.abs(before).max(), np.abs(now).max()) > 60:  # such scores need each row's largest taken off
                most = np.maximum(before.max(2, keepdims=True), now.max(2, keepdims=True))
                before -= most
                now -= most
            for s, near in ((before, self.near[i][:, :CONTEXT]), (now, self.near[i][:, CONTEXT:])):
                np.exp(s, out=s)
                s *= near
            before[alone] = 0
            a = before @ values[:-1]
            a += now @ values[1:]
            a /= (before @ _ONES[:CONTEXT] + now @ _ONES[:SCORED])[:, :, None]
            got.append(a.reshape(-1, w))
        h = (np.concatenate(got, 1) if HEADS > 1 else got[0]) @ p["O"]
        h += e.take(own, 0)
        z = h @ p["A"]
        z += p["a"]
        np.maximum(z, 0, out=z)
        h += z @ p["B"]
        return h

    def taken(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """As logs(), without gradients and in less memory."""
        p, t = self.p, self.of.take(y)
        longest = float(np.sqrt(np.einsum("ij,ij->i", h, h).max(initial=0)))

        def picked(z, at, reach):
            if longest * reach[0] + reach[1] > 60:
                z -= z.max(1, keepdims=True)
            own = z[np.arange(len(at)), at]
            np.exp(z, out=z)
            return own - np.log(z @ (_ONES[: z.shape[1]] if z.shape[1] <= len(_ONES) else np.ones(z.shape[1], np.float32)))

        z = h @ p["C"].T
        z += p["c"]
        out = picked(z, t, self.reach[0])
        order = np.argsort(t, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.classes))])
        hs, ys, more = h.take(order, 0), (y - self.starts[t]).take(order), np.empty(len(y), np.float32)
        for c in range(self.classes):
            a, b = ends[c], ends[c + 1]
            if a < b:
                own = slice(self.starts[c], self.starts[c + 1])
                z = hs[a:b] @ p["D"][own].T
                z += p["d"][own]
                more[a:b] = picked(z, ys[a:b], self.reach[c + 1])
        out[order] += more
        return out

    def logs(self, h: np.ndarray, y: np.ndarray, grad: bool = False):
        """Natural log probabilities of outputs y after states h; with grad, the gradients of their sum."""
        p = self.p
        t, rows = self.of[y], np.arange(len(y))
        z, e, total = _softmax(h @ p["C"].T + p["c"])
        out = z[rows, t] - np.log(total)
        g = {}
        if grad:
            dz = -e / total[:, None]
            dz[rows, t] += 1
            g = {"C": dz.T @ h, "c": dz.sum(0), "D": np.zeros_like(p["D"]), "d": np.zeros_like(p["d"])}
            dh = dz @ p["C"]
        order = np.argsort(t, kind="stable")
        ends = np.searchsorted(t[order], np.arange(self.classes + 1))
        hs, ys, more = h[order], (y - self.starts[t])[order], np.empty_like(out)
        for c in range(self.classes):
            a, b = ends[c], ends[c + 1]
            if a < b:
                own = slice(self.starts[c], self.starts[c + 1])
                r = rows[: b - a]
                z, e, total = _softmax(hs[a:b] @ p["D"][own].T + p["d"][own])
                more[a:b] = z[r, ys[a:b]] - np.log(total)
                if grad:
                    dz = -e / total[:, None]
                    dz[r, ys[a:b]] += 1
                    g["D"][own], g["d"][own] = dz.T @ hs[a:b], dz.sum(0)
                    dh[order[a:b]] += dz @ p["D"][own]
        out[order] += more
        return (out, g, dh) if grad else out

    def gradients(self, x: np.ndarray, pad: np.ndarray, y: np.ndarray, on: np.ndarray):
        """Mean log probability of y where on, and its gradients."""
        p = self.p
        hid, (h, own, q, k, v, got, a, h2, z) = self.hidden(x, pad)
        some = np.flatnonzero(on.reshape(-1))
        flat = hid.reshape(-1, WIDTH)
        out, g, d = self.logs(flat[some], y.reshape(-1)[some], True)
        dh = np.zeros_like(flat)
        dh[some] = d
        dh = dh.reshape(hid.shape)
        f = lambda t: t.reshape(-1, t.shape[-1])
        g["B"] = f(z).T @ f(dh)
        dz = (dh @ p["B"].T) * (z > 0)
        g["A"], g["a"] = f(h2).T @ f(dz), f(dz).sum(0)
        d2 = dh + dz @ p["A"].T
        g["O"] = f(a).T @ f(d2)
        g["R"], seen = np.zeros_like(p["R"]), _BACK >= 0
        dq, dk, dv = [], [], []
        for i, da in enumerate(np.split(d2 @ p["O"].T, HEADS, 2)):
            s = got[i][0] / got[i][1]
            ds = da @ v[i].transpose(0, 2, 1)
            dv.append(s.transpose(0, 2, 1) @ da)
            ds = s * (ds - (ds * s).sum(2, keepdims=True))
            g["R"][i] = np.bincount(_BACK[seen], ds.sum(0)[seen], CONTEXT + SCORED)
            dq.append(ds @ k[i] * _SCALE)
            dk.append(ds.transpose(0, 2, 1) @ q[i])
        dq, dk, dv = (np.concatenate(t, 2) for t in (dq, dk, dv))
        g["Q"], g["K"], g["V"] = f(own).T @ f(dq), f(h).T @ f(dk), f(h).T @ f(dv)
        de = dk @ p["K"].T + dv @ p["V"].T
        de[:, CONTEXT:] += d2 + dq @ p["Q"].T
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], x.reshape(-1), f(de))
        return float(out.mean()), {n: t / len(some) for n, t in g.items()}

    def train(self, tokens: np.ndarray, lens: np.ndarray, steps: int = STEPS, seed: int = 6) -> list[float]:
        """Adam's steps over windows of the texts' outputs, given one after the other."""
        x, pad, y, on = windows(tokens, lens, self.v)
        rng, m1, m2, told = np.random.default_rng(seed), {}, {}, []
        for i in range(steps if len(x) else 0):
            at = rng.integers(0, len(x), BATCH)
            mean, g = self.gradients(x[at], pad[at], y[at], on[at])
            told.append(mean)
            rate = 0.01 * min(1, (i + 1) / 30) * (1 - i / steps)
            for n, d in g.items():
                m1[n] = 0.9 * m1.get(n, 0) + 0.1 * d
                m2[n] = 0.99 * m2.get(n, 0) + 0.01 * d * d
                self.p[n] = (self.p[n] + rate * (m1[n] / (1 - 0.9 ** (i + 1))) / (np.sqrt(m2[n] / (1 - 0.99 ** (i + 1))) + 1e-8)).astype(np.float32)
        return told

    def slopes(self, x: np.ndarray, y: np.ndarray, alone: np.ndarray):
        """As gradients(), of cells as states() has them: a window's context is the chunk before it, whose keys and values are
        made once. y: outputs of all cells of x but the first CONTEXT, -1 for none."""
        p, n, w = self.p, len(alone), WIDTH // HEADS
        h = p["E"].take(x, 0)
        own, cut = h[CONTEXT:], lambda t, i: t[:, i * w : (i + 1) * w].reshape(-1, SCORED, w)
        asked, keys, values = own @ (p["Q"] * _SCALE), h @ p["K"], h @ p["V"]
        seen, got = [], np.empty_like(own)
        turned, ones = lambda t: np.ascontiguousarray(t.transpose(0, 2, 1)), _ONES[:SCORED].astype(h.dtype)
        far = lambda t: float(np.einsum("ij,ij->i", t, t).max()) ** 0.5
        for i in range(HEADS):
            at, near = slice(i * w, (i + 1) * w), p["R"][i][np.maximum(_BACK, 0)] + _AHEAD
            q, kt, v = cut(asked, i), turned(cut(keys, i)), cut(values, i)
            before, now = q @ kt[:-1], q @ kt[1:]
            before += near[:, :CONTEXT]
            now += near[:, CONTEXT:]
            if far(asked[:, at]) * far(keys[:, at]) + float(np.abs(p["R"][i]).max()) > 60:  # such scores need each row's largest taken off
                before[alone] = -np.inf
                most = np.maximum(before.max(2, keepdims=True), now.max(2, keepdims=True))
                before -= most
                now -= most
            np.exp(before, out=before)
            np.exp(now, out=now)
            before[alone] = 0
            total = (before @ ones + now @ ones)[:, :, None]
            a = before @ v[:-1]
            a += now @ v[1:]
            a /= total
            got[:, at] = a.reshape(-1, w)
            seen.append((before, now, total, a))
        h2 = own + got @ p["O"]
        z = np.maximum(h2 @ p["A"] + p["a"], 0)
        some = np.flatnonzero(y >= 0)
        out, g, d = self.logs((h2 + z @ p["B"]).take(some, 0), y.take(some), True)
        dh = np.zeros_like(h2)
        dh[some] = d
        dz = (dh @ p["B"].T) * (z > 0)
        d2 = dh + dz @ p["A"].T
        g |= {"B": z.T @ dh, "A": h2.T @ dz, "a": dz.sum(0), "O": got.T @ d2, "R": np.zeros_like(p["R"])}
        da, dq, dk, dv, back = d2 @ p["O"].T, np.empty_like(own), np.zeros_like(h), np.zeros_like(h), _BACK >= 0
        for i, (before, now, total, a) in enumerate(seen):
            q, k, v, at = cut(asked, i), cut(keys, i), cut(values, i), slice(i * w, (i + 1) * w)
            e, vt = cut(da, i) / total, turned(v)
            mean = (a * e) @ _ONES[:w].astype(h.dtype)
            db, dn = e @ vt[:-1], e @ vt[1:]
            dv[CONTEXT:, at] += (now.transpose(0, 2, 1) @ e).reshape(-1, w)
            dv[:-SCORED, at] += (before.transpose(0, 2, 1) @ e).reshape(-1, w)
            for d, weigh in ((db, before), (dn, now)):
                d -= mean[:, :, None]
                d *= weigh
            g["R"][i] = np.bincount(_BACK[back], np.concatenate([db.sum(0), dn.sum(0)], 1)[back], CONTEXT + SCORED)
            dq[:, at] = (db @ k[:-1] + dn @ k[1:]).reshape(-1, w) * _SCALE
            dk[CONTEXT:, at] += (dn.transpose(0, 2, 1) @ q).reshape(-1, w)
            dk[:-SCORED, at] += (db.transpose(0, 2, 1) @ q).reshape(-1, w)
        g |= {"Q": own.T @ dq, "K": h.T @ dk, "V": h.T @ dv, "E": np.zeros_like(p["E"])}
        de = dk @ p["K"].T + dv @ p["V"].T
        de[CONTEXT:] += d2 + dq @ p["Q"].T
        order = np.argsort(x, kind="stable")
        ids, firsts = np.unique(x[order], return_index=True)
        g["E"][ids] = np.add.reduceat(de.take(order, 0), firsts, 0)
        return float(out.mean()), {k: t / np.float32(len(some)) for k, t in g.items()}

    def follow(self, tokens: np.ndarray, lens: np.ndarray, rate: float, chunks: int = CHUNKS) -> None:
        """Adam's steps over all tokens and ends of texts, each once, in their order; its moments begin anew."""
        x, y, void = cells(tokens, lens, self.v)
        m1, m2 = {}, {}
        for i, a in enumerate(range(1, len(void), chunks)):
            b = min(a + chunks, len(void))
            own = y[a * SCORED : b * SCORED]
            if (own < 0).all():
                continue
            for n, d in self.slopes(x[(a - 1) * SCORED : b * SCORED], own, void[a - 1 : b - 1])[1].items():
                d = d.astype(np.float32)
                m1[n] = 0.9 * m1[n] + 0.1 * d if n in m1 else 0.1 * d
                m2[n] = 0.99 * m2[n] + 0.01 * d * d if n in m2 else 0.01 * d * d
                now = rate * min(1, (i + 1) / 30)
                self.p[n] = self.p[n] + (m1[n] / np.float32(1 - 0.9 ** (i + 1))) / (np.sqrt(m2[n] / np.float32(1 - 0.99 ** (i + 1))) + np.float32(1e-8)) * np.float32(now)

    def scores(self, tokens: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sums of the natural log probabilities of each text's outputs and its end."""
        return sums(self.each(tokens, lens), lens + 1)

    def each(self, tokens: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Natural log probabilities of each text's outputs and its end, one text after the other."""
        self.tables()
        x, y, void = cells(tokens, lens, self.v)
        out, hs, ys, held = [np.empty(0)], [], [], 0
        for a in range(1, len(void), TOGETHER):
            b = min(a + TOGETHER, len(void))
            want = y[a * SCORED : b * SCORED]
            some = np.flatnonzero(want >= 0)
            hs.append(self.states(x[(a - 1) * SCORED : b * SCORED], void[a - 1 : b - 1]).take(some, 0))
            ys.append(want.take(some))
            held += len(some)
            if held >= OUTPUTS or b == len(void):
                out.append(self.taken(np.concatenate(hs), np.concatenate(ys)).astype(float))
                hs, ys, held = [], [], 0
        return np.concatenate(out)


def cells(tokens: np.ndarray, lens: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and outputs (-1: none) of texts in chunks of SCORED cells, and which chunks are void. Before each text is a
    void one, the context of its first; a text's inputs are its begin and its tokens, its outputs these and the end."""
    chunks = -(-(lens + 1) // SCORED) + 1
    first = (np.cumsum(chunks) - chunks + 1) * SCORED
    x, y = np.full(int(chunks.sum()) * SCORED, v.begin), np.full(int(chunks.sum()) * SCORED, -1)
    at = np.arange(len(tokens)) + np.repeat(first - (np.cumsum(lens) - lens), lens)
    y[at] = tokens
    y[first + lens] = v.end
    x[at + 1] = tokens
    void = np.zeros(int(chunks.sum()), bool)
    void[first // SCORED - 1] = True
    return x, y, void


def batches(tokens: np.ndarray, lens: np.ndarray, v: Vocabulary, together: int = TOGETHER):
    """Windows of texts (outputs one after the other): inputs, what is before a text's begin, outputs to
    predict, which of these there are, and the window's text. A window's inputs are a text's tokens
    shifted by one, its begin first."""
    starts = np.cumsum(lens) - lens
    n = -(-(lens + 1) // SCORED)
    doc = np.repeat(np.arange(len(lens)), n)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * SCORED
    padded = np.append(tokens, v.end)
    for i in range(0, len(doc), together):
        d, f = doc[i : i + together], first[i : i + together]
        at = f[:, None] + np.arange(-CONTEXT, SCORED)  # places of the tokens to predict; inputs are those before
        size = lens[d][:, None]
        before = padded[np.clip(starts[d][:, None] + at - 1, 0, len(tokens))]
        x = np.where(at <= 0, v.begin, np.where(at - 1 < size, before, v.end))
        to = at[:, CONTEXT:]
        y = np.where(to < size, padded[np.clip(starts[d][:, None] + to, 0, len(tokens))], v.end)
        yield x, at < 0, y, to <= size, d


def windows(tokens, lens, v):
    got = [b[:4] for b in batches(tokens, lens, v)]
    return [np.concatenate(c) for c in zip(*got)] if got else [np.empty((0, CONTEXT + SCORED), np.int64)] * 4


def outputs(words: list[bytes], path: str, v: Vocabulary) -> np.ndarray:
    return v.local[subwords(words, path)[1]]


def _tallied(places: np.ndarray, ends: np.ndarray, per: np.ndarray, on: np.ndarray, size: int) -> np.ndarray:
    """How often each of the places (below size) occurs in its own text; 0 in texts that are not on."""
    tally, out = np.zeros(size, np.int32), np.zeros(len(places), np.int64)
    for a, b in zip((ends - per)[on].tolist(), ends[on].tolist()):
        s = places[a:b]
        np.add.at(tally, s, 1)
        out[a:b] = tally[s]
        tally[s] = 0
    return out


def _logs(net: Network, total: int, ends: int, told, values, pack):
    """Of a pack of documents: words a document, their places among the block's words, counts of these, and natural
    log probabilities of each word and end, under the counts and the network together."""
    offsets, _, flat, many = values
    lens, outputs_of, spelling, places, of = told
    c = flat[offsets]
    _, marks, _, per, seq = pack
    seq, on = unplanes(seq).astype(np.int64), marks != 0
    first, last = gaps(per)
    # the network: a token for each subword and each text's end
    starts = np.cumsum(lens) - lens
    n = np.ones(len(last), np.int64)
    n[~last] = lens[seq]
    each = sums(net.each(outputs_of[ragged(starts, lens, seq)], sums(n, per + 1) - 1), n)
    each[~last] += spelling[seq]
    # how often training documents have the word, what is before it, and both; without this one
    keys = pairs(of, seq, per)
    at = places(keys)
    own = _tallied(seq, np.cumsum(per), per, on, len(lens))
    alone, before = np.full(len(last), ends, np.int64), np.full(len(last), ends, np.int64)
    alone[~last] = before[~first] = c[seq] - own
    mine = np.repeat(on, per + 1)
    alone[last] -= mine[last]
    before[first] -= mine[first]
    pair = many[at] - _tallied(at, np.cumsum(per + 1), per + 1, on, len(places.among))
    size = total - np.repeat(np.where(on, per + 1, 0), per + 1)
    return per, seq, c, mixed(each, pair, before, alone, size)


def mixed(net: np.ndarray, pair: np.ndarray, before: np.ndarray, own: np.ndarray, total) -> np.ndarray:
    """Natural log probabilities of words: net is the network's, pair and before how often the training
    documents have the word after the one before it and that one at all, own how often the word, of total."""
    after, alone = PAIRS * before / (before + WEIGHT), np.where(np.asarray(total) > 0, ALONE, 0.0)
    with np.errstate(divide="ignore"):
        known = after * pair / np.maximum(before, 1) + (1 - after) * alone * own / np.maximum(total, 1)
        return np.logaddexp(np.log(known), np.log((1 - after) * (1 - alone)) + net)


def _learning(net: Network, rate: float, chunks: int):
    """What a block makes of the network by its training documents: the weights, one after the other, and the tokens they saw."""

    def run(rows: pa.Table) -> pa.Table:
        own = sorted(zip(*(rows.column(n).to_pylist() for n in ("kind", "payload"))))
        lens, flat = next(unpack(d) for k, d in own if k == TOLD)
        outputs_of, starts, tokens, sizes = net.v.local[unplanes(flat)], np.cumsum(lens) - lens, [], []
        for kind, data in own:
            if kind == DOCS:
                _, marks, _, per, seq = unpack(data)
                on = marks != 0
                words = unplanes(seq).astype(np.int64)[np.repeat(on, per)]
                tokens.append(outputs_of[ragged(starts, lens, words)])
                sizes.append(sums(lens[words], per[on]))
        mine, sizes = copy.copy(net), np.concatenate(sizes)
        mine.p = dict(net.p)
        mine.follow(np.concatenate(tokens), sizes, rate, chunks)
        n = int((sizes + 1).sum())
        flat = np.concatenate([mine.p[k].reshape(-1) for k in sorted(mine.p)]).astype(float) * n
        trim()
        return pa.table({"n": pa.array([n], pa.int64()), "payload": pa.array([flat.tobytes()], pa.binary())})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a task's weights, summed."""
    n, total = 0, None
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1)):
            own = np.frombuffer(data.as_buffer(), np.float64)
            n, total = n + k, own.copy() if total is None else total + own
    if n:
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "payload"])


def learn(net: Network, rows: DataFrame) -> None:
    """All training documents' tokens, once each, in ROUNDS: in a round each of its blocks goes on from the same weights, and then these are
    averaged by tokens. Sums go over tasks, then over about as many as the root of these, and a row at a time to the driver."""
    shape = "n long, payload binary"
    for i in range(ROUNDS):
        own = rows.where(F.col("kind").isin(DOCS, TOLD) & (F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == i)).select("block", "kind", "payload")
        sums_of = own.groupBy("block").applyInArrow(_learning(net, RATE * (1 - i / ROUNDS), CHUNKS), shape).mapInArrow(_added, shape)
        tasks = max(1, math.isqrt(shuffle_parts(rows.sparkSession)))
        n, total = 0, 0.0
        for r in sums_of.repartition(tasks).mapInArrow(_added, shape).toLocalIterator():
            n, total = n + r.n, total + np.frombuffer(r.payload, np.float64)
        if n:
            at = 0
            for k in sorted(net.p):
                size = net.p[k].size
                net.p[k] = (total[at : at + size] / n).astype(np.float32).reshape(net.p[k].shape)
                at += size


def _finish(net: Network, total: int, distinct: int, ends: int):
    base = np.log10(total + SMOOTH * (distinct + 1))
    end_score = np.log10(ends + SMOOTH) - base

    def finish(rows, values):
        lens, own = next(unpack(d) for k, d, _ in rows if k == TOLD)
        own, of, numbers = unplanes(own), np.empty(len(lens), np.uint64), []
        for place, data in sorted((b, d) for k, d, b in rows if k == PIECES):
            k, words, _, keys, _ = unpack(data)
            of[np.cumsum(unplanes(k), dtype=np.int64)] = hashes(words)
            numbers.append(unspread(keys))
        told = lens, net.v.local[own], sums(net.v.spelling[own], lens), Places(np.concatenate(numbers)), of
        for kind, data, _ in rows:
            if kind == DOCS:
                pack = unpack(data)
                per, seq, c, each = _logs(net, total, ends, told, values, pack)
                score = np.log10(c + SMOOTH) - base
                model = sums(each, per + 1) / np.log(10)
                n = sums(told[0][seq], per) + 1
                yield (
                    pa.array(pack[0], pa.int64()), pa.array(pack[1] == 0), per + 1, sums((c > 0)[seq].astype(np.int64), per) + int(ends > 0), np.full(len(per), total, np.int64),
                    sums(score[seq], per) + end_score, model, n, model / (per + 1),
                )

    return finish


def scores(docs: DataFrame, vocabulary_file: str | None = None, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords (the end
    included) and mean_score (score by token) of each row of docs (doc_id, text; more columns are ignored). Null and
    empty texts are their end alone; a repeated row comes back as often; an empty table gives none; a text may be as
    long as a binary value can be. Base counts, subword counts and pairs of words are those of all training documents (a
    training document's own included, but not in score's frequencies); the network, which score mixes with them, begins on a
    sample of at most about `sample` documents, SNIPPET code points of each, and then learns from every training document (learn()). Without training documents every count is
    0 and the network stays as it began."""
    path = vocabulary_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    held = held_out(F.col("doc_id"), FOLDS, FOLD)
    learnt = docs.where(~held)
    ends = learnt.count()
    own = docs.select(F.col("doc_id").alias("id"), "text", (~held).cast("int").alias("mark"))
    rows, values = exchange(own, functools.partial(_Counting, path), _counts, "op9", _distinct, BLOCK, BUCKET)
    values = materialize(values, "op9-values", packed=True)
    total, ids = ends, np.zeros(max(ranks(path).values()) + 1, np.int64)
    # a row for each subword id at most
    for r in rows.where(F.col("kind") == ADDED).select("payload").mapInArrow(_sums, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        if r.key == _TOTAL:
            total += r.n
        else:
            ids[r.key] = r.n
    distinct = int(ends > 0) + (values.where("block = -1").select("payload").mapInArrow(_own, "n long").agg(F.sum("n")).first()[0] or 0)
    v = vocabulary(ids, ends)
    net = Network(v)
    if ends:
        # documents by hash, so that the sample is the same in each run; where in a long text, too
        h = F.xxhash64(F.lit("lm"), "doc_id")
        some = learnt.where(F.pmod(h, F.lit(1 << 20)) < int(min(1.0, sample / ends) * (1 << 20)) + 1)
        at = F.pmod(F.shiftright(h, 20), F.greatest(F.length("text") - SNIPPET + 1, F.lit(1))).cast("int") + 1
        texts = sorted((r[0] or "").encode() for r in some.select(F.substring("text", at, F.lit(SNIPPET))).collect())
        seqs = [outputs(lower_words(t), path, v) for t in texts]
        net.train(np.concatenate(seqs) if seqs else np.empty(0, np.int64), np.array(list(map(len, seqs)), np.int64), steps)
        learn(net, rows)
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_subwords long, mean_score double"
    return assemble(rows, values.where("block <> -1"), _finish(net, total, distinct, ends), schema, types, (DOCS, PIECES, TOLD))


def _counts(pieces: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ones(len(pieces), np.int64), counts

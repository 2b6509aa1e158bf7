"""Operator 5: toxicity by weak supervision.

Many voters vote on a bounded sample of training documents: insults of four languages, patterns of
shouting and masking, marks of boilerplate, and words and word beginnings that go along with toxic
or with clean labelled rows. A generative model of the votes estimates each voter's accuracy (how often it
fires under either label) and the voters' correlations (a tree of the pairs that depend on each other most
given the label), and gives posterior labels, of labelled and unlabelled documents alike. A given label is one more voter,
whose accuracy is estimated like the others'. A linear classifier learns the posteriors, and scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, materialize

#: Labelled documents, and documents whatever their label, that the fit reads at most (a hash of doc_id picks them; in
#: expectation); voters from labelled rows that it keeps for either label.
SAMPLE, OTHERS, VOTERS, CLEAN = 12_000, 6_000, 250, 30
#: Word beginnings by length; a voter needs this many documents and this association (G squared).
SHORT, LONG, LEAST, TIED = 3, 8, 4, 14.0
#: Marks that a task holds while it counts them.
HELD = 150_000
#: Hits from which a voter of the label model fires: each mark has one for each number.
LEVELS = (1, 2, 4)
#: Rounds of the label model, and dependence (mutual information given the label, in nats) from which a voter has a parent.
ROUNDS, DEPENDS = 20, 0.002
#: How far a given label is trusted at most, and how much it counts that a voter does not fire (1: as the model has it): a
#: lexicon of another language can't.
TRUST, ABSENT = 0.97, 0.7
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]+")

# Insults (English, German, French, Spanish) and patterns that vote whatever the labels say.
LEXICON = (
    "idiot", "stupid", "moron", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "dumb", "garbage", "imbecile", "filth", "vermin",
    "dummkopf", "trottel", "abschaum", "arschloch", "vollidiot", "schwachkopf", "drecksau", "versager", "widerlich", "wertlos",
    "imbécile", "crétin", "abruti", "connard", "salaud", "ordure", "débile", "minable", "pourriture", "dégoûtant",
    "imbécil", "estúpido", "basura", "escoria", "gilipollas", "cabrón", "asqueroso", "inútil", "patético", "payaso",
)
PATTERNS = {
    "shouted": re.compile(r"[A-ZÀ-Þ]{5,}"),
    "exclaimed": re.compile(r"[!?]{2,}"),
    "masked": re.compile(r"[*#$@%&]{3,}"),
    "linked": re.compile(r"https?://|www\."),
    "licensed": re.compile(r"(?i)\blicen[sc]ed? |copyright|all rights reserved"),
}


@dataclass
class Model:
    voters: dict[str, int] = field(default_factory=dict)  # "^x": words beginning with x; "x": the word x
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS) + 1))  # of voters, patterns, and words of voters
    bias: float = -3.0


def _marks(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in range(SHORT, min(LONG, len(word)) + 1))]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, clean, toxic) documents that have it; sums of parts, so that a task holds HELD marks and a document's."""
    counts: dict[str, list[int]] = {}

    def told() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["mark", "clean", "toxic"])

    for b in batches:
        for t, y in zip(b.column(0), b.column(1).to_pylist()):
            for m in {m for w in set(WORDS.findall((t.as_py() or "").lower())) for m in _marks(w)}:
                counts.setdefault(m, [0, 0])[y] += 1
            if len(counts) >= HELD:
                yield told()
                counts.clear()
    # a mark of clean documents only can't become a voter here, but may be one elsewhere: all go
    yield told()


def _hits(word: str, voters: dict[str, int]) -> tuple[int, ...]:
    return tuple(voters[m] for m in _marks(word) if m in voters)


def _features(text: str, voters: dict[str, int], cache: dict) -> tuple[dict[int, int], int]:
    """Hits by voter, then by pattern; and how many words are of some voter."""
    out: Counter = Counter()
    words = 0
    for w, n in Counter(WORDS.findall(text.lower())).items():
        got = cache.get(w)
        if got is None:
            if len(cache) > 400_000:
                cache.clear()
            got = cache[w] = _hits(w, voters)
        if got:
            words += n
            for k in got:
                out[k] += n
    for k, p in enumerate(PATTERNS.values(), len(voters)):
        if n := sum(1 for _ in p.finditer(text)):
            out[k] = n
    return out, words


def _votes(voters: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            rows = [_features(t.as_py() or "", voters, cache) for t in b.column(0)]
            yield pa.record_batch([b.column(1), pa.array([list(r) for r, _ in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r, _ in rows], pa.list_(pa.int32())), pa.array([w for _, w in rows], pa.int32())], ["y", "k", "n", "words"])

    return run


class LabelModel:
    """P(label) and of each voter P(fires | label, whether its parent fires); a root's parent is itself at 0."""

    def __init__(self, voters: int) -> None:
        self.prior, self.parent = 0.5, np.full(voters, -1)
        self.fires = np.full((2, 2, voters), 0.5)  # label, parent, voter

    def accuracies(self, v: np.ndarray, p: np.ndarray) -> np.ndarray:
        """P(fires | label) of each voter: label, voter."""
        return np.stack([((1 - p) @ v + 0.05) / ((1 - p).sum() + 1), (p @ v + 0.05) / (p.sum() + 1)])

    def correlate(self, v: np.ndarray, p: np.ndarray) -> None:
        """The tree: each voter's parent is the one it shares most information with, given the label, among those before it
        in the order of a maximum spanning forest (by Prim); pairs below DEPENDS stay apart."""
        n, k = v.shape
        info = np.zeros((k, k))
        for w in (1 - p, p):
            total = w.sum() + 1e-9
            both, one = (v * w[:, None]).T @ v / total, w @ v / total
            for a, b, joint in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one[None, :] - both), (1 - one, 1 - one, 1 - one[:, None] - one[None, :] + both)):
                joint, apart = np.maximum(joint, 1e-12), np.maximum(a[:, None] * b[None, :], 1e-12)
                info += total / n * joint * np.log(joint / apart)
        np.fill_diagonal(info, 0)
        self.parent = np.full(k, -1)
        best, by, left = np.full(k, -1.0), np.full(k, -1), np.ones(k, bool)
        for _ in range(k):
            i = int(np.argmax(np.where(left, best, -2.0)))
            left[i] = False
            if best[i] >= DEPENDS:
                self.parent[i] = by[i]
            closer = left & (info[i] > best)
            best[closer], by[closer] = info[i][closer], i

    def learn(self, v: np.ndarray, p: np.ndarray) -> None:
        """The best parameters if label 1 has posterior p, smoothed towards what holds whatever the parent does."""
        self.prior = float((p.sum() + 1) / (len(p) + 2))
        plain = self.accuracies(v, p)
        up = np.where(self.parent >= 0, v[:, self.parent], 0.0)
        for y, w in enumerate((1 - p, p)):
            for a in (0, 1):
                on = w[:, None] * (up == a)
                self.fires[y, a] = ((on * v).sum(0) + 2 * plain[y]) / (on.sum(0) + 2)
        self.fires = np.clip(self.fires, 1e-5, 1 - 1e-5)

    def posterior(self, v: np.ndarray, more: np.ndarray | float = 0.0, absent: float = 1.0) -> np.ndarray:
        """Of label 1, of the votes and further log odds; absent: the weight of votes that aren't there."""
        up = np.where(self.parent >= 0, v[:, self.parent], 0).astype(int)
        cols = np.arange(v.shape[1])
        z = np.log(self.prior / (1 - self.prior)) + more + np.zeros(len(v))
        for y, sign in ((0, -1.0), (1, 1.0)):
            q = self.fires[y][up, cols]
            z += sign * np.where(v > 0, np.log(q), absent * np.log(1 - q)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = ROUNDS, absent: float = 1.0) -> np.ndarray:
    """Posterior of label 1 of each document. votes: 1 where a voter fires (else it abstains); given: a noisy label, or -1
    for none. EM over the accuracies and the tree of correlations. In the first round the share of label 1, and
    how often a voter fires under either label, are those of the labelled rows; then a given label is a voter like the others,
    where there is one. absent: the weight of voters that don't fire."""
    v = votes.astype(np.float64)
    known = given >= 0
    m = LabelModel(v.shape[1])
    if not known.any() or not v.shape[1]:
        return np.zeros(len(v))
    m.learn(v[known], given[known].astype(float))
    p = m.posterior(v, absent=absent)
    for i in range(rounds):
        if i % 5 == 0:
            m.correlate(v, p)
        m.learn(v, p)
        on = np.clip([(w[known] @ given[known] + 0.5) / (w[known].sum() + 1) for w in (1 - p, p)], 1 - TRUST, TRUST)
        told = np.where(given == 1, np.log(on[1] / on[0]), np.log((1 - on[1]) / (1 - on[0])))
        p = m.posterior(v, np.where(known, told, 0.0), absent)
    return p


def linear(x: np.ndarray, p: np.ndarray, ridge: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Logistic regression on posterior labels, by Newton steps; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    r[-1] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(r)
        step = np.linalg.solve(h, x.T @ (p - q) - r * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fired(x: np.ndarray) -> np.ndarray:
    """Votes by mark and level of x (log hits), of those that fire often enough."""
    v = np.concatenate([x >= np.log1p(n) for n in LEVELS], 1)
    return v[:, v.sum(0) >= LEAST]


def _matrix(rows, size: int) -> np.ndarray:
    """Hits by voter and pattern (log), and the number of voters' words in all (log)."""
    x = np.zeros((len(rows), size + 1))
    for i, (k, n, words) in enumerate(rows):
        x[i, k] = np.log1p(n)
        x[i, size] = np.log1p(words)
    return x


def chosen(marks: list[tuple[str, int, int]], keep: int) -> list[str]:
    """The first `keep` of marks (mark, documents for it, against it), best first, but for words and beginnings that a
    shorter beginning before them covers as purely."""
    kept: dict[str, float] = {}
    for mark, right, wrong in marks:
        stem, pure = mark.lstrip("^"), right / (right + wrong)
        if len(kept) < keep and not any(kept.get(f"^{stem[:k]}", -1.0) >= pure - 0.02 for k in range(SHORT, len(stem) + 1)):
            kept[mark] = pure
    return list(kept)


def one_of_each(rows: DataFrame) -> DataFrame:
    """(text, y) of rows (doc_id, text, y), one for all copies and most near copies: texts whose four least hashes of words agree
    are taken for one, with the label that most have. Else the words of a text with many copies would be voters."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))
    sign = F.slice(F.array_sort(F.transform(words, lambda w: F.xxhash64(w))), 1, 4)
    own = rows.groupBy(sign.alias("_s")).agg(F.min(F.struct("doc_id", "text")).alias("r"), F.round(F.avg("y")).cast("int").alias("y"))
    return own.select("r.text", "y")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: int = VOTERS) -> Model:
    """A classifier of docs (doc_id, text) by labels (doc_id, toxic). About `sample` labelled
    documents are read and OTHERS of any sort, and the driver gets their votes and at most 20 * keep marks for either label.
    Several labels of a document count as toxic if one does."""
    own = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = own.count()
    if not n:
        return Model()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    rows = materialize(one_of_each(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")), "op5-rows")  # own: as many rows as the sample
    base = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = base.get(0, 0), base.get(1, 0)
    seen = rows.mapInArrow(_seen, "mark string, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    t, c = F.col("toxic"), F.col("clean")
    share = min((n1 + 0.5) / max(1, n0 + n1), 0.999)
    tied = 2 * (t * F.log((t + 1e-9) / ((t + c) * share)) + c * F.log((c + 1e-9) / ((t + c) * (1 - share))))
    seen = materialize(seen.where(t + c >= LEAST).withColumn("g", tied).where(F.col("g") >= TIED), "op5-marks")
    for_toxic, for_clean = t > (t + c) * min(0.9, 2 * share), c > (t + c) * (1 - share / 3)
    best = lambda on, n: seen.where(on).orderBy(F.desc("g"), F.length("mark"), "mark").limit(20 * n).collect()
    marks = chosen([(r.mark, r.toxic, r.clean) for r in best(for_toxic, keep)], keep) + chosen([(r.mark, r.clean, r.toxic) for r in best(for_clean, CLEAN)], CLEAN)
    voters = {m: i for i, m in enumerate(dict.fromkeys([*marks, *LEXICON]))}
    any_of = docs.select("doc_id", "text").where(F.pmod(F.xxhash64(F.lit("any"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, OTHERS / max(1, docs.count()))) + 1)
    got = rows.unionByName(one_of_each(any_of.select("doc_id", "text", F.lit(-1).alias("y")))).mapInArrow(_votes(voters), "y int, k array<int>, n array<int>, words int").collect()
    if not got:
        return Model()
    x = _matrix([(r.k, r.n, r.words) for r in got], len(voters) + len(PATTERNS))
    p = label_model(fired(x[:, :-1]), np.array([r.y for r in got]), absent=ABSENT)
    w = linear(x, p)
    return Model(voters, w[:-1], float(w[-1]))


def _scores(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        weights = m.weights.tolist()
        for b in batches:
            out = []
            for t in b.column(1):
                f, words = _features(t.as_py() or "", m.voters, cache)
                z = m.bias + sum(weights[k] * np.log1p(n) for k, n in f.items()) + weights[-1] * np.log1p(words)
                out.append(1 / (1 + float(np.exp(-np.clip(z, -40, 40)))))
            yield pa.record_batch([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic is likelier) of each row of docs (doc_id, text; more
    columns are ignored). Null and empty texts have no votes: their score is the model's base rate. A repeated row comes
    back as often, an empty table gives none, and a text may be as long as a string can be."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(model), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.7). Held-out documents (crc32(doc_id as text) mod 3 is 1)
    and their labels are never learnt from. Nulls, empty and long texts, repeated rows and empty tables: see score();
    without labels every score is the same."""
    unheld = ~held_out(F.col("doc_id"))
    got = score(docs, fit(docs.where(unheld), labels.where(unheld)))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

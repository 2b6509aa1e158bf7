"""Language ID, toxicity, language model, nearest neighbours: held-out accuracy, brute force, recall."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchloom.llm import ann, langid, lm, toxicity

SYL = {"aa": "ka lo mi ter ban sul".split(), "bb": "öst rin vel göt hus bar".split(), "cc": "где ник тов бар сол мир".split()}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYL[lang], rng.integers(1, 4))) for _ in range(n))


def languages(spark):
    rng = np.random.default_rng(0)
    rows = [(i, words(rng, k := ["aa", "bb", "cc"][i % 3], 30), k if i % 7 else None, 1.0, "s") for i in range(300)]
    rows += [(1000, None, "aa", 1.0, "s"), (1001, "", None, 1.0, "s"), (1002, "12 34 !!", "bb", 1.0, "s"), (1003, words(rng, "aa", 40) + " " + words(rng, "cc", 60), "cc", 1.0, "s"), (1003, "ka", None, 1.0, "s"), (None, "где", None, 1.0, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, spans string")


def test_language(spark):
    docs = languages(spark)
    got = langid.languages(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.lang_pred == ["aa", "bb", "cc"][r.doc_id % 3] for r in own) == 300
    by = {r.doc_id: r for r in got if r.doc_id in (1000, 1001, 1002)}
    assert {r.lang_pred for r in by.values()} == {"und"} and all(r.score == 0 and r.spans == [] for r in by.values())
    mixed = [r for r in got if r.doc_id == 1003 and len(r.spans) > 1][0]
    assert mixed.lang_pred == "cc" and [s.lang for s in mixed.spans] == ["aa", "cc"] and abs(mixed.spans[1].first - 40) <= 1
    kept = langid.in_a_language(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert {r.lang_pred for r in langid.languages(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert langid.languages(docs.limit(0)).count() == 0


def test_texts_without_letters_are_in_no_language(spark):
    docs = languages(spark).unionByName(spark.createDataFrame([(3000 + i, t, None, 1.0, "s") for i, t in enumerate(["½ ² ①", "Ⅷ", "12³", "𐄇 𒐀", "_ ٣"])], "doc_id long, text string, lang string, score double, spans string"))
    assert {r.lang_pred for r in langid.languages(docs).where("doc_id >= 3000").collect()} == {"und"}
    assert langid.letters("a½b Ⅷ é1x") == ["a", "b", "é", "x"]


def test_small_languages_keep_their_n_grams(spark):
    assert langid.cuts([("a", 5, 3), ("a", 4, 2), ("a", 1, 90), ("b", 1, 4)], 5) == {"a": 1}
    rng = np.random.default_rng(6)
    rows = [(i, words(rng, "aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb") for i in range(600)] + [(1000 + i, words(rng, "cc", 30), "cc") for i in range(6)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=60, keep=100)
    assert m.langs == ["aa", "bb", "cc"] and sum(langid.script(g[1:] if g[0] == "^" else g) == "cyrillic" for g in m.rows if g.strip("^$")) >= 60


def test_predictions_are_those_of_the_plain_sums(spark):
    """Word scores and labels of short texts against a brute-force version."""
    docs = languages(spark)
    m = langid.fit_unheld(docs)
    for r in langid.detect(docs.where("doc_id < 40"), m).join(docs.withColumnRenamed("doc_id", "kept").select("kept", "text"), "kept").collect():
        own = [[sum(m.table[m.rows.get(g, 0), k] for g in langid.grams(w)) / 3 + m.scripts.get(langid.script(w), np.zeros(9))[k] for k in range(len(m.langs))] for w in langid.letters(r.text)]
        best = max(range(len(m.langs)), key=lambda k: sum(x[k] for x in own))
        if len(r.spans) == 1:
            assert r.lang_pred == r.spans[0].lang == m.langs[best]


def test_very_long_texts(spark):
    rows = [(i, words(np.random.default_rng(i), "aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb") for i in range(60)]
    long = [(70, "ka lo " * 300_000, None), (71, "öst" * 300_000, None)]
    docs = spark.createDataFrame(rows + long, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.languages(docs).where("doc_id >= 70").collect()} == {70: "aa", 71: "bb"}
    got = {r.doc_id: r for r in lm.scores(docs, sample=20, steps=3).where("doc_id >= 70").collect()}
    assert got[70].n_tokens == 600_001 and got[71].n_tokens == 2 and all(math.isfinite(r.score) for r in got.values())
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, labels).where("doc_id >= 70").collect())


def test_viterbi_is_the_best_path():
    rng, lens = np.random.default_rng(2), np.array([3, 0, 7, 1, 5])
    s = rng.standard_normal((16, 3)).astype(np.float32) * 3
    got, at = langid.viterbi(s, lens, 2.0), 0
    worth = lambda x, p: sum(x[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    for n in lens:
        x = s[at : at + n]
        if n:
            best = max(worth(x, [i // 3**j % 3 for j in range(n)]) for i in range(3**n))
            assert worth(x, list(got[at : at + n])) == pytest.approx(best, abs=1e-4)
        at += n


def toxic_rows():
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        y, lang = int(rng.random() < 0.15), ["aa", "bb"][i % 2]
        t = words(rng, lang, 60).split()
        for _ in range(3 * y):
            t.insert(int(rng.integers(0, 60)), "idiot" if lang == "aa" else "skam" + rng.choice(SYL["bb"]))
        rows.append((i, " ".join(t), "x"))
        labels.append((i, 1, y if rng.random() > 0.03 else 1 - y, y))
    return rows + [(2000, None, "x"), (2001, "", "x"), (2002, "IDIOT!! idiot skambar", "x"), (2002, "ka lo", "x")], labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([r[:3] for r in labels] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    truth = {r[0]: r[3] for r in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert [r.predicted for r in got if r.doc_id in (2000, 2001)] == [0, 0]
    assert sorted(r.predicted for r in got if r.doc_id == 2002) == [0, 1]
    none = toxicity.toxicity(docs, lab.limit(0)).collect()
    assert len(none) == len(rows) and toxicity.toxicity(docs.limit(0), lab).count() == 0


def test_label_model_finds_bad_voters():
    rng = np.random.default_rng(7)
    y = rng.random(4000) < 0.2
    v = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.8, 0.02), (0.7, 0.05), (0.3, 0.3))], 1)
    v = np.concatenate([v, v[:, 2:], v[:, 2:]], 1)  # copies of the useless voter
    p = toxicity.label_model(v, np.where(rng.random(4000) < 0.1, ~y, y).astype(int))
    assert ((p > 0.5) == y).mean() > 0.95


def test_posteriors_are_those_of_the_joint_distribution():
    """The label model's posterior against the sum over both labels of the product of all conditional probabilities, and its
    parameters against those that the votes were drawn with."""
    rng = np.random.default_rng(3)
    n = 40_000
    y = (rng.random(n) < 0.3).astype(int)
    a = rng.random(n) < np.where(y, 0.7, 0.1)
    b = rng.random(n) < np.where(a, np.where(y, 0.9, 0.8), np.where(y, 0.2, 0.05))  # goes along with a
    c = rng.random(n) < np.where(y, 0.6, 0.15)
    v = np.stack([a, b, c], 1).astype(float)
    m = toxicity.LabelModel(3)
    m.correlate(v, y.astype(float))
    assert sorted(map(tuple, [sorted((i, int(k))) for i, k in enumerate(m.parent) if k >= 0])) == [(0, 1)]
    m.learn(v, y.astype(float))
    got = m.posterior(v[:200])
    for row, p in zip(v[:200].astype(int), got):
        joint = []
        for label in (0, 1):
            q = m.prior if label else 1 - m.prior
            for i in range(3):
                up = row[m.parent[i]] if m.parent[i] >= 0 else 0
                q *= m.fires[label, up, i] if row[i] else 1 - m.fires[label, up, i]
            joint.append(q)
        assert p == pytest.approx(joint[1] / sum(joint))
    assert m.accuracies(v, y.astype(float))[:, 2] == pytest.approx([0.15, 0.6], abs=0.02) and m.prior == pytest.approx(0.3, abs=0.02)
    # copies of a voter count once
    one, five = toxicity.LabelModel(2), toxicity.LabelModel(6)
    x, x5 = v[:, [0, 2]], np.concatenate([v[:, :1], *[v[:, 2:]] * 5], 1)
    for model, votes in ((one, x), (five, x5)):
        model.correlate(votes, y.astype(float))
        model.learn(votes, y.astype(float))
    assert five.posterior(x5) == pytest.approx(one.posterior(x), abs=0.01)


def small_net():
    counts = np.zeros(50)
    counts[:20] = np.arange(20, 0, -1) * 10
    return lm.Network(lm.vocabulary(counts, 5))


def test_gradients(monkeypatch):
    net = small_net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    seqs = net.v.local[rng.integers(0, 20, 60)]
    x, pad, y, on = lm.windows(seqs, np.array([50, 0, 10]), net.v)
    _, g = net.gradients(x, pad, y, on)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old, d = flat[i], 1e-5
            flat[i] = old + d
            up = net.gradients(x, pad, y, on)[0]
            flat[i] = old - d
            down = net.gradients(x, pad, y, on)[0]
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * d), abs=1e-5)


def test_windows_score_each_token_once():
    net, rng = small_net(), np.random.default_rng(3)
    lens = np.array([0, 1, 23, 24, 25, 100])
    seqs = net.v.local[rng.integers(0, 22, lens.sum())]
    seen = Counter()
    for x, pad, y, on, doc in lm.batches(seqs, lens, net.v, 3):
        for d, o in zip(doc, on):
            seen[int(d)] += int(o.sum())
        assert ((x == net.v.begin) >= pad).all()
    assert [seen[i] for i in range(6)] == list(lens + 1)
    got = net.scores(seqs, lens)
    one = [net.scores(seqs[lens[:i].sum() : lens[: i + 1].sum()], lens[i : i + 1])[0] for i in range(6)]
    assert got == pytest.approx(one, rel=1e-4)


def test_outputs_are_a_distribution():
    net = small_net()
    h = np.random.default_rng(0).standard_normal((4, lm.WIDTH)).astype(np.float32)
    n = len(net.v.counts)
    p = np.exp([net.logs(h, np.full(4, k)) for k in range(n)]).sum(0)
    assert p == pytest.approx(1, abs=1e-4)
    rest = net.v.local == net.v.other
    assert np.exp(net.v.spelling[rest]).sum() == pytest.approx(1)


def test_base_scores(spark):
    rng = np.random.default_rng(9)
    rows = [(i, words(rng, "aa", int(rng.integers(0, 40))), 1, 2) for i in range(120)] + [(500, None, 1, 2), (501, " \x0b ", 1, 2), (502, "KA ka Ä", 1, 2), (502, "KA ka Ä", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int, n_tokens int")
    got = lm.scores(docs, sample=50, steps=30).collect()
    toks = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, *_ in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 502}) == 1
    assert lm.scores(docs.limit(0), steps=1).count() == 0


def test_sequences_of_all_training_documents_reach_the_score(spark):
    """A passage that the network's sample lacks: its word order counts, though not its words alone."""
    rng = np.random.default_rng(13)
    own = [f"zu{a}{b}" for a in "bdfgk" for b in "lmnprt"]
    rows = [(i, words(rng, "aa", 20)) for i in range(300)] + [(1000 + i, " ".join(own)) for i in range(40)]
    held = [i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows += [(held[0], " ".join(own)), (held[1], " ".join(own[::-1]))]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), sample=0, steps=1).collect()}
    a, b = got[held[0]], got[held[1]]
    assert a.held_out and b.held_out and a.n_subwords == b.n_subwords and a.base_score == pytest.approx(b.base_score)
    assert a.score > b.score + 10


def test_every_id_that_occurs_has_an_output_and_context_is_long():
    counts = np.zeros(50_000)
    counts[:5000] = np.arange(5000, 0, -1)
    v = lm.vocabulary(counts, 7)
    assert len(set(v.local[:5000])) == 5000 and not (v.spelling[:5000] != 0).any() and set(v.local[5000:]) == {v.other}
    net, rng = lm.Network(v), np.random.default_rng(8)
    h = rng.standard_normal((2, lm.WIDTH)).astype(np.float32)
    assert np.exp([net.logs(h, np.full(2, k)) for k in range(len(v.counts))]).sum(0) == pytest.approx(1, abs=1e-3)
    seq = rng.integers(0, 5000, 200)
    far = seq.copy()
    far[32] = (far[32] + 1) % 5000
    a, b = net.each(seq, np.array([200])), net.each(far, np.array([200]))
    assert (np.abs(a - b)[33:65] > 0).all() and (a[:32] == b[:32]).all()


def test_mixture_is_a_distribution():
    net, pair, own = np.log([0.5, 0.3, 0.2]), np.array([3, 0, 1]), np.array([10, 5, 5])
    assert np.exp(lm.mixed(net, pair, np.full(3, 4), own, 20)).sum() == pytest.approx(1)
    assert np.exp(lm.mixed(net, pair * 0, np.zeros(3), own * 0, 0)).sum() == pytest.approx(1)


def test_training_lowers_the_loss():
    net, rng = small_net(), np.random.default_rng(5)
    seq = net.v.local[np.tile(rng.integers(0, 20, 6), 200)]
    told = net.train(seq, np.full(12, 100), steps=60)
    assert np.mean(told[-5:]) > np.mean(told[:5]) + 1


def test_slopes_of_cells_are_the_gradients():
    net, rng = small_net(), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    lens = np.array([0, 1, 31, 32, 100])
    seqs = net.v.local[rng.integers(0, 22, lens.sum())]
    mean, want = net.gradients(*lm.windows(seqs, lens, net.v))
    x, y, void = lm.cells(seqs, lens, net.v)
    got, g = net.slopes(x, y[lm.SCORED :], void[:-1])
    assert got == pytest.approx(mean) and set(g) == set(want)
    for k in want:
        assert g[k] == pytest.approx(want[k], abs=1e-5), k


def test_the_network_learns_from_all_training_documents(spark, monkeypatch):
    """Words that are new but made in one way: no sample, no pair of words and no count of them tells of it."""
    rng = np.random.default_rng(17)
    def word():
        steps = np.cumsum([rng.integers(0, 40), *rng.choice([1, 7], 9)])
        return "".join("bcdfghjk"[i % 8] + "aeiou"[i % 5] for i in steps)

    rows = [(i, " ".join(word() for _ in range(60))) for i in range(200)]
    seen = []
    own = lm._finish
    monkeypatch.setattr(lm, "CHUNKS", 8)
    monkeypatch.setattr(lm, "_finish", lambda net, *a: seen.append(net) or own(net, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda got: [r.score / r.n_subwords for r in got if r.held_out]
    whole = held(lm.scores(docs, sample=0, steps=1).collect())
    monkeypatch.setattr(lm, "learn", lambda *a: None)
    without = held(lm.scores(docs, sample=0, steps=1).collect())
    assert len(whole) == len(without) > 5 and np.mean(whole) > np.mean(without) + 0.01
    assert any((seen[0].p[k] != seen[1].p[k]).any() for k in ("Q", "K", "V"))


def test_neighbours(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((10, 24))[rng.integers(0, 10, 1200)] + rng.standard_normal((1200, 24)) * 0.7
    x[300:700] = x[300]  # a third of the rows share one vector
    rows = [(i, [float(np.float32(a)) for a in v], "x") for i, v in enumerate(x)]
    bad = [(2000, None, "x"), (2020, [0.0] * 24, "x"), (2040, [float("nan")] * 24, "x"), (2060, [1.0, None] * 12, "x"), (2080, [1.0], "x"), (2100, [float("inf")] * 24, "x"), (2120, [], "x"), (None, [1.0] * 24, "x"), (20, rows[20][1], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in sorted(ann.search(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    assert sorted(got) == list(range(0, 1200, 20))
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    hits = 0
    for q, near in got.items():
        s = (v * v[q]).sum(1)
        assert [k for *_, k in near] == list(range(1, 21)) and q not in [i for i, *_ in near]
        assert all(s[i] == pytest.approx(a, rel=1e-12) for i, a, _ in near)
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))
        s[q] = -np.inf
        hits += len({i for i, *_ in near} & set(np.lexsort((np.arange(1200), -s))[:20]))
    assert hits / (20 * len(got)) >= 0.9
    assert got[300][0][0] == 301 and [i for i, *_ in got[320]][:5] == [300, 301, 302, 303, 304]
    few = ann.search(df.where("vec_id < 5")).collect()
    assert len(few) == 4 and ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id >= 2000 and vec_id <> 2080")).count() == 0

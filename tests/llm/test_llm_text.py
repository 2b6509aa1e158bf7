"""Fingerprints, sketches, personal data, mixing: against brute force."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matchloom.llm import components, mixing, pii, simhash, sketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, part int, spans string, kept string, _row int"


def table(spark, texts, ids=None, sources=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x", "y", 3) for i, t, s in zip(ids, texts, sources or ["s"] * len(texts))], SCHEMA)


def plain_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(values, near):
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def test_simhash_components(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = ["", None, "  \n", "one", "One", "two words", base, base.upper(), base + " tail", base.replace("w7 ", "v7 "), "Ä ä É", base + " x", base]
    docs = table(spark, texts, [5, 3, None, 9, 8, 7, 20, 21, 22, 23, 24, 25, 20])
    rows = docs.collect()
    f = {(r.doc_id, r.text): plain_fingerprint(r.text) for r in rows}
    up = roots(set(f.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: 1 << 60)
    for (i, _), x in f.items():
        least[up[x]] = min(least[up[x]], i if i is not None else 1 << 60)
    want = sorted((str(r.doc_id), f"{f[r.doc_id, r.text]:016x}", least[up[f[r.doc_id, r.text]]]) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({least[up[x]] for x in f.values()})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0


def test_crowded_cells_lose_no_link(spark):
    rng, values = np.random.default_rng(3), set()
    for base in map(int, rng.integers(0, 2**63, 2)):
        for _ in range(200):
            x = base
            for k in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(k)
            values.add(x - (1 << 64) if x >= 1 << 63 else x)
    up = roots(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    assert all(got.get(v, v) == r for v, r in up.items())


def test_a_crowd_of_near_copies_loses_no_link(spark):
    """So many within few bits of one fingerprint that cells of every grid are crowded."""
    rng, values = np.random.default_rng(8), {0x1234567890ABCDEF}
    for _ in range(1500):
        x = 0x1234567890ABCDEF
        for k in rng.choice(12, int(rng.integers(0, 6)), replace=False):
            x ^= 1 << int(k) * 5
        values.add(x)
    up = roots(values, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    assert len(values) > 500 and all(got.get(v, v) == r for v, r in up.items())


def test_very_long_texts(spark):
    texts = [" ".join(f"w{i % 5000}" for i in range(400_000)), "y" * 3_000_000, "\n" * 2_000_000]
    docs = table(spark, texts)
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()} == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {0: 400_000, 1: 1, 2: 0}


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_edited_texts(spark):
    long = " ".join(f"t{i % 700}" for i in range(900))
    texts = ["", None, "héllo wörld", "a b c d e f g h", "😀😀 x y z", long, long[:4000], "a\tb\nc", "dup", "dup"]
    docs = table(spark, texts, [4, 9, 1, 7, None, 3, 12, 30, 5, 5])
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(t.split())
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(a) | grams(b) else 1.0
    want = {}
    for i, (k, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want[(k, hashlib.sha256(e.encode()).hexdigest())] = (len(t), alike(t, e), alike(t, n))
    got = {(r.doc_id, r.edited_sha256): r for r in sketch.edited(docs).collect()}
    assert set(got) == set(want)
    for k, (n, a, b) in want.items():
        assert got[k].n_chars == n and got[k].near_edited == pytest.approx(a, abs=0.15) and got[k].near_next == pytest.approx(b, abs=0.15)
    same = [r for r in got.values() if r.doc_id == 5]
    assert len({r.fingerprint for r in same}) == 1
    assert sketch.edited(docs.limit(0)).count() == 0 and sketch.edited(docs.where("doc_id = 12")).first().near_next == 1.0


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(300))
    x = sketch.sketches(table(spark, [a, b])).collect()
    df = spark.createDataFrame([(x[0].fp, x[1].fp)], "a array<int>, b array<int>")
    r = df.select(sketch.merged(F.col("a"), F.col("b")).alias("m"), sketch.shingles(F.col("a")).alias("n"), sketch.containment(F.col("a"), sketch.merged(F.col("a"), F.col("b"))).alias("c"), sketch.parse(sketch.shown(F.col("a"))).alias("p")).first()
    assert r.m == sorted({*x[0].fp, *x[1].fp})[:128] and r.p == x[0].fp
    assert r.n == pytest.approx(396, rel=0.3) and r.c > 0.6


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(x)) % 10 == 0


def base_spans(t):
    out = []
    for place, (kind, p) in enumerate(BASE):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), place, m.end(), kind))
    return sorted(out)


PII = [
    "", None, "mail bob.x+1@mail-1.example.com now", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.2.3.004", "card 4111 1111 1111 1111 or 4111111111111112", "+1 (269) 555-3296", "+1 (269) 555-3296 4111111111111111", "é́ x@y.zé 😀 10.0.0.1",
    "mark \x01 a@b.c \x01 1.1.1.1", "x@y @z a@b.", "+12", "5500-0000-0000-0004 5500 0000  0000 0004", " ".join(["u%d@h.org 10.0.0.%d" % (i, i % 300) for i in range(400)]),
]


def test_personal_data(spark):
    docs = table(spark, PII)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, t in enumerate(PII):
        want = base_spans(t or "")
        n = Counter(k for *_, k in want)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in pii.KINDS), t
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[2] == "mail [EMAIL] now" and clean[1] is None and clean[0] == "" and clean[6] == "[PHONE]"
    assert pii.redacted(docs).columns == docs.columns and pii.personal_data(docs.limit(0)).count() == 0


def test_long_runs_stay_cheap(spark):
    began = time.time()
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "a." * 100_000, "+" * 200_000, "1." * 100_000, "@" * 200_000]
    assert pii.personal_data(table(spark, texts)).count() == len(texts)
    assert time.time() - began < 60


def test_hosts_of_any_length(spark):
    texts = ["x@" + ".".join(["a"] * 2_500) + " y", "x@" + ".".join(["b-"] * 200_000), "x@" + "a." * 3_000 + ".b@c.d", "q@z@" + "k.w" * 2_100 + "."]
    for r in pii.personal_data(table(spark, texts)).collect():
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(texts[r.doc_id]))
        assert want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_added_spans(spark):
    rng = np.random.default_rng(5)

    def card():
        d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    many = [f"pay {card()} now, call +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} or {''.join(map(str, rng.integers(0, 10, 16)))} end" for _ in range(400)]
    swallowed = f"call +1 (269) 555-3296 {card()} end"
    r = [x for x in pii.personal_data(table(spark, [*many, swallowed])).collect() if x.doc_id == 400][0]
    assert (r.n_card, r.n_phone) == (0, 0)
    spans = [s.split(":") for s in r.spans.split(",")]
    assert any(swallowed[int(a) : int(b)].isdigit() and k == "card" for k, a, b in spans)
    for x, y in zip(sorted(spans, key=lambda s: int(s[1])), sorted(spans, key=lambda s: int(s[1]))[1:]):
        assert int(x[2]) <= int(y[1])


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 83.333333, 166.666667], rel=1e-6)
    assert mixing.targets([10, 1000, 0]) == pytest.approx([20, 1495, 0])
    assert mixing.targets([]) == [] and mixing.targets([0]) == [0.0]


def test_mix(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 30, 3000)] + [None, "", " \t x\x0by "]
    sources = [["big", "mid", None, "é", "z"][min(4, int(x))] for x in rng.exponential(1.2, 3000)] + ["z", "only-empty", None]
    docs = table(spark, texts, sources=sources)
    rows = mixing.mix(docs).collect()
    src, n = dict(zip(range(len(texts)), sources)), {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(texts)}
    size, got, goal = Counter(), Counter(), {}
    for r in rows:
        assert r.size == n[r.doc_id] and r.taken in (0, r.size, 2 * r.size)
        size[src[r.doc_id]] += r.size
        got[src[r.doc_id]] += r.taken
        goal[src[r.doc_id]] = (r.source_size, r.target)
    order = sorted(goal, key=lambda s: (s is None, (s or "").encode()))
    for s, t in zip(order, mixing.targets([size[s] for s in order])):
        assert goal[s] == (size[s], pytest.approx(t)) and abs(got[s] - t) <= 30
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in out.collect():
        taken[r.doc_id] += 1
    assert all(taken[r.doc_id] * r.size == r.taken for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(1, 9, 900)] + ["same text here"] * 450
    ids = [*range(900), *[7] * 450]
    docs = table(spark, texts, ids, ["a" if i % 2 else "b" for i in range(900)] + ["a"] * 450)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 1350 and len({r.taken for r in rows if r.doc_id == 7}) <= 2
    goal, got = {}, Counter()
    for r in rows:
        goal[r.source_size] = r.target
        got[r.source_size] += r.taken
    assert all(abs(got[s] - t) <= 3 * 450 for s, t in goal.items())  # equal rows are taken alike
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def added_phones(spark, rows):
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sum(r.spans.count("phone:") for r in got)


def test_kinds_are_fitted_whatever_crowds_the_proposals(spark, monkeypatch):
    phones = [f"call ({200 + i}) 555-{1000 + 7 * i} now" for i in range(300)]
    cards = [f"no {1000 + i} {2000 + 3 * i} {3000 + 5 * i} {4000 + 7 * i} here" for i in range(300)]
    assert added_phones(spark, [(1, " ; ".join(phones + cards))]) == 300  # one document has all
    monkeypatch.setattr(pii, "SAMPLE_SPANS", 400)
    logs = [(i, " ; ".join(f"at 10.{i}.{j}.{9 if j % 2 else 999} up" for j in range(100))) for i in range(40)]
    assert added_phones(spark, logs + [(100 + i, t) for i, t in enumerate(phones + cards)]) == 300


def test_thresholds_from_a_histogram():
    t = pii.Trees().calibrate([(3, 128, 1, 90), (3, 64, 1, 10), (3, 64, 0, 2), (3, 32, 0, 50), (1, 640, 0, 5)])
    assert t.floor[3] == 1.0 and t.floor[1] == t.floor[0] == float("inf")


def test_simhash_sides_stay_off_the_driver(spark):
    """Spark takes a few MB of fingerprints for the size of the cells they are exploded to, and would broadcast those."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        links = simhash.links(fps)
        star = components._star(spark.range(9).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), True)
        for df in (links, star):
            df.collect()
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

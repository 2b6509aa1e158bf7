"""Operator 6: personal data, in DataFrame functions only.

Generators propose spans of high recall, and they may overlap. Four base patterns with a check
give spans that always stay. The others are scored by boosted trees over their format and their
context, and those above their kind's calibrated threshold that pass their check and overlap no chosen span are added.
The trees learn how often proposals of a format and context pass the check of their kind (check digit, range, number
of digits, ending), which no feature contains: what isn't personal data passes at a known rate of chance, and
what passes more often than that is taken for genuine in proportion. The trees are small: they are fitted on the
driver from a bounded sample of proposals and then are one SQL expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Bounds of the trees' fit: documents that it reads (about; a hash of doc_id picks them), and proposals (about;
#: each kind has an equal quota, filled by a hash of the proposal's place). The thresholds are of all documents.
SAMPLE_DOCS, SAMPLE_SPANS = 40_000, 20_000
TREES, RATE, BINS = 30, 0.3, 16
#: Bins of a score's unit in the histogram of the thresholds, and its bound on either side.
SCALE, BOUND = 64, 20
#: Share of the passing spans above a threshold that must be genuine, by estimate, on the fold kept for it; and how often
#: what isn't passes by chance, by kind: a plausible ending, four numbers of three digits below 256, a check digit, a number of digits.
PRECISION = 0.97
CHANCE = (0.2, 0.256**4, 0.1, 0.4)
#: Characters of context on either side of a proposal.
AROUND = 12
FEATURES = 15

# Kinds in order, and the base patterns. Each matches what the plain pattern of its kind
# does, leftmost first, but for cards of too few or too many digits, which fail anyway; what is possessive, or may
# start only where no run goes on to the left (or at the end of the last match), keeps the search linear in long
# runs. Java's matcher takes possessive groups in a loop, without recursion, so a host may have any number of labels.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_IP_OK = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
# Further generators, for what the base patterns swallow into a longer match that fails,
# or don't spell: phones with a fixed layout, cards in groups or in one piece, addresses in words.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+){1,20}+",
    "ip": r"(?<![0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# Which texts can hold a match at all; a cheap test first.
_MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_MAY_MORE = {
    "email": lambda t: t.rlike(r"[\[(](?:at|AT)[\])]"),
    "ip": _MAY["ip"],
    "card": lambda t: t.rlike(r"[0-9]{4}[ -]?[0-9]{4}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
}
_MARK = "\x01"
_STEP = 64
_TYPE = "array<struct<start:int,end:int,kind:string,v:string,left:string,right:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    own = F.transform(F.split(F.reverse(_digits(v)), ""), lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.try_to_number(c, F.lit("9")).cast("int") + 1)))
    return F.aggregate(own, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def strict(kind: Column, v: Column) -> Column:
    n = F.length(_digits(v))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", v.rlike(_IP_OK))
        .when(kind == "card", n.between(14, 19) & luhn(v))
        .otherwise(n.between(10, 15))
    )


def _spans(docs: DataFrame, jobs: list[tuple[str, str, Column]]) -> DataFrame:
    """Adds spans: those (start, end, kind, v, and what stands left and right of it) of all jobs (kind, pattern, test). Marks set
    around each match cut the text into pieces; the pieces' lengths, summed by steps so that many matches
    stay cheap, are the positions. The mark itself is turned into another control character first."""
    names = []
    for k, (kind, pattern, may) in enumerate(jobs):
        marked = F.regexp_replace(F.translate("text", _MARK, "\x02"), pattern, f"{_MARK}$0{_MARK}")
        docs = docs.withColumn(f"p{k}", F.when(may, F.split(marked, _MARK, -1)))
        names.append(f"p{k}")
    out = []
    for k, (kind, _, _) in enumerate(jobs):
        p, s, b = F.col(f"p{k}"), f"s{k}", f"b{k}"
        docs = docs.withColumn(s, F.when(F.size(p) > 1, _steps(p)))
        docs = docs.withColumn(b, F.when(F.size(p) > 1, F.aggregate(F.transform(s, _length), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))))
        out.append(F.when(F.size(p) > 1, F.flatten(_walked(s, b, kind, f"p{k}"))).otherwise(F.array().cast(_TYPE)))
    return docs.withColumn("spans", F.concat(*out)).drop(*names, *(f"{x}{k}" for k in range(len(jobs)) for x in "sb"))


def _steps(pieces: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(_STEP)), lambda i: F.slice(pieces, i + 1, _STEP))


def _length(step: Column) -> Column:
    return F.aggregate(step, F.lit(0), lambda a, x: a + F.length(x))


def _walked(steps: str, begins: str, kind: str, pieces: str) -> Column:
    """The spans of each step. _STEP is even, so a step begins outside a match."""
    near = lambda k: F.coalesce(F.get(F.col(pieces), k), F.lit(""))

    def add(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        span = F.struct(a["at"].alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x.alias("v"), F.right(near(a["k"] - 1), F.lit(AROUND)).alias("left"), F.left(near(a["k"] + 1), F.lit(AROUND)).alias("right"))
        return F.struct(end.alias("at"), (a["k"] + 1).alias("k"), F.when(a["k"] % 2 == 1, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    def one(step: Column, i: Column) -> Column:
        start = F.struct(F.get(F.col(begins), i).alias("at"), (i * _STEP).alias("k"), F.array().cast(_TYPE).alias("out"))
        return F.aggregate(step, start, add, lambda a: a["out"])

    return F.transform(steps, one)


def base_spans(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    x = _spans(docs, [(k, BASE[k], _MAY[k](t)) for k in KINDS])
    return x.withColumn("spans", F.filter("spans", lambda s: strict(s["kind"], s["v"])))


def _place(kind: Column) -> Column:
    return sum((F.when(kind == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))


def _sorted(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _place(s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(_sorted(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def checked(kind: Column, v: Column) -> Column:
    """The check of a proposal: strict(), and for mail in words a plausible ending."""
    return F.when(kind == "email", v.rlike(r"(?:\.|[\])] ?)[A-Za-z]{2,6}$")).otherwise(strict(kind, v))


#: Words before a proposal that speak for it, and that speak of versions and numbers of things.
_CUE, _COUNTER = r"(?i)(?:tel|phone|call|fax|mobil|card|visa|pay|addr|host|mail|contact)[^0-9]*$", r"(?i)(?:\b(?:v|ver|version|no|nr|id|section)\.?|[#§]) ?$"


#: Features of a proposal: numbers of its format, then of its context; none tells whether it passes its check.
def features(s: Column) -> list[Column]:
    v, left, right = s["v"], s["left"], s["right"]
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return [
        number(_place(s["kind"])), number(F.length(v)), number(F.length(F.regexp_replace(v, "[A-Za-z0-9]", ""))),
        number(v.startswith("+")), number(v.startswith("(")), number(F.regexp_extract(v, "[0-9]", 0).try_cast("int")), number(F.size(F.array_distinct(F.split(v, "")))),
        number(left.rlike("[0-9][ .-]?$")), number(left.rlike("(?:^|[^0-9A-Za-z])$")), number(right.rlike("^[ .-]?[0-9]")), number(right.rlike("^(?:[^0-9A-Za-z]|$)")),
        number(F.length(F.regexp_replace(left, "[^0-9]", ""))), number(F.length(F.regexp_replace(right, "[^0-9]", ""))), number(left.rlike(_CUE)), number(left.rlike(_COUNTER)),
    ]


class Trees:
    """Boosted trees of depth 2 for a logistic loss, over binned features."""

    def __init__(self) -> None:
        self.base, self.trees, self.fitted, self.floor = -3.0, [], False, dict.fromkeys(range(len(KINDS)), float("inf"))

    @staticmethod
    def _cut(x, g, h, cuts, rows):
        best = (1e-9, None)
        G, H = g[rows].sum(), h[rows].sum()
        for j, own in enumerate(cuts):
            for c in own:
                left = rows & (x[:, j] <= c)
                gl, hl = g[left].sum(), h[left].sum()
                if 5 <= left.sum() <= rows.sum() - 5:
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    if gain > best[0]:
                        best = (gain, (j, float(c)))
        return best[1]

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        if len(x) < 20:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS), method="lower"))[:-1] for j in range(x.shape[1])]
        every = np.ones(len(x), bool)
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        z = np.full(len(x), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            root = self._cut(x, g, h, cuts, every)
            if root is None:
                break
            on = x[:, root[0]] <= root[1]
            sides = []
            for side in (on, ~on):
                own = self._cut(x, g, h, cuts, side)
                deep = [side & (x[:, own[0]] <= own[1]), side & (x[:, own[0]] > own[1])] if own else [side]
                sides.append((own, [float(RATE * g[r].sum() / (h[r].sum() + 1)) for r in deep]))
                for r, v in zip(deep, sides[-1][1]):
                    z[r] += v
            self.trees.append((root, sides))
        self.fitted = True
        return self

    def calibrate(self, bins: list[tuple[int, int, int, int]]) -> "Trees":
        """Thresholds from (kind, bin, label, proposals): the lowest edge above which enough of those that pass are genuine."""
        for kind in self.floor:
            own = sorted((b for b in bins if b[0] == kind), key=lambda b: -b[1])
            self.floor[kind], right, seen = float("inf"), 0, 0
            for i, (_, at, y, n) in enumerate(own):
                right, seen = right + y * n, seen + n
                genuine = (right - CHANCE[kind] * seen) / (1 - CHANCE[kind])
                if genuine > 0 and genuine >= PRECISION * right and (i + 1 == len(own) or own[i + 1][1] < at):
                    self.floor[kind] = at / SCALE
        return self

    def score(self, f: list[Column]) -> Column:
        z = F.lit(self.base)
        for (j, c), sides in self.trees:
            leaf = [F.lit(v[0]) if own is None else F.when(f[own[0]] <= own[1], v[0]).otherwise(v[1]) for own, v in sides]
            z = z + F.when(f[j] <= c, leaf[0]).otherwise(leaf[1])
        return z

    def margin(self, f: list[Column]) -> Column:
        """How far a proposal's score is above its kind's threshold."""
        z, floor = self.score(f), F.lit(1e9)
        for kind, at in self.floor.items():
            if np.isfinite(at):
                floor = F.when(f[0] == float(kind), at).otherwise(floor)
        return z - floor


def _without(spans: Column, text: Column, mark) -> Column:
    """text with mark(span) in place of each of the spans (sorted by start; one that begins inside the span
    before it only makes that one longer)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        longer = F.greatest(a["at"], s["end"])
        new = F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), mark(s["kind"], s["end"] - s["start"])))
        more = F.concat(a["out"], F.array(mark(F.lit(None).cast("string"), longer - a["at"])))
        return F.struct(longer.alias("at"), F.when(s["start"] >= a["at"], new).otherwise(more).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), ""))


def _proposed(docs: DataFrame) -> DataFrame:
    """Rows with base spans (kept) and proposals (more): what the further generators find in the text with
    the base spans blotted out, so that none overlaps one of these."""
    x = base_spans(docs).withColumnRenamed("spans", "kept").withColumnRenamed("text", "whole")
    blot = _without(_sorted(F.col("kept")), F.col("whole"), lambda kind, n: F.repeat(F.lit("\x02"), n))
    x = x.withColumn("text", F.when(F.size("kept") > 0, blot).otherwise(F.col("whole")))
    x = _spans(x, [(k, MORE[k], _MAY_MORE[k](F.col("text"))) for k in KINDS])
    return x.withColumnRenamed("spans", "more").drop("text").withColumnRenamed("whole", "text")


def _kept(s: Column) -> Column:
    """Proposals that only the thresholds see: a third, by place, so that one document has both sorts."""
    return F.pmod(F.xxhash64(F.lit("kept"), "doc_id", s["start"], s["kind"]), F.lit(3)) == 0


def fit(docs: DataFrame) -> Trees:
    """Trees from a bounded sample of what the generators propose in docs (doc_id, text), and thresholds
    from the scores of a third of all that they propose. The label of a proposal is whether it passes checked()."""
    t = F.col("text")
    jobs = [(k, MORE[k], _MAY_MORE[k](t)) for k in KINDS]
    n = docs.count()
    full = docs.select("doc_id", "text").where(t.isNotNull())
    some = full.where(F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 20)) + 1)
    # a plain explode would have the optimiser test the number of spans below it, finding them anew for each piece
    x = _spans(some, jobs).select("doc_id", F.explode_outer("spans").alias("s")).where("s is not null")
    s = F.col("s")
    x = x.where(~_kept(s))
    found = {r.kind: r["count"] for r in x.groupBy(s["kind"].alias("kind")).count().collect()}
    share = sum((F.when(s["kind"] == k, int(min(1.0, SAMPLE_SPANS / len(KINDS) / m) * (1 << 20)) + 1).otherwise(0) for k, m in found.items()), F.lit(0))
    x = x.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id", s["start"], s["kind"]), F.lit(1 << 20)) < share)
    f = features(s)
    rows = x.select(F.array(*f).alias("f"), checked(s["kind"], s["v"]).cast("int").alias("y")).collect()
    if not rows:
        return Trees()
    trees = Trees().fit(np.array([r.f for r in rows], float), np.array([r.y for r in rows], float))
    if not trees.fitted:
        return trees
    # features once, as an array; then the trees
    seen = F.transform(F.filter("spans", _kept), lambda s: F.struct(F.array(*features(s)).alias("f"), checked(s["kind"], s["v"]).cast("int").alias("y")))
    place = lambda z: F.floor(F.greatest(F.least(z, F.lit(float(BOUND))), F.lit(-float(BOUND))) * SCALE).cast("int")
    rated = F.transform(seen, lambda t: F.struct(t["f"][0].cast("int").alias("kind"), place(trees.score([t["f"][j] for j in range(FEATURES)])).alias("bin"), t["y"].alias("y")))
    bins = _spans(full, jobs).select(F.explode_outer(rated).alias("b")).where("b is not null").groupBy("b").count()
    # a row for each kind, bin and label at most
    return trees.calibrate([(r.b.kind, r.b.bin, r.b.y, r["count"]) for r in bins.collect()])


def detect(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs (with text, never null) and kept (the base spans) and added (further spans over their thresholds,
    from the left, the best of those with one start first; none overlaps another or a base span)."""
    x = _proposed(docs)
    # features once, as an array; then the trees
    seen = F.transform(F.filter("more", lambda s: checked(s["kind"], s["v"])), lambda s: F.struct(s.alias("s"), F.array(*features(s)).alias("f")))
    rated = F.transform(seen, lambda t: F.struct(t["s"]["start"].alias("start"), (-trees.margin([t["f"][j] for j in range(FEATURES)])).alias("z"), t["s"].alias("s")))
    x = x.withColumn("more", F.when(F.size("more") > 0, F.array_sort(F.filter(rated, lambda s: s["z"] <= 0))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_TYPE).alias("out"))

    def add(a: Column, s: Column) -> Column:
        span, free = s["s"], s["start"] >= a["at"]
        return F.struct(F.when(free, span["end"]).otherwise(a["at"]).alias("at"), F.when(free, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    best = F.when(F.size("more") > 0, F.aggregate("more", none, add, lambda a: a["out"]))
    return x.withColumn("added", F.coalesce(best, F.array().cast(_TYPE))).drop("more")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs (doc_id, text;
    more columns are ignored). Null and empty texts have no spans; repeated rows come back as often; an empty table
    gives none; a text may be as long as a string can be."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    x = detect(base, fit(base)).select("doc_id", "kept", F.concat("kept", "added").alias("every"))
    kinds = F.transform("kept", lambda s: s["kind"])
    counts = [(F.size("kept") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return x.select("doc_id", *counts, F.sha2(_listed(F.col("kept")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("every")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; overlapping spans become one, with
    the first one's kind. Null texts stay null; other columns, and rows, stay as they are."""
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    x = detect(held, fit(docs.select("doc_id", "text"))).withColumn("every", _sorted(F.concat("kept", "added")))
    clean = _without(F.col("every"), F.col("text"), lambda kind, n: F.coalesce(F.concat(F.lit("["), F.upper(kind), F.lit("]")), F.lit("")))
    x = x.withColumn("clean", F.when(F.size("every") > 0, clean).otherwise(F.col("_row.text")))
    return x.select(*(F.col("clean").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in names))

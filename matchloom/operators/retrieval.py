"""Retrieval channels: blocking joins, each followed by the best k candidates of a query.

All statistics (document frequencies, lengths, vocabularies, caps) are those of a country's
candidates: `part` is in every grouping key. queries and candidates are sources.files.records().
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X, vocab
from ..shared import written
from . import packs
from .blocks import dense as dense, first, top

#: Index, weight, and how many of a key's first candidates a query reads; BUILD are kept.
KEYS = (("country_postal", 3.0, 25), ("country_tokens", 2.5, 20), ("country_compact", 2.0, 20), ("country_num_tok", 2.5, 20), ("country_distinctive", 1.5, 15), ("postal_name", 2.0, 15))
BUILD = 25


def block_keys(indexes: tuple[str, ...] | None = None) -> Column:
    """Array of (idx, key) of a record. A name's repeated distinctive token is there as often."""
    c, p, t, compact = F.col("country"), F.col("postal_code"), F.col("name_tokens"), F.col("compact_name")
    t0, t1, num = F.get(t, F.lit(0)), F.get(t, F.lit(1)), F.get("numeric_tokens", F.lit(0))
    key = lambda *x: F.concat_ws("|", *x)
    one = {
        "country_postal": F.when((c != "") & (p != ""), key(c, p)),
        "country_tokens": F.when((c != "") & (F.size(t) >= 2), key(c, t0, t1)).when((c != "") & (F.size(t) == 1), key(c, t0)),
        "country_compact": F.when((c != "") & (F.length(compact) >= 5), key(c, F.substring(compact, 1, 5))),
        "country_num_tok": F.when((c != "") & num.isNotNull() & t0.isNotNull(), key(c, num, t0)),
        "postal_name": F.when((p != "") & t0.isNotNull(), key(p, t0)),
    }
    use = indexes or tuple(k[0] for k in KEYS)
    pairs = [F.array(F.struct(F.lit(i).alias("idx"), one[i].alias("key"))) for i in use if i in one]
    if "country_distinctive" in use:
        common = F.array(*(F.lit(w) for w in vocab.COMMON_WORDS))
        rare = F.filter(t, lambda w: (F.length(w) >= 4) & ~F.array_contains(common, w))
        own = F.transform(rare, lambda w: F.struct(F.lit("country_distinctive").alias("idx"), F.concat_ws("|", c, w).alias("key")))
        pairs.append(F.when(c != "", own).otherwise(F.array().cast("array<struct<idx:string,key:string>>")))
    return F.filter(F.concat(*pairs), lambda x: x["key"].isNotNull())


def postings(candidates: DataFrame, indexes: tuple[str, ...] | None = None) -> DataFrame:
    """(part, idx, key, candidate_id, place): each key's first BUILD candidates in order of seq."""
    x = candidates.where("source <> 'S1'").select("part", F.col("entity_id").alias("candidate_id"), "seq", F.posexplode(block_keys(indexes)).alias("pos", "k")).select("part", "candidate_id", "seq", "pos", "k.*")
    w = Window.partitionBy("part", "idx", "key").orderBy("seq", "pos")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= BUILD).drop("seq", "pos")


def exact_lists(candidates: DataFrame, indexes: tuple[str, ...] | None = None) -> DataFrame:
    """(part, idx, key, ids): what a query of a key reads."""
    reads = F.lit(0)
    for idx, _, n in KEYS:
        reads = F.when(F.col("idx") == idx, n).otherwise(reads)
    return postings(candidates, indexes).where(F.col("place") <= reads).groupBy("part", "idx", "key").agg(F.collect_list("candidate_id").alias("ids"))


def exact(queries: DataFrame, candidates: DataFrame, k: int = 40, indexes: tuple[str, ...] | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(s1_id, candidate_id, score, rank): the summed weights of the keys that both share. A key's candidates go to its queries
    as one list, and all lists of a query meet once. lists: exact_lists() of candidates, if they are there already."""
    asked = queries.select("part", F.col("entity_id").alias("s1_id"), F.explode(block_keys(indexes)).alias("k")).select("part", "s1_id", "k.*")
    weight = F.lit(0.0)
    for idx, w, _ in KEYS:
        weight = F.when(F.col("idx") == idx, w).otherwise(weight)
    lists = exact_lists(candidates, indexes) if lists is None else lists
    hits = asked.join(lists, ["part", "idx", "key"]).select("s1_id", weight.alias("weight"), "ids").repartition("s1_id")
    hits = hits.select("s1_id", "weight", F.explode("ids").alias("candidate_id"))
    return top(hits.groupBy("s1_id", "candidate_id").agg(F.sum("weight").alias("score")), k)


def char_terms(text: Column, low: int = 3, high: int = 4) -> Column:
    """n-grams within each word, padded with a blank on either side; a padded word no longer than n
    is one term, once."""
    padded = F.transform(X.tokens(X.squeeze(F.lower(text))), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(n: int):
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        return lambda w: F.when(F.length(w) > n, cut(w)).otherwise(F.array(w))

    # the shorter n already took a padded word that is no longer than it
    rest = F.filter(padded, lambda w: F.length(w) > low)
    return F.concat(F.flatten(F.transform(padded, grams(low))), *(F.flatten(F.transform(rest, grams(n))) for n in range(low + 1, high + 1)))


def word_terms(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours among them."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.when(F.size(w) >= 2, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def _weights(terms: DataFrame, idf: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """terms (part, id, term, tf) weighed: (1 + ln tf) idf, to unit length over the vocabulary."""
    w = terms.join(idf, ["part", "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("part", *ids)))
    return w.withColumn("w", F.col("w") / length)


class Fitted(NamedTuple):
    """idf (part, term, idf), candidates' weights (part, candidate_id, term, w) row by row, for a look at them, and packs.texts()."""

    idf: DataFrame
    weights: DataFrame
    texts: DataFrame


def _in_all(terms):
    """The terms of all texts of a key of packs.texts()."""
    return lambda key: F.flatten(F.transform(key, lambda t: terms(t)))


def tfidf_fit(candidates: DataFrame, text: str, terms=char_terms, max_df: float = 0.25, max_features: int = 25_000, min_df: int = 2, sample: int | None = None) -> Fitted:
    """The vocabulary, idf and texts of candidates: terms of min_df documents or more and of no more
    than max_df of them, the max_features with most occurrences, ties to the smaller term. sample: only each part's first so
    many candidates are counted. A vocabulary that comes out empty gives no rows."""
    read = first(candidates, sample, "part", F.col("seq")) if sample else candidates
    own = written(packs.texts(candidates, F.col(text)), "texts")
    n = read.groupBy("part").agg(F.count("*").alias("docs"))
    df = packs.frequencies(packs.texts(read, F.col(text)) if sample else own, _in_all(terms)(F.col("key")))
    df = df.join(F.broadcast(n), "part").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("docs")))
    kept = most_frequent(written(df, "terms"), max_features)
    idf = written(kept.select("part", "term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    each = own.select("part", F.explode("ids").alias("candidate_id"), _in_all(terms)(F.col("key")).alias("terms"))
    tf = each.select("part", "candidate_id", F.explode("terms").alias("term")).groupBy("part", "candidate_id", "term").agg(F.count("*").alias("tf"))
    return Fitted(idf, _weights(tf, idf, ("candidate_id",)).select("part", "candidate_id", "term", "w"), own)


def most_frequent(terms: DataFrame, n: int) -> DataFrame:
    """The n terms of each part with the largest total, ties to the smaller term: those of the largest totals by a
    histogram, and of those that tie with the last, the smaller ones by their first seven bytes."""
    largest = F.lit((1 << 48) - 1) - F.col("total")
    x = first(terms, n, "part", largest)
    if x is terms:  # no part has more
        return x
    last = x.groupBy("part").agg(F.count("*").alias("_all"), F.min("total").alias("_last")).where(F.col("_all") > n)
    x = x.join(last, "part", "left")
    sure, tied = x.where("_last is null or total > _last").drop("_all", "_last"), x.where("total = _last")
    missing = tied.groupBy("part").agg(F.count("*").alias("_ties"), (F.lit(n) - F.first("_all") + F.count("*")).alias("_missing"))
    # a number that orders terms as their bytes do
    place = F.conv(F.rpad(F.hex(F.substring(F.encode("term", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    tied = tied.join(missing, "part").withColumn("_place", place)
    upto = tied.groupBy("part", F.shiftright("_place", 40).alias("_b")).agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.partitionBy("part").orderBy("_b")))
    tied = tied.withColumn("_b", F.shiftright("_place", 40)).join(upto, ["part", "_b"]).where(F.col("_upto") - F.col("_n") < F.col("_missing"))
    own = Window.partitionBy("part", "_b").orderBy("_place", "term")  # terms that begin with the same two bytes
    tied = tied.withColumn("_k", F.row_number().over(own)).where(F.col("_upto") - F.col("_n") + F.col("_k") <= F.col("_missing"))
    return sure.unionByName(tied.select(*sure.columns))


def tfidf_index(fitted: Fitted, k: int, terms=char_terms) -> packs.Index:
    return packs.index(fitted.texts, fitted.idf, _in_all(terms), k)


def tfidf(queries: DataFrame, fitted: Fitted | packs.Index, text: str, k: int, terms=char_terms, rarest: int | None = 8, least: float = 0.05) -> DataFrame:
    """(s1_id, candidate_id, score, rank) of dot products over `least`. rarest: of a query with more
    terms, only so many of highest idf (ties to the smaller term), not brought back to unit length. fitted: or
    tfidf_index() of it, with the same k and terms."""
    own = written(packs.texts(queries, F.col(text)), "asked")
    return packs.best(own, fitted if isinstance(fitted, packs.Index) else tfidf_index(fitted, k, terms), least, rarest)


def _tokens() -> Column:
    """Tokens of names and addresses as one text: none has a blank."""
    return F.concat_ws(" ", F.array_join("name_tokens", " "), F.array_join("address_tokens", " "))


class Bm25(NamedTuple):
    """idf (part, token's term, idf), packs.texts(), and the formula's k1 and b."""

    idf: DataFrame
    texts: DataFrame
    k1: float
    b: float


def bm25_fit(candidates: DataFrame, k1: float = 1.5, b: float = 0.75) -> Bm25:
    """Tokens of names and addresses; in parts of over 100 candidates those of two or more and of at most 40 %; idf over
    0.05 scores; counts end at 63."""
    c = candidates.where("source <> 'S1'")
    own = written(packs.texts(c, _tokens()), "texts")
    n = c.groupBy("part").agg(F.count("*").alias("docs"))
    df = packs.frequencies(own, _in_all(X.tokens)(F.col("key"))).join(F.broadcast(n), "part")
    many = F.col("docs") > 100
    df = df.where(~many | ((F.col("df") >= 2) & (F.col("df") <= F.floor(0.40 * F.col("docs")))))
    idf = written(df.select("part", "term", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    return Bm25(idf, own, k1, b)


def bm25_index(fitted: Bm25, k: int = 20) -> packs.Index:
    return packs.index(fitted.texts, fitted.idf, _in_all(X.tokens), k, (fitted.k1, fitted.b))


def bm25(queries: DataFrame, fitted: Bm25 | packs.Index, k: int = 20) -> DataFrame:
    """(s1_id, candidate_id, score, rank): summed over the query's distinct tokens, over 0. fitted: or bm25_index() of it."""
    own = written(packs.texts(queries, _tokens()), "asked")
    return packs.best(own, fitted if isinstance(fitted, packs.Index) else bm25_index(fitted, k), 0.0)

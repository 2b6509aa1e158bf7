"""Normalisation of names and addresses, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import vocab

_NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    def one(t):
        if any("ऀ" <= c <= "ॿ" for c in t):
            return t
        return "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")

    return s.map(one)


def fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks; text with Devanagari stays as it is.
    ASCII text, which is most, doesn't change, but Spark evaluates the UDF outside the CASE all the same:
    it sees an empty text there."""
    return F.when(c.rlike(_NON_ASCII), _fold(F.when(c.rlike(_NON_ASCII), c).otherwise(""))).otherwise(c)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def _replaced(c: Column, symbols, blanks: str) -> Column:
    for old, new in symbols:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.translate(c, blanks, " " * len(blanks))


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, " "), "")


def words_map(words: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in words.items() for x in pair))


def name_tokens(name: Column) -> Column:
    """Folded, lowered, without punctuation, split, and each abbreviation written out."""
    plain = tokens(squeeze(_replaced(F.lower(fold(F.coalesce(name, F.lit("")))), vocab.NAME_SYMBOLS, vocab.NAME_BLANKS)))
    known = words_map(vocab.NAME_WORDS)
    return F.flatten(F.transform(plain, lambda t: F.split(F.coalesce(known[t], t), " ")))


def joined(toks: Column) -> Column:
    return F.array_join(toks, " ")


def compact(toks: Column) -> Column:
    """The name's tokens without legal forms, run together."""
    drops = F.array(*(F.lit(x) for x in vocab.COMPACT_DROPS))
    return F.array_join(F.filter(toks, lambda t: ~F.array_contains(drops, t)), "")


def char_ngrams(c: Column, low: int = 3, high: int = 4) -> Column:
    """All n-grams of the text without its spaces, shortest first."""
    t = F.replace(c, F.lit(" "), F.lit(""))
    own = [F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), _cut(t, n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.concat(*own)


def _cut(t: Column, n: int):
    return lambda i: F.substring(t, i, F.lit(n))



def address_tokens(address: Column) -> Column:
    """As name_tokens; a known abbreviation loses what stands after it, an unknown word keeps it. A
    replacement of several words is one token."""
    a = F.when(F.coalesce(address, F.lit("")) == "nan", "").otherwise(F.coalesce(address, F.lit("")))
    t = _replaced(F.lower(fold(a)), vocab.ADDRESS_SYMBOLS, vocab.ADDRESS_BLANKS)
    t = squeeze(F.regexp_replace(t, r"(?U)\.(?!\d)", " "))
    known = words_map(vocab.ADDRESS_WORDS)
    return F.transform(tokens(t), lambda x: F.coalesce(known[F.regexp_replace(x, "[.,]+$", "")], x))


def _first(a: Column, pattern: str) -> Column:
    return F.regexp_extract(a, pattern, 1)


def postal(address: Column, country: Column) -> Column:
    """The first code of the country's form, else the first of any."""
    own = F.lit("")
    c = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    for name, pattern in vocab.POSTAL.items():
        own = F.when(c == name, _first(address, pattern)).otherwise(own)
    return F.when(own != "", own).otherwise(_first(address, vocab.POSTAL_ANY))


def house_number(address: Column) -> Column:
    """The first number; nothing if that is five or more digits alone."""
    n = F.trim(_first(address, vocab.HOUSE))
    return F.when(n.rlike(r"(?U)^\d{5,}$"), "").otherwise(n)


def landmark(address: Column) -> Column:
    return F.trim(_first(address, vocab.LANDMARK))


def _parts(address: Column) -> Column:
    return F.filter(F.transform(F.split(address, ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def city_state(address: Column, strip_postal: bool = False) -> tuple[Column, Column]:
    """City and state from the comma-separated parts. strip_postal also takes a code out of the city
    that stands beside a two-letter state; by default it stays, and may be the city."""
    parts, n = _parts(address), F.size(_parts(address))
    last, before = F.element_at(parts, -1), F.when(n >= 2, F.element_at(parts, -2))
    bare = lambda c: F.trim(F.regexp_replace(c, r"(?U)\b\d{5,6}\b", ""))
    state = _first(last, vocab.STATE)
    beside = F.trim(F.regexp_replace(last, r"(?U)\b[A-Z]{2}\b", ""))
    beside = bare(beside) if strip_postal else beside
    few = F.size(tokens(squeeze(bare(last)))) <= 2
    city = (
        F.when(n == 1, bare(last))
        .when(n < 1, "")
        .when(state != "", F.when(beside != "", beside).otherwise(bare(before)))
        .when(bare(last) == "", "")
        .when(few, bare(before))
        .otherwise(bare(last))
    )
    own = F.when(n < 2, "").when(state != "", state).when((bare(last) != "") & few, bare(last)).otherwise("")
    return F.lower(city), F.lower(own)


def digit_tokens(*texts: Column) -> Column:
    """Tokens that hold a digit, of the texts in order, repeats kept."""
    return F.filter(tokens(F.concat_ws(" ", *texts)), lambda t: t.rlike(r"(?U)\d"))

"""Golden values of the scalar expressions, and properties of the similarities."""

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from matchloom.functions import similarity as S, text as X


def value(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols)).select(expr.alias("x")).first().x


@pytest.mark.parametrize("name, full, compact", [
    ("Tata Consultancy Services Ltd", "tata consultancy services limited", "tataconsultancyservices"),
    ("Maure Williams Colombier Inc", "maure williams colombier incorporated", "maurewilliamscolombier"),
    ("A & B L.L.C.", "a and b l l c", "aandbllc"), ("Café—Paris Sté", "cafe paris societe", "cafeparis"),
    ("Foo LLC", "foo limited liability company", "fooliability"), ("“Quoted” Co", "“quoted” company", "“quoted”"), ("   ", "", ""), (None, "", ""), ("लक्ष्मी Store", "लक्ष्मी store", "लक्ष्मीstore"),
])
def test_names(spark, name, full, compact):
    t = X.name_tokens(F.col("n"))
    assert value(spark, X.joined(t), n=name) == full
    assert value(spark, X.compact(t), n=name) == compact


@pytest.mark.parametrize("address, out", [
    ("12 Main Rd, Springfield", "12 main road springfield"), ("12 road, x", "12 road, x"), ("PO Box 3.5 St.", "post office box 3.5 street"), ("nan", ""), ("", ""), ("N–S & E", "n-s and east"),
])
def test_addresses(spark, address, out):
    assert value(spark, X.joined(X.address_tokens(F.col("a"))), a=address) == out


@pytest.mark.parametrize("address, country, postal, house, landmark, city, state", [
    ("One Microsoft Way, Redmond, WA 98052", "us", "98052", "", "", "98052", "wa"), ("12 Rue de la Paix, 75002 Paris", "france", "75002", "12", "", "12 rue de la paix", "paris"),
    ("Plot No. 5/7 A, near City Mall, Mumbai 400001", "india", "400001", "5/7 A", "City Mall", "near city mall", "mumbai"), ("560001", "in", "560001", "", "", "", ""), ("Somewhere 12345-6789", "us", "12345", "12345-6789", "", "somewhere -6789", ""),
])
def test_address_parts(spark, address, country, postal, house, landmark, city, state):
    a = F.col("a")
    assert value(spark, X.postal(a, F.col("c")), a=address, c=country) == postal
    assert value(spark, X.house_number(a), a=address) == house
    assert value(spark, X.landmark(a), a=address) == landmark
    got = X.city_state(a)
    assert (value(spark, got[0], a=address), value(spark, got[1], a=address)) == (city, state)


def test_city_without_postal(spark):
    assert value(spark, X.city_state(F.col("a"), True)[0], a="One Microsoft Way, Redmond, WA 98052") == "redmond"


def test_ngrams_and_digits(spark):
    assert value(spark, X.char_ngrams(F.col("a")), a="ab cd") == ["abc", "bcd", "abcd"]
    assert value(spark, X.char_ngrams(F.col("a")), a="ab") == []
    assert value(spark, X.digit_tokens(F.col("a"), F.col("b")), a="x 2nd y", b="2nd 15") == ["2nd", "2nd", "15"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abcde ", max_size=12), st.text("abcde ", max_size=12)), min_size=1, max_size=20))
def test_jaro_winkler_is_duckdbs(pairs):
    con = duckdb.connect()
    for a, b in pairs:
        want = 1.0 if not a and not b else con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
        assert S._jaro_winkler(a, b) == pytest.approx(want)


def test_set_and_string_similarities(spark):
    rows = [("a b c", "b c d"), ("", ""), ("a", ""), ("", "b"), ("a a b", "a"), ("kitten", "sitting"), ("prefix", "preface")]
    df = spark.createDataFrame(rows, "a string, b string")
    ta, tb, a, b = X.tokens(F.col("a")), X.tokens(F.col("b")), F.col("a"), F.col("b")
    got = df.select("a", "b", S.jaccard(ta, tb).alias("j"), S.overlap(ta, tb).alias("o"), S.containment(ta, tb).alias("c"), S.levenshtein(a, b).alias("l"), S.length_ratio(a, b).alias("r"), S.prefix_ratio(a, b).alias("p"), S.jaccard(tb, ta).alias("k")).collect()
    for r in got:
        x, y = set(r.a.split()), set(r.b.split())
        assert r.j == pytest.approx(len(x & y) / len(x | y) if x | y else 0) and r.j == r.k
        assert r.o == pytest.approx(len(x & y) / min(len(x), len(y)) if x and y else 0)
        assert r.c == pytest.approx(len(x & y) / len(x) if x else 0)
        assert 0 <= r.p <= r.r <= 1 or r.p == 0
    assert [r.l for r in got[1:4]] == [1.0, 0.0, 0.0]
    assert got[5].l == pytest.approx(1 - 3 / 7) and got[6].p == pytest.approx(4 / 7)

import math
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrina.functions import prices
from vitrina.functions.similarity import add_lcs, add_token_set_ratio
from vitrina.functions.titles import clean_title, normalize_text, normalize_title, normalize_title_exact

NBSP = " "
PRICES = [
    ("$69.990", 69990.0, 69990.0),
    ("$69.990,50", 69990.5, 6999050.0),
    ("$49,000", 49000.0, 49000.0),
    ("1,234.56", 1234.56, 123456.0),
    ("9,5", 9.5, 95.0),
    ("$ 990", 990.0, 990.0),
    (f"44.990{NBSP}$", 44990.0, 44990.0),
    ("De $43.970 a $38.000", 43970.0, 43970.0),
    ("En oferta desde $24.000", 24000.0, 24000.0),
    ("$19.990 CLP", 19990.0, 19990.0),
    ("$0", 0.0, 0.0),
    ("1.234.567", 1234567.0, 1234567.0),
    ("1.234.567,8", 1234567.8, 12345678.0),
    ("0.500", 500.0, 500.0),
    ("69.9900", 69.99, 699900.0),
    (".5", 0.5, 5.0),
    ("1,234,56", None, 123456.0),
    ("1.2.3", None, 123.0),
    ("1.299.", None, 1299.0),
    ("Nº. 5.990", None, 5990.0),
    ("", None, None),
    ("gratis", None, None),
    (None, None, None),
]


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_prices(spark):
    got = one(spark, [(t,) for t, _, _ in PRICES], "t string", prices.parse_price(F.col("t")), prices.filter_price(F.col("t")))
    assert got == [(a, b) for _, a, b in PRICES]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=50, max_size=50))
def test_price_round_trip(spark, numbers):
    texts = [(f"${n:,}".replace(",", "."),) for n in numbers]
    assert [x for (x,) in one(spark, texts, "t string", prices.parse_price(F.col("t")))] == [float(n) for n in numbers]


def test_discounts(spark):
    rows = [(49990.0, 35990.0), (49990.0, 39990.0), (32000.0, 30000.0), (10000.0, 10000.0), (10000.0, 12000.0), (0.0, 1.0), (None, 1.0)]
    o, c = F.col("o"), F.col("c")
    assert one(spark, rows, "o double, c double", prices.discount_pct(o, c), prices.format_discount(o, c)) == [(28.0, "-28%"), (20.0, "-20%"), (6.2, "-6%"), (None, "-"), (None, "-"), (None, "-"), (None, "-")]


def test_pairs_and_stock_words(spark):
    rows = [(None, "x"), ("x", "x"), ("x", "y"), (None, None), ("$9.990", "$ 9.990")]
    assert one(spark, rows, "o string, c string", *prices.price_pair(F.col("o"), F.col("c"))) == [("x", None), ("x", None), ("x", "y"), (None, None), ("$9.990", "$ 9.990")]
    assert one(spark, [("AGOTADO ya",), ("No disponible",), ("ok",), (None,)], "t string", prices.sold_out(F.col("t"))) == [(True,), (True,), (False,), (False,)]


NORMS = [
    ("Clank!: En las Catacumbas (En Español)", "clank en las catacumbas"),
    ("Terraforming Mars Edición Kickstarter", "terraforming mars kickstarter"),
    ("Catan 2ª edición", "catan"),
    ("Catan 2da edición", "catan 2da"),
    ("edición deluxe", "deluxe"),
    (None, ""),
]


def test_normalize(spark):
    got = one(spark, [(t,) for t, _ in NORMS], "t string", normalize_title(F.col("t")), normalize_title_exact(F.col("t")))
    assert got == [(n, n) for _, n in NORMS]
    assert normalize_text("Catan™") == "catanTM"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=string.ascii_letters + string.digits + " !-()", max_size=40))
def test_normalize_is_idempotent_on_ascii(text):
    once = normalize_text(text)
    assert normalize_text(once) == once or "espanol" in once or "edi" in once or "ingles" in once or "english" in once or "castellano" in once


def test_clean(spark):
    rows = [
        ("Catan - Juego de Mesa", "Catan"),
        ("Carcassonne | Board Game", "Carcassonne"),
        ("Pandemic La CuraJuego de Mesa, Cooperativo, Juego de dados", "Pandemic La Cura"),
        ("Clank! Juego de Mesa Aventura", "Clank! Aventura"),
        ("Juego de Mesa", ""),
        (None, None),
    ]
    assert one(spark, [(t,) for t, _ in rows], "t string", clean_title(F.col("t"))) == [(c,) for _, c in rows]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


def test_common_subsequence(spark):
    import random

    rng = random.Random(7)
    rows = [("".join(rng.choices("abñc", k=rng.choice([0, 1, 5, 61, 62, 63, 90]))), "".join(rng.choices("abñc", k=rng.choice([0, 2, 30, 62, 64, 80])))) for _ in range(60)]
    got = add_lcs(spark.createDataFrame(rows, "a string, b string"), "a", "b", "n").collect()
    assert [r["n"] for r in got] == [brute_lcs(a, b) for a, b in rows]


def test_token_set_ratio(spark):
    rows = [("clank", "clank en las catacumbas", 100.0), ("clank catacumba", "clank", 100.0), ("clank catacumba", "clank catacumbas", 96.774), ("", "x", 0.0), ("ab", "cd", 0.0)]
    pairs = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    got = [(r["x"], r["y"]) for r in add_token_set_ratio(add_token_set_ratio(pairs, "a", "b", "x"), "b", "a", "y").collect()]
    for (_, _, want), (x, y) in zip(rows, got, strict=True):
        assert math.isclose(x, want, abs_tol=1e-3) and x == y
    below = add_token_set_ratio(spark.createDataFrame([("abcdef", "z")], "a string, b string"), "a", "b", "x", 80.0)
    assert below.first()["x"] is None


def test_bound_errors():
    from vitrina.operators.catalog import price_bounds

    assert price_bounds("1.000", None, None) == (1000.0, None)
    assert price_bounds("1", "2", "3:4") == (3.0, 4.0)
    assert price_bounds("1", "2", "3:4:5") == (None, None)
    with pytest.raises(ValueError):
        price_bounds(None, None, ":5")

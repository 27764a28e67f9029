import pytest
from pyspark.sql import functions as F

from acervo.operators.packed import given_names, parse_element, unpack

GIVEN = frozenset("ana luis maría josé".split())


@pytest.mark.parametrize(
    ("raw", "names", "values"),
    [
        ("Paz, Ana; Gil, Luis", True, ["Paz, Ana", "Gil, Luis"]), ("'Paz, Ana' 'Gil, Luis'", True, ["Paz, Ana", "Gil, Luis"]), ("[\"Paz, Ana\", 'Gil, Luis']", True, ["Paz, Ana", "Gil, Luis"]),
        ("Paz y Gil, Ana", True, ["Paz y Gil, Ana"]), ("Ana Paz y Luis Gil", True, ["Ana Paz", "Luis Gil"]), ("Ana Paz, Luis Gil", True, ["Ana Paz", "Luis Gil"]), ("Paz, Ana y Gil, Luis", True, ["Paz, Ana", "Gil, Luis"]),
        ("Centro de Física y Química de Sur", True, ["Centro de Física y Química de Sur"]), ("1) Paz, Ana 2) Gil, Luis", True, ["Paz, Ana", "Gil, Luis"]), ("Paz, Ana::1a||Gil, Luis::2b", True, ["Paz, Ana", "Gil, Luis"]),
        ("agua, suelo, roca", False, ["agua", "suelo", "roca"]), ("Agua, historia del", False, ["Agua, historia del"]), ("relación agua/suelo", False, ["relación agua/suelo"]), ("a / b\nc", False, ["a", "b", "c"]),
        ('"a; b"; c', False, ["a; b", "c"]), ('"a; b', False, ['"a', "b"]), ("cuenca (Sur, siglo XX)", False, ["cuenca (Sur, siglo XX)"]), ("(1) a (2) b", False, ["a", "b"]), ("«a» «b»", False, ["a", "b"]),
        ("a;; ;b;", False, ["a", "b"]), ("pH 7,4", False, ["pH 7,4"]), ("pH 7,4, agua, 1,5 m", False, ["pH 7,4", "agua", "1,5 m"]), ("siglo 19, 20", False, ["siglo 19", "20"]), (None, False, []), ("", True, []), ("  ", False, []), ("l'eau, d'or", False, ["l'eau", "d'or"]),
    ],
)
def test_grammar(raw, names, values):
    assert parse_element(raw, names, GIVEN)[0] == values


def test_malformed_quote_is_flagged():
    assert parse_element('"a; b', False, GIVEN)[1] and not parse_element('"a"; b', False, GIVEN)[1]


def test_long_element():
    assert len(parse_element("; ".join(f"k{i}" for i in range(5000)), False, GIVEN)[0]) == 5000


def test_unpack_edges(spark):
    rows = [("1", ["a; b", None, "c"], 7), ("1", ["a; b", None, "c"], 7), (None, ["x;x"], 8), ("2", None, 9), ("3", [], 9)]
    df = spark.createDataFrame(rows, "id string, k array<string>, value int")  # value clashes with an output column
    out = sorted(map(tuple, unpack(df, "id", {"k": (F.col("k"), False)}, GIVEN).drop("malformed").collect()), key=repr)
    assert out == sorted([("1", "k", 0, 1, "a"), ("1", "k", 0, 2, "b")] * 2 + [(None, "k", 0, 1, "x"), (None, "k", 0, 2, "x")], key=repr)
    assert unpack(df.limit(0), "id", {"k": (F.col("k"), False)}, GIVEN).count() == 0


def test_given_names(spark):
    names = spark.createDataFrame([(f"S{i}, Ana",) for i in range(5)] + [("Ana; Luis",), (None,)], "name string")
    assert given_names(names) == frozenset({"ana"})
    assert given_names(names.limit(0)) == frozenset()

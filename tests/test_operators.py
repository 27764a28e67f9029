"""Small fixtures with hand-worked results, and brute force where SQL cannot say it."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.operators import classify as K
from acervo.operators import curation as C
from acervo.operators import evaluation as E
from acervo.operators import layout as L
from acervo.operators import patterns as P
from acervo.operators import structured as X

PAIR = "run_no int, system string, id string, doc_type string, field string, pred array<string>, pred_is_list boolean, truth array<string>, truth_is_list boolean"


def pairs(spark, *values):
    return spark.createDataFrame([(1, "s", str(i), "T", "f", p, False, t, False) for i, (p, t) in enumerate(values)], PAIR)


@pytest.mark.parametrize(
    ("values", "counts"),
    [([(["b"], ["a"])], (0, 1, 0)), ([(None, None)], (0, 0, 0)), ([(["null"], ["a"]), (["A."], ["a"])], (1, 0, 1)), ([(["a"], [" "])], (0, 1, 0)), ([([], None), ([""], ["  "])], (0, 0, 0))],
)
def test_f1_counts(spark, values, counts):
    row = E.f1(pairs(spark, *values), "system").first()
    assert (row["tp"], row["fp"], row["fn"]) == counts
    if counts == (0, 0, 0):
        assert (row["precision"], row["recall"], row["f1"]) == (1.0, 1.0, 1.0)


def test_jaccard_cases(spark):
    rows = [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b", "c"], 1 / 3)]
    got = spark.createDataFrame([(a, b) for a, b, _ in rows], "a array<string>, b array<string>").select(E.jaccard(F.col("a"), F.col("b"))).collect()
    assert all(math.isclose(g[0], want) for g, (_, _, want) in zip(got, rows))
    twice = spark.createDataFrame([(["Paz, Ana", "Ana Paz"], ["Paz, Ana"])], "a array<string>, b array<string>")
    assert twice.select(E.name_jaccard(F.col("a"), F.col("b"))).first()[0] == 0.5


def test_winner_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", "f", 0.5), ("a", "f", 0.5), ("c", "f", None)], "system string, field string, m double")
    assert E.winners(df, "m", ["b", "a", "c"], "system", "field").first()["winner"] == "b"


def test_split_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i, "x") for i in range(35)], "id int, label string")
    counts = {r["split"]: r["count"] for r in C.stratified_split(df, "label", "id").groupBy("split").count().collect()}
    assert counts == {"training": 28, "test": 3, "validation": 4}
    assert C.stratified_split(df, "label", "id").exceptAll(C.stratified_split(df.repartition(3), "label", "id")).count() == 0


def test_curation_pieces(spark):
    df = spark.createDataFrame([("1", None, "b", "c"), ("1", "a", None, None), ("2", None, None, None)], "id string, `t[es]` string, `t[en]` string, x string")
    assert [r["t"] for r in C.coalesce_family(df.select("id", *[F.col(f"`{c}`").alias(c.replace("[", "_").replace("]", "")) for c in ("t[es]", "t[en]")]), "t_", "t").collect()] == ["b", "a", None]
    first = C.keep_first(df.withColumn("n", C.completeness(df.select("x"))), ["id"], F.desc("n"), F.col("x"))
    assert first.count() == 2 and first.where("id = '1'").first()["x"] == "c"
    once = spark.createDataFrame([([" A", "a ", "b"],)], "k array<string>").select(C.distinct_ignoring_case(F.col("k"))).first()[0]
    assert once == [" A", "b"]
    empty = spark.createDataFrame([([],)], "k array<string>").select(C.distinct_ignoring_case(F.col("k"))).first()[0]
    assert empty == []
    changed = C.update_by_key(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string"), spark.createDataFrame([("2", None)], "id string, v string"), "id")
    assert sorted(map(tuple, changed.collect())) == [("1", "a"), ("2", None)]
    have, pool = spark.createDataFrame([(1, "x")], "id int, l string"), spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "id int, l string")
    assert sorted(r["id"] for r in C.quota(have, pool, "l", "id", 2).collect()) == [2, 4]


def test_layout_tiers(spark):
    rows = [(1, 1, i, "w", 0.0, 1.0, 0.0, 1.0, float(h), 600.0, 800.0) for i, h in enumerate((8, 10, 12, 20, 45))]
    words = spark.createDataFrame(rows, "doc_id long, page_no int, seq int, text string, x0 double, x1 double, top double, bottom double, height double, page_w double, page_h double")
    assert tuple(L.font_tiers(words).first())[1:] == (20, 20)
    assert [r["tag"] for r in L.tagged_runs(words).orderBy("run").collect()] == ["p", "h1"]


def test_patterns(spark):
    text = "Resumen\nLa cuenca del río se des-\ncribe aquí.\n\nPalabras clave: cuenca, río\n"
    df = spark.createDataFrame([("1", text), ("2", None), ("3", "")], "id string, text string")
    assert [tuple(r) for r in P.abstracts(df, "id", "text").collect()] == [("1", "La cuenca del río se describe aquí.")]
    assert df.select(P.keyword_section(F.col("text"))).collect()[0][0] == ["cuenca", "río"]
    many = spark.createDataFrame([(i, "alfa beta gamma alfa beta") for i in range(4)], "id int, text string")
    phrases = P.keyphrases(many, "id", "text", P.pmi(many, "id", "text")).where("id = 0").orderBy("rank").collect()
    assert [r["phrase"] for r in phrases][0] == "alfa beta"
    assert P.vocabulary(df.limit(0), "id", "text").count() == 0


def test_keyword_section_on_following_lines(spark):
    texts = ["Keywords\nagua; suelo\ncauce\n\nfin", "Palabras clave: Abstract\nuno, dos\nAbstract\nno", "Keywords:\n\nPalabras clave - a - b", "nada", None, "Keywords: " + "x" * 130 + "\nagua, suelo"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(P.keyword_section(F.col("t"))).collect()]
    assert got == [["agua", "suelo cauce"], ["uno", "dos"], ["a", "b"], None, None, ["agua", "suelo"]]


@pytest.mark.parametrize(
    ("text", "abstract"),
    [
        ("Abstract\nThe river.\n\nResumen\nEl río crece.\n1. Introducción\nno", "El río crece."), ("Resumen .......... 12\nResumen\nLa cuenca.", "La cuenca."), ("RESUMEN DE LA OBRA COMPLETA\nResumen: Se mide.\nKeywords: x", "Se mide."),
        ("Resumen\nviene de antes\nAbstract\nA river.", "A river."), ("Resumen\nFin de frase.\n12\nSigue la frase\nXI\nII acaba.", "Fin de frase. Sigue la fraseXI II acaba."), ("Resumen\nUno.\n\n\nDos.", "Uno."),
        ("Resumen\nUno.\nhttps://x.y\nDos.\n2 Objetivos\nno", "Uno. Dos."), ("nada", None), (None, None), ("", None),
    ],
)
def test_abstract_of(text, abstract):
    assert P.abstract_of(text) == abstract


def test_keyphrases_prefer_phrases_of_two_words(spark):
    df = spark.createDataFrame([(1, "napa profunda y napa profunda con napa; nivel, nivel, niveles, niveles"), (2, None)], "id int, text string")
    vocab = spark.createDataFrame([("napa", "profunda")], "a string, b string")
    got = [r["phrase"] for r in P.keyphrases(df, "id", "text", vocab).orderBy("rank").collect()]
    assert got == ["napa profunda", "nivel"]  # no "napa", no "niveles"


def test_ngrams_within_rows(spark):
    df = spark.createDataFrame([(1, "alfa beta gamma"), (2, "alfa"), (3, None), (4, "")], "id int, text string")
    got = df.where("id = 1").select(P.grams(P.kept_words(F.col("text")), 2), P.grams(P.kept_words(F.col("text")), 3), P.grams(P.kept_words(F.col("text")), 4)).first()
    assert tuple(got) == (["alfa beta", "beta gamma"], ["alfa beta gamma"], [])
    assert [tuple(r) for r in P.bigrams(df, "id", "text").collect()] == [(1, "alfa", "beta"), (1, "beta", "gamma")]


def test_ranked_equals_window(spark):
    rows = [(i, None if i % 11 == 0 else f"l{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, l string").repartition(5)
    w = Window.partitionBy("l")
    want = df.withColumn("i", F.row_number().over(w.orderBy(C.hash_order("id", 7), "id"))).withColumn("n", F.count("*").over(w))
    got = C.ranked(df, "l", "id", 7)
    assert sorted(map(tuple, got.select("id", "_i", "_all").collect())) == sorted(map(tuple, want.select("id", "i", "n").collect()))


def test_layout_vetoes_and_full_width_lines(spark):
    columns = "doc_id long, page_no int, seq int, text string, x0 double, x1 double, top double, bottom double, height double, page_w double, page_h double"

    def page(doc, lines):
        seq = 0
        for i, words in enumerate(lines):
            for x0, x1, text in words:
                yield doc, 1, seq, text, float(x0), float(x1), 60.0 + 14 * i, 70.0 + 14 * i, 10.0, 600.0, 800.0
                seq += 1

    two = [[(50, 130, f"a{i}"), (140, 190, f"b{i}"), (340, 420, f"c{i}"), (430, 450 + 40 * (i % 4), f"d{i}")] for i in range(12)]
    wide = [[(50, 180, "w"), (190, 310, "x"), (320, 440, "y"), (450, 550, "z")]]
    edge = [[(50, 130, "a"), (140, 250, "b"), (340, 420, "c"), (560, 590, "9")] for _ in range(12)]
    words = spark.createDataFrame([*page(1, wide + two), *page(2, edge), *page(3, two[:2])], columns)
    pages = {r["doc_id"]: r for r in L.page_columns(words).collect()}
    assert pages[1]["two_columns"] and not pages[2]["two_columns"] and not pages[3]["two_columns"]
    assert {r["doc_id"]: r["two_columns"] for r in L.char_gap(words).collect()} == {1: True, 2: False, 3: False}
    assert {r["doc_id"]: r["right_spike"] for r in L.histogram_valley(words).collect()} == {1: False, 2: True}
    text = {r["doc_id"]: r["text"] for r in L.column_text(words, L.page_columns(words)).collect()}
    assert text[1].startswith("w x y z\na0 b0\na1 b1") and "\n\nc0 d0\n" in text[1] and text[3] == "a0 b0 c0 d0\na1 b1 c1 d1"
    assert {r["doc_id"]: r["two_columns"] for r in L.document_vote(L.page_columns(words)).collect()} == {1: True, 2: False, 3: False}


def test_saved_model_predicts_as_it_did(spark, tmp_path):
    rows = [(i, ("agua cauce cuenca" if i % 2 else "poema verso soneto") + f" palabra{'abc'[i % 3]}", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label double")
    model = K.text_classifier().fit(df)
    K.save_model(model, str(tmp_path / "m"))
    K.save_model(model, str(tmp_path / "m"))  # written over
    asked = spark.createDataFrame([(1, "cuenca agua", 5), (2, "verso", 6), (3, None, 7), (4, "", 8)], "id int, text string, prediction int")
    assert [tuple(r) for r in K.predict(asked, str(tmp_path / "m"), ["letras", "agua"]).orderBy("id").select("id", "prediction", "predicted").collect()] == [(1, 5, "agua"), (2, 6, "letras"), (3, 7, None), (4, 8, None)]


def test_a_failing_model_has_its_error_in_its_row(spark, monkeypatch):
    class Bad:
        def fit(self, df):
            raise ValueError("no")

    monkeypatch.setattr(K, "vector_models", lambda n, size: {"bad": Bad()})
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "id int, v array<double>, label int")
    assert [tuple(r) for r in K.compare_models(df, "id", "v", "label").collect()] == [("bad", None, None, None, "no")]


def test_report_emptiness(spark):
    df = spark.createDataFrame([(None, False), ([], False), ([""], False), ([" "], None), (["null"], False), ([None], False), ([""], True), (["a"], True)], "v array<string>, l boolean")
    assert [r[0] for r in df.select(T.is_empty(F.col("v"), F.col("l"))).collect()] == [True, True, True, True, False, True, False, False]


def test_rake(spark):
    df = spark.createDataFrame([(1, "La napa freática del norte, la napa freática y los pozos."), (2, None)], "id int, text string")
    got = [(r["phrase"], r["score"]) for r in P.rake(df, "id", "text").orderBy("rank").collect()]
    assert got == [("napa freática", 4.0), ("norte", 1.0), ("pozos", 1.0)]


def test_structured(spark):
    raws = ['{"a": 1}', "{'a': 'x'}", '{"a": "x", "b": [1', '```json\n{"a": 2}\n```', 'noise "a": "xx", "a": "y"', None, "[1]", "nothing"]
    got = [(r["value"], r["error"]) for r in X.tolerant_json(spark.createDataFrame(list(enumerate(raws)), "id int, raw string"), "id", "raw").orderBy("id").collect()]
    assert [json.loads(v) if v else e for v, e in got] == [{"a": 1}, {"a": "x"}, {"a": "x", "b": [1]}, {"a": 2}, {"a": "xx"}, "empty", "not an object", "no pairs"]
    lists = spark.createDataFrame([("['a', 'b']",), ("x",), (None,)], "v string").select(X.literal_list(F.col("v"))).collect()
    assert [r[0] for r in lists] == [["a", "b"], None, None]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(60)], "id long, v array<float>, label int").repartition(5)
    got = K.nearest_neighbours(df, df.where("id % 10 = 0"), "id", "v", 4)
    n = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = n @ n[q]
        s[q] = -9
        assert [r["id"] for r in got.where(f"query = {q}").orderBy("rank").collect()] == np.argsort(-s)[:4].tolist()
    assert K.vote(got, df, "id", "label").count() == 6
    parts = K.nearest_neighbours(df, df.where("id % 10 = 0"), "id", "v", 4, part=2)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, got.collect()))
    assert K.nearest_neighbours(df, df.limit(0), "id", "v", 4).count() == 0


def test_report_and_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "y string, p string")
    row = E.classification_report(df, "y", "p").first()
    assert row["accuracy"] == 0.5 and round(row["macro_recall"], 6) == round((0.5 + 0.5 + 0) / 3, 6)
    assert {(r["y_true"], r["y_pred"]): r["percent"] for r in E.confusion_percent(df, "y", "p").collect()}[("a", "a")] == 50

from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.sources import files
from acervo.streaming.incremental import append_new, run_available, windowed_counts


def test_csv_and_texts(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc'), ("2", None)], "id string, t string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), ["id", "t"]).collect())) == [("1", 'a "b"\nc'), ("2", None)]
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "90-1.txt").write_text("hola\nmundo", encoding="utf-8")
    (tmp_path / "t" / "90-2.txt").write_bytes("ñ".encode("latin-1"))
    assert {r["id"]: r["text"] for r in files.read_texts(spark, str(tmp_path / "t")).collect()}["90-1"] == "hola\nmundo"
    listed = files.list_files(spark, str(tmp_path / "t"))
    assert sorted(r["id"] for r in listed.collect()) == ["90-1", "90-2"]
    raw = spark.read.format("binaryFile").load(str(tmp_path / "t")).select(files.decoded(F.col("content")).alias("d")).select("d.*")
    assert {(r["text"], r["encoding"]) for r in raw.collect()} == {("hola\nmundo", "utf-8"), ("ñ", "latin-1")}
    assert [r[0] for r in spark.createDataFrame([("a.PDF",), ("b.txt",)], "p string").select(files.allowed(F.col("p"))).collect()] == [True, False]


def test_keyed_json(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"90-1": {"title": "a"}, "90-2": {"title": null}}', encoding="utf-8")
    got = files.read_keyed_json(spark, str(tmp_path / "k.json"), T.StructType([T.StructField("title", T.StringType())]))
    assert sorted(map(tuple, got.collect()), key=repr) == [("90-1", "a"), ("90-2", None)]


def test_incremental(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = lambda a, b: spark.createDataFrame([(i, i * 1.0) for i in range(a, b)], "id long, v double")
    rows(0, 5).write.parquet(source)
    step = lambda batch, n: append_new(batch, sink, "id")
    run_available(spark, source, state, step)
    rows(3, 8).write.mode("append").parquet(source)
    run_available(spark, source, state, step)
    assert run_available(spark, source, state, step) == 0
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(8))


def test_windows(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' as ts, 'a' as event_type union all select timestamp_ntz'2024-01-01 00:20:00', 'a' union all select timestamp_ntz'2024-01-01 09:00:00', 'b'").write.parquet(path)
    stream = windowed_counts(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    q = stream.writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["event_type"], r["n"]) for r in spark.table("w").collect()] == [("a", 2)]


def test_decoded_by_mark_and_signs(spark):
    raws = ["año".encode("utf-16"), b"\xef\xbb\xbfuno", "año “x”".encode("cp1252"), "año".encode("latin-1"), "año".encode(), None, b""]
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(raws)], "i int, b binary").select("i", files.decoded(F.col("b")).alias("d")).orderBy("i").collect()
    assert [tuple(r["d"]) for r in rows] == [("año", "utf-16"), ("uno", "utf-8-sig"), ("año “x”", "cp1252"), ("año", "latin-1"), ("año", "utf-8"), (None, None), ("", "utf-8")]


def test_undecodable_bytes_can_be_dropped(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"k,v\n1,a\xf1o\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv")).first()["v"] == "a\ufffdo"
    assert files.read_csv(spark, str(tmp_path / "a.csv"), ["v"], drop_undecodable=True).first()["v"] == "ao"


def test_texts_as_files_of_one_folder(spark, tmp_path):
    rows = [("90871-1", "uno\ndos"), ("a/b", "z"), ("n", None), (None, "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, body string, text string").repartition(3)
    for _ in range(2):  # written again, nothing changes
        files.write_texts(df, str(tmp_path / "out"), "id", "body")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["90871-1.txt", "a%2Fb.txt"]
    assert {r["id"]: r["text"] for r in files.read_texts(spark, str(tmp_path / "out")).collect()} == {"90871-1": "uno\ndos", "a%2Fb": "z"}

"""Files as relations, and sinks: CSV, JSON records by key, whole texts, listings; overwrite, append and text per record."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.streaming.incremental import append_new


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "UTF-8", drop_undecodable: bool = False) -> DataFrame:
    """A CSV with header, every column STRING, quoted line breaks kept; ``columns`` prunes the scan. Undecodable bytes are
    the replacement character, or left out with ``drop_undecodable``."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    kept = [F.col(f"`{c}`") for c in columns or df.columns]
    return df.select(*[F.replace(c, F.lit("\ufffd"), F.lit("")).alias(n) if drop_undecodable else c for c, n in zip(kept, columns or df.columns)])


def read_keyed_json(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """One object ``{id: record}`` per file as rows ``id, record fields``; the id of the key wins over one in the record."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), record))).alias("id", "record"))
    return rows.select("id", *[F.col(f"record.{f.name}") for f in record.fields if f.name != "id"])


def read_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """``id, text``: a row per text file that is not empty, the id from the file's name."""
    files = spark.read.text(path, wholetext=True).select("value", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("name")).where(F.col("name").endswith(suffix))
    return files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("id"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``id, path, bytes`` of the files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), "path", F.col("length").alias("bytes"))


def allowed(path: Column, suffixes: tuple[str, ...] = (".pdf", ".docx"), any_case: bool = True) -> Column:
    """Whether a path ends on one of the suffixes, whatever its case or, without ``any_case``, as written."""
    out = F.lit(False)
    for s in suffixes:
        out = out | (F.lower(path) if any_case else path).endswith(s)
    return out


def _decoded(b: bytes) -> tuple[str, str]:
    marks = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
    marked = [name for mark, name in marks if b.startswith(mark)]
    signs = ["cp1252"] if any(0x80 <= x < 0xA0 for x in b) else []
    for name in (*marked, "utf-8", *signs):
        try:
            return b.decode(name), name
        except UnicodeDecodeError:
            continue
    return b.decode("latin-1"), "latin-1"


def decoded(content: Column) -> Column:
    """Bytes as text with the encoding used: by the byte-order mark, else UTF-8 where they are well formed, else Windows-1252
    where they hold its signs, else Latin-1. NULL gives NULL."""

    @F.pandas_udf("text string, encoding string")
    def decode(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if b is None else _decoded(bytes(b)) for b in s], columns=["text", "encoding"])

    return decode(content)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object per line, NULL fields left out."""
    df.write.mode("overwrite").json(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """Each text as a file ``key.txt`` in one folder, signs a file name cannot hold percent-encoded; NULL texts and keys give none.

    Files are written where the rows are and named by their key alone, so a task that runs again writes the same files.
    """
    from pyarrow import fs as pa_fs

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = pa_fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        for b in batches:
            for k, t in zip(b["key"], b["text"]):
                with fs.open_output_stream(f"{folder}/{quote(k, safe=' ')}.txt") as f:
                    f.write(t.encode())
            yield pd.DataFrame({"n": [len(b)]})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    rows.mapInPandas(put, "n long").agg(F.sum("n")).collect()


__all__ = ["allowed", "append_new", "decoded", "list_files", "read_csv", "read_keyed_json", "read_texts", "write_csv", "write_json", "write_texts"]

"""Query of problem 3: packed creators and keywords, one row per value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.operators.packed import given_names, unpack
from acervo.sources import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "dataset", ["id", "creator", "keywords"])
    given = given_names(df.select(F.explode("creator").alias("name")))
    out = unpack(df, "id", {"creator": (F.col("creator"), True), "keywords": (F.col("keywords.real"), False)}, given)
    return out.select("id", "field", "elem", "pos", "value").distinct()

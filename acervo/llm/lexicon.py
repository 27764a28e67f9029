"""Frequency lexicon of a corpus: word counts over all different texts, and the bounded set of words common enough to trust."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.hashcounts import counts_of

WORD = re.compile(r"[^\W\d_]+")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word, n`` over every row of ``df``; NULL texts add nothing. Counted per task first, so a task sends each word once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for b in batches:
            for t in b["t"]:
                total.update(WORD.findall(t.lower()))
        yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())}).astype({"word": "object", "n": "int64"})

    partial = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """``text``: one row for each different text that is not NULL, so a group of copies votes once.

    Texts whose 64-bit hash has a residue of its own are kept where they are;
    only the others, copies for the most part, are shuffled to be compared, and partly aggregated before that.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_t"), F.xxhash64(text).alias("_h"))
    held = counts_of(rows.select("_h"))

    @F.pandas_udf("boolean")
    def alone(h: pd.Series) -> pd.Series:  # the hashes go to Python, the texts stay
        return pd.Series(held[h.to_numpy() & (len(held) - 1)] == 1)

    return rows.where(alone("_h")).unionByName(rows.where(~alone("_h")).dropDuplicates(["_t"])).select(F.col("_t").alias(text))


def trusted_words(df: DataFrame, text: str, share: float = 1e-5, least: int = 3, copies: bool = True) -> dict[str, int]:
    """Words that make up at least ``share`` of all words, with their counts: at most 1/share of them (100 000), whatever the corpus.

    Different texts are counted once each; without ``copies`` the rows are known to be so.
    """
    counts = word_counts(distinct_texts(df, text) if copies else df, text)
    counts = counts.persist()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    out = {r["word"]: r["n"] for r in counts.where(F.col("n") >= max(least, share * total)).collect()}
    counts.unpersist()
    return out

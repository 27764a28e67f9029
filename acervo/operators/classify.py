"""Classification of texts and vectors: centroids, nearest neighbours, and trained models compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.operators.curation import ranked
from acervo.sources import cut


def holdout(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``train``: true for the first ``share`` of a repeatable shuffle of each label."""
    return ranked(df, label, key, seed).withColumn("train", F.col("_i") <= F.floor(F.col("_all") * share)).drop("_i", "_all")


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, centroid``: the mean vector of each label."""
    parts = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, key: str, vector: str, means: DataFrame, label: str) -> DataFrame:
    """``key, predicted, score``: the label whose centroid has the largest cosine, the least label on ties.

    means has a row per label of a fixed label set, so it is small by nature and sent to every task; rows are not shuffled.
    """
    rows = sorted(means.collect(), key=lambda r: r[label])
    labels = np.array([r[label] for r in rows])
    c = np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), -1)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b[vector].tolist(), np.float64).reshape(len(b), -1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            scores = np.round(x @ c.T, 9)
            best = scores.argmax(axis=1)
            yield pd.DataFrame({"key": b[key], "predicted": labels[best], "score": scores[np.arange(len(b)), best]})

    kinds = df.schema[key].dataType.simpleString(), means.schema[label].dataType.simpleString()
    told = df.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(tell, f"key {kinds[0]}, predicted {kinds[1]}, score double")
    return told.select(F.col("key").alias(key), "predicted", F.round("score", 6).alias("score"))


def nearest_neighbours(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 4096, part: int = 20_000) -> DataFrame:
    """``query, key, rank, score``: the ``k`` rows of largest cosine for each query (itself left out), least key on ties.

    Every row is compared with every query. Queries are taken in parts of about ``part``, so what the driver and the tasks hold
    is bounded however many there are, and within a part in blocks of ``block``; a task keeps its ``k`` best per query, so what is
    shuffled is queries times tasks times k, never the pairs. Rows and queries with NULL vectors are left out.
    """
    df, queries = df.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull())
    parts = max(1, -(-queries.count() // part))
    out = None
    for at in range(parts):
        found = _nearest(df, queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == at), key, vector, k, block)
        found = cut(found) if parts > 1 else found  # a part's queries leave the driver before the next are taken
        out = found if out is None else out.unionByName(found)
    return out


def _nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int) -> DataFrame:
    asked = queries.select(F.col(key).alias("query"), F.col(vector).alias("v")).collect()
    ids = np.array([r["query"] for r in asked])
    q = np.array([r["v"] for r in asked], np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for b in batches:
            keys, x = b[key].to_numpy(), np.array(b[vector].tolist(), np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            for at in range(0, len(ids), block):
                scores = np.round(q[at : at + block] @ x.T, 9)
                scores[ids[at : at + block][:, None] == keys[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(scores)), order.shape[1])
                got = pd.DataFrame({"query": ids[at : at + block][rows], "key": keys[order.ravel()], "score": scores[rows, order.ravel()]})
                got = got[np.isfinite(got["score"])]
                best = got if best is None else pd.concat([best, got])
            if best is not None:
                best = best.sort_values(["query", "score", "key"], ascending=[True, False, True]).groupby("query").head(k)
        if best is not None:
            yield best

    kind = df.schema[key].dataType.simpleString()
    found = df.select(key, vector).mapInPandas(search, f"query {kind}, key {kind}, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    return ranked.select("query", F.col("key").alias(key), "rank", F.round("score", 6).alias("score"))


def vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``query, predicted``: the label of most weight, 1 / distance per neighbour; the least label on ties."""
    weight = 1.0 / F.greatest(1.0 - F.col("score"), F.lit(1e-9))
    w = neighbours.join(labels.select(key, label), key).groupBy("query", label).agg(F.round(F.sum(weight), 6).alias("w"))
    return w.groupBy("query").agg(F.max_by(label, F.struct("w", (-F.col(label)).alias("n"))).alias("predicted"))


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows over labels times rows of the label, so that every label weighs the same. The label set is small."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("rows"), F.count("*").alias("labels")).first()
    return df.join(F.broadcast(counts), label).withColumn("weight", F.lit(float(totals["rows"] or 0)) / (totals["labels"] * F.col("_n"))).drop("_n")


def vector_models(labels: int, size: int) -> dict:
    """Models over dense vectors, by name; those that take class weights do."""
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "logistic": LogisticRegression(maxIter=30, regParam=0.01, weightCol="weight", **common),
        "svm": OneVsRest(classifier=LinearSVC(maxIter=10, regParam=0.01), weightCol="weight", **common),
        "forest": RandomForestClassifier(numTrees=100, seed=42, weightCol="weight", **common),
        "boosted": OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=6, seed=42), weightCol="weight", **common),
        "perceptron": MultilayerPerceptronClassifier(layers=[size, 256, 128, labels], maxIter=40, seed=42, **common),
    }


def compare_models(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``model, y_true, y_pred, n, error`` on the held-out fifth, for every model; one that fails does not stop the others
    and has one row with its error and no counts. Rows with NULL vectors or labels are left out."""
    given = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    data = holdout(given, label, key).select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), "train")
    data = cut(with_class_weights(data, "label"))
    first = data.select("features").first()
    n = int(data.agg(F.max("label")).first()[0] or 0) + 1
    rows = "model string, y_true int, y_pred int, n long, error string"
    out = df.sparkSession.createDataFrame([], rows)
    for name, model in vector_models(n, len(first[0]) if first else 1).items():
        try:
            told = model.fit(data.where("train")).transform(data.where("not train"))
            cells = told.groupBy(F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")).agg(F.count("*").alias("n"))
            out = out.unionByName(cells.select(F.lit(name).alias("model"), "y_true", "y_pred", "n", F.lit(None).cast("string").alias("error")))
        except Exception as e:  # noqa: BLE001 - told in its row
            out = out.unionByName(df.sparkSession.createDataFrame([(name, None, None, None, str(e)[:500])], rows))
    return out


def text_classifier(label: str = "label", text: str = "text", features: int = 15000) -> Pipeline:
    """TF-IDF of one word (two documents or more), normalised, into a logistic model; fitted on training rows only."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}]+", minTokenLength=3),
            StopWordsRemover(inputCol="words", outputCol="kept", stopWords=StopWordsRemover.loadDefaultStopWords("spanish")),
            CountVectorizer(inputCol="kept", outputCol="tf", vocabSize=features, minDF=2.0),
            IDF(inputCol="tf", outputCol="raw"),
            Normalizer(inputCol="raw", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol=label, maxIter=20, regParam=0.01),
        ]
    )


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted pipeline, written over whatever was there."""
    model.write().overwrite().save(path)


def predict(df: DataFrame, path: str, labels: list[str], text: str = "text") -> DataFrame:
    """Adds ``predicted``: the label that the saved pipeline gives to ``text``; NULL and empty texts get NULL."""
    known = df.withColumn("_given", F.coalesce(F.col(text) != "", F.lit(False))).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    told = PipelineModel.load(path).transform(known.select(*[F.col(c).alias(f"_c_{c}") for c in df.columns], "_given", F.col("_text").alias("text")))
    names = F.array(*[F.lit(x) for x in labels])
    return told.select(*[F.col(f"_c_{c}").alias(c) for c in df.columns], F.when(F.col("_given"), F.get(names, F.col("prediction").cast("int"))).alias("predicted"))

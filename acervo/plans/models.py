"""Queries over classifiers, with SQL where the result does not depend on training."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.operators import classify as K
from acervo.plans.texts import dataset
from acervo.sources import checkpoint_dir, read_table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_MEANS = "(SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i) GROUP BY label)"


@query("label_centroids", f"SELECT label, list_transform(c, lambda x: round(x, 6)) AS centroid FROM {_MEANS}")
def label_centroids(spark, sf_dir):
    means = K.centroids(read_table(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query("centroid_classes", f"SELECT vec_id, label AS predicted, round(s, 6) AS score FROM (SELECT vec_id, m.label, round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS s FROM embeddings, {_MEANS} m) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1")
def centroid_classes(spark, sf_dir):
    df = read_table(spark, sf_dir, "embeddings")
    return K.nearest_centroid(df, "vec_id", "embedding", K.centroids(df, "label", "embedding"), "label")


_NEAR = "(SELECT q.vec_id AS query, e.vec_id, e.label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) <= 5)"


def _near(spark, sf_dir):
    df = read_table(spark, sf_dir, "embeddings")
    return K.nearest_neighbours(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding")


@query("nearest_neighbours", f'SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS "rank", round(s, 6) AS score FROM {_NEAR}')
def nearest_neighbours(spark, sf_dir):
    return _near(spark, sf_dir)


@query("neighbour_votes", f"SELECT query, label AS predicted FROM (SELECT query, label, round(sum(1.0 / greatest(1.0 - round(s, 6), 1e-9)), 6) AS w FROM {_NEAR} GROUP BY query, label) QUALIFY row_number() OVER (PARTITION BY query ORDER BY w DESC, label) = 1")
def neighbour_votes(spark, sf_dir):
    return K.vote(_near(spark, sf_dir), read_table(spark, sf_dir, "embeddings", ["vec_id", "label"]), "vec_id", "label")


@query("holdout_split", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8) AS train FROM embeddings")
def holdout_split(spark, sf_dir):
    return K.holdout(read_table(spark, sf_dir, "embeddings", ["vec_id", "label"]), "label", "vec_id").select("vec_id", "train")


@query("model_ranking")
def model_ranking(spark, sf_dir):
    cells = K.compare_models(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    scored = cells.groupBy("model").agg(F.round(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"), F.max("error").alias("error"))
    return scored.withColumn("place", F.row_number().over(W.orderBy(F.col("accuracy").desc_nulls_last(), "model")))  # a row per model


def _typed(spark, sf_dir):
    df = dataset(spark, sf_dir, "original_text", "doc_type", "split").where("original_text <> ''").select("id", F.col("original_text").alias("text"), "doc_type", "split")
    return df, StringIndexer(inputCol="doc_type", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)


@query("type_classifier")
def type_classifier(spark, sf_dir):
    """Document type from text, fitted on the training split and scored on the others."""
    df, index = _typed(spark, sf_dir)
    data = index.transform(df)
    told = K.text_classifier().fit(data.where("split = 'training'")).transform(data.where("split <> 'training'"))
    return told.groupBy("split", "doc_type").agg(F.count("*").alias("records"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("int")), 6).alias("accuracy"))


@query("type_predictions")
def type_predictions(spark, sf_dir):
    """The type model fitted, saved in the shared folder, loaded and applied to every record of the other splits."""
    df, index = _typed(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/type-model-{uuid.uuid4().hex}"
    K.save_model(K.text_classifier().fit(index.transform(df).where("split = 'training'")), path)
    return K.predict(df.where("split <> 'training'").select("id", "text", "doc_type"), path, index.labels).select("id", "doc_type", "predicted")

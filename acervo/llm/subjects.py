"""Subject areas of documents from latent Dirichlet topics.

A topic model is fitted on a bounded sample of labelled texts, balanced over the languages of their labels so that rare
languages have topics of their own, over words that tell areas apart. Each topic is mapped to the areas its top terms
stand for, and a text's areas follow from the proportions of its topics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.lexicon import WORD
from acervo.llm.scans import bare
from acervo.sources import cut


@dataclass
class SubjectModel:
    """vocab: word -> row; topics: words x topics, p(word | topic); topic_area: topics x areas, 1 at the area that a topic's top terms stand for; purity: how far they do."""

    names: list[str]
    vocab: dict[str, int]
    topics: np.ndarray
    weights: np.ndarray
    topic_area: np.ndarray
    purity: np.ndarray

    def table(self, terms: int = 15) -> list[tuple[int, str, float, str]]:
        """``topic, subject, purity, terms``: what the mapping was read from."""
        words = list(self.vocab)
        return [
            (k, self.names[int(self.topic_area[k].argmax())], float(round(self.purity[k], 4)), ", ".join(words[i] for i in np.argsort(-self.topics[:, k])[:terms])) for k in range(self.topics.shape[1])
        ]


def declared_areas(df: DataFrame, subject: str, materias: DataFrame) -> DataFrame:
    """Adds ``declared``: the area a label stands for, itself or through its materia (an ``::authority`` is dropped); else NULL."""
    areas = materias.select(F.col("materia").alias("_name"), F.col("subject").alias("declared")).unionByName(materias.select(F.col("subject").alias("_name"), F.col("subject").alias("declared"))).distinct()
    return df.withColumn("_name", F.trim(F.split_part(F.col(subject), F.lit("::"), F.lit(1)))).join(F.broadcast(areas), "_name", "left").drop("_name")


def fit(labelled: DataFrame, names: list[str], sample: int = 12000, topics: int = 60, share: float = 2e-5, lift: float = 3.0, pure: float = 0.75, covered: float = 0.98, fits: int = 4, seed: int = 7) -> SubjectModel:
    """Fit ``topics`` topics for each ``lang`` on about ``sample`` rows of ``area, lang, text`` in all, as many of each
    ``lang`` (few, so at most a few fits), taken by the hash of the text. Rows with NULL ``lang`` serve where there are no others.

    The vocabulary holds the words that make up ``share`` of the sample's words or more (at most 1/share) and whose
    documents are ``lift`` times as often of one area as of a random one (with few areas, half the most that can be reached).
    A topic is mapped to the area that its 15 top terms stand for; a topic whose terms give no area ``pure`` is set aside.
    Where the top terms of the topics kept do not make up ``covered`` of a language's words, topics are fitted again with
    another seed and added, ``fits`` times at most. Topics of one language that stand for one area are taken together.
    """
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    totals = {k: n for k, n in totals.items() if k is not None} or totals
    part = F.lit(0.0)
    for lang, n in totals.items():
        part = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(min(1.0, sample / len(totals) / n))).otherwise(part)
    rows = cut(labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < part * (1 << 20)).select("area", "lang", "text"))
    number = {a: i for i, a in enumerate(names)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for a, t in zip(b["area"], b["text"]):
                for w in {bare(x) for x in WORD.findall(t.lower()) if len(x) > 3}:
                    if w not in seen:
                        seen[w] = np.zeros(len(names))
                    seen[w][number[a]] += 1
        if seen:
            yield pd.DataFrame([(w, x.tolist()) for w, x in seen.items()], columns=["word", "n"])

    counted = rows.mapInPandas(count, "word string, n array<double>")
    summed = counted.groupBy("word").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(len(names))])
    every = sum(F.col(f"n{i}") for i in range(len(names)))
    size = summed.agg(F.coalesce(F.sum(every), F.lit(0.0)).alias("n")).first()["n"]
    table = summed.where(every >= max(3.0, share * size)).toPandas().sort_values("word")
    n = table[[f"n{i}" for i in range(len(names))]].to_numpy()
    base = n.sum(axis=0) / max(n.sum(), 1)
    rate = (n + base) / (n.sum(axis=1, keepdims=True) + 1)
    keep = (rate / np.maximum(base, 1e-9)).max(axis=1) >= min(lift, (1 + len(names)) / 2)
    words = table["word"].to_numpy()[keep]
    none = SubjectModel(names, {}, np.zeros((0, 1)), np.ones(1), np.full((1, len(names)), 1 / len(names)), np.zeros(1))
    if not len(words):
        return none
    adjusted = rate[keep] / np.maximum(base, 1e-9)
    term_area = adjusted**2 / (adjusted**2).sum(axis=1, keepdims=True)
    plain = F.translate(F.lower("text"), "áéíóúàèìòùâêîôûãõäëïöüçñ", "aeiouaeiouaeiouaoaeioucn")
    vectors = CountVectorizerModel.from_vocabulary(words.tolist(), "tokens", "features")
    docs = cut(vectors.transform(rows.select("lang", F.xxhash64("text").alias("_h"), F.split(plain, r"[^a-z]+").alias("tokens"))).select("lang", "_h", "features"))
    merged: dict[tuple, list] = {}  # topics of one language that stand for one area are taken together
    for lang in sorted(totals, key=str):
        # the same partitions and order wherever it runs, as mini-batches are drawn from them
        own = docs.where(F.col("lang").eqNullSafe(F.lit(lang))).repartition(4, "_h").sortWithinPartitions("_h").select("features")
        if not own.head(1):
            continue
        told = np.zeros(len(words), bool)
        for turn in range(fits):
            lda = LDA(k=topics, maxIter=40, optimizer="online", subsamplingRate=0.2, learningOffset=64.0, docConcentration=[0.05] * topics, topicConcentration=0.02, seed=seed + turn)
            matrix = lda.fit(own).topicsMatrix().toArray().copy()
            matrix /= max(matrix.sum(), 1e-12)
            best = np.argsort(-matrix, axis=0)[:15]
            stands = np.stack([(matrix[best[:, k], k] @ term_area[best[:, k]]) / max(matrix[best[:, k], k].sum(), 1e-12) for k in range(topics)])
            clear = stands.max(axis=1) >= pure
            for area in np.unique(stands[clear].argmax(axis=1)):
                of = clear & (stands.argmax(axis=1) == area)
                held = merged.setdefault((lang, area), [np.zeros(len(words)), 0.0])
                held[0] += matrix[:, of].sum(axis=1)
                held[1] += stands[of].max(axis=1) @ matrix[:, of].sum(axis=0)
            told[best[:, clear].ravel()] = True
            if matrix.sum(axis=1)[told].sum() >= covered:
                break
    if not merged:
        return none
    matrix = np.stack([x for x, _ in merged.values()], axis=1)
    weights = matrix.sum(axis=0)
    phi = matrix / np.maximum(weights, 1e-12)
    topic_area = np.eye(len(names))[[area for _, area in merged]]
    purity = np.array([p for _, p in merged.values()]) / np.maximum(weights, 1e-12)
    return SubjectModel(names, {w: i for i, w in enumerate(words)}, phi, weights / weights.sum(), topic_area, purity)


class Numbers(dict):
    """Word as written -> its row in the vocabulary, or -1."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = row = self.vocab.get(bare(word), -1) if len(word) > 3 else -1
        return row


def shares(texts: list[str], model: SubjectModel, numbers: Numbers | None = None, rounds: int = 10, alpha: float = 0.05) -> np.ndarray:
    """texts x areas: the areas of each text's topic proportions; zeros where it has no subject word.

    Proportions are folded in with the topics fixed, over each text's different words and their counts; texts are taken
    in order of their number of words, a group of like size at a time.
    """
    numbers = Numbers(model.vocab) if numbers is None else numbers
    bags = [Counter(map(numbers.__getitem__, WORD.findall(t.lower()))) for t in texts]
    for bag in bags:
        bag.pop(-1, None)
    out = np.zeros((len(texts), len(model.names)), np.float32)
    order = sorted((i for i, bag in enumerate(bags) if bag), key=lambda i: len(bags[i]))
    topics = np.vstack([model.topics, np.zeros((1, model.topics.shape[1]))]).astype(np.float32)  # the last row fills up
    prior = (alpha * model.weights).astype(np.float32)
    while order:
        width = len(bags[order[0]])
        most = max(1, 4000 // (width + width // 4))
        group = [i for i in order[:most] if len(bags[i]) <= width + width // 4]
        order = order[len(group) :]
        width = len(bags[group[-1]])
        ids, n = np.full((len(group), width), len(topics) - 1), np.zeros((len(group), width), np.float32)
        for row, i in enumerate(group):
            ids[row, : len(bags[i])] = list(bags[i].keys())
            n[row, : len(bags[i])] = list(bags[i].values())
        phi = topics[ids]
        theta = np.tile(model.weights.astype(np.float32), (len(group), 1))
        for _ in range(rounds):
            each = n / np.maximum(np.matmul(phi, theta[:, :, None])[:, :, 0], 1e-12)
            theta = theta * np.matmul(each[:, None, :], phi)[:, 0, :] + prior
            theta /= theta.sum(axis=1, keepdims=True)
        found = np.maximum(theta - prior / (n.sum(axis=1, keepdims=True) + alpha), 0) @ model.topic_area
        out[group] = found / np.maximum(found.sum(axis=1, keepdims=True), 1e-12)
    return out


def assign(df: DataFrame, key: str, text: str, declared: str, model: SubjectModel, least: float = 0.28) -> DataFrame:
    """``key, declared, subject, share``: the areas that make up ``least`` of a text's topic proportions, or its largest area.

    NULL and empty texts and texts without any subject word give no row; repeated rows give theirs each.
    """

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers(model.vocab)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                b = whole.iloc[at : at + 2000]
                found = shares(b["text"].tolist(), model, numbers)
                top = found.max(axis=1)
                d, a = np.nonzero((found > 0) & ((found >= least) | (found == top[:, None])) & (top[:, None] > 0))
                keys, labels = b["key"].tolist(), b["declared"].tolist()
                yield pd.DataFrame([(keys[i], labels[i], model.names[j], round(float(found[i, j]), 4)) for i, j in zip(d, a)], columns=["key", "declared", "subject", "share"])

    rows = df.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(declared).alias("declared"))
    return rows.mapInPandas(tell, "key string, declared string, subject string, share double").withColumnRenamed("key", key)


def subject_cases(found: DataFrame, key: str) -> DataFrame:
    """The areas of texts whose label is missing or is not exactly the set of areas found."""
    one = found.distinct()
    sets = one.groupBy(key).agg(F.collect_set("subject").alias("areas"), F.first("declared").alias("label"))
    wrong = sets.where(F.col("label").isNull() | (F.size("areas") != 1) | ~F.array_contains("areas", F.col("label")))
    return wrong.select(key, F.explode("areas").alias("subject"))

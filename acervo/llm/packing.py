"""Filling fixed-capacity containers by lexical retrieval: a sharded BM25 index finds unused neighbours of each seed text.

Texts are ordered by a minhash of their words, so that a shard (a bounded run of that order) holds texts alike; equal
minhashes are split by key, so no group is too large for a task. In a shard the largest unused text seeds a container,
its unused BM25 neighbours fill the window while they fit, and the room left goes to the largest texts that fit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.tokens import TOKENIZER, with_tokens

WORDS = re.compile(r"[^\W\d_]{4,}")
K1, B = 1.2, 0.75


class Index:
    """BM25 over the texts of one shard: term -> positions and weights."""

    def __init__(self, texts: list[str]):
        bags = [Counter(WORDS.findall(t.lower())) for t in texts]
        mean = max(1.0, sum(sum(b.values()) for b in bags) / max(1, len(bags)))
        postings: dict[str, list[tuple[int, float]]] = {}
        for i, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / mean)
            for w, n in bag.items():
                postings.setdefault(w, []).append((i, n * (K1 + 1) / (n + norm)))
        n = len(texts)
        self.idf = {w: float(np.log(1 + (n - len(p) + 0.5) / (len(p) + 0.5))) for w, p in postings.items()}
        self.postings = {w: (np.array([i for i, _ in p]), np.array([x for _, x in p])) for w, p in postings.items()}
        self.bags, self.size = bags, n

    def neighbours(self, i: int) -> np.ndarray:
        """The other texts by falling BM25 score for all terms of text ``i``."""
        scores = np.zeros(self.size)
        for w in self.bags[i]:
            at, weight = self.postings[w]
            scores[at] += self.idf[w] * weight
        scores[i] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def fill(sizes: np.ndarray, index: Index, capacity: int) -> list[list[int]]:
    """Containers of text numbers; every text of size 1 to ``capacity`` is in exactly one. Empty texts go with the first."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    free = sorted((int(s), i) for i, s in enumerate(sizes) if s > 0)
    unused = sizes > 0
    out: list[list[int]] = []

    def take(i: int) -> None:
        unused[i] = False
        del free[bisect_right(free, (int(sizes[i]), i)) - 1]

    for seed in order:
        if not unused[seed]:
            continue
        take(int(seed))
        box, room = [int(seed)], capacity - int(sizes[seed])
        if free and free[0][0] <= room:
            for j in index.neighbours(int(seed)):
                if room < free[0][0] if free else True:
                    break
                if unused[j] and sizes[j] <= room and room - sizes[j] >= 0 and (room - sizes[j] == 0 or room - sizes[j] >= free[0][0] or sizes[j] >= room * 0.9):
                    take(int(j))
                    box.append(int(j))
                    room -= int(sizes[j])
        while free and (k := bisect_right(free, (room, len(sizes)))):
            size, j = free[k - 1]
            take(j)
            box.append(j)
            room -= size
        out.append(box)
    return out


def pack(df: DataFrame, capacities: dict[str, int], key: str = "doc_id", text: str = "text", shard: int = 3000, path: str = TOKENIZER) -> DataFrame:
    """``budget, container, slot, key, piece, start, tokens``: where every text (or piece of one) lies for each capacity.

    A text above the capacity fills containers of its own with whole pieces, and its rest (piece > 0, from token ``start``)
    is packed like a text. NULL and empty texts have no tokens and no row. Repeated keys and copies are separate texts.
    """
    rows = df.where(F.col(text) != "").select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    words = F.filter(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+")), lambda w: F.length(w) > 5)
    signature = F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w))), F.lit(0))
    # ranges are sampled from what stands before the exchange, so texts are tokenised after it, once
    ordered = rows.withColumn("_sig", signature).repartitionByRange(F.col("_sig"), F.xxhash64("_key")).sortWithinPartitions("_sig", F.xxhash64("_key"))
    sized = with_tokens(ordered, "_text", path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, shards = TaskContext.get().partitionId(), 0

        def shard_of(b: pd.DataFrame) -> pd.DataFrame:
            index = Index(b["_text"].tolist())
            tokens, keys = b["tokens"].to_numpy(np.int64), b["_key"].to_numpy()
            out = []
            for budget, capacity in capacities.items():
                whole, rest = tokens // capacity, tokens % capacity
                exact = whole * capacity
                fits = np.where(tokens <= capacity, tokens, rest)
                n = 0
                for i in np.flatnonzero(tokens > capacity):
                    for p in range(int(whole[i])):
                        out.append((budget, f"{task}-{shards}-{n}", 0, keys[i], p, p * capacity, capacity))
                        n += 1
                for box in fill(fits, index, capacity):
                    for slot, i in enumerate(box):
                        split = tokens[i] > capacity
                        out.append((budget, f"{task}-{shards}-{n}", slot, keys[i], int(whole[i]) if split else 0, int(exact[i]) if split else 0, int(fits[i])))
                    n += 1
            return pd.DataFrame(out, columns=["budget", "container", "slot", "key", "piece", "start", "tokens"])

        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            while len(held) >= 2 * shard:
                yield shard_of(held.iloc[:shard].reset_index(drop=True))
                shards += 1
                held = held.iloc[shard:].reset_index(drop=True)
        if held is not None and len(held):
            yield shard_of(held)

    kind = df.schema[key].dataType.simpleString()
    return sized.select("_key", "_text", "tokens").mapInPandas(run, f"budget string, container string, slot int, key {kind}, piece int, start int, tokens int").withColumnRenamed("key", key)


def fill_rates(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``budget, containers, tokens, least, fill``: containers used, the least number the tokens could fill, and the share filled."""
    sums = packed.groupBy("budget").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    capacity = F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])[F.col("budget")]
    return sums.select("budget", "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"))

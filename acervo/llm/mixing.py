"""Mixing sources to target weights by soft membership.

A classifier fitted on a bounded table of labelled texts gives every text its posteriors over the sources. Projected-gradient
least squares finds document rates, from 0 to the cap on repeats of the text's source, at which the expected tokens per
posterior source come nearest the targets, among the rates that give each source its share by label. Rates become whole
uses by a threshold on a hash of the key, set so that the tokens used come to what the rate asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.llm.tokens import TOKENIZER, with_tokens
from acervo.sources import cut

#: Posteriors are kept in steps of 1/STEPS.
STEPS = 20


def memberships(df: DataFrame, key: str, text: str, source: str, sample: int = 20000, features: int = 1 << 14) -> DataFrame:
    """``key, tokens, label, source, weights`` of every row: its label (NULL where blank), the label or else the likeliest
    source, and MAP<source, weight> of posteriors in steps of 1/STEPS that sum to 1.

    The classifier is fitted on about ``sample`` labelled rows taken by the hash of the key; labels serve the fitting
    only, the weights are posteriors for labelled rows too. Without any labelled text there are no sources and no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.when(F.trim(F.col(source)) != "", F.trim(F.col(source))).alias("label"), "tokens")
    labelled = rows.where("label is not null and tokens > 0")
    total = labelled.count()
    if not total:
        return rows.where("false").select("key", "tokens", "label", F.col("label").alias("source"), F.create_map("label", F.lit(1.0)).alias("weights"))
    tf = HashingTF(inputCol="words", outputCol="features", numFeatures=features)
    bag = lambda x: tf.transform(x.withColumn("words", F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")))
    train = cut(bag(labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < max(min(1.0, sample / total), 1 / (1 << 20)) * (1 << 20))).select("label", "features"))
    if not train.head(1):  # very few labelled rows, none of them taken
        train = cut(bag(labelled).select("label", "features"))
    index = StringIndexer(inputCol="label", outputCol="target").fit(train)
    model = NaiveBayes(featuresCol="features", labelCol="target").fit(index.transform(train))
    entries = F.arrays_zip(F.array(*[F.lit(x) for x in index.labels]).alias("source"), vector_to_array("probability").alias("weight"))
    scored = model.transform(bag(rows)).select("key", "tokens", "label", F.transform(entries, lambda e: F.struct(e["source"].alias("source"), F.floor(e["weight"] * STEPS).cast("int").alias("n"), e["weight"].alias("p"))).alias("all"))
    best = F.array_max(F.transform("all", lambda e: F.struct(e["p"].alias("p"), e["source"].alias("source"))))["source"]
    given = F.aggregate("all", F.lit(0), lambda a, e: a + e["n"])
    scored = scored.withColumn("best", best).withColumn("rest", F.lit(STEPS) - given)  # what rounding down leaves goes to the likeliest
    steps = F.transform("all", lambda e: F.struct(e["source"], (e["n"] + F.when(e["source"] == F.col("best"), F.col("rest")).otherwise(0)).cast("double") / STEPS))
    return scored.select("key", "tokens", "label", F.coalesce("label", "best").alias("source"), F.map_filter(F.map_from_entries(steps), lambda _, v: v > 0).alias("weights"))


@dataclass
class Rates:
    """rates: ``group, rate``; whether the steps settled, after how many, and the error left: the root of the squared misses over that of the targets."""

    rates: DataFrame
    settled: bool
    steps: int
    error: float


def rates(groups: DataFrame, targets: dict[str, float], caps: dict[str, float], rounds: int = 40, step: float = 0.5) -> Rates:
    """Rates from 0 to the cap of the source at which the expected tokens per posterior source come nearest the targets.

    groups: ``group, source, weights, tokens``. A step is one aggregation over the groups; the gradient of a source is
    scaled by the tokens it holds, and its mean over a source is taken off, so that a step keeps the tokens each source
    has by label; what the bounds change there is made good in the next step, and at the end until it fits. Sources
    without a target are not used. A source whose cap keeps it short stays at the cap.
    """

    def value(of: Column, values: dict[str, float]) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[of], F.lit(0.0)) if values else F.lit(0.0)

    parts = F.concat(
        F.array(F.struct(F.lit("label").alias("by"), F.col("source").alias("name"), F.lit(1.0).alias("weight"))),
        F.transform(F.map_entries("weights"), lambda e: F.struct(F.lit("posterior").alias("by"), e["key"].alias("name"), e["value"].alias("weight"))),
    )
    state = cut(groups.where(F.col("source").isin(*targets)).withColumn("cap", value(F.col("source"), caps)).withColumn("parts", parts))
    crossed = state.select("source", "tokens", F.explode("weights").alias("name", "weight")).groupBy("source", "name").agg(F.sum(F.col("tokens") * F.col("weight")).alias("n")).collect()
    own, held = {}, {}
    for r in crossed:  # a row per two sources
        own[r["source"]] = own.get(r["source"], 0.0) + r["n"]
        held[r["name"]] = held.get(r["name"], 0.0) + r["n"]
    state = state.withColumn("rate", F.least("cap", value(F.col("source"), {s: targets[s] / max(n, 1e-9) for s, n in own.items()})))
    size = max(sum(t * t for t in targets.values()), 1e-9)
    last, settled, error, turn = np.inf, False, 0.0, 0

    def totals() -> tuple[dict[str, float], dict[str, float]]:
        """What the rates use of each source, by label and by posteriors."""
        sums = state.select("tokens", "rate", F.explode("parts").alias("x")).groupBy("x.by", "x.name").agg(F.sum(F.col("tokens") * F.col("x.weight") * F.col("rate")).alias("n")).collect()
        return tuple({r["name"]: r["n"] for r in sums if r["by"] == by} for by in ("label", "posterior"))

    def missing(label: dict[str, float]) -> dict[str, float]:
        """By how much the rates of each source must rise to use what they should by label, bounds aside."""
        return {s: (targets[s] - label.get(s, 0.0)) / max(n, 1e-9) for s, n in own.items()}

    within = lambda rate: F.greatest(F.lit(0.0), F.least("cap", rate))
    for turn in range(1, rounds + 1):
        label, reached = totals()
        error = (sum((reached.get(s, 0.0) - t) ** 2 for s, t in targets.items()) / size) ** 0.5
        settled = abs(last - error) <= 1e-3  # of the targets
        if settled:
            break
        last = error
        gradient = {s: (reached.get(s, 0.0) - targets.get(s, 0.0)) / max(held[s], 1e-9) for s in held}
        mean: dict[str, float] = dict.fromkeys(own, 0.0)
        for r in crossed:
            mean[r["source"]] += r["n"] * gradient[r["name"]] / max(own[r["source"]], 1e-9)
        slope = F.aggregate(F.map_entries("weights"), F.lit(0.0), lambda a, e: a + e["value"] * value(e["key"], gradient))
        state = state.withColumn("rate", within(F.col("rate") + value(F.col("source"), missing(label)) - step * (slope - value(F.col("source"), mean))))
        state = cut(state) if turn % 5 == 0 else state
    state = cut(state)
    for again in range(rounds):  # onto the rates that give each source its share by label, or its cap
        label, reached = totals()
        rise = missing(label)
        if all(abs(d) <= 1e-3 * targets[s] / max(own[s], 1e-9) or (d > 0 and label.get(s, 0.0) >= caps.get(s, 0.0) * own[s] * (1 - 1e-6)) for s, d in rise.items()):
            break
        state = state.withColumn("rate", within(F.col("rate") + value(F.col("source"), rise)))
        state = cut(state) if again % 5 == 4 else state
    error = (sum((reached.get(s, 0.0) - t) ** 2 for s, t in targets.items()) / size) ** 0.5
    return Rates(cut(state.select("group", "rate")), settled, turn, float(error))


@dataclass
class Mixture:
    """selection: ``mix, key, source, tokens, uses, weights``; fits: of each mix its name, whether its rates settled, after how many steps, and the error left."""

    selection: DataFrame
    fits: list[tuple[str, bool, int, float]]


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER) -> Mixture:
    """The texts of each mix and how often each is used; rows with no use are left out.

    targets: ``mix, source, target_share, max_repeats, total_ratio``. A source that its cap keeps below its share stays at
    the cap; ``source`` is the label, or the likeliest source of a text without one. Texts without tokens are not used.
    """
    sized = memberships(with_tokens(df, text, path), key, text, source).where("tokens > 0")
    group = F.xxhash64("source", F.array_sort(F.map_entries("weights")))
    rows = cut(sized.withColumn("group", group))
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    wanted = targets.collect()  # a row per mix and source, fixed
    groups = cut(rows.groupBy("group").agg(F.min("source").alias("source"), F.map_from_entries(F.min(F.array_sort(F.map_entries("weights")))).alias("weights"), F.sum("tokens").cast("double").alias("tokens")))
    out, told = None, []
    for name in sorted({r["mix"] for r in wanted}):
        mine = [r for r in wanted if r["mix"] == name]
        goal = {r["source"]: r["target_share"] * r["total_ratio"] * total for r in mine}
        caps = {r["source"]: float(r["max_repeats"]) for r in mine}
        fit = rates(groups, goal, caps)
        told.append((name, fit.settled, fit.steps, round(fit.error, 6)))
        used = rows.join(fit.rates, "group").where("rate > 0")
        used = used.withColumn("base", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.floor("rate"))
        # a row's part of a use becomes one where a hash in [0, 1) lies below it, times a factor near 1 for each source that
        # makes the tokens used what the rates ask for; the factor is found among 4096 bins
        lots = (F.pmod(F.xxhash64("key", F.lit(name)), F.lit(1 << 20)) + 0.5) / (1 << 20)
        used = used.withColumn("bin", F.when(F.col("part") > 0, F.greatest(F.lit(-1), F.least(F.lit(4096), F.floor((lots / F.col("part") - 0.5) * 4096)))).otherwise(4097).cast("int"))
        tokens = used.groupBy("source", "bin").agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("part")).alias("asked"))
        run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
        sums = tokens.withColumn("before", F.sum("n").over(run) - F.col("n")).withColumn("asked", F.sum("asked").over(W.partitionBy("source")))
        edges = sums.where("bin < 4096 and before + n / 2 <= asked").groupBy("source").agg(F.max("bin").alias("edge"))
        picked = used.join(F.broadcast(edges), "source", "left")  # a row per source of the mix
        picked = picked.withColumn("uses", (F.col("base") + F.when(F.col("bin") <= F.col("edge"), 1).otherwise(0)).cast("int"))
        picked = picked.where("uses > 0").select(F.lit(name).alias("mix"), F.col("key").alias(key), "source", "tokens", "uses", "weights")
        out = picked if out is None else out.unionByName(picked)
    if out is None:
        out = rows.where("false").select(F.lit("").alias("mix"), F.col("key").alias(key), "source", "tokens", F.lit(0).alias("uses"), "weights")
    return Mixture(out, told)


def reached_shares(mixture: Mixture, targets: DataFrame) -> DataFrame:
    """``mix, source, target_share, share, posterior_share, tokens, texts, most_uses, settled, error``: what each source
    contributes by label and by posteriors, sources with nothing included, and how the rates of the mix were found."""
    mixed = mixture.selection
    sums = mixed.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    soft = mixed.select("mix", (F.col("tokens") * F.col("uses")).alias("n"), F.explode("weights").alias("source", "weight")).groupBy("mix", "source").agg(F.sum(F.col("n") * F.col("weight")).alias("soft"))
    fits = targets.sparkSession.createDataFrame(mixture.fits, "mix string, settled boolean, steps int, error double")
    every = targets.select("mix", "source", "target_share").join(sums, ["mix", "source"], "left").join(soft, ["mix", "source"], "left").join(fits, "mix", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    of = W.partitionBy("mix")
    return every.select(
        "mix", "source", "target_share", F.round(tokens / F.sum(tokens).over(of), 6).alias("share"), F.round(F.coalesce("soft", F.lit(0.0)) / F.sum(tokens).over(of), 6).alias("posterior_share"),
        tokens.alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "settled", "error",
    )

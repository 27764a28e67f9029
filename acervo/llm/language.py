"""Document and segment languages from language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each slot, one bit per language; the masks at an n-gram's slots, and-ed, give all
languages that contain it. A sentence's language is decided by how many of its n-grams each language contains, less the
number a filter of that density returns by chance. Runs of sentences in one language form segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.sources import cut

LANGUAGES = ("es", "en", "pt", "fr", "it")
#: The outcome for a stretch of which none of the languages contains LEAST of the n-grams.
OTHER, LEAST = "other", 0.45
#: Spellings of the five languages, lower case, without accents and without region.
SPELLINGS = {
    "es": "es spa esp cas castellano espanol spanish espagnol spagnolo espanhol".split(),
    "en": "en eng ing english ingles anglais inglese".split(),
    "pt": "pt por ptg portugues portuguese portugais portoghese".split(),
    "fr": "fr fra fre frances french francais francese".split(),
    "it": "it ita italiano italian italien".split(),
}
GRAM, SLOTS, HASHES = 4, 1 << 20, ((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), (0x165667B1, 0xD3A2646C | 1, 0xFD7046C5, 0xB55A4F09))
SENTENCE = re.compile(r"[.?!…]+[»”\"')\]]*\s+(?=[^\W\da-zß-ÿ]|[¿¡«“\"(])|[.?!]\s*\n|\n[^\S\n]*\n\s*|\x00")
QUOTED = re.compile(r"«[^«»\x00]+»|“[^“”\x00]+”|(?<![^\W_])\"[^\"\n\x00]+\"")
WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Filter:
    """masks: a byte of language bits per slot; density: the share of slots set for each language."""

    masks: np.ndarray
    density: np.ndarray


def declared(label: Column) -> Column:
    """The language a label names in any of its spellings, or NULL where it is missing or names none of the five."""
    plain = F.lower(F.trim(F.translate(label, "áéíóúãõâêôçñÁÉÍÓÚÃÕÂÊÔÇÑ", "aeiouaoaeocnAEIOUAOAEOCN")))
    name = F.regexp_extract(plain, r"^([a-z]+)(?:[-_ (].*)?$", 1)
    out = F.lit(None).cast("string")
    for lang, names in SPELLINGS.items():
        out = F.when(name.isin(*names), lang).otherwise(out)
    return out


def _letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, all but letters blank; positions are those of ``text``."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals lower to two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32).copy()
    letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xDF) & (codes <= 0xFF) & (codes != 0xF7))
    beyond = np.flatnonzero(codes > 0xFF)
    letter[beyond] = [chr(c).isalpha() for c in codes[beyond]]
    codes[~letter] = 32
    return codes


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    """The slots of the n-gram at each position, one array per hash function."""
    out = []
    n = max(0, len(codes) - GRAM + 1)
    for factors in HASHES:
        h = np.zeros(n, np.uint32)
        with np.errstate(over="ignore"):
            for k, f in enumerate(factors):
                h += codes[k : k + n] * np.uint32(f)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        out.append(h >> np.uint32(12))
    return out


def train(labelled: DataFrame, per_language: int = 2000, rate: float = 1e-5, ratio: float = 0.2) -> Filter:
    """Fit the filters on a bounded sample: about ``per_language`` labelled texts of each language, taken by the hash of the text.

    labelled: ``lang, text``. An n-gram belongs to a language where it makes up ``rate`` of its n-grams and its rate is at
    least ``ratio`` of that in any other, so that wrong labels and mixed texts do not spread n-grams.
    """
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / max(n, 1)))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                for at in range(0, len(texts), 500):
                    for j, slots in enumerate(_slots(_letters("\n".join(texts.iloc[at : at + 500])))):
                        slot, n = np.unique(slots.astype(np.int32), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "hash": j, "slot": slot, "n": n})

    counted = cut(sample.mapInPandas(count, "lang string, hash int, slot int, n long").groupBy("lang", "hash", "slot").agg(F.sum("n").alias("n")))
    sums = {(r["lang"], r["hash"]): r["n"] for r in counted.groupBy("lang", "hash").agg(F.sum("n").alias("n")).collect()}
    least = F.lit(0.0)
    for (lang, j), n in sums.items():
        least = F.when((F.col("lang") == lang) & (F.col("hash") == j), F.lit(rate * n)).otherwise(least)
    tables = np.zeros((2, len(LANGUAGES), SLOTS))
    for r in counted.where(F.col("n") >= least).toPandas().itertuples(index=False):  # at most 1/rate of each language and hash
        if r.lang in LANGUAGES:
            tables[r.hash, LANGUAGES.index(r.lang), r.slot] = r.n / sums[r.lang, r.hash]
    masks = np.zeros((2, SLOTS), np.uint8)
    for j, rates in enumerate(tables):
        top = rates.max(axis=0)
        for k in range(len(LANGUAGES)):
            masks[j] |= (((rates[k] >= rate) & (rates[k] >= ratio * top)).astype(np.uint8)) << k
    density = np.array([[(m >> k & 1).mean() for k in range(len(LANGUAGES))] for m in masks]).prod(axis=0)
    return Filter(masks, density)


def _runs(scores: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The language of each sentence: the best path in which every run holds two full sentences or more, if it can."""
    n, k = scores.shape
    if full.sum() < 4:  # two runs of two need four
        return np.full(n, int(scores[full].sum(axis=0).argmax() if full.any() else scores.sum(axis=0).argmax()))
    cost_of_switch = 4.0
    best = np.full((n + 1, k, 3), -np.inf)  # by full sentences of the run so far: 0, 1, 2 and more
    back = np.zeros((n + 1, k, 3, 2), np.int64)
    for lang in range(k):
        step = min(1, int(full[0]))
        best[1, lang, step] = scores[0, lang]
    for i in range(1, n):
        f = int(full[i])
        enter = int(best[i, :, 2].argmax())
        for lang in range(k):
            for have in range(3):
                if best[i, lang, have] > -np.inf:
                    to, value = min(2, have + f), best[i, lang, have] + scores[i, lang]
                    if value > best[i + 1, lang, to]:
                        best[i + 1, lang, to], back[i + 1, lang, to] = value, (lang, have)
            if enter != lang:
                value = best[i, enter, 2] - cost_of_switch + scores[i, lang]
                if value > best[i + 1, lang, f]:
                    best[i + 1, lang, f], back[i + 1, lang, f] = value, (enter, 2)
    lang, have = np.unravel_index(int(best[n, :, 2].argmax()) * 3 + 2, (k, 3))
    out = np.zeros(n, np.int64)
    for i in range(n, 0, -1):
        out[i - 1] = lang
        lang, have = back[i, lang, have]
    return out


def segment_batch(texts: list[str], model: Filter) -> list[list[tuple[str, float, int, int]]]:
    """Of each text, its segments in reading order: language, confidence, start and end. Texts without letters have none."""
    whole = "\x00".join(t.replace("\x00", " ") for t in texts) + "\x00"
    quoteless = QUOTED.sub(lambda m: " " * len(m[0]), whole) if "«" in whole or "“" in whole or '"' in whole else whole
    codes = _letters(quoteless)
    first, second = _slots(np.concatenate([codes, np.full(GRAM - 1, 32, np.uint32)]))
    masks = model.masks[0][first] & model.masks[1][second]
    # an n-gram of blanks alone, or that begins with two, tells nothing
    masks[(codes == 32) & (np.append(codes[1:], 32) == 32)] = 0
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    for k in range(GRAM):  # nor does one that reaches into the next text
        masks[np.maximum(stops - k, 0)] = 0
    told = np.concatenate([[0], np.cumsum(codes != 32)])
    sums = np.stack([np.concatenate([[0], np.cumsum(masks >> k & 1)]) for k in range(len(LANGUAGES))], axis=1)
    out: list[list[tuple[str, float, int, int]]] = []
    at, start, bounds, ends = 0, 0, [], []
    for m in SENTENCE.finditer(whole):
        if m[0] != "\x00":
            bounds.append((at, m.end(), m[0][0] in ".?!…"))
            at = m.end()
            continue
        if m.start() > at:
            bounds.append((at, m.start(), whole[m.start() - 1] in ".?!…»”\")"))
        ends.append((start, len(bounds)))
        start = len(bounds)
        at = m.end()
    if not bounds:
        return [[] for _ in texts]
    b = np.array([(x, y) for x, y, _ in bounds])
    letters = told[b[:, 1]] - told[b[:, 0]]
    hits = (sums[b[:, 1]] - sums[b[:, 0]]).astype(np.float64)
    hits = np.maximum(hits - letters[:, None] * model.density[None, :], 0) / np.maximum(1 - model.density[None, :], 0.01)
    full = np.array([f for _, _, f in bounds]) & (letters >= 15)
    offset = 0
    for text, (i, j) in zip(texts, ends):
        if i == j or not letters[i:j].any():
            out.append([])
            offset += len(text) + 1
            continue
        s, f = hits[i:j], full[i:j]
        voting = s[f] if f.any() else s
        tops = voting.argmax(axis=1)
        langs = np.full(j - i, tops[0]) if (tops == tops[0]).all() else _runs(np.where(f[:, None], s, s * 0.2), f)
        cuts = [0, *(np.flatnonzero(np.diff(langs)) + 1), j - i]
        found = []
        for a, z in zip(cuts, cuts[1:]):
            total = s[a:z].sum(axis=0)
            rank = np.sort(total)[::-1]
            sure = float(rank[0] - rank[1]) / float(max(rank[0], 1e-9))
            lang = LANGUAGES[langs[a]] if total.max() >= LEAST * letters[i + a : i + z].sum() else OTHER
            found.append((lang, round(min(1.0, max(0.0, sure)), 4), int(b[i + a, 0] - offset), int(min(b[i + z - 1, 1] - offset, len(text)))))
        out.append(found)
        offset += len(text) + 1
    return out


def segments(df: DataFrame, key: str, text: str, label: str, model: Filter | None = None) -> DataFrame:
    """``key, declared, seg_no, segments, lang, confidence, start, end``: every single-language segment of every text.

    ``declared`` is the language the label names (NULL where missing); ``segments`` the number of segments of the text;
    confidence is the lead of the language over the next, from 0 to 1. NULL, empty and letterless texts give no row;
    repeated rows give theirs each. Without ``model`` one is trained on a bounded sample of the labelled rows.
    """
    rows = df.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text"), declared(F.col(label)).alias("declared"))
    if model is None:
        model = train(rows.where(F.col("declared").isNotNull()).select(F.col("declared").alias("lang"), "text"))

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                told = segment_batch(b["text"].tolist(), model)
                out = [(k, d, n, len(x), *seg) for k, d, x in zip(b["key"], b["declared"], told) for n, seg in enumerate(x, 1)]
                yield pd.DataFrame(out, columns=["key", "declared", "seg_no", "segments", "lang", "confidence", "start", "end"])

    schema = "key string, declared string, seg_no int, segments int, lang string, confidence double, start int, end int"
    return rows.mapInPandas(tell, schema).withColumnRenamed("key", key)


def label_cases(found: DataFrame) -> DataFrame:
    """The segments of texts whose label is missing, names another language than the text, or that hold several languages."""
    return found.where(F.col("declared").isNull() | (F.col("segments") > 1) | (F.col("declared") != F.col("lang")))

"""Same or near-same records across splits: an exact prefix-filter join on rare shingles, evaluation against training.

Texts are compared by a skeleton that damage does not change: wrong decoding undone, accents and typography dropped,
hyphenated words joined, spaced and tripled letters closed up, and letters that scanners confuse folded together.
Evaluation texts with the same skeleton form one content. Their prefixes are indexed in blocks of bounded size, written
once to the shared folder; training texts probe the blocks where they are read, so no training text is shuffled.
"""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.encoding import decode_spans, decode_words
from acervo.llm.lexicon import trusted_words
from acervo.sources import checkpoint_dir, cut

BROKEN_WORD = re.compile(r"[-\xad¬‐‑–](?<=\w.)[^\S\n]*\n\s*(?=\w)")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
SPACED_SIGN = re.compile(r" [^\W\d_] [^\W\d_] [^\W\d_] ")
MULTIBYTE_SIGN = re.compile("[ÃÂâ√├┬ГВ]")
ONE_BYTE_SIGN = re.compile(r"[^\x00-\x7fáàâãéèêíìîóòôõúùûüñçºª«»“”‘’‐-―\xad¬´\xa0¿¡](?<=[a-z].)")
#: Letters and signs that scanners take for one another, folded to one of them.
FOLD_FROM, FOLD_TO = b"1l!|ueyv65029tf8", b"iiiiicvvbsoooffb"
_TABLE = bytearray(b" " * 256)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _TABLE[_c] = _c
for _a, _b in zip(FOLD_FROM, FOLD_TO):
    _TABLE[_a] = _b
FOLD = bytes(_TABLE)
REPEATED = re.compile(rb"([a-z])\1+")
#: Shingles of the evaluation texts that a block of the index holds; a block takes about 11 bytes a shingle, and 64 MB.
BLOCK = 24_000_000
#: Training texts that are held for one reading of the index. Texts whose words are looked up together; texts, meetings and pairs
#: that are counted together; marks by which a text's shingles are told before they are compared.
HELD, TEXTS, TOGETHER, MEETINGS, PAIRS, MARKS = 40_000, 2_000, 128, 250_000, 20_000, 8_192
#: Lists of so many texts are cut to the sizes that count.
LONG = 64
#: Fixed value: of the shingles a pair must have in common, this share may lie beyond the prefixes. At 1 one meeting makes a
#: pair to compare; the less it is, the longer are the prefixes and the more meetings such a pair needs.
BEYOND = 0.85


def fold(text: str) -> bytes:
    """Lower-case ASCII with confusable letters folded and repeated letters closed up; other signs become blanks."""
    plain = unicodedata.normalize("NFKD", text.lower().replace("ı", "i")).encode("ascii", "ignore")
    plain = plain.replace(b"cl", b"d").replace(b"rn", b"m").translate(FOLD)
    return REPEATED.sub(rb"\1", plain)


class Codes(dict):
    """Token -> the hashes of its folded words, 8 bytes each."""

    def __missing__(self, token: str) -> bytes:
        if len(self) > 1_000_000:
            self.clear()
        code = b"".join(xxhash.xxh3_64_digest(w) for w in fold(token).split())
        self[token] = code
        return code


def skeleton(text: str, trusted: dict[str, int], codes: Codes) -> np.ndarray:
    """The word hashes of the skeleton in order; an empty or blank text has none."""
    if MULTIBYTE_SIGN.search(text):
        text = decode_spans(text)
    if ONE_BYTE_SIGN.search(text):
        text = decode_words(text, trusted)
    text = BROKEN_WORD.sub("", text)
    if SPACED_SIGN.search(text):
        text = SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return np.frombuffer(b"".join(map(codes.__getitem__, text.split())), np.uint64)


def shingles(codes: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text. Shorter texts are one shingle."""
    if not len(codes):
        return np.empty(0, np.int64)
    width = min(width, len(codes))
    n = len(codes) - width + 1
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = (mixed ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.append(True, mixed[1:] != mixed[:-1])].view(np.int64)


def contents(df: DataFrame, trusted: dict[str, int], width: int) -> DataFrame:
    """``key, split, content, shingles`` of ``key, split, text``: the skeleton's hash and its distinct shingles as bytes, a row per text that has words.

    Rows with NULL, empty or wordless text give no row.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for b in batches:
            out = []
            for k, s, t in zip(b["key"], b["split"], b["text"]):
                coded = skeleton(t, trusted, codes)
                if len(coded):
                    out.append((k, s, xxhash.xxh3_64_intdigest(coded.tobytes()) >> 1, shingles(coded, width).tobytes()))
            yield pd.DataFrame(out, columns=["key", "split", "content", "shingles"])

    return df.where("text != ''").select("key", "split", "text").mapInPandas(rows, "key string, split string, content long, shingles binary")


class Prefixes:
    """A block of the index: texts by rising size, and the texts that have each word in their prefix.

    All shingles of a hash bucket are one word, so no dictionary is needed; words are numbered by rising frequency. Texts have
    no fewer words in common than shingles, so no pair is lost by it.
    contents, sizes: the texts; at, sets: text -> its shingles; number: bucket -> word; start, owner: word -> texts.
    """

    FIELDS = ("contents", "sizes", "at", "sets", "number", "start", "owner")

    def __init__(self, same: float, **arrays: np.ndarray):
        self.same, self.part = same, same / (1 + same)
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, contents: np.ndarray, sets: list[np.ndarray], same: float) -> Prefixes:
        sizes = np.array([len(x) for x in sets], np.int64)
        order = np.argsort(sizes, kind="stable")
        return cls.of_sorted(np.asarray(contents)[order], sizes[order], np.concatenate([*(sets[i] for i in order), np.empty(0, np.int64)]), same)

    @classmethod
    def of_sorted(cls, contents: np.ndarray, sizes: np.ndarray, flat: np.ndarray, same: float) -> Prefixes:
        """The index of texts by rising size, whose shingles lie one text after another in ``flat``."""
        kept = _prefix(sizes, same)
        at = np.concatenate([[0], np.cumsum(sizes)])
        parts = [(k, min(k + TEXTS, len(sizes))) for k in range(0, len(sizes), TEXTS)]
        counts = np.zeros(1 << min(max(10, len(flat).bit_length()), 23), np.int32)
        for a, b in parts:
            np.add.at(counts, _buckets(flat[at[a] : at[b]], counts), 1)
        number = np.empty(len(counts), np.int32)
        number[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
        del counts
        posted = np.empty(kept.sum(), np.int64)
        done = 0
        for a, b in parts:
            words = _sorted_words(flat[at[a] : at[b]], sizes[a:b], number)
            words = words[_places(sizes[a:b]) < np.repeat(kept[a:b], sizes[a:b])]
            posted[done : done + len(words)] = words.astype(np.int64) << 32 | np.repeat(np.arange(a, b), kept[a:b])
            done += len(words)
        posted.sort()
        start = np.searchsorted(posted, np.arange(len(number) + 1) << 32).astype(np.int32)
        return cls(same, contents=contents, sizes=sizes, at=at, sets=flat, number=number, start=start, owner=posted.astype(np.int32))

    def save(self, path: str) -> None:
        fs, name = pa_fs.FileSystem.from_uri(path)
        part = f"{name}.{uuid.uuid4().hex}"  # another attempt of this task may be writing too
        fs.create_dir(part, recursive=True)
        for x in self.FIELDS:
            with fs.open_output_stream(f"{part}/{x}.npy") as f:
                np.save(f, getattr(self, x))
        fs.move(part, name)

    @classmethod
    def load(cls, path: str, same: float) -> Prefixes:
        """Files of this machine are mapped, so that what is not asked for is not read."""
        fs, name = pa_fs.FileSystem.from_uri(path)
        if isinstance(fs, pa_fs.LocalFileSystem):
            return cls(same, **{x: np.load(f"{name}/{x}.npy", mmap_mode="r").view(np.ndarray) for x in cls.FIELDS})
        arrays = {}
        for x in cls.FIELDS:
            with fs.open_input_file(f"{name}/{x}.npy") as f:
                arrays[x] = np.load(f)
        return cls(same, **arrays)

    def close_to(self, sets: list[np.ndarray]) -> list[list[tuple[int, float]]]:
        """For each set of shingles ``content, similarity`` of every indexed text with a Jaccard coefficient of ``same`` or more.

        Such a pair has ``part`` of both sizes together in common. At most ``BEYOND`` of these lie beyond the prefix of either,
        so the others are meetings of prefixes, which are counted. The prefix of a text is the shorter the longer the other
        text is: a word late in it is looked up for short texts alone. Pairs that meet often enough are compared in full.
        """
        out: list[list[tuple[int, float]]] = [[] for _ in sets]
        order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
        for k in range(0, len(order), TEXTS):
            few = order[k : k + TEXTS]
            for i, content, similarity in self._close([sets[i] for i in few]):
                out[few[i]].append((content, similarity))
        return out

    def _close(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int, float]]:
        m = np.array([len(x) for x in sets], np.int64)
        place, text = _places(m), np.repeat(np.arange(len(m)), m)
        inside = place < _prefix(m, self.same)[text]
        word = _sorted_words(np.concatenate(sets), m, self.number)[inside]
        first, last = self.start[word], self.start[word + 1]
        some = last > first
        text, place, first, last = text[inside][some], place[inside][some], first[some], last[some]
        long = np.flatnonzero(last - first >= LONG)
        of = text[long]
        # the word at a place counts for texts of a size at which the prefix reaches it
        most = np.floor((m[of] - place[long]) / (BEYOND * self.part) - m[of] + 1e-6)
        longest = np.searchsorted(self.sizes, np.arange(most.max(initial=0) + 1), "right")
        last[long] = _at_least(self.owner, first[long], last[long], longest[np.maximum(most, 0).astype(np.int64)])
        many = last - first
        through = np.cumsum(np.bincount(text, weights=many, minlength=len(m)).astype(np.int64))
        begin = 0
        while begin < len(m):
            end = max(begin + 1, int(np.searchsorted(through, (through[begin - 1] if begin else 0) + MEETINGS, "right")))
            end = min(end, begin + TOGETHER, begin + (2**31 - 1) // len(self.sizes))
            a, b = np.searchsorted(text, [begin, end])
            for i, *found in self._compare(sets[begin:end], m[begin:end], text[a:b] - begin, first[a:b], many[a:b]):
                yield begin + i, *found
            begin = end

    def _compare(self, sets: list[np.ndarray], m: np.ndarray, text: np.ndarray, first: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int, float]]:
        least = max(1, int(np.ceil((1 - BEYOND) * self.same * m.min() - 1e-6)))  # meetings that any pair here needs
        total = int(many.sum())
        if total < least:
            return
        met = np.repeat(first - (np.cumsum(many, dtype=np.int64) - many).astype(np.int32), many)
        met += np.arange(total, dtype=np.int32)
        met = self.owner[met]
        met += np.repeat((text * len(self.sizes)).astype(np.int32), many)
        met.sort()
        often = met[least - 1 :][met[least - 1 :] == met[: total - least + 1]]
        often, n = _runs(often)
        of, held = np.divmod(often.astype(np.int64), len(self.sizes))
        size = self.sizes[held]
        common = self.part * (m[of] + size)
        fits = (n + least - 1 >= (1 - BEYOND) * common - 1e-6) & (size <= m[of] / self.same + 1e-6) & (size >= m[of] * self.same - 1e-6)
        of, held, size, common = of[fits], held[fits], size[fits], common[fits]
        marks = np.zeros((len(sets), MARKS), bool)
        for i in np.unique(of):
            marks[i, sets[i] & (MARKS - 1)] = True
        for a in range(0, len(of), PAIRS):
            theirs, begins = self._shingles(held[a : a + PAIRS])
            theirs &= MARKS - 1
            theirs += np.repeat(of[a : a + PAIRS] * MARKS, size[a : a + PAIRS])
            shared = np.add.reduceat(marks.ravel()[theirs], begins, dtype=np.int64)
            for k in a + np.flatnonzero(shared >= common[a : a + PAIRS] - 1e-6):
                i = int(of[k])
                shared_k = len(np.intersect1d(sets[i], self.sets[self.at[held[k]] : self.at[held[k] + 1]], assume_unique=True))
                similarity = shared_k / (len(sets[i]) + int(size[k]) - shared_k)
                if similarity >= self.same - 1e-9:
                    yield i, int(self.contents[held[k]]), similarity

    def _shingles(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of indexed texts one text after another, and where each begins."""
        size = self.sizes[held]
        begins = np.cumsum(size) - size
        return self.sets[np.repeat(self.at[held] - begins, size) + np.arange(size.sum())], begins


def _prefix(sizes: np.ndarray, same: float) -> np.ndarray:
    """How many of a text's rarest shingles its prefix holds: the others are ``BEYOND`` of what a pair has in common, or fewer."""
    return sizes - np.floor(BEYOND * same * sizes + 1e-9).astype(np.int64)


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the texts that lie one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a row in which equal ones stand together, and how often each stands there."""
    at = np.flatnonzero(np.append(True, rising[1:] != rising[:-1])[: len(rising)])
    return rising[at], np.diff(at, append=len(rising))


def _buckets(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return hashes & (len(table) - 1)


def _sorted_words(hashes: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The words of each text in order."""
    words = number[_buckets(hashes, number)]
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        words[a:b].sort()
    return words


def _at_least(values: np.ndarray, first: np.ndarray, last: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each stretch of ``values``, in which they rise, the place of the first that is ``bound`` or more."""
    first, last = first.copy(), last.copy()
    open_ = np.flatnonzero(first < last)
    while len(open_):
        middle = (first[open_] + last[open_]) >> 1
        less = values[middle] < bound[open_]
        first[open_[less]] = middle[less] + 1
        last[open_[~less]] = middle[~less]
        open_ = open_[first[open_] < last[open_]]
    return first


@lru_cache(maxsize=1)
def _block(path: str, same: float) -> Prefixes:
    """A block of the index, loaded once per Python worker."""
    return Prefixes.load(path, same)


def index(sides: DataFrame, same: float, block: int = BLOCK) -> list[str]:
    """The blocks of the index over ``content, shingles``, each of about ``block`` shingles; equal contents are one."""
    total = sides.select("content", F.octet_length("shingles").alias("n")).distinct().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // 8
    blocks = -(-total // block)
    folder = f"{checkpoint_dir(sides.sparkSession)}/prefixes-{uuid.uuid4().hex}"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        contents, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        with tempfile.TemporaryFile() as held:  # a file, so that a block's shingles need no memory
            for b in batches:
                held.write(b"".join(b["shingles"]))
                contents.append(b["content"].to_numpy())
                sizes.append(b["shingles"].map(len).to_numpy() // 8)
            held.flush()
            if held.tell():
                name = f"{TaskContext.get().partitionId()}"
                Prefixes.of_sorted(np.concatenate(contents), np.concatenate(sizes), np.memmap(held, np.int64, "r").view(np.ndarray), same).save(f"{folder}/{name}")
                yield pd.DataFrame({"block": [name]})

    if not total:
        return []
    built = sides.dropDuplicates(["content"]).repartition(blocks, "content").sortWithinPartitions(F.octet_length("shingles")).mapInPandas(build, "block string")
    return [f"{folder}/{r['block']}" for r in built.collect()]


def probe(texts: DataFrame, paths: list[str], trusted: dict[str, int], same: float, width: int) -> DataFrame:
    """``key, content, similarity`` of every ``key, text`` and indexed content; equal texts of a batch are looked up once, many texts for each reading of the index."""

    def found(asked: list[tuple[str, int]], sets: list[np.ndarray]) -> pd.DataFrame:
        met: list[list[tuple[int, float]]] = [[] for _ in sets]
        for path in paths:
            for of, pairs in zip(met, _block(path, same).close_to(sets)):
                of += pairs
        return pd.DataFrame([(k, *pair) for k, i in asked for pair in met[i]], columns=["key", "content", "similarity"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        asked: list[tuple[str, int]] = []
        sets: list[np.ndarray] = []
        for b in batches:
            place: dict[str, int] = {}
            for k, t in zip(b["key"], b["text"]):
                if t not in place:
                    place[t] = len(sets)
                    sets.append(shingles(skeleton(t, trusted, codes), width))
                asked.append((k, place[t]))
            if len(sets) >= HELD:
                yield found(asked, sets)
                asked, sets = [], []
        yield found(asked, sets)

    return texts.mapInPandas(rows, "key string, content long, similarity double")


@dataclass
class Overlaps:
    """matches: ``id_t, content, similarity`` per training row and evaluation content; members: ``content, id_e, split_e``."""

    matches: DataFrame
    members: DataFrame

    def pairs(self) -> DataFrame:
        """``id_t, id_e, split_e, similarity``: contents expanded into their records."""
        return self.matches.join(self.members, "content").where("id_t != id_e").select("id_t", "id_e", "split_e", "similarity")

    def counts(self, rows: DataFrame, key: str = "id", source: str = "source") -> DataFrame:
        """``split, source, records, training_records, pairs``: overlaps by the evaluation record's split and source.

        Pairs are counted from the sizes of contents, so no group of copies is expanded. A key that is in training
        and in evaluation counts as a pair with the others only.
        """
        of = rows.select(F.col(key).alias("id_e"), F.col(source).alias("source")).distinct()
        members = cut(self.members.join(of, "id_e"))
        trained = self.matches.groupBy("content").agg(F.count("*").alias("t"))
        own = self.matches.join(members, (self.matches["content"] == members["content"]) & (F.col("id_t") == F.col("id_e"))).groupBy("id_e", "split_e", "source").agg(F.count("*").alias("own"))
        held = members.join(trained, "content").join(own, ["id_e", "split_e", "source"], "left").withColumn("n", F.col("t") - F.coalesce("own", F.lit(0))).where("n > 0")
        totals = held.groupBy("split_e", "source").agg(F.countDistinct("id_e").alias("records"), F.sum("n").alias("pairs"))
        groups = members.groupBy("content", "split_e", "source").agg(F.min("id_e").alias("least"), F.max("id_e").alias("most"))
        used = self.matches.join(groups, "content").where("not (id_t = least and id_t = most)").groupBy("split_e", "source").agg(F.countDistinct("id_t").alias("training_records"))
        return totals.join(used, totals["split_e"].eqNullSafe(used["split_e"]) & totals["source"].eqNullSafe(used["source"])).select(
            totals["split_e"].alias("split"), totals["source"], "records", "training_records", "pairs"
        )


def split_overlaps(
    df: DataFrame, key: str = "id", text: str = "original_text", split: str = "split", training: str = "training", same: float = 0.29, width: int = 5
) -> Overlaps:
    """Every training row with every evaluation content whose running text is (nearly) the same.

    The similarity is the Jaccard coefficient of the ``width``-word shingles of the whole skeletons, at least ``same``; no
    such pair is left out. Rows with NULL split, NULL or wordless text take part in no pair; repeated deliveries of a key
    count once, under each content they were delivered with.
    """
    trusted = trusted_words(df, text)
    rows = df.where(F.col(split).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(split).alias("split"))
    evaluation, train = rows.where(F.col("split") != training), rows.where(F.col("split") == training)
    known = cut(contents(evaluation, trusted, width))
    paths = index(known.select("content", "shingles"), same)
    members = known.select("content", F.col("key").alias("id_e"), F.col("split").alias("split_e")).distinct()
    matches = cut(probe(train.where("text != ''").select("key", "text"), paths, trusted, same, width).select(F.col("key").alias("id_t"), "content", "similarity").distinct())
    return Overlaps(matches, members)

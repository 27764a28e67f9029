"""Variant spellings of people and bodies: a pigeonhole segment join on surnames, then linking by what the rest allows.

Each surname (or place of a body) is cut into k+1 segments; a surname within k edits has one of them intact at a shifted
position, so looking the shifted substrings up in an inverted index of segments finds every pair, which a banded edit
distance then verifies. Names with near surnames are linked when their given names, second surnames and initials agree;
a short form that would fit two different people is linked to neither.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.operators.packed import parse_element
from acervo.sources import cut

#: Spanish and Portuguese short forms of given names, without accents.
SHORT_FORMS = {
    "ale": "alejandro", "jano": "alejandro", "alex": "alejandro", "bea": "beatriz", "beti": "beatriz", "beto": "roberto", "rober": "roberto", "tito": "roberto", "chela": "graciela", "chelo": "graciela",
    "concha": "concepcion", "conchita": "concepcion", "fran": "francisco", "paco": "francisco", "pancho": "francisco", "gaby": "gabriela", "gabi": "gabriela", "gonza": "gonzalo", "chalo": "gonzalo",
    "guille": "guillermo", "memo": "guillermo", "isa": "isabel", "chabela": "isabel", "juli": "julian", "lalo": "eduardo", "edu": "eduardo", "lau": "laura", "lola": "dolores", "loli": "dolores",
    "lucho": "luis", "manolo": "manuel", "manu": "manuel", "lolo": "manuel", "maria": "maria", "mari": "maria", "mary": "maria", "maru": "maria", "mecha": "mercedes", "meche": "mercedes", "merche": "mercedes",
    "moncho": "ramon", "nacho": "ignacio", "nico": "nicolas", "pepe": "jose", "pepa": "josefa", "quique": "enrique", "kike": "enrique", "rulo": "raul", "santi": "santiago", "sergi": "sergio", "checho": "sergio",
    "sofi": "sofia", "susi": "susana", "susy": "susana", "tere": "teresa", "tomi": "tomas", "tete": "hector", "vito": "victor", "emi": "emilia", "mili": "emilia", "pau": "paula", "lidi": "lidia", "ale.": "alejandro",
}
#: Titles before names, and particles that surnames may carry or drop.
TITLES = frozenset("dr dra prof profa lic ing mg mag mgr arq abog cpn sr sra srta phd msc mtro mtra don dona".split())
PARTICLES = frozenset("de del la las los da do dos das y e van von di".split())
#: First words of bodies with their letter in acronyms, and the little words acronyms leave out.
BODIES = {"instituto": "i", "inst": "i", "institute": "i", "centro": "c", "ctro": "c", "departamento": "d", "depto": "d", "dpto": "d", "dep": "d", "facultad": "f", "fac": "f", "facultade": "f", "laboratorio": "l", "lab": "l", "universidad": "u", "univ": "u", "grupo": "g", "museo": "m", "escuela": "e", "catedra": "c", "programa": "p", "unidad": "u", "comision": "c", "ministerio": "m", "secretaria": "s"}
LITTLE = frozenset("de del la las los el y e of the and".split())
COLUMNS = ["body", "s1", "s2", "g1", "g2"]


def plain(text: str) -> str:
    return unicodedata.normalize("NFD", text.lower()).encode("ascii", "ignore").decode()


def parse_name(name: str, given: frozenset[str]) -> tuple[bool, str, str, str, str]:
    """``body, s1, s2, g1, g2``: first surname and the others, first given name and the others (full or initial, joined by
    blanks), or place and acronym of a body."""
    text = re.sub(r"::\w*\s*$", "", name).strip()
    words = re.findall(r"[^\W\d_]+", text)
    if not words:
        return False, "", "", "", ""
    flat = [plain(w) for w in words]
    kinds = [i for i, w in enumerate(flat) if w in BODIES]
    acronym = re.match(r"^([A-Z]{2,6})\s+(?!\W)([^\W\d_][^,]+)$", text)
    if kinds and (kinds[0] == 0 or re.match(r"^[^,]+\.\s", text)):
        at = kinds[0]
        if at > 0:  # "Place. Institute of X"
            place, body = flat[:at], flat[at:]
        elif m := re.search(r"\(([^()]+)\)\s*$", text):
            place = [plain(w) for w in re.findall(r"[^\W\d_]+", m[1])]
            body = flat[: len(flat) - len(place)]
        else:
            last = max((i for i, w in enumerate(flat[:-1]) if w == "de"), default=None)
            tail = flat[last + 1 :] if last is not None and len(flat) - last <= 3 and text.rstrip(".")[-1:] != ")" else flat[-1:]
            place, body = tail, flat[: len(flat) - len(tail)]
        letters = "".join(BODIES.get(w, w[0]) if i == 0 else w[0] for i, w in enumerate(w for w in body if w not in LITTLE))
        return True, "".join(place), "", letters, ""
    if acronym and len(words) <= 4 and acronym[2][0].isupper() and not acronym[2].isupper():
        return True, "".join(plain(w) for w in re.findall(r"[^\W\d_]+", acronym[2])), "", plain(acronym[1]), ""

    def is_given(w: str) -> bool:
        return w in given or w in SHORT_FORMS or len(w) == 1

    if "," in text:
        left, right = text.split(",", 1)
        surnames = [plain(w) for w in re.findall(r"[^\W\d_]+", left)]
        names = [plain(w) for w in re.findall(r"[^\W\d_]+", right)]
    else:
        flat = [w for w in flat if w not in TITLES]
        surnames = [w for w in flat if not is_given(w)]
        names = [w for w in flat if is_given(w)]
        if len([w for w in surnames if w not in PARTICLES]) > 1 and surnames:
            near = [w for w in surnames if len(w) > 3 and any(abs(len(w) - len(g)) <= 1 and _edits(w, g) <= 1 for g in given if g[0] == w[0] or g[1:3] == w[1:3])]
            if near and len(near) < len(surnames):  # a misspelt given name
                names = [w for w in flat if w in near or w in names]
                surnames = [w for w in surnames if w not in near]
        if not names and len(flat) > 1:
            surnames, names = flat[-1:], flat[:-1]
    surnames = [w for w in surnames if w not in PARTICLES and w not in TITLES]
    names = [SHORT_FORMS.get(w, w) for w in names if w not in TITLES and w not in PARTICLES or len(w) == 1]
    (s1, *others), (g1, *further) = surnames or [""], names or [""]
    return False, s1, " ".join(others), g1, " ".join(further)


def _edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance with adjacent transpositions, in a band of ``most`` around the diagonal; above it, ``most`` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = [j if j <= most else most + 1 for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        new = [i if i <= most else most + 1] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before[j - 2] + 1)
            new[j] = min(best, most + 1)
        before, row = row, new
    return row[-1]


def _cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and end of ``parts`` segments of near equal length."""
    base, extra = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - extra)
        out.append((at, at + size))
        at += size
    return out


def near_words(words: DataFrame, k: int = 2, most: int = 1) -> DataFrame:
    """``word_a, word_b``: all pairs (both ways, equals included) of the STRING column ``word`` within ``most`` edits.

    The segment join is exact for ``k`` plain edits; a transposition is one edit here and two plain ones, so k = 2 serves
    most = 1. Segments of short words tell nothing: words of three to five letters meet by what is left without one
    letter, which is exact for most = 1. Words of two letters or fewer match only themselves. NULL and empty words are left out.
    """
    words = words.where(F.col("word") != "").select("word").distinct()

    def short(w: str) -> set[str]:
        return {f"-:{x}" for x in (w, *(w[:i] + w[i + 1 :] for i in range(len(w))))} if 3 <= len(w) <= 5 else set()

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{len(w)}:{i}:{w[x:y]}", w) for w in b["word"] if len(w) > 4 for i, (x, y) in enumerate(_cuts(len(w), k + 1))]
            rows += [(x, w) for w in b["word"] for x in short(w)]
            yield pd.DataFrame(rows, columns=["segment", "word_a"])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for w in b["word"]:
                n = len(w)
                rows.update((x, w) for x in short(w))
                for length in range(max(5, n - k), n + k + 1) if n > 4 else ():
                    for i, (x, y) in enumerate(_cuts(length, k + 1)):
                        shift = n - length
                        low = max(0, x - i, x + shift - (k - i))
                        high = min(n - (y - x), x + i, x + shift + (k - i))
                        rows.update((f"{length}:{i}:{w[s : s + y - x]}", w) for s in range(low, high + 1))
            yield pd.DataFrame(list(rows), columns=["segment", "word_b"])

    found = words.mapInPandas(index, "segment string, word_a string").join(words.mapInPandas(probe, "segment string, word_b string"), "segment")
    found = found.where((F.col("word_a") < F.col("word_b")) & (F.levenshtein("word_a", "word_b", k) >= 0)).select("word_a", "word_b").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[_edits(x, y, most) <= most for x, y in zip(b["word_a"], b["word_b"])]]

    near = found.mapInPandas(verify, "word_a string, word_b string")
    return near.unionByName(near.select(F.col("word_b").alias("word_a"), F.col("word_a").alias("word_b"))).unionByName(words.select(F.col("word").alias("word_a"), F.col("word").alias("word_b")))


def agreement(a: tuple, b: tuple, given: frozenset[str]) -> str | None:
    """How two parsed names with near surnames agree: ``same`` (equally full), ``part`` (one lacks a second name), ``initial``, or None."""

    def fits(x: str, y: str, known: frozenset[str]) -> bool:
        if not x or not y:
            return True
        if len(x) == 1 or len(y) == 1:
            return x[0] == y[0]
        return x == y or (not (x in known and y in known) and min(len(x), len(y)) > 2 and _edits(x, y, 1) <= 1)

    def all_fit(x: str, y: str, known: frozenset[str]) -> bool:
        return all(fits(p, q, known) for p, q in zip(x.split(), y.split()))

    def full(x: str) -> int:
        return sum(len(p) > 1 for p in x.split())

    if a[0] != b[0] or not a[3] or not b[3]:
        return None
    if a[0]:
        return "same" if a[3] == b[3] else None
    if not fits(a[3], b[3], given) or not all_fit(a[4], b[4], given) or not all_fit(a[2], b[2], frozenset()):
        return None
    if len(a[3]) == 1 or len(b[3]) == 1:
        return "initial"
    return "same" if full(a[4]) == full(b[4]) else "part"


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, comp``: the least id reachable from each of ``nodes`` over ``edges`` (a, b, both ways).

    Least labels are passed on, and each takes the label of its label, until none moves.
    """
    labels = cut(nodes.select("id", F.col("id").alias("comp")))
    while True:
        passed = edges.join(labels, edges["a"] == labels["id"]).groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("least"))
        moved = cut(labels.join(passed, "id", "left").select("id", F.least("comp", "least").alias("comp"), (F.col("least") < F.col("comp")).alias("moved")))
        if not moved.where("moved").head(1):
            return moved.select("id", "comp")
        further = moved.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        labels = cut(moved.join(further, "comp", "left").select("id", F.least("comp", "next").alias("comp")))


def link_names(names: DataFrame, given: frozenset[str]) -> DataFrame:
    """``name, entity``: each distinct name that holds one value, with the id of the person or body it means.

    names: a STRING column ``name``. NULL, blank and many-valued names give no row; repeated names one row.
    """
    known = frozenset(plain(g) for g in given)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, *parse_name(n, known)) for n in b["name"] if len(parse_element(n, True, given)[0]) == 1]
            yield pd.DataFrame(rows, columns=["name", *COLUMNS])

    parsed = cut(names.where(F.trim("name") != "").select("name").distinct().mapInPandas(parse, "name string, body boolean, s1 string, s2 string, g1 string, g2 string").where("s1 != ''"))
    # spellings that parse alike are one form: forms are compared, and names follow their form
    form = F.xxhash64(*COLUMNS).alias("id")
    nodes = cut(parsed.select(form, *COLUMNS).distinct().withColumn("first", F.substring("g1", 1, 1)))
    near = cut(near_words(nodes.select(F.col("s1").alias("word"))))
    side = lambda x, *extra: nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", *COLUMNS)], F.col("s1").alias(f"word_{x}"), "first", "body", *extra)
    columns = [f"{c}_{x}" for x in "ab" for c in ("id", *COLUMNS)]
    meets = side("a").join(near, "word_a").join(side("b"), ["word_b", "first", "body"]).where("id_a != id_b").select(*columns)
    # given names of different first letters: near spellings under one surname
    given_near = near_words(nodes.where("not body and length(g1) > 2").select(F.col("g1").alias("word"))).where(F.substring("word_a", 1, 1) != F.substring("word_b", 1, 1))
    given_near = given_near.select(F.col("word_a").alias("g1_a"), F.col("word_b").alias("g1_b"))
    swapped = side("a").drop("first").join(given_near, "g1_a").join(side("b").drop("first").withColumnRenamed("word_b", "word_a"), ["word_a", "g1_b", "body"]).where("not body").select(*columns)
    pairs = meets.unionByName(swapped)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = [f"{c}_a" for c in COLUMNS], [f"{c}_b" for c in COLUMNS]
        for b in batches:
            told = [agreement(x, y, known) for x, y in zip(b[left].itertuples(index=False, name=None), b[right].itertuples(index=False, name=None))]
            out = pd.DataFrame({"a": b["id_a"], "b": b["id_b"], "how": told, "exact": b["s1_a"] == b["s1_b"], "second": (b["g2_a"] != "") & (b["g2_b"] != "")})
            yield out[out["how"].notna()]

    links = cut(pairs.mapInPandas(judge, "a long, b long, how string, exact boolean, second boolean"))
    full = nodes.where("body or length(g1) > 1")
    comp = components(full, links.where("how = 'same'").select("a", "b"))
    # a form with fewer given names joins the one person it fits
    fullness = lambda c: nodes.select(F.col("id").alias(c), F.size(F.filter(F.split("g2", " "), lambda g: F.length(g) > 1)).alias(f"full_{c}"))
    part = links.where("how = 'part'").join(fullness("a"), "a").join(fullness("b"), "b").where("full_a < full_b").select("a", "b")
    of = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
    lone = part.join(of("a"), "a").join(of("b"), "b").groupBy("comp_a").agg(F.collect_set("comp_b").alias("fits")).where("size(fits) = 1").select(F.col("comp_a").alias("comp"), F.col("fits")[0].alias("into"))
    people = cut(comp.join(lone, "comp", "left").select("id", F.coalesce("into", "comp").alias("comp")))
    # a form with initials joins the one person it fits: of equal surnames first, then of those whose second name agrees too
    short = nodes.where("not body and length(g1) = 1").select(F.col("id").alias("a"))
    meets = links.where("how = 'initial'").join(short, "a", "left_semi").join(people.select(F.col("id").alias("b"), F.col("comp")), "b")
    fits = meets.groupBy("a").agg(
        F.collect_set(F.when(F.col("exact"), F.col("comp"))).alias("equal"), F.collect_set(F.when(F.col("exact") & F.col("second"), F.col("comp"))).alias("closer"), F.collect_set("comp").alias("any")
    )
    chosen = F.when(F.size("equal") == 1, F.col("equal")[0]).when(F.size("closer") == 1, F.col("closer")[0]).when((F.size("equal") == 0) & (F.size("any") == 1), F.col("any")[0])
    joined = fits.select(F.col("a").alias("id"), chosen.alias("comp"))
    rest = nodes.where("not body and length(g1) = 1").join(joined, "id", "left").select("id", F.coalesce("comp", F.xxhash64("s1", "g1", F.substring("g2", 1, 1))).alias("comp"))
    bare = nodes.where("not body and g1 = ''").select("id", F.xxhash64("s1", "s2").alias("comp"))
    return parsed.select("name", form).join(people.unionByName(rest).unionByName(bare), "id").select("name", F.col("comp").alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """``name_a, name_b``: every pair of different names of one entity, the smaller first by code point."""
    a = linked.select("entity", F.col("name").alias("name_a"))
    return a.join(linked.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b").distinct()

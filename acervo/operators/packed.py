"""Several values packed in one field: a parsing expression grammar over list elements.

The grammar tries its alternatives in order and backtracks:

    element   <- bracketed / numbered / quoted_list / separated / single
    bracketed <- '[' item (sep item)* ']' end
    numbered  <- marker(1) body marker(2) body ...          markers ``1.``, ``1)`` or ``(1)``, consecutive from 1
    item      <- quoted authority? &boundary / bare authority?
    quoted    <- '"' ... '"' / "'" ... "'" / '«' ... '»' / '“' ... '”'
    bare      <- (group / !separator any)*                  separators inside (...) do not count

A quote that never closes before a boundary is backtracked over, read as an ordinary character, and the row is flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.sources import cut

QUOTES = {'"': '"', "'": "'", "«": "»", "“": "”"}
STRONG = re.compile(r"\s*(?:\|\||[|;\n\r\t•·])\s*|\s+/\s+|\s+[–—-]\s+")
#: A comma separates unless it stands between two digits, where it belongs to a number ("pH 7,4").
STRONG_OR_COMMA = re.compile(STRONG.pattern + r"|\s*(?:(?<!\d),|,(?!\d))\s*")
MARKER = re.compile(r"\(?(\d{1,3})[.)]\s+")
AUTHORITY = re.compile(r"\s*::\s*\w*\s*$")
AUTHORITY_AFTER_QUOTE = re.compile(r"::\w*")
CONJUNCTION = re.compile(r"\s+(?:y|e|and|et|&)\s+")
#: Words on which an inverted heading such as "Spectrum, history of" ends.
OPEN_ENDS = frozenset("de del da do das dos di of la las los lo el en the des du della delle dei degli le les l d para for to".split())
#: An element without any of these holds one value; the rest go to the grammar.
CANDIDATE = r"[|;\n\t•·,/–—&\[«\"“]|::|'| - |\d[.)]\s| (y|e|and|et) "


class Packed(Exception):
    """Raised by a rule that does not match; the next alternative is tried."""


def _quoted(s: str, at: int, sep: re.Pattern, close: str = "") -> tuple[str, int]:
    """A quoted value from ``at`` whose end is followed by a boundary; the earliest such closing quote wins."""
    end_mark = QUOTES.get(s[at : at + 1])
    if not end_mark:
        raise Packed
    end = s.find(end_mark, at + 1)
    while end != -1:
        after = end + 1
        if m := AUTHORITY_AFTER_QUOTE.match(s, after):
            after = m.end()
        rest = s[after:]
        bare = rest.lstrip()
        if not bare or sep.match(s, after) or (close and bare.startswith(close)) or (rest[:1].isspace() and bare[0] in QUOTES):
            return s[at + 1 : end], after
        end = s.find(end_mark, end + 1)
    raise Packed


def _bare(s: str, at: int, sep: re.Pattern, close: str = "") -> tuple[str, int]:
    """Text up to the next separator outside parentheses; a parenthesis that never closes is an ordinary character."""
    i = at
    while i < len(s):
        if s[i] == "(" and (end := s.find(")", i)) != -1:
            i = end + 1
            continue
        if close and s[i] == close:
            break
        if (m := sep.match(s, i)) and m.end() > i:
            break
        i += 1
    return s[at:i], i


def _items(s: str, sep: re.Pattern, close: str = "", only_quoted: bool = False) -> tuple[list[tuple[str, bool]], int, bool]:
    """item (sep item)*: the values with whether each was quoted, where the list ended, and whether a quote was malformed."""
    out: list[tuple[str, bool]] = []
    at, bad = 0, False
    while True:
        if (m := sep.match(s, at)) and m.end() > at:
            at = m.end()
            continue
        while at < len(s) and s[at].isspace():
            at += 1
        if at >= len(s) or (close and s[at] == close):
            return out, at, bad
        try:
            value, at = _quoted(s, at, sep, close)
            out.append((value, True))
        except Packed:
            if only_quoted:
                raise
            bad |= s[at] in QUOTES
            value, at = _bare(s, at, sep, close)
            out.append((value, False))


def _clean(value: str) -> str:
    return AUTHORITY.sub("", value).strip().strip(";|").strip()


def _bracketed(s: str) -> list[str]:
    if not (s.startswith("[") and s.endswith("]")):
        raise Packed
    values, at, _ = _items(s[1:], STRONG_OR_COMMA, "]")
    if at != len(s) - 2 or not any(q for _, q in values):
        raise Packed
    return [v for v, _ in values]


def _numbered(s: str) -> list[str]:
    marks, want = [], 1
    for m in MARKER.finditer(s):
        if int(m[1]) == want and (want > 1 or m.start() == 0):
            marks.append(m)
            want += 1
        elif want == 1:
            raise Packed
    if len(marks) < 2:
        raise Packed
    stops = [m.start() for m in marks[1:]] + [len(s)]
    return [s[m.end() : e].strip().rstrip(";,|/").strip() for m, e in zip(marks, stops)]


def _people(s: str, given: frozenset[str]) -> list[str]:
    """Names joined by a conjunction or, in natural order, by commas; ``[s]`` where the parts are not whole names.

    "A, B y C, D" holds two; "A y B, C" is one person with a double surname; "C A y D B" and "C A, D B" hold two when
    each part has two words or more and begins with a known given name.
    """
    parts = CONJUNCTION.split(s)
    if len(parts) > 1 and all(p.count(",") == 1 for p in parts):
        return parts
    natural = [p.strip() for part in parts for p in part.split(",")]
    if len(natural) > 1 and all(len(w := p.split()) > 1 and w[0].lower() in given and w[-1].lower() not in given for p in natural):
        return natural
    return [s]


def _headings(values: list[tuple[str, bool]], seps: list[str]) -> list[str]:
    """Join a comma piece that ends on an open word to the piece before it ("Spectrum, history of" is one heading)."""
    out: list[str] = []
    for (value, quoted), sep in zip(values, seps):
        words = value.lower().split()
        if out and not quoted and sep.strip() == "," and words and words[-1].split("'")[-1] in OPEN_ENDS:
            out[-1] = f"{out[-1]}{sep}{value}"
        else:
            out.append(value)
    return out


def parse_element(s: str | None, names: bool, given: frozenset[str]) -> tuple[list[str], bool]:
    """The values one element holds, in order, and whether a malformed quote was met. Blank pieces are not values."""
    if not s or not (s := s.strip()):
        return [], False
    bad = False
    for rule in (_bracketed, _numbered):
        try:
            values = rule(s)
            break
        except Packed:
            continue
    else:
        try:
            values = [v for v, _ in _items(s, STRONG_OR_COMMA, only_quoted=True)[0]]
        except Packed:
            if names:
                pieces, _, bad = _items(s, STRONG)
                values = [w for v, quoted in pieces for w in ([v] if quoted else _people(_clean(v), given))]
            else:
                pieces, _, bad = _items(s, STRONG_OR_COMMA)
                seps, at = [], 0
                for value, _ in pieces:  # the separator text before each piece
                    where = s.find(value, at) if value else at
                    seps.append(s[at:where].strip("\"'«»“”") if where >= at else "")
                    at = max(at, where + len(value))
                values = _headings(pieces, seps)
    return [v for v in map(_clean, values) if v], bad


def given_names(people: DataFrame, share: float = 1e-3) -> frozenset[str]:
    """Words that stand after the comma of different "Surname, Given" elements: each at least ``share`` of all such words.

    people: one STRING column ``name``; each spelling counts once, so that a misspelling repeated often is no given name.
    At most 1/share words can qualify, so the collected set has a proven bound (1 000).
    """
    people = people.distinct()
    plain = people.where(F.col("name").rlike(r"^[^,;|/\[\]\"«•·\n\t]+,\s[^,;|/\[\]\"«•·\n\t:]+$") & ~F.col("name").rlike(r" (y|e|and|et|&) "))
    words = plain.select(
        F.explode(
            F.concat(
                F.transform(F.split(F.lower(F.substring_index("name", ",", 1)), r"\s+"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("is_given"))),
                F.transform(F.split(F.lower(F.trim(F.substring_index("name", ",", -1))), r"\s+"), lambda w: F.struct(w.alias("word"), F.lit(1).alias("is_given"))),
            )
        ).alias("x")
    ).select("x.*")
    counts = cut(words.groupBy("word").agg(F.sum("is_given").alias("g"), F.sum(1 - F.col("is_given")).alias("s")))  # asked twice, counted once
    total = counts.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("n")).first()["n"]
    kept = counts.where((F.col("g") >= max(2.0, share * total)) & (F.col("g") > 2 * F.col("s")) & (F.length("word") > 2) & ~F.col("word").isin(*OPEN_ENDS))
    return frozenset(r["word"] for r in kept.select("word").collect())


def unpack(df: DataFrame, key: str, fields: dict[str, tuple[Column, bool]], given: frozenset[str]) -> DataFrame:
    """One row per value of every element that holds two or more: ``key, field, elem, pos, value, malformed``.

    fields: name -> (ARRAY<STRING> column, whether it holds names). NULL arrays, NULL and blank elements give no row; a
    missing key is kept as NULL; other columns of ``df`` are not touched. Repeated values stay, each with its position.
    The candidate test runs in the JVM; only elements that may hold several values reach Python, in Arrow batches.
    """
    def tag(field: str, col: Column, names: bool) -> Column:
        cells = F.coalesce(col, F.array().cast("array<string>"))
        return F.transform(cells, lambda e, i: F.struct(F.lit(field).alias("field"), i.alias("elem"), e.alias("raw"), F.lit(names).alias("names")))

    tagged = F.concat(*[tag(field, col, names) for field, (col, names) in fields.items()])
    cells = df.select(F.col(key).alias("key"), F.explode(F.filter(tagged, lambda x: x["raw"].rlike(CANDIDATE))).alias("x")).select("key", "x.*")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, f, e, raw, names in zip(b["key"], b["field"], b["elem"], b["raw"], b["names"]):
                values, bad = parse_element(raw, names, given)
                if len(values) > 1:
                    rows += [(k, f, e, p, v, bad) for p, v in enumerate(values, 1)]
            yield pd.DataFrame(rows, columns=["key", "field", "elem", "pos", "value", "malformed"])

    out = cells.mapInPandas(parse, "key string, field string, elem int, pos int, value string, malformed boolean")
    return out.withColumnRenamed("key", key)

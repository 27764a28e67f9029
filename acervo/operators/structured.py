"""Broken JSON, TEI and BibTeX records, and markup, read with built-in expressions."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.functions import text as T

#: Fixed value: a first-level pair of broken JSON; any key, a value without nesting.
PAIR = r'"([^"]+)"\s*:\s*("[^"]*"|\[[^\]]*\]|true|false|null|-?[0-9]+(?:\.[0-9]+)?)'


def strip_fence(c: Column) -> Column:
    """A string without the code fence (and its language) around it."""
    return F.trim(F.regexp_replace(c, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def after_marker(c: Column, marker: str = "</think>") -> Column:
    """The text after the first ``marker``; NULL without one."""
    at = F.locate(marker, c)
    return F.when(at > 0, F.trim(F.substring(c, at + len(marker), F.length(c))))


def salvage_pairs(df: DataFrame, key: str, raw: str) -> DataFrame:
    """``key, field, value``: first-level pairs of a broken JSON string; of a repeated field the longest raw value, then the first."""
    names, values = F.regexp_extract_all(F.col(raw), F.lit(PAIR), F.lit(1)), F.regexp_extract_all(F.col(raw), F.lit(PAIR), F.lit(2))
    pairs = df.select(key, F.posexplode(F.arrays_zip(names.alias("field"), values.alias("value"))).alias("pos", "x")).select(key, "pos", "x.field", "x.value")
    w = W.partitionBy(key, "field").orderBy(F.desc(F.length("value")), "pos")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "field", F.regexp_replace("value", '^"|"$', "").alias("value"))


def tolerant_json(df: DataFrame, key: str, raw: str) -> DataFrame:
    """``key, value, error``: the object as JSON text, after strict parsing, quote repair, closing of brackets, decoding its
    bytes again as UTF-8, or salvage of pairs (values typed where they are JSON), else an error."""
    import re

    pair = re.compile(PAIR)

    def value(raw: str):
        try:
            return json.loads(raw)
        except ValueError:
            return raw.strip('"')

    def read(s: str | None) -> tuple[str | None, str | None]:
        if s is None or not s.strip():
            return None, "empty"
        text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", s).strip()
        for attempt in (text, text + "}", text + '"}', text + "]}", text + '"]}'):
            try:
                out = json.loads(attempt)
                return (json.dumps(out, ensure_ascii=False, sort_keys=True), None) if isinstance(out, dict) else (None, "not an object")
            except ValueError:
                continue
        try:
            out = ast.literal_eval(text)
            if isinstance(out, dict):
                return json.dumps(out, ensure_ascii=False, sort_keys=True, default=str), None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
        redecoded = text.replace("'", '"').replace('"[', "[").replace(']"', "]").encode("latin-1", "replace").decode("utf-8", "replace")
        try:
            out = json.loads(redecoded, strict=False)
            if isinstance(out, dict):
                return json.dumps(out, ensure_ascii=False, sort_keys=True), None
        except ValueError:
            pass
        found: dict[str, str] = {}
        for k, v in pair.findall(text):
            if k not in found or len(v) > len(found[k]):
                found[k] = v
        return (json.dumps({k: value(v) for k, v in found.items()}, ensure_ascii=False, sort_keys=True), None) if found else (None, "no pairs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [read(s) for s in b[raw]]
            yield pd.DataFrame({"key": b[key], "value": [v for v, _ in told], "error": [e for _, e in told]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, raw).mapInPandas(run, f"key {kind}, value string, error string").withColumnRenamed("key", key)


def literal_list(c: Column) -> Column:
    """A string that spells a list (``['a', 'b']``) as that list; NULL where it spells none."""

    @F.pandas_udf("array<string>")
    def parse(s: pd.Series) -> pd.Series:
        def one(x: str | None):
            try:
                out = ast.literal_eval(x) if x else None
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return None
            return [str(v) for v in out] if isinstance(out, list) else None

        return s.map(one)

    return parse(c)


#: What a reader takes for a title or an author and is none.
NO_TITLE, NO_AUTHORS = "Esta obra está bajo una Licencia Creative Commons", ("Internacional", "Google Maps", "Api")
#: Keywords whose surroundings give a field, with how far, in order; by document type.
SEARCHED = {
    "event": (("Congreso", "Conference", "Simposio", "Symposium", "Reunión", "Meeting"), 200),
    "compiler": (("Compilador", "Compiler", "Compilado por"), 100),
    "editor": (("Editor", "Editado por", "Ed."), 100),
}
SEARCHED_BY_TYPE = {
    "director": ("Tesis", ("Director", "Directora", "Dir.", "Dirigido por"), 100),
    "codirector": ("Tesis", ("Codirector", "Codirectora", "Co-director"), 100),
    "degree_name": ("Tesis", ("Grado", "Degree", "Título", "Carrera"), 100),
    "degree_grantor": ("Tesis", ("Universidad", "University", "Facultad", "Institute"), 100),
    "publisher": ("Libro", ("Editorial", "Publisher", "Publicado por", "Press"), 100),
}


def searched_fields(text: Column) -> dict[str, Column]:
    """Fields from the surroundings of keywords in a text: identifiers and volume by their form, others as they stand; NULL where there is none."""
    form = lambda keyword, chars, pattern: F.nullif(F.regexp_extract(T.around(text, keyword, chars), pattern, 1), F.lit(""))
    return {
        "issn": form("ISSN", 50, "([0-9]{4}-[0-9]{3}[0-9X])"),
        "isbn": form("ISBN", 50, "([0-9]{3}-[0-9]{1,5}-[0-9]{1,7}-[0-9]{1,7}-[0-9X])"),
        "volume": F.concat(F.lit("Vol. "), form("Vol", 30, r"(?i)vol\.?\s*([0-9]+)")),
        **{k: T.first_around(text, words, chars) for k, (words, chars) in SEARCHED.items()},
    }


def searched_by_type(text: Column, doc_type: Column) -> dict[str, Column]:
    """Fields that only a document of their type has, from the surroundings of keywords."""
    return {k: F.when(doc_type == of, T.first_around(text, words, chars)) for k, (of, words, chars) in SEARCHED_BY_TYPE.items()}


def tei_keywords(c: Column) -> Column:
    """Keywords of a TEI document: its terms, else its keyword text cut at separators, else its keyword note."""
    terms = F.filter(F.transform(F.xpath(c, F.lit("//keywords/term/text()")), lambda t: F.trim(t)), lambda t: t != "")
    cut = lambda x: F.filter(F.transform(F.split(x, r"[,;|•·]"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    plain, note = cut(F.xpath_string(c, F.lit("//keywords"))), cut(F.xpath_string(c, F.lit("//note[@type='keywords']")))
    return F.when(F.size(terms) > 0, terms).when(F.size(plain) > 0, plain).otherwise(note)


def tei_fields(c: Column) -> dict[str, Column]:
    """Main title, authors ("Surname, Forename"), abstract, keywords, language and first organisation of a TEI document."""
    text = lambda path: F.when(F.xpath_string(c, F.lit(path)) != "", F.xpath_string(c, F.lit(path)))
    # each author is read by itself, as one may lack a part that the next has
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)(<author\b[^>]*>.*?</author>)"), F.lit(1))
    part = lambda b, name: F.nullif(F.trim(F.xpath_string(b, F.lit(f"/author/persName/{name}"))), F.lit(""))
    return {
        "title": F.nullif(text("//titleStmt/title[@level='a' and @type='main']"), F.lit(NO_TITLE)),
        "authors": F.filter(F.transform(blocks, lambda b: F.concat_ws(", ", part(b, "surname"), part(b, "forename"))), lambda a: (a != "") & ~a.isin(*NO_AUTHORS)),
        "abstract": F.nullif(F.trim(F.array_join(F.xpath(c, F.lit("//abstract//p/text()")), " ")), F.lit("")),
        "organisation": F.get(F.filter(F.transform(F.xpath(c, F.lit("//affiliation/orgName/text()")), lambda o: F.trim(o)), lambda o: F.length(o) > 5), F.lit(0)),
        "keywords": F.xpath(c, F.lit("//keywords/term/text()")),
        "language": text("//profileDesc/language/@ident"),
    }


def bibtex_field(c: Column, name: str) -> Column:
    """A field of a BibTeX entry, in braces; NULL where it is missing."""
    out = F.regexp_extract(c, rf"(?im)^\s*{name}\s*=\s*\{{([^{{}}]*)\}}", 1)
    return F.when(out != "", out)


def html_text(c: Column) -> Column:
    """The text of a page: scripts and styles dropped, tags as blanks, basic entities decoded, white space single."""
    x = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


def escape_markup(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

"""Text functions as column expressions; all run in the JVM and give NULL for NULL."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FROM = "".join(c for c in map(chr, range(0xC0, 0x1F00)) if (d := unicodedata.normalize("NFD", c)) != c and len([x for x in d if not unicodedata.combining(x)]) == 1 and len(d) <= 4)
_TO = "".join(next(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) for c in _FROM)
LETTER = r"\p{L}"
#: Vowels with an acute accent, by the bare vowel; a dotless i counts as i.
ACUTE = {"a": "á", "e": "é", "i": "í", "ı": "í", "o": "ó", "u": "ú", "A": "Á", "E": "É", "I": "Í", "O": "Ó", "U": "Ú"}
#: Forms of address removed from names where a dot follows, and those removed without one.
HONORIFICS = (
    "dr dra drª lic lica licª ing inga ingª mg mgr mgs mgtr mag msc phd ph.d prof profa profª sr sra srª mr mrs ms dir dira dirª codir codira codirª coord colab "
    "agr agra arq arqa esp abog cdor cdora cra med vet mv zoot farm psic geof ftal sc ec tec téc bio biol"
).split()
WHOLE_HONORIFICS = "colaborador colaboradora doctor doctora".split()
#: Month names dropped from volume and issue statements.
MONTHS = (
    "january february march april may june july august september october november december "
    "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre"
).split()
#: The further steps of a volume and issue statement, in order, as pattern and replacement.
VOLUME_STEPS = (
    (r"\bvol(\.|umen)?\b", "vol"),
    (r"\b(número|numero|nro|nº|n°|n\.º|no\.?)\b", "no"),
    (r"\b(no\s+)?especial\b", "especial"),
    (r"\b(suplemento|sup)\s*(no\s*)?(\d+)", "suplemento $3"),
    (r"(vol\s+\d+)\s*\(\s*(\d+)\s*\)", "$1, no $2"),
    (r"\b(\d+)\s*\(\s*(\d+)\s*\)", "vol $1, no $2"),
    (r"\b(vol|no|suplemento)(\d+)\b", "$1 $2"),
    (r"\s*[,;|]\s*", ", "),
    (r"[()]", ""),
    (r"\bvol\s+vol\b", "vol"),
    (r"\s{2,}", " "),
    (r"^[ ,]+|[ ,]+$", ""),
)
#: Names of repository keys and what records call them.
KEY_NAMES = {
    "dc.language": "language", "dc.subject": "keywords", "dc.title": "title", "sedici.creator.person": "creator", "dc.subject.ford": "subject", "sedici.rights.license": "rights",
    "sedici.rights.uri": "rightsurl", "dc.identifier.uri": "dc.uri", "sedici.identifier.uri": "sedici.uri", "dc.date.issued": "date", "mods.originInfo.place": "originPlaceInfo",
    "sedici.relation.isRelatedWith": "isrelatedwith", "sedici.contributor.codirector": "codirector", "sedici.contributor.director": "director", "thesis.degree.grantor": "degree.grantor",
    "thesis.degree.name": "degree.name", "sedici.relation.journalTitle": "journalTitle", "sedici.relation.journalVolumeAndIssue": "journalVolumeAndIssue", "sedici.identifier.issn": "issn",
    "sedici.relation.event": "event", "sedici.contributor.publisher": "publisher", "sedici.identifier.isbn": "isbn", "sedici.contributor.compiler": "compiler",
}
#: Attributes that curated records do not keep, and fields that extracted records must not have.
UNUSED_KEYS = ("sedici.contributor.editor", "sedici.contributor.colaborator", "sedici.institucionDesarrollo", "id")
FORBIDDEN_KEYS = ("dc.type", "isRelatedWith", "isrelatedwith", "sedici.uri", "dc.uri")
#: Spellings of document types and what each is called.
TYPE_NAMES = {"Artículo": "Articulo", "Articulo": "Articulo", "Article": "Articulo", "ARTÍCULO": "Articulo", "Tesis": "Tesis", "Tesina": "Tesis", "Libro": "Libro", "Objeto de conferencia": "Objeto de conferencia"}


def strip_accents(c: Column) -> Column:
    """Decompose and drop combining marks."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")


def decode_escapes(c: Column) -> Column:
    r"""Literal \uXXXX sequences as characters; anything else is left as it is."""
    parts = F.split(c, r"\\u(?=[0-9A-Fa-f]{4})")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 4)), "UTF-16BE"), F.substring(p, 5, 1 << 30)))
    return F.when(c.isNotNull(), F.concat(parts[0], F.array_join(rest, "")))


def attach_acutes(c: Column) -> Column:
    """A stand-alone acute accent joined to the vowel before it, else to the one after."""
    after = reduce(lambda x, kv: F.replace(x, F.lit(f"{kv[0]}´"), F.lit(kv[1])), ACUTE.items(), c)
    return reduce(lambda x, kv: F.replace(x, F.lit(f"´{kv[0]}"), F.lit(kv[1])), ACUTE.items(), after)


def collapse_runs(c: Column, keep_roman: bool = False) -> Column:
    """Runs of three or more equal punctuation marks or letters as one; with ``keep_roman`` Roman numerals stay whole."""
    x = F.regexp_replace(F.regexp_replace(c, r"\.{2,}", " "), r"([^\p{L}\p{N}\s])\1{2,}", "$1")
    if not keep_roman:
        return F.regexp_replace(x, r"(\p{L})\1{2,}", "$1")
    words = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.when(c.isNotNull(), F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[IVXLCDM]+$"), w).otherwise(F.regexp_replace(w, r"(\p{L})\1{2,}", "$1"))), ""))


def normalise(c: Column, keep_roman: bool = False) -> Column:
    """Escapes, acutes, then runs."""
    return collapse_runs(attach_acutes(decode_escapes(c)), keep_roman)


def metric_key(c: Column) -> Column:
    """What two values are compared by: lower case, no accents or opening marks, no closing punctuation, single blanks."""
    x = strip_accents(F.regexp_replace(F.lower(decode_escapes(c)), "[¿¡]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[.,;:!?\-–]+$", ""), r"[ \t\n\r]+", " "))


def name_key(c: Column) -> Column:
    """A name as its sorted set of words of two letters or more."""
    words = F.split(F.trim(F.regexp_replace(metric_key(c), r"[,;.\-_() ]+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)))


def drop_honorifics(c: Column) -> Column:
    """Forms of address (with their dot), bracketed notes of up to 80 characters, and one closing dot removed, in this order."""
    x = reduce(lambda y, h: F.regexp_replace(y, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){h.replace('.', '[.]')}\.\s*", ""), HONORIFICS, c)
    x = reduce(lambda y, h: F.regexp_replace(y, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){h}(?![\p{{L}}\p{{N}}_])\s*", ""), WHOLE_HONORIFICS, x)
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*\([^)]{1,80}\)\s*", ""), r"\s+", " "))
    return F.trim(F.regexp_replace(x, r"\.\s*$", ""))


def person_name(c: Column) -> Column:
    """Letters, blanks, dots and quotes only; each word's first letter upper, the rest lower, initials upper."""
    words = F.filter(F.split(F.regexp_replace(c, r"[^\p{L} .'`]", ""), " +"), lambda w: w != "")
    return F.when(c.isNotNull(), F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^(\p{L}\.)+$"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))), " "))


def join_hyphens(c: Column) -> Column:
    """Words broken by a hyphen and white space before a small letter joined."""
    return F.regexp_replace(c, r"(\p{L})-[ \t\n\r]+(\p{Ll})", "$1$2")


def before_authority(c: Column) -> Column:
    """Text before ``::``, trimmed only where there is one."""
    return F.when(c.contains("::"), F.trim(F.split_part(c, F.lit("::"), F.lit(1)))).otherwise(c)


def split_pipe(c: Column) -> Column:
    """The values of a field joined by ``||``, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\|\|"), lambda v: F.trim(v)), lambda v: v != "")


def joined_values(c: Column) -> Column:
    """The values of a field joined by ``||`` without their authorities, joined by ", "."""
    return F.array_join(F.transform(F.split(c, r"\|\|"), before_authority), ", ")


def handle_id(c: Column) -> Column:
    """The handle of the first URI as an id (``90871/12`` is ``90871-12``); NULL without one."""
    return F.replace(F.get(F.split(F.split_part(c, F.lit("||"), F.lit(1)), "handle/"), F.lit(1)), F.lit("/"), F.lit("-"))


def cid_profile(c: Column) -> dict[str, Column]:
    """Of glyph references like ``(cid:12)``: their number, how many differ, and the percentage of characters inside them."""
    found = F.regexp_extract_all(c, F.lit(r"(\(cid:[0-9]+\))"), F.lit(1))
    inside = F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x))
    return {"cid_count": F.size(found), "cid_distinct": F.size(F.array_distinct(found)), "cid_percent": F.when(F.length(c) > 0, inside.cast("double") * 100.0 / F.length(c)).otherwise(0.0)}


def drop_cid(c: Column) -> Column:
    """Glyph references deleted, white space single, empty tags removed once."""
    x = F.regexp_replace(F.regexp_replace(c, r"\(cid:[0-9]+\)", ""), r"[ \t\n\r]+", " ")
    return F.trim(F.regexp_replace(x, r"<(h1|h2|p)> ?</\1>", ""))


def corruption_class(c: Column) -> Column:
    """The kinds of corruption above their limits, joined by " + "; empty where there is none."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    return F.concat_ws(
        " + ",
        F.when(n(r"\(cid:[0-9]+\)") > 50, "cid"),
        F.when(n(r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]") > 100, "control"),
        F.when(n(r"(/[A-Za-z0-9_]+)+") > 100, "glyph names"),
        F.when(n(r"\\u") > 10, "escapes"),
    )


def extraction_score(c: Column) -> Column:
    """Share of characters that are neither glyph references nor controls."""
    bad = F.regexp_count(c, F.lit(r"\(cid:[0-9]+\)")) + F.regexp_count(c, F.lit(r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]"))
    return F.when(F.length(c) > 0, (F.length(c) - bad).cast("double") / F.length(c)).otherwise(0.0)


def readable_sample(c: Column, words: int = 20) -> Column:
    """The first words of three letters or more that are letters alone."""
    return F.array_join(F.slice(F.filter(F.split(drop_cid(c), " "), lambda w: w.rlike(r"^\p{L}{3,}$")), 1, words), " ")


def strip_tags(c: Column) -> Column:
    """h1, h2 and p tags removed (anything that begins with ``<p`` too)."""
    return F.regexp_replace(c, r"</?h1[^>]*>|</?h2[^>]*>|</?p[^>]*>", "")


def found_tags(c: Column) -> Column:
    """The h1, h2 and p tags of a text (anything that begins with ``<p`` too), in order."""
    return F.regexp_extract_all(c, F.lit(r"(</?h1[^>]*>|</?h2[^>]*>|</?p[^>]*>)"), F.lit(1))


def has_licence(c: Column) -> Column:
    """Whether the text names an open licence of the CC family, by name, sign or address."""
    return c.rlike(r"(?i)creative\s*commons|cc[-\s]*by")


def licence_holds(rights: Column, text: Column) -> Column:
    """Whether rights are stated and the text names such a licence; NULL text names none."""
    return F.coalesce((rights != "") & has_licence(text), F.lit(False))


def valid_issn(c: Column) -> Column:
    return c.rlike(r"^[0-9]{4}-[0-9Xx]{4}$")


def valid_isbn(c: Column) -> Column:
    return F.regexp_replace(c, r"[-\s]", "").rlike(r"^([0-9Xx]{10}|[0-9Xx]{13})$")


def valid_partial_date(c: Column) -> Column:
    return c.rlike(r"^[0-9]{4}(/[0-9]{2}(/[0-9]{2})?)?$")


def volume_issue(c: Column) -> Column:
    """A volume and issue statement in one form: lower case, months dropped, then the VOLUME_STEPS in order."""
    x = F.regexp_replace(F.lower(c), rf"(?U)\b({'|'.join(MONTHS)})\b", "")
    return reduce(lambda y, step: F.regexp_replace(y, f"(?U){step[0]}", step[1]), VOLUME_STEPS, x)


#: Fixed value: what separates keywords.
KEYWORD_SEPARATORS = r"[,;|•·]|\s[-/]\s|\.\s+"


def split_keywords(c: Column, longest: int = 80, words: int = 6) -> Column:
    """Keywords of a section: cut at separators, 1 to ``words`` words and at most ``longest`` characters each."""
    parts = F.transform(F.split(c, KEYWORD_SEPARATORS), lambda p: F.trim(F.regexp_replace(p, r"[ \t\n\r]+", " ")))
    return F.filter(parts, lambda p: (p != "") & (F.length(p) <= longest) & (F.size(F.split(p, " ")) <= words))


def first_tokens(c: Column, n: int = 500) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " ")), " "), 1, n), " ")


def fold_space(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " ")))


def letter_tokens(c: Column, least: int = 4) -> Column:
    """Lower-case runs of ``least`` letters or more, addresses removed first."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, r"https?://[^ \t\n\r]+", " ")), F.lit(rf"(\p{{L}}{{{least},}})"), F.lit(1))


def context(c: Column, keyword: str, before: int = 20, after: int = 60) -> Column:
    """Text around the first occurrence of a keyword, whatever its case; NULL without one."""
    at = F.locate(keyword.lower(), F.lower(c))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(c, start, at - start + len(keyword) + after))


def around(c: Column, keyword: str, chars: int) -> Column:
    """Text from 20 characters before the first occurrence of a keyword, whatever its case, to ``chars`` after its start; NULL without one."""
    at = F.locate(keyword.lower(), F.lower(c))
    start = F.greatest(at - 20, F.lit(1))
    return F.when(at > 0, F.substring(c, start, at + chars - start))


def first_around(c: Column, keywords: tuple[str, ...], chars: int) -> Column:
    """The text around the first of the keywords that occurs, trimmed."""
    return F.coalesce(*[F.trim(around(c, k, chars)) for k in keywords])


def present(c: Column) -> Column:
    """A value list that holds something: not NULL, not empty, and no blank or "null" alone."""
    return F.coalesce(F.exists(c, lambda v: v.isNotNull() & ~F.lower(F.trim(v)).isin("", "null")), F.lit(False))


def is_empty(values: Column, is_list: Column) -> Column:
    """Emptiness as the report counts it: NULL, a list without elements, or a single value that is NULL or blank; "null" is a value."""
    single = ~F.coalesce(is_list, F.lit(False)) & (F.size(values) == 1) & F.coalesce(F.trim(F.get(values, F.lit(0))) == "", F.lit(True))
    return values.isNull() | (F.size(values) == 0) | single


def type_name(c: Column) -> Column:
    """The name of a document type by its exact spelling; an unknown one stays."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])[c], c)


def latin_text(c: Column) -> Column:
    r"""Text of a model's answer: literal \\r\\n as a blank, stray \\R, \\p, \\/ and \\c dropped, \\uXXXX, \\n and \\r as characters, quoted lists bare, an escaped lost sign as ¿."""
    x = F.regexp_replace(F.replace(c, F.lit("\\r\\n"), F.lit(" ")), r"\\[Rp/c]", "")
    x = F.replace(F.replace(decode_escapes(x), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.replace(F.regexp_replace(x, r'"\[(.*?)\]"', "[$1]"), F.lit("\\\ufffd"), F.lit("¿"))


def is_blank(c: Column) -> Column:
    """NULL or white space."""
    return c.isNull() | (F.trim(F.regexp_replace(c, r"[\t\n\r]", " ")) == "")


REPEATED_NUMBER = r"[0-9]{6,}-+[0-9]{6,}"


def fix_repeated_digits(c: Column) -> Column:
    """Numbers like ``1122334455-6677889900`` with each digit once: of two runs of six digits or more around dashes, one
    whose length divides by four keeps four digits, another even one every second digit. Other text reaches no Python."""

    def run(digits: str) -> str:
        step = len(digits) // 4 if len(digits) % 4 == 0 else 2 if len(digits) % 2 == 0 else 1
        return digits[::step]

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        whole = re.compile(r"([0-9]{6,})-+([0-9]{6,})")
        return s.map(lambda x: None if x is None else whole.sub(lambda m: f"{run(m[1])}-{run(m[2])}", x))

    return F.when(c.rlike(REPEATED_NUMBER), fix(c)).otherwise(c)

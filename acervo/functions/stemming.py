"""Spanish stems by the published Snowball algorithm."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = frozenset("aeiouáéíóúü")
#: Attached pronouns, and the verb endings they may follow.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ACUTE_HOSTS, PLAIN_HOSTS = "iéndo ándo ár ér ír".split(), "ando iendo ar er ir".split()
#: Standard endings by what is done with them.
DROPPED = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AFTER_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
AFTER_MENTE, AFTER_IDAD = ("ante", "able", "ible"), ("abil", "ic", "iv")
#: Endings of verbs.
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
GU_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _longest(word: str, endings: list[str] | tuple[str, ...] | dict[str, str]) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _after_syllable(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one lower-case word."""
    rv = _verb_region(word)
    r1 = _after_syllable(word, 0)
    r2 = _after_syllable(word, r1)
    inside = lambda w, ending, region: bool(ending) and len(w) - len(ending) >= region

    if pronoun := _longest(word, PRONOUNS):
        host = word[: -len(pronoun)]
        if inside(word, pronoun, rv):
            acute, plain = _longest(host, ACUTE_HOSTS), _longest(host, PLAIN_HOSTS)
            if inside(host, acute, rv):
                word = host[: -len(acute)] + acute.translate(str.maketrans("áéí", "aei"))
            elif inside(host, plain, rv) or (host.endswith("uyendo") and inside(host, "yendo", rv)):
                word = host

    before = word
    ending = _longest(word, [*DROPPED, *AFTER_IC, *REPLACED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])

    def drop(w: str, *more: str) -> str:
        """``w`` without the longest of ``more`` that lies in R2."""
        tail = _longest(w, more)
        return w[: -len(tail)] if inside(w, tail, r2) else w

    if ending == "amente":
        if inside(word, ending, r1):
            word = word[: -len(ending)]
            shorter = drop(word, "iv", "os", "ic", "ad")
            word = drop(shorter, "at") if shorter != word and word.endswith("iv") else shorter
    elif inside(word, ending, r2):
        base = word[: -len(ending)]
        if ending in REPLACED:
            word = base + REPLACED[ending]
        elif ending in AFTER_IC:
            word = drop(base, "ic")
        elif ending == "mente":
            word = drop(base, *AFTER_MENTE)
        elif ending in ("idad", "idades"):
            word = drop(base, *AFTER_IDAD)
        elif ending in ("iva", "ivo", "ivas", "ivos"):
            word = drop(base, "at")
        else:
            word = base

    if word == before:
        y_verb = _longest(word[rv:], Y_VERBS)
        if y_verb and word[: -len(y_verb)].endswith("u"):
            word = word[: -len(y_verb)]
        else:
            verb = _longest(word[rv:], [*GU_VERBS, *VERBS])
            if verb:
                word = word[: -len(verb)]
                if verb in GU_VERBS and word.endswith("gu"):
                    word = word[:-1]

    rest = _longest(word[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if rest:
        word = word[: -len(rest)]
        if rest in "eé" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(str.maketrans("áéíóú", "aeiou"))


def stem_phrase(phrase: str) -> str:
    return " ".join(stem(w) for w in unicodedata.normalize("NFC", phrase).lower().split())


def stemmed(c: Column) -> Column:
    """Each word of a string as its stem, in Arrow batches; NULL for NULL. Apply it to distinct words where there are many rows."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else stem_phrase(x))

    return run(c)

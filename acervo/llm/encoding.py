"""Garbled text from wrong character encoding.

Characters are mapped back to the bytes of the legacy encoding they were read in; a byte-structure automaton (lead byte,
then exactly its continuation bytes) finds the maximal well-formed multibyte spans, and only those spans are decoded.
Text of one byte per character read in another one-byte encoding has no such structure; there a word is decoded when the
result is a trusted word of the corpus, and then the field's other words of the same damage too.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legacy encodings that UTF-8 was read in, with the lead bytes that are decoded wherever they stand (Latin
#: letters, punctuation, and the lead of four bytes). Sequences of other leads are decoded in runs of two or more.
MULTIBYTE = {
    "cp1252": (0xC2, 0xC3, 0xC5, 0xE2, 0xF0), "mac_roman": (0xC2, 0xC3, 0xE2), "cp437": (0xC2, 0xC3, 0xE2), "cp850": (0xC2, 0xC3, 0xE2), "cp1251": (0xC2, 0xC3, 0xF0),
}
#: Encodings that Latin-1 text was read in.
SINGLE_BYTE = ("mac_roman", "cp850", "cp1251", "cp437", "cp1250", "koi8_r")
#: The letters and signs beyond ASCII that the five languages use.
SOUND = "áàâãäéèêëíìîïóòôõöúùûüñçýœæÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇŒ¿¡ªº«»"
LOST = "�"
#: Rows that may be garbled, tested in the JVM: signs and scripts beyond the sound letters, capitals inside a word, lone lead letters.
#: One class with a cheap test for ASCII leads; only what it lets through is looked at closer.
_CLOSER = "ÀÁÂÃÈÉÊÌÍÎÒÓÔÕÙÚÛÜÑÇ·°ı"
SUSPECT = (
    r"[\x{80}-\x{10FFFF}&&[^áàâãéèêíìîóòôõúùûüñç¿¡ªº«»\x{AD}\x{A0}´¬\x{2010}-\x{2015}‘’“”…•ﬁﬂ]]"
    rf"(?:(?<![{_CLOSER}])|(?<=\p{{Ll}}[ÀÁÂÃÈÉÊÌÍÎÒÓÔÕÙÚÛÜÑÇı])|(?<=[ÃÂ])[[^\p{{L}} ]ªº]|(?<=\p{{L}}[·°])|(?<=[·°])\p{{L}})"
)
#: Signs of damage that hold even where nothing can be decoded: lost characters, controls, a lead letter inside a lower-case word, table-drawing or mixed-script letters next to Latin ones, a sign or accented capital between small letters.
RESIDUE = re.compile(r"�|[\x80-\x9f]|[a-zß-ÿ][ÃÂ](?![A-ZÀ-Þ])|[A-Za-z][√├┬╔╗│▒║┤][^\s]|[√├┬][^\s\d]|[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]|Ã[‚ƒ€†]|â€|[a-z][ÀÁÂÈÉÊÌÍÎÒÔÙÚÛÝÞ±¾§þ³¹][a-z]|ðŸ|[ÐÑ][^\w\s»”\"')\],.;:?!-]")
TOKEN = re.compile(r"[^\s.,;:()\[\]!?\"'’/-]+")


def _table(codec: str) -> dict[int, str]:
    """Byte -> character; cp1252's unused bytes are read as the control of that number, as browsers do."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            if codec == "cp1252":
                out[b] = chr(b)
    return out


def _automaton(codec: str, leads: tuple[int, ...]) -> tuple[re.Pattern, re.Pattern, dict[str, int]]:
    """Patterns over the codec's characters that match runs of well-formed UTF-8 sequences, of any lead or of ``leads``
    alone, and character -> byte."""
    table = _table(codec)
    back = {c: b for b, c in table.items()}
    if codec == "cp1252":
        back |= {chr(b): b for b in range(0x80, 0xA0)}
    tails = "".join(re.escape(c) for c, b in back.items() if 0x80 <= b < 0xC0)
    of = lambda low, high, only: "".join(re.escape(table[b]) for b in range(low, high) if b in table and (b in leads or not only))
    sequences = [[f"[{x}][{tails}]{{{n}}}" for n, low, high in ((1, 0xC2, 0xE0), (2, 0xE0, 0xF0), (3, 0xF0, 0xF5)) if (x := of(low, high, only))] for only in (True, False)]
    sure, every = ("|".join(x) for x in sequences)
    return re.compile(f"(?:{every}){{2,}}|(?:{sure})"), re.compile(f"(?:{sure})+"), back


AUTOMATA = {codec: _automaton(codec, leads) for codec, leads in MULTIBYTE.items()}
RETURN = {}
for _codec in SINGLE_BYTE:
    RETURN[_codec] = {ord(c): bytes([b]).decode("latin-1") for b, c in _table(_codec).items() if b >= 0xA0 and bytes([b]).decode("latin-1") in SOUND and ord(c) > 0x7F}


def _bytes(span: str, back: dict[str, int]) -> str:
    try:
        return bytes(back[c] for c in span).decode("utf-8")
    except UnicodeDecodeError:
        return span


def decode_spans(text: str) -> str:
    """Decode every maximal well-formed multibyte span, up to three layers deep."""
    for _ in range(3):
        before = text
        for pattern, sure, back in AUTOMATA.values():

            def decoded(m: re.Match, sure: re.Pattern = sure, back: dict[str, int] = back) -> str:
                try:
                    out = bytes(back[c] for c in m[0]).decode("utf-8")
                    if not any(unicodedata.category(c) in ("Co", "Cn") for c in out):
                        return out
                except UnicodeDecodeError:
                    pass
                return sure.sub(lambda x: _bytes(x[0], back), m[0])  # no characters of any script: the surer leads alone

            text = pattern.sub(decoded, text)
        if text == before:
            break
    return text


def decode_words(text: str, trusted: dict[str, int]) -> str:
    """Undo a one-byte misreading: of the encodings, the one that turns most untrusted words into trusted ones."""
    odd = {w for w in TOKEN.findall(text) if not w.isascii() and w.lower() not in trusted}
    best, most = None, 0
    for codec, table in RETURN.items():
        hits = sum(1 for w in odd if (v := w.translate(table)) != w and v.strip("¿¡«»").lower() in trusted)
        if hits > most:
            best, most = table, hits
    if best is None:  # no trusted word to go by: the encoding that makes every sign inside a word a letter
        inner = [w for w in odd if RESIDUE.search(w)]
        best = next((t for t in RETURN.values() if inner and not any(RESIDUE.search(w.translate(t)) for w in inner)), None)
        odd = set(inner)
    if best is None:
        return text
    return TOKEN.sub(lambda m: m[0].translate(best) if m[0] in odd else m[0], text)


def restore(text: str, trusted: dict[str, int]) -> tuple[str, bool, bool]:
    """The text with its garbled characters decoded, whether any were found, and whether some could not be had back."""
    out = decode_words(decode_spans(text), trusted)
    left = bool(RESIDUE.search(out))
    return out, out != text or left, left


def find_garbled(df: DataFrame, key: str, fields: list[str], trusted: dict[str, int]) -> DataFrame:
    """``key, field, restored, complete``: one row per field that holds wrongly decoded characters.

    ``complete`` is false where characters were lost (the replacement character, broken sequences). NULL and empty fields
    are never garbled; repeated rows each give a row; a NULL key is kept. Other columns of ``df`` are not read.
    """
    cells = df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("key", "x.*")

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, f, *restore(t, trusted)) for k, f, t in zip(b["key"], b["field"], b["text"])]
            yield pd.DataFrame([(k, f, out, not left) for k, f, out, found, left in rows if found], columns=["key", "field", "restored", "complete"])

    suspects = cells.where(F.col("text").rlike(SUSPECT))
    return suspects.mapInPandas(fix, "key string, field string, restored string, complete boolean").withColumnRenamed("key", key)

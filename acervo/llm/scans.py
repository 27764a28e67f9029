"""Noise in text from scanned pages: hyphens of the layout, misread letters, running headers and page numbers.

Misread words are found against the corpus's frequency lexicon: a symmetric-delete index (all words with up to two letters
left out of their first seven) gives correction candidates, a weighted edit distance in which letters that scanners
confuse are cheap ranks them, and the word before decides between equals. Words that only lack accents are not misread,
and wrong decoding is undone first, so it is never counted here.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, product, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.encoding import RESIDUE, restore
from acervo.llm.lexicon import WORD, distinct_texts, trusted_words
from acervo.llm.overlap import MULTIBYTE_SIGN, ONE_BYTE_SIGN, SPACED_SIGN, fold

KINDS = ("hyphen", "chars", "header", "pageno")
#: What scanners take for what, as (seen, meant), both ways where both occur.
CONFUSIONS = [
    ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("0", "o"), ("6", "o"), ("9", "o"), ("6", "b"), ("5", "s"), ("8", "b"), ("9", "g"),
    ("2", "z"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("v", "y"), ("y", "v"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"),
    ("fi", "n"), ("li", "h"), ("h", "li"), ("h", "b"), ("b", "h"), ("vv", "w"), ("nn", "m"), ("in", "m"), ("i", "l"), ("l", "i"), ("q", "g"), ("g", "q"), ("a", "o"), ("u", "n"), ("n", "u"),
]
CHEAP, PLAIN, SLACK = 0.25, 1.0, 0.75
#: Page number lines, alone or with the usual words and signs.
PAGE_LINE = re.compile(r"\s*(?:\[\s*\d{1,4}\s*\]|[-—–]\s*\d{1,4}\s*[-—–]|(?:p|pp|pág|pag|page|página|pagina)\.?\s*\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|\w{4,7} \d{1,4} (?:de|of|di|sur|su) \d{1,4})\s*$", re.I)
NUMBER_LINE = re.compile(r"\s*\d{1,4}\s*$")
ROMAN_LINE = re.compile(r"\s*(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\s*$")
NUMBERED_HEADER = re.compile(r"^\s*(?:\d{1,4}\s{2,}(?=\D*[^\W\d_]{3})(.+)|(.*[^\W\d_]{3}.*?)\s{2,}\d{1,4})\s*$")
VOLUME_HEADER = re.compile(r"\|\s*v[o0][l1!i]\.?\s*\w+", re.I)
ET_AL_LINE = re.compile(r"^[^\W\d_][\w!|]+ (?:e|c)t a[l1!]\.$", re.I)
TABLE_LINE = re.compile(r"^\s*\d+(?:\s{2,}|\t)\S*\d\s*$")
DIGITS = re.compile(r"\d+")
NO_LETTERS = bytes(x for x in range(256) if not 97 <= x <= 122)
LINE_MARKS = tuple("-\xad¬‐‑–")
LINE_HYPHEN = re.compile(r"([^\W_]\S*?)([-\xad¬‐‑–])\s*$")
SPACED_LETTERS = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){4,}[^\W\d_](?![^\W_])")
TRIPLED = re.compile(r"([A-ZÀ-Þ])\1\1(?:([A-ZÀ-Þ])\2\2)+(?:([.,;:])\3\3)?")
SPACED_WORD = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])(?: (?=[.,;:]))?")
#: Words of one letter.
ONE_LETTER = frozenset("aeoyuéàè")
LOST_GLYPH = re.compile(r"(?:[^\W\d_]|\(cid:\d+\))*\(cid:\d+\)(?:[^\W\d_]|\(cid:\d+\))*")
CID = re.compile(r"\(cid:\d+\)")
#: One class leads, which is searched fast; what it finds is then looked at closer.
BAD_EXTRACTION = re.compile(
    r"[ﬀ-ﬆı\ue000-\uf8ff´¨˜~0-9!|(](?:(?<=[ﬀ-ﬆı\ue000-\uf8ff])|(?<=[´¨˜~])(?:[^\W\d_]|(?<=[^\W\d_].))|(?<=[^\W\d_][0-9!|])[^\W\d_]|(?<=[a-zà-ÿ]{2}0)(?!\w)|(?<=\()cid:\d+\))"
)
#: Words that leave a sentence open; a line that ends on one is running text.
OPEN_WORDS = frozenset(
    "a al and as con da das de degli dei del della delle des di do dos du e el em en et for from il in la las le les lo los na no of on or os per por que se su than the to un una und y à é o más hacia entre between around vers tra pour com with".split()
)
LOWER_WORD = re.compile(r"(?<![\w´¨~-])[^\W\d_]{4,}(?![\w´¨~(])")
#: Words with digits or signs that scanners take for letters at the start or the end.
EDGE_WORD = re.compile(r"(?<![\w´¨~.,-])(?:[0125689!|]{1,2}[^\W\d_]+|[^\W\d_]+[0125689!|]{1,2})(?![\w´¨~(-])")
EDGE_SIGN = re.compile(r"[0125689!|](?:(?<=[^\W\d_].)|(?=[^\W\d_]))")
DIGIT_WORD = re.compile(r"[^\s.,;:()?¿]*[^\W\d_][0-9!|][^\s.,;:()?¿]*")
LONG_WORD = re.compile(r"[^\W\d_]{4,}")
BETWEEN = "zzzzbetweentextszzzz"  # no word of any text, so no pair spans two texts
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")


def ends_sentence(line: str) -> bool:
    return line.rstrip().rstrip("»”\"')]")[-1:] in tuple(".?!:")


def last_word(line: str) -> str:
    words = line.rsplit(None, 1)
    return words[-1].strip(".,;:()[]?!«»\"'").lower() if words else ""


def bare(word: str) -> str:
    """Lower case without accents."""
    return word if word.isascii() else unicodedata.normalize("NFD", word).encode("ascii", "ignore").decode()


class Odd(dict):
    """Word as written -> whether it is unknown and may be a misreading of a trusted word."""

    def __init__(self, speller: Speller):
        self.speller = speller

    def __missing__(self, word: str) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        low, speller = word.lower(), self.speller
        self[word] = out = not speller.knows(low) and (word[0].islower() or speller.looks_known(low)) and bool(speller.candidates(low))
        return out


class Speller:
    """Corrections of misread words from a lexicon of trusted words and their counts."""

    def __init__(self, trusted: dict[str, int], bigrams: dict[tuple[str, str], int] | None = None, head: int = 7):
        self.head, self.bigrams = head, bigrams or {}
        self.counts: dict[str, int] = {}
        self.spelled: dict[str, str] = {}
        for word, n in trusted.items():
            plain = bare(word)
            if n > self.counts.get(plain, 0):
                self.counts[plain], self.spelled[plain] = n, word
        self.index: dict[str, list[str]] = defaultdict(list)
        for plain in self.counts:
            if len(plain) >= 4:
                for short in self._deletes(plain):
                    self.index[short].append(plain)
        self.folded = {fold(w).replace(b" ", b"") for w in self.counts if len(w) >= 4}
        self.cache: dict[str, list[tuple[float, str]]] = {}
        self.odd = Odd(self)

    def _deletes(self, word: str) -> set[str]:
        part = word[: self.head]
        return {"".join(c for i, c in enumerate(part) if i not in left) for k in range(3) for left in combinations(range(len(part)), k)}

    def knows(self, word: str) -> bool:
        return bare(word) in self.counts

    def looks_known(self, word: str) -> bool:
        """Whether a trusted word has the same letters once those that scanners confuse are folded together."""
        return fold(word).replace(b" ", b"") in self.folded

    def distance(self, seen: str, meant: str, most: float = SLACK) -> float:
        """Weighted edit distance; pairs of CONFUSIONS cost CHEAP, other edits PLAIN; more than ``most`` is given as infinite."""
        row = {0: 0.0}
        table = [row]
        for i in range(len(seen) + 1):
            if i == len(table):
                table.append({})
            for j, cost in sorted(table[i].items()):
                steps = []
                if i < len(seen) and j < len(meant) and seen[i] == meant[j]:
                    steps.append((i + 1, j + 1, cost))
                for a, b in CONFUSIONS:
                    if seen.startswith(a, i) and meant.startswith(b, j):
                        steps.append((i + len(a), j + len(b), cost + CHEAP))
                for x, y, c in steps:
                    if c <= most:
                        while len(table) <= x:
                            table.append({})
                        if c < table[x].get(y, 9.0):
                            table[x][y] = c
        return table[len(seen)].get(len(meant), float("inf")) if len(table) > len(seen) else float("inf")

    def _forms(self, word: str) -> list[str]:
        """The word as seen, and with its digits and signs replaced by the letters they may stand for: the index covers two
        damaged letters, so these forms let it find words with more of which are digits or signs."""
        odd = [c for c in dict.fromkeys(word) if not c.isalpha()]
        if not odd:
            return [word]
        meant = [[m for seen, m in CONFUSIONS if seen == c and len(m) == 1] or [c] for c in odd[:4]]
        return [word, *("".join(dict(zip(odd, x)).get(c, c) for c in word) for x in product(*meant))]

    def candidates(self, word: str) -> list[tuple[float, str]]:
        """Trusted words that ``word`` may be a misreading of, cheapest first; none for a trusted word or one out of its accents."""
        plain = bare(word.lower())
        if plain in self.counts or len(plain) < 4:
            return []
        if plain not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = {}
            if len(plain) > 4 or self.looks_known(plain):
                for short in {x for form in self._forms(plain) for x in self._deletes(form)}:
                    for meant in self.index.get(short, ()):
                        if meant not in found and abs(len(meant) - len(plain)) <= 3:
                            cost = self.distance(plain, meant)
                            if cost <= (SLACK if len(plain) > 5 else CHEAP):
                                found[meant] = cost
            self.cache[plain] = sorted((c, m) for m, c in found.items())
        return self.cache[plain]

    def edge(self, word: str, before: str = "") -> str | None:
        """The trusted word meant by one of EDGE_WORD; two signs ("e1") only where that word is known to follow ``before``."""
        if len(word) > 3:
            return self.correct(word, before) if word.islower() or self.looks_known(word.lower()) else None
        plain = [""]
        for c in bare(word.lower()):
            plain = [x + m for x in plain for m in ([meant for seen, meant in CONFUSIONS if seen == c] if not c.isalpha() else [c])]
        found = [w for x in plain if (w := self.spelled.get(x)) and (len(word) == 3 or (not word.startswith("1") and (before, w) in self.bigrams))]
        return max(found, key=lambda w: (self.bigrams.get((before, w), 0), self.counts[bare(w)]), default=None)

    def complete(self, parts: list[str], before: str = "") -> str | None:
        """The trusted word whose letters are those of ``parts`` with one unknown letter between each two; None without one."""
        known = [bare(p.lower()) for p in parts]
        form = re.compile(".".join(map(re.escape, known)))
        found = {m for short in self._deletes("".join(known)) for m in self.index.get(short, ()) if form.fullmatch(m)} if len(parts) < 4 else set()
        best = max(found, key=lambda m: (self.bigrams.get((before, self.spelled[m]), 0), self.counts[m]), default=None)
        return best and (self.spelled[best].capitalize() if parts[0][:1].isupper() else self.spelled[best])

    def correct(self, word: str, before: str = "") -> str | None:
        """The trusted word meant, by cost, then how often it follows ``before``, then its count; None if there is none."""
        found = self.candidates(word)
        if not found:
            return None
        best = min(found, key=lambda x: (x[0], -self.bigrams.get((before, self.spelled[x[1]]), 0), -self.counts[x[1]]))[1]
        out = self.spelled[best]
        return out.upper() if word.isupper() else out.capitalize() if word[0].isupper() else out


def _layout(lines: list[str]) -> tuple[set[int], set[int], bool]:
    """Indices of header lines, of page number lines, and whether a page number stands inside a header line."""
    text_at = [i for i, s in enumerate(lines) if s and not s.isspace()]
    short = [i for i in text_at if len(lines[i]) <= 30]
    pages = {i for i in short if PAGE_LINE.match(lines[i])}
    tables = {i for i in short if TABLE_LINE.match(lines[i])}
    bare_pages = [i for i in short if i not in pages and (NUMBER_LINE.match(lines[i]) or ROMAN_LINE.match(lines[i]))]
    keyed: dict[bytes, list[int]] = defaultdict(list)
    numbered: set[int] = set()
    for i in text_at:
        if len(lines[i]) > 140 or i in pages or i in tables or i in bare_pages:
            continue
        s = lines[i].strip()
        if "  " in s and (m := NUMBERED_HEADER.match(lines[i])):
            if lines[i].count("  ") == 1 or re.search(r"\s{3,}", lines[i].strip()):
                numbered.add(i)
                s = (m[1] or m[2]).strip()
        if s[0].isupper() or s[0].isdigit():
            keyed[fold(DIGITS.sub("", s)).translate(None, NO_LETTERS)].append(i)
    order = {i: k for k, i in enumerate(text_at)}

    def around(i: int, skip: set[int]) -> tuple[str, str]:
        k = order[i]
        before = next((lines[j] for j in reversed(text_at[:k]) if j not in skip), "")
        after = next((lines[j] for j in text_at[k + 1 :] if j not in skip), "")
        return before, after

    skip = pages | set(bare_pages)
    headers: set[int] = set()
    for key, at in keyed.items():
        if len(key) < 4:
            continue
        s = lines[at[0]].strip()
        if len(at) == 1 and not (s.isupper() or skip or at[0] in numbered or "|" in s or s.endswith((".", "1.", "!."))):
            continue
        runs_on = (last_word(s) in OPEN_WORDS and not s.isupper()) or s[-1] in ",;:-"
        named = any(VOLUME_HEADER.search(lines[i]) or i in numbered or ET_AL_LINE.match(lines[i].strip()) for i in at)
        if named and (len(at) > 1 or VOLUME_HEADER.search(s) or ET_AL_LINE.match(s) or at[0] in numbered):
            headers.update(at)
            continue
        if runs_on or ends_sentence(s) and not ET_AL_LINE.match(s):
            continue
        breaks = [i for i in at if (b := around(i, skip | set(at)))[0] and not ends_sentence(b[0]) and (b[1][:1].islower() or s.isupper() or b[0].rstrip()[-1:] in "-\xad¬‐–")]
        beside = [i for i in at if any(j in skip for j in (text_at[order[i] - 1] if order[i] else -1, text_at[order[i] + 1] if order[i] + 1 < len(text_at) else -1))]
        apart = [i for i in at if (not (b := around(i, skip | set(at)))[0] or ends_sentence(b[0])) and not b[1][:1].islower()]
        words = len(s.split())
        if len(at) > 1:
            known = (s.isupper() or "," not in s) and bool(breaks or beside or (words > 1 and (s.isupper() or len(apart) == len(at))))
        else:  # seen once: capitals that interrupt a sentence, or a short line with the page number at the top or bottom
            b, edge = around(at[0], skip | set(at)), order[at[0]] in (0, len(text_at) - 1)
            known = bool(breaks and s.isupper() and words > 1 and (b[1][:1].islower() or b[0].rstrip()[-1:] in LINE_MARKS)) or bool(edge and beside and words <= 8 and not b[1][:1].islower() and not re.search(r"[.,;:?!]", s))
        if known:
            headers.update(at)
    if bare_pages:
        values = [int(lines[i]) if NUMBER_LINE.match(lines[i]) else -1 for i in bare_pages]
        rising = sum(1 for a, b in zip(values, values[1:]) if b == a + 1)
        for i, v in zip(bare_pages, values):
            k = order[i]
            next_to = {text_at[k - 1] if k else -1, text_at[k + 1] if k + 1 < len(text_at) else -1}
            before, after = around(i, skip | headers)
            if next_to & set(bare_pages):  # a column of a table
                continue
            inside = last_word(before) in OPEN_WORDS or re.match(r"\s*%", after) or next_to & tables
            if (v == -1 and len(lines[i].strip()) > 1) or next_to & headers or (rising and not next_to & tables) or not inside:
                pages.add(i)
    return headers, pages, bool(numbered & headers)


def _plain(text: str, trusted: dict[str, int]) -> str:
    return restore(text, trusted)[0] if MULTIBYTE_SIGN.search(text) or ONE_BYTE_SIGN.search(text) else text


def repair(text: str, trusted: dict[str, int], speller: Speller, compounds: frozenset[str], rebuild: bool = True) -> tuple[set[str], str]:
    """The kinds of noise in a text, and (with ``rebuild``) its paragraphs without them, one per line, blank lines between."""
    text = _plain(text, trusted)
    kinds: set[str] = set()
    lines = text.split("\n")
    headers, pages, numbered = _layout(lines) if len(lines) > 1 else (set(), set(), False)
    if headers:
        kinds.add("header")
    if pages or numbered:
        kinds.add("pageno")
    body = [s for i, s in enumerate(lines) if i not in headers and i not in pages]
    k = 0
    while k < len(body):
        m = LINE_HYPHEN.search(body[k]) if body[k].rstrip()[-1:] in LINE_MARKS else None
        after = next((j for j in range(k + 1, len(body)) if body[j].strip()), None) if m else None
        if m and after is not None:
            head, mark, tail = m[1], m[2], body[after].lstrip()
            first = re.match(r"[^\s.,;:?!)»”\"]+", tail)
            tail_word = first[0] if first else ""
            head_word = re.split(r"[^\w!|'’]", head)[-1] or head
            joined = re.sub(r"^\W+", "", head_word + tail_word)
            letters = joined.lower()
            own = f"{head_word}-{tail_word}".lower() in compounds
            known = letters.split("'")[-1].split("’")[-1] in trusted or speller.knows(letters) or speller.looks_known(letters)
            damaged = not own and (known or bool(speller.candidates(letters)))
            if tail_word[:1].islower() or tail_word[:1] in "!|0123456789(´¨" or (tail_word and RESIDUE.match(tail_word)):
                if damaged or (not own and (mark != "-" or head_word[:1].isupper() or not head_word.isalpha() or not tail_word.isalpha())):
                    kinds.add("hyphen")
                    body[k] = body[k][: m.start(2)] + tail
                    del body[k + 1 : after + 1]
                    continue
                body[k] = body[k][: m.end(2)] + tail
                del body[k + 1 : after + 1]
                continue
        k += 1
    flat = "\n".join(body)
    # the index decides first; what it cannot know (glyphs, spaced and tripled letters, signs inside names) is told by its form
    fixes = {}
    odd = speller.odd
    for m in LOWER_WORD.finditer(flat) if any(map(odd.__getitem__, LONG_WORD.findall(flat))) else ():
        w = m[0]
        if odd[w] and (fixed := speller.correct(w, _word_before(m))):
            fixes[m.span()] = fixed
            if not rebuild:
                break
    for m in EDGE_WORD.finditer(flat) if (rebuild or not fixes) and EDGE_SIGN.search(flat) else ():
        if fixed := speller.edge(m[0], _word_before(m)):
            fixes[m.span()] = fixed
            if not rebuild:
                break
    if fixes or BAD_EXTRACTION.search(flat) or (SPACED_SIGN.search(flat) and SPACED_LETTERS.search(flat)) or TRIPLED.search(flat):
        kinds.add("chars")
    for (a, b), fixed in sorted(fixes.items(), reverse=True) if rebuild else ():
        flat = flat[:a] + fixed + flat[b:]
    if not rebuild:
        return kinds, ""
    flat = SPACED_WORD.sub(lambda m: _closed(m[0], speller), flat)
    flat = TRIPLED.sub(lambda m: _single(m[0][::3], speller), flat)
    flat = unicodedata.normalize("NFKC", MARK_BESIDE.sub(_accent, flat)) if BAD_EXTRACTION.search(flat) else flat
    flat = DIGIT_WORD.sub(lambda m: speller.correct(m[0], _word_before(m)) or BETWEEN_LETTERS.sub("o", m[0]), flat)
    flat = LOST_GLYPH.sub(lambda m: speller.complete(CID.split(m[0]), _word_before(m)) or m[0], flat) if "(cid:" in flat else flat
    return kinds, _paragraphs(flat.split("\n"))


def _word_before(m: re.Match) -> str:
    """The word that stands before a match, in lower case."""
    before = WORD.findall(m.string[max(0, m.start() - 30) : m.start()])
    return before[-1].lower() if before else ""


#: A lone mark with the letters beside it: it goes to the letter after it where that is a dotless i, or where the one before cannot bear it.
MARK_BESIDE = re.compile(r"([^\W\d_]?)([´¨˜~]) ?([^\W\d_]?)")
BEARERS = {"´": "aeiouyı", "¨": "aeiouyı", "˜": "aon", "~": "aon"}
BETWEEN_LETTERS = re.compile(r"(?<=[^\W\d_])0(?=[^\W\d_])")


def _accent(m: re.Match) -> str:
    """A letter with the accent that stands beside it."""
    before, sign, after = m[1], m[2], m[3]
    may = lambda c: bool(c) and c.lower() in BEARERS[sign]
    mark = {"´": "\u0301", "¨": "\u0308", "˜": "\u0303", "~": "\u0303"}[sign]
    with_mark = lambda c: unicodedata.normalize("NFC", c.replace("ı", "i") + mark)
    if may(after) and (after == "ı" or not may(before)):
        return before + with_mark(after)
    if may(before):
        return with_mark(before) + m[0][len(before) + 1 :]
    return m[0]


def _closed(spaced: str, speller: Speller) -> str:
    """A word whose letters stand apart, closed up; a one-letter word at its side stays one. Few letters that make no known word stay apart."""
    word = spaced.replace(" ", "")
    if speller.knows(word.lower()):
        return word
    if word[0].lower() in ONE_LETTER and speller.knows(word[1:].lower()):
        return f"{word[0]} {word[1:]}"
    if word[-1] in ONE_LETTER and speller.knows(word[:-1].lower()):
        return f"{word[:-1]} {word[-1]}"
    return word if len(word) > 4 else spaced


def _single(word: str, speller: Speller) -> str:
    """A word of tripled capitals as it was: small if it is known, else a name."""
    low = word.lower()
    return low if speller.knows(low.rstrip(".,;:")) else low.capitalize()


def _paragraphs(lines: list[str]) -> str:
    """Lines joined into paragraphs: a blank line ends one only where a sentence has ended."""
    out: list[str] = []
    gap = True
    for s in lines:
        s = re.sub(r"\s+", " ", s).strip()
        if not s:
            gap = True
            continue
        if out and not (gap and ends_sentence(out[-1])) and (s[0].islower() or not gap):
            out[-1] = f"{out[-1]} {s}"
        else:
            out.append(s)
        gap = False
    return "\n\n".join(out)


def corpus_statistics(df: DataFrame, text: str, trusted: dict[str, int], share: float = 1e-5) -> tuple[dict[tuple[str, str], int], frozenset[str]]:
    """Over all rows: pairs of adjacent trusted words that make up ``share`` of all such pairs, and words written with a
    hyphen of their own that are ``share`` / 10 of all; so at most 1/share and 10/share of them, whatever the corpus."""
    words = sorted(trusted)
    number = {w: i for i, w in enumerate(words)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compounds: Counter[str] = Counter()
        for b in batches:
            low = f"\n{BETWEEN}\n".join(b["t"]).lower()
            codes = np.fromiter(map(number.get, WORD.findall(low), repeat(-1)), np.int64)
            a, z = codes[:-1], codes[1:]
            pairs, n = np.unique((a * len(words) + z)[(a >= 0) & (z >= 0)], return_counts=True)
            for token in low.split():
                if "-" in token:
                    compounds.update(COMPOUND.findall(token))
            yield pd.DataFrame({"pair": pairs, "word": None, "n": n}).astype({"word": "object"})
        yield pd.DataFrame({"pair": -1, "word": list(compounds), "n": list(compounds.values())}).astype({"pair": "int64", "word": "object", "n": "int64"})

    counts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(count, "pair long, word string, n long").groupBy("pair", "word").agg(F.sum("n").alias("n")).persist()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    kept = counts.where(F.col("n") >= F.when(F.col("word").isNull(), max(2, share * total)).otherwise(max(2, share * total / 10))).collect()
    counts.unpersist()
    bigrams = {(words[r["pair"] // len(words)], words[r["pair"] % len(words)]): r["n"] for r in kept if r["word"] is None}
    return bigrams, frozenset(r["word"] for r in kept if r["word"] is not None)


_SPELLERS: dict[str, Speller] = {}


def _speller(name: str, trusted: dict[str, int], bigrams: dict[tuple[str, str], int]) -> Speller:
    """The speller of a run, its index built once per Python worker."""
    if name not in _SPELLERS:
        _SPELLERS.clear()
        _SPELLERS[name] = Speller(trusted, bigrams)
    return _SPELLERS[name]


def scan_noise(df: DataFrame, key: str, text: str, rebuild: bool = True) -> DataFrame:
    """``key, kinds, clean``: the rows whose text carries noise of scanned pages, its kinds and the running text in paragraphs.

    clean is NULL without ``rebuild``. NULL, empty and noise-free texts give no row; repeated rows give one each; other
    columns are not read. Lexicon, compounds and bigrams are counted over all different texts and bounded by their shares.
    """
    once = distinct_texts(df, text)
    trusted = trusted_words(once, text, copies=False)
    bigrams, compounds = corpus_statistics(once, text, trusted)
    run = uuid.uuid4().hex

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller = _speller(run, trusted, bigrams)
        for b in batches:
            out = []
            for k, t in zip(b["key"], b["text"]):
                kinds, clean = repair(t, trusted, speller, compounds, rebuild)
                if kinds:
                    out.append((k, [x for x in KINDS if x in kinds], clean if rebuild else None))
            yield pd.DataFrame(out, columns=["key", "kinds", "clean"])

    texts = df.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text"))
    return texts.mapInPandas(rows, "key string, kinds array<string>, clean string").withColumnRenamed("key", key)

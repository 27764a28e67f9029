"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from functools import reduce

from acervo.functions.text import ACUTE, HONORIFICS, MONTHS, WHOLE_HONORIFICS

LETTERS = "abcdefghijklmnopqrstuvwxyzáéíóúàèìòùâêîôûãõçñüABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÀÈÂÊÔÃÕÇÑ"
DATASET = "(SELECT * FROM dataset QUALIFY row_number() OVER (PARTITION BY id ORDER BY harvested_at DESC) = 1)"
PAIRS = "(SELECT DISTINCT run_no, system, id, doc_type, field, pred, pred_is_list, truth, truth_is_list FROM evaluation_pairs)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse_letters(x: str) -> str:
    return reduce(lambda y, c: f"regexp_replace({y}, '{c}{{3,}}', '{c}', 'g')", LETTERS, x)


def collapse_signs(x: str) -> str:
    signs = ["-", "_", ",", ";", ":", r"\!", r"\?", r"\*", "=", r"\(", r"\)", "´", "—", "–", "/"]
    return reduce(lambda y, c: f"regexp_replace({y}, '{c}{{3,}}', '{c[-1]}', 'g')", signs, f"regexp_replace({x}, '\\.{{2,}}', ' ', 'g')")


def attach_acutes(x: str) -> str:
    after = reduce(lambda y, kv: f"replace({y}, '{kv[0]}´', '{kv[1]}')", ACUTE.items(), x)
    return reduce(lambda y, kv: f"replace({y}, '´{kv[0]}', '{kv[1]}')", ACUTE.items(), after)


def honorifics(x: str) -> str:
    edge = "(^|[^\\p{L}\\p{N}_])"
    y = reduce(lambda z, h: f"regexp_replace({z}, '{edge}{h.replace('.', '[.]')}\\.\\s*', '\\1', 'gi')", HONORIFICS, x)
    y = reduce(lambda z, h: f"regexp_replace({z}, '{edge}{h}($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2', 'gi')", WHOLE_HONORIFICS, y)
    return f"trim(regexp_replace(trim(regexp_replace(regexp_replace({y}, '\\s*\\([^)]{{1,80}}\\)\\s*', '', 'g'), '\\s+', ' ', 'g')), '\\.\\s*$', ''))"


def volume_issue(x: str) -> str:
    """The steps written out for RE2, whose word boundary knows ASCII alone; º and ª count as letters here."""
    steps = [
        (rf"\b({'|'.join(MONTHS)})\b", ""), (r"\bvol(\.\b|umen\b|\b)", "vol"), (r"\bno\.(\w)", r"no\1"), (r"\b(n[uú]mero|nro)\b", "no"), (r"(^|\W)n\.?º($|\W)", r"\1no\2"), (r"(^|\W)n°(\w)", r"\1no\2"),
        (r"\b(no\s+)?especial\b", "especial"), (r"\b(suplemento|sup)\s*(no\s*)?(\d+)", r"suplemento \3"), (r"(vol\s+\d+)\s*\(\s*(\d+)\s*\)", r"\1, no \2"), (r"\b(\d+)\s*\(\s*(\d+)\s*\)", r"vol \1, no \2"),
        (r"\b(vol|no|suplemento)(\d+)\b", r"\1 \2"), (r"\s*[,;|]\s*", ", "), (r"[()]", ""), (r"\bvol\s+vol\b", "vol"), (r"\s{2,}", " "), (r"^[ ,]+|[ ,]+$", ""),
    ]
    return reduce(lambda y, step: f"regexp_replace({y}, '{step[0]}', '{step[1]}', 'g')", steps, f"lower({x})")


def metric_key(x: str) -> str:
    y = f"strip_accents(regexp_replace(lower({x}), '[¿¡]', '', 'g'))"
    return f"trim(regexp_replace(regexp_replace({y}, '[.,;:!?\\-–]+$', ''), '[ \\t\\n\\r]+', ' ', 'g'))"


def name_key(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split(trim(regexp_replace({metric_key(x)}, '[,;.\\-_() ]+', ' ', 'g')), ' '), lambda w: length(w) > 1)))"


def present(x: str) -> str:
    return f"coalesce(len(list_filter({x}, lambda v: v IS NOT NULL AND lower(trim(v)) NOT IN ('', 'null'))) > 0, false)"

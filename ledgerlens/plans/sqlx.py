"""DuckDB expression builders for the oracle text (mirrors ``functions``)."""
from __future__ import annotations

import math
import re

from ..functions import text as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown' ELSE "
            f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) END")


def norm_label(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'unknown' ELSE "
            f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) END")


def handle(v: str) -> str:
    return f"CASE WHEN {v} IS NULL OR strpos({v}, '@') = 0 THEN 'unknown' ELSE lower(string_split({v}, '@')[-1]) END"


def contains_any(x: str, kws) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(k)})" for k in kws) + ")"


def first_match(x: str, table, default: str) -> str:
    parts = [f"WHEN {contains_any(x, kws)} THEN {q(lbl)}" for lbl, kws in table if kws]
    return "CASE " + " ".join(parts) + f" ELSE {q(default)} END"


def category_hint(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'other' ELSE {first_match(f'lower({x})', X.CATEGORY_HINT_KEYWORDS, 'other')} END"


def word_count(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN trim({x}) = '' THEN 0 "
            f"ELSE len(regexp_split_to_array(trim({x}), '\\s+')) END")


def rlike(x: str, pat: str) -> str:
    return f"regexp_matches({x}, {q(pat)})"


def whole_word(x: str, w: str) -> str:
    return f"regexp_matches({x}, {q(r'\b' + re.escape(w) + r'\b')})"


def cyc(fn: str, x: str, period: float) -> str:
    return f"{fn}({2 * math.pi!r} * {x} / {float(period)!r})"


def rc_bin(x: str, edges) -> str:
    parts = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = f"{x} > {float(lo)!r}" + ("" if hi == float("inf") else f" AND {x} <= {float(hi)!r}")
        parts.append(f"WHEN {cond} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def merchant_trust(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return "CASE " + " ".join(f"WHEN contains({low}, {q(k)}) THEN {v!r}" for k, v in X.TRUSTED_MERCHANTS) + " ELSE 0.6 END"


def display(x: str) -> str:
    return "coalesce(CASE lower(" + x + ") " + " ".join(
        f"WHEN {q(k)} THEN {q(v)}" for k, v in X.DISPLAY_CATEGORY.items()) + f" END, {x})"


def signature(name: str, hnd: str, geo: str = "''") -> str:
    return f"substr(sha256(concat_ws('|', {norm_label(name)}, lower(coalesce({hnd}, '')), coalesce({geo}, ''))), 1, 16)"


def dec_places(x: str) -> str:
    return (f"greatest(length(regexp_replace(split_part(CAST(CAST({x} AS DECIMAL(38,10)) AS VARCHAR), '.', 2), '0+$', '')), 1)")

"""Structured log lines `info <field> <value> ...`, read word by word by a small state machine in a pandas UDF.

A line is a list of fields. Most take one value; `score` takes a kind and a value and may be followed by a bound; `pv`,
`string`, `refutation` and `currline` take the rest of the line, so words after them are never fields. A word in a place
where a score's kind or value must stand is that, whatever it spells. Nothing is searched for: text that looks like a
score in a free part is no score. What follows a word depends on all before it, which column expressions can only fold with
lambdas many times dearer than the UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The format's fields.
INTEGERS = {"depth", "seldepth", "time", "nodes", "nps", "hashfull", "tbhits", "cpuload", "currmovenumber", "multipv"}
REST = {"pv", "string", "refutation", "currline"}
FIELDS = INTEGERS | REST | {"currmove", "score"}
BOUNDS = {"lowerbound", "upperbound"}
SCORES = {"cp": re.compile("[+-]?[0-9]+"), "mate": re.compile("[+-]?[0-9]+|[+-]")}
NUMBER = re.compile("[+-]?[0-9]+")
#: Longest runs of digits that are read, and the numbers that a column holds.
DIGITS, LEAST, MOST = 40, -(1 << 63), (1 << 63) - 1
#: Integer fields that log_line() returns; `nodes` has a verdict of its own.
KEPT = ("depth", "seldepth", "time", "nps", "multipv")
SCHEMA = ", ".join([f"{k} bigint" for k in KEPT] + [f"{k} string" for k in ("kind", "raw", "bound")]) + ", pv array<string>, parse_error string, malformed_scores int, nodes bigint, node_verdicts array<string>, node_evidence string"


def _prefix(words: list[str]) -> tuple[list[str], int]:
    """(words before the first that takes the rest of the line, malformed scores among them)."""
    due, malformed, kind = "field", 0, ""
    for at, w in enumerate(words):
        if due == "kind":
            due, kind = "value", w
            continue
        if due == "value":
            good = kind in SCORES and SCORES[kind].fullmatch(w)
            malformed += not good
            due = "field"
            continue
        if w in REST:
            return words[:at], malformed
        due = "kind" if w == "score" else "field"
    return words, malformed + (due != "field")


def _number(word: str) -> int | None:
    """The number that a word of digits spells, or None beyond 64 bits."""
    digits = word.lstrip("+-").lstrip("0")
    value = (-1 if word.startswith("-") else 1) * (int(digits or "0") if len(digits) < DIGITS else 1 << 64)
    return value if LEAST <= value <= MOST else None


def _node_verdicts(words: list[str]) -> tuple[list[str], list[int | None]]:
    """What each `nodes` field holds: valid, negative, malformed, missing or, beyond 64 bits, overflow; and its number."""
    verdicts, values, due = [], [], False
    for w in [*words, "nodes"]:  # a field of the format ends a `nodes` that waits for its value
        if due and w in FIELDS:
            verdicts.append("missing")
            values.append(None)
        elif due:
            found = "valid" if re.fullmatch("[0-9]+", w) else "negative" if re.fullmatch("-[0-9]+", w) else "malformed"
            value = None if found == "malformed" else _number(w)
            verdicts.append("overflow" if found != "malformed" and value is None else found)
            values.append(value)
        due = w == "nodes" if not due or w in FIELDS else False
    return verdicts, values


def _fields(words: list[str]) -> dict:
    """The fields up to a word that is none, a malformed score, or one that takes the rest."""
    out: dict = {}
    left = list(reversed(words))
    while left:
        name = left.pop()
        if name == "score":
            kind, raw = (left.pop() if left else None for _ in range(2))
            if raw is None or kind not in SCORES or not SCORES[kind].fullmatch(raw):
                return out | {"parse_error": "malformed_score"}
            out |= {"kind": kind, "raw": raw, "bound": left.pop() if left and left[-1] in BOUNDS else "exact"}
        elif name == "pv":
            return out | {"pv": left[::-1]}
        elif name in REST:
            return out
        elif name == "nodes":
            if left and left[-1] not in FIELDS:
                left.pop()
        elif name not in FIELDS:
            return out | {"parse_error": f"unknown_info_field:{name}"}
        elif not left:
            return out | {"parse_error": f"missing_{name}_value"}
        else:
            value = left.pop()
            out[name] = _number(value) if name in INTEGERS and NUMBER.fullmatch(value) else None
            if name in INTEGERS and out[name] is None:
                out["parse_error"] = f"{'overflow' if NUMBER.fullmatch(value) else 'malformed'}_{name}_value"
    return out


def read_line(line: str | None) -> dict | None:
    words = (line or "").split()
    if len(words) < 2 or words[0] != "info" or words[1] == "string":
        return None
    before, malformed = _prefix(words[1:])
    verdicts, values = _node_verdicts(before)
    free = words.index("string", 2) if "string" in words[2:] else len(words)
    out = _fields(words[1:free])
    out.setdefault("parse_error", "malformed_score" if malformed else None)
    one = verdicts[0] if len(verdicts) == 1 else None
    evidence = "missing" if not verdicts else "ambiguous" if not one else "present" if one == "valid" else one
    return out | {"malformed_scores": malformed, "nodes": values[0] if one else None, "node_verdicts": verdicts, "node_evidence": evidence}


NAMES = [part.split(" ")[0] for part in SCHEMA.split(", ")]


def _read(lines: pd.Series) -> pd.DataFrame:
    rows = [read_line(x) for x in lines]
    made = {k: pd.Series([(r or {}).get(k) for r in rows], dtype=object) for k in NAMES}
    return pd.DataFrame(made | {"is_info": [r is not None for r in rows]})


def log_line(line: Column) -> Column:
    """A struct of a line's fields; is_info is false, and all else null, for a line that isn't `info` or is `info string` (FN-10, FN-30).

    depth, seldepth, time, nps, multipv; kind, raw and bound (exact, lowerbound, upperbound) of the last score; pv, null if
    there is none; parse_error, null if the line is well-formed as far as it was read; malformed_scores, their number on
    the whole line; nodes, if the line has one `nodes` field with a number; node_verdicts; node_evidence (present, missing,
    negative, malformed, overflow, or ambiguous for several). A number beyond 64 bits is null with a verdict of its own,
    overflow; raw keeps a score's digits. A score that isn't well-formed leaves kind null but never hides `nodes`.
    """
    return F.pandas_udf(_read, f"{SCHEMA}, is_info boolean")(line)


def is_primary(parsed: Column) -> Column:
    """Whether a parsed line is a scored principal line: well-formed, with a score and a move list, and of rank 1 or none (FLT-12)."""
    return F.coalesce(parsed["parse_error"].isNull() & parsed["kind"].isNotNull() & (F.size(parsed["pv"]) > 0) & (F.coalesce(parsed["multipv"], F.lit(1)) == 1), F.lit(False))

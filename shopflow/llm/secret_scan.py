"""Secret scan: base patterns plus assignment-aware lexing of source and configuration syntax.

The lexer turns assignments in a text (``name = value``, ``"name": value``,
``name := value``, ``'name' => value``, ``name: type = value``, ``a = b = value``)
into name-literal pairs. The value is a sum of literals (single, triple or back
quotes), bare words, names and calls, whose literal arguments count but not the
names of environment variables; it may stand in brackets or, quoted, on the next
line, and of a YAML block its first line is read. A name assigned earlier stands
for the literals assigned to it, bare or quoted, so constants travel through
renamings and concatenations. A literal is scored by how sensitive its target's
name is and by how much it looks like a generated value.

Spans are code points, end exclusive: whole matches for the base patterns,
the literal's content (without quotes) for lexed ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
# a maximal run is matched from its first character, so the least length can stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")

# Name parts and how much they speak for a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signature": 0.5, "salt": 0.6, "key": 0.5,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "redacted", "your", "dummy", "todo", "none", "null",
                "true", "false")
THRESHOLD = 0.5

FINDINGS = "array<struct<kind: string, start: int, end: int, name: string, score: double>>"
_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                ("name", pa.string()), ("score", pa.float64())]))

_OPERATOR = re.compile(r"[=:]")
_TERM = re.compile(r'''
      [rbuf]{0,2}(?: """(.*?)"""
                   | \'\'\'(.*?)\'\'\'
                   | "([^"\\\n]*(?:\\[^\n][^"\\\n]*)*)"
                   | '([^'\\\n]*(?:\\[^\n][^'\\\n]*)*)' )
    | `([^`]*)`
    | ((?:[^\s"'`,;(){}\[\]<>+&|=:]|:(?=[^\s=]))+(?:={1,2}(?=[\s"'`,;)}\]&]|\Z))?)
    ''', re.VERBOSE | re.DOTALL)
_BARE = 6
# most values: one bare word that ends its line, list element or query parameter
_PLAIN = re.compile(r"[ \t]*([\w/$%@!*#~^\-]+)(?=[;,\n]|&\w{1,80}=)", re.ASCII)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|&|\|\||\?\?|\bor\b)[ \t]*(?:\\?\n[ \t]*)?|[ \t]+(?=[\"'`])")
# what may stand between a name and its "=": a type's parameters, its alternatives
_ASSIGNS = re.compile(r"""(?P<type>(?:\[[^\]\n=]{0,80}\]|<[^>\n=]{0,80}>)?\??(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]{0,80})*)
                          (?P<gap>[ \t]*):?=(?![=>])""", re.VERBOSE)
_NEXT_LINE = re.compile(r"[ \t]*\\?\n[ \t]*(?=[rbuf]{0,2}[\"'`(])")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[ \t]*\n[ \t]+(\S[^\n]*)")
_BLANKS, _SPACE = re.compile(r"[ \t]*"), re.compile(r"\s*")
_SUBSCRIPT = re.compile(r"\[[^\]\n]{0,200}\]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_NAME_END = re.compile(r"[A-Za-z_$][\w$.\-]*\Z", re.ASCII)


def name_weight(name: str) -> float:
    """How sensitive a target is: its strongest part, or pair of adjacent parts."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max((SENSITIVE.get(p, 0.0) for p in parts + [a + b for a, b in zip(parts, parts[1:])]), default=0.0)


def literal_weight(value: str) -> float:
    """How much a value looks like a generated one: 0 for placeholders and short or plain words."""
    low = value[:16].lower()
    if len(value) < 6 or any(low.startswith(p) for p in PLACEHOLDERS) or re.match(r"[$<{%*]|(.)\1*\Z", value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 * kinds + 0.15 * entropy)


def _target(text: str, at: int, least: int) -> str | None:
    """The name that ends just before the operator at ``at``, quotes, empty brackets and spaces taken off."""
    end = at
    while end > least and text[end - 1] in " \t":
        end -= 1
    if end > least and text[end - 1] in "\"'`]":
        end -= 1
        if end > least and text[end - 1] in "\"'[":
            end -= 1
    begin = end
    while begin > least and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "_$.-"):
        begin -= 1
    name = _NAME_END.search(text[begin:end])
    return name[0] if name else None


@dataclass(slots=True)
class Assignment:
    """The names given one value, its literals as (start, end, quoted), the earlier assignments it refers to.

    ``inner`` are the literals that may hold assignments of their own.
    """

    names: dict[str, None]
    literals: list[tuple[int, int, bool]] = field(default_factory=list)
    refers: list[Assignment] = field(default_factory=list)
    inner: list[tuple[int, int]] = field(default_factory=list)
    weight: float = 0.0
    name: str = ""


def _skip_line(text: str, at: int, stop: int) -> int:
    """``at``, or where a value begins on the next line."""
    line = _NEXT_LINE.match(text, at, stop) if at < stop and text[at] in " \t\\\n" else None
    return line.end() if line else at


def _read_value(text: str, at: int, stop: int, colon: bool, found: Assignment,
                known: dict[str, Assignment]) -> int:
    """Read the expression at ``at`` into ``found``; returns its end. Nothing before that end is read again."""
    if plain := _PLAIN.match(text, at, stop):
        if plain[1] in known:
            found.refers.append(known[plain[1]])
        else:
            found.literals.append((*plain.span(1), False))
        return plain.end()
    block = _BLOCK.match(text, at, stop) if colon else None
    if block:
        found.literals.append((block.start(1), block.start(1) + len(block[1].rstrip()), False))
        found.inner.append(block.span(1))
        return block.end()
    at = _skip_line(text, at, stop)
    calls: list[bool] = []  # of each open bracket, whether the literals in it are the name of a variable to look up
    first, end = True, at
    while True:
        char = text[at] if at < stop else ""
        if char.isspace():
            at = (_SPACE if calls else _BLANKS).match(text, at, stop).end()
            char = text[at] if at < stop else ""
        if char and char in "([":
            calls.append(False)
            end = at = at + 1
            continue
        if calls and char and char in ")],":
            if char == ",":
                calls[-1] = False
            else:
                calls.pop()
            end = at = at + 1
            if calls:
                continue
        elif term := _TERM.match(text, at, stop):
            after = term.end()
            if term[_BARE] is None:
                if not (calls and calls[-1]):
                    found.literals.append((*term.span(term.lastindex), True))
                found.inner.append(term.span(term.lastindex))
            elif assigns := _ASSIGNS.match(text, after, stop):
                if not first:
                    return end  # the next assignment, not a part of this value
                if not (colon and (assigns["type"] or assigns["gap"])):
                    if term[_BARE] not in found.names and (name := _NAME_END.search(term[_BARE])):
                        found.names[name[0]] = None
                colon, at = False, assigns.end()
                end = at
                at = _skip_line(text, at, stop)
                continue
            else:
                name = term[_BARE].rstrip(".")
                if text.startswith("(", after) and after < stop:
                    calls.append("env" in name.lower())
                    after += 1
                elif name in known:
                    found.refers.append(known[name])
                elif text.startswith("[", after) and (part := _SUBSCRIPT.match(text, after, stop)):
                    after = part.end()
                elif not calls:
                    found.literals.append((term.start(), term.start() + len(name), False))
            end = at = after
            first = False
            if calls:
                more = _JOIN.match(text, at, stop)
                at = more.end() if more else at
                continue
        else:
            return end
        more = _JOIN.match(text, at, stop)
        if not more:
            return end
        at = more.end()
        first = False


def _assignments(text: str, at: int, stop: int) -> Iterator[Assignment]:
    """The assignments in ``text[at:stop]`` in order; each refers to those before it."""
    known: dict[str, Assignment] = {}
    least = at
    while operator := _OPERATOR.search(text, at, stop):
        start = operator.start()
        at = start + 1
        if text.startswith(("://", "::", "=="), start):
            at = start + 2
            continue
        if text[start] == "=" and start > least and text[start - 1] in "=!<>":
            continue
        name = _target(text, start, least)
        if text.startswith((":=", "=>"), start):
            at += 1
        if not name:
            continue
        found = Assignment({name: None})
        at = max(at, _read_value(text, min(at, stop), stop, text[start] == ":" and at == start + 1, found, known))
        found.literals = [s for s in found.literals if s[1] > s[0]]
        if found.literals or found.refers or found.inner:
            known.update(dict.fromkeys(found.names, found))
            yield found


def lexed_pairs(text: str) -> Iterator[tuple[str, float, int, int, bool]]:
    """(name, its weight, start, end, quoted) of every literal given to a sensitive name.

    Constants travel by their targets' weights: an assignment hands its name to
    the earlier assignments it refers to, taken from the last one back, so each
    reference is followed once. Quoted literals are read again by themselves for
    the assignments inside them; as a literal cannot hold its own quotes these
    lie a few deep, and the work is linear in the text.
    """
    regions, weigh = [(0, len(text))], lru_cache(maxsize=4096)(name_weight)
    while regions:
        found = list(_assignments(text, *regions.pop()))
        for a in reversed(found):
            for name in a.names:
                if (weight := weigh(name)) > a.weight:
                    a.weight, a.name = weight, name
            for earlier in a.refers:
                if a.weight > earlier.weight:
                    earlier.weight, earlier.name = a.weight, a.name
        for a in found:
            for start, end, quoted in a.literals:
                if a.weight:
                    yield a.name, a.weight, start, end, quoted
            regions += [inner for inner in a.inner if _OPERATOR.search(text, *inner)]


def scan_text(text: str) -> list[tuple[str, int, int, str, float]]:
    """All findings of one text, by start, then kind as listed, then end."""
    found = [("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    best: dict[tuple[int, int], tuple[str, float]] = {}
    for name, weight, start, end, quoted in lexed_pairs(text):
        score = weight * literal_weight(text[start:end]) * (1.0 if quoted else 0.8)
        if score >= THRESHOLD and score > best.get((start, end), ("", 0.0))[1]:
            best[start, end] = (name, score)
    found += [("lexed", *span, name, score) for span, (name, score) in best.items()]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, findings`` for every row of ``docs`` (needs ``doc_id`` and ``text``).

    A finding has kind, start, end, target name and score. Null and empty
    texts have no findings; repeated rows are scanned alike; an empty table
    gives an empty result. Each text is scanned whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = ("kind", "start", "end", "name", "score")
            found = [[dict(zip(keys, f)) for f in scan_text(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FINDINGS)],
                                             ["doc_id", "findings"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, docs.select("doc_id").schema.add("findings", DataType.fromDDL(FINDINGS)))

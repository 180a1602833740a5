"""Secret scan: three base patterns and an assignment-aware lexer.

Base spans (kinds assign, access, hex) are leftmost non-overlapping matches over the whole text. The lexer
reads every line that holds an assignment mark as source or configuration syntax: names, quoted, triple-quoted
or bare literals, ``=``, ``:``, ``:=``, ``=>`` and ``+``; values go on over lines within brackets, after ``+`` and
after the mark. It builds name-literal pairs, propagates constants (a name on the right stands for all the
literals it was given before, also within a concatenation), and scores each literal by how sensitive the
target's name is, its entropy, length and character mix. Literals that reach the threshold are spans of kind
named; they stand beside the base spans and never replace one. The lexer reads each character a bounded number
of times, however a text is quoted.

Edge cases: a null text counts as empty (no spans, the digest of the empty string); very long texts are read
whole, line by line; repeated rows get equal rows; empty tables give empty results; other columns are ignored,
whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "named"]
# The base patterns and the lengths their matches need.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Parts of names that make what is assigned to them sensitive, with their weight.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api_key": 3.0, "access_key": 3.0, "private_key": 3.0, "credential": 2.5, "auth": 1.5, "bearer": 2.0, "salt": 1.0, "signature": 1.0, "key": 1.0}
THRESHOLD = 4.0
_PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|changeme|example|your.*|placeholder|none|null|true|false|todo|test|dummy|redacted)$")
#: All tokens but strings, which are read by hand, each character once.
_TOKEN = re.compile(r"""(?P<mark>:=|=>|==|!=|<=|>=|=|:(?!//))|(?P<plus>\+(?![A-Za-z0-9/=]))|(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*(?=["']?[^\S\n]*(?::=|=>|=(?!=)|:(?!//)|\+\s|$|[;,)\s]))(?![+/]))|(?P<bare>[A-Za-z0-9_+/.=\-]{6,})|(?P<end>[;,{}()\[\]])|(?P<newline>\n)""")
#: The next character at which a token can start.
_START = re.compile(r"[A-Za-z0-9_+/.=\-:!<>;,{}()\[\]\n\"']")


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    #: The part to redact.
    value_start: int
    value_end: int
    name: str
    score: float


def entropy(s: str) -> float:
    """Bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def sensitivity(name: str) -> float:
    """Weight of the most sensitive part of a target's name."""
    plain = re.sub(r"[.\-]", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)).lower()
    return max((w for part, w in SENSITIVE.items() if re.search(rf"(^|_){part}s?(_|\d|$)", plain) or (w >= 2.5 and part in plain)), default=0.0)


def literal_score(name: str, value: str) -> float:
    """Sensitivity of the name plus evidence from the literal; 0 where either says nothing."""
    weight = sensitivity(name)
    if not weight or len(value) < 6 or _PLACEHOLDER.match(value) or " " in value.strip():
        return 0.0
    mix = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return weight + 0.5 * entropy(value) + 0.25 * mix + min(len(value), 40) / 40 - 1.0


def base_findings(text: str) -> list[Finding]:
    """Spans of the three base patterns, in the order of their start and then their kind."""
    out = [Finding("assign", *m.span(), *m.span(2), m[1], 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [Finding("access", *m.span(), *m.span(), "", 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [Finding("hex", *m.span(), *m.span(), "", 0.0) for m in HEX.finditer(text)]
    return sorted(out, key=lambda f: (f.start, KINDS.index(f.kind)))


def lexed(text: str) -> list[tuple[str, str, int, int]]:
    """Tokens (kind, as written, start, end) of the lines that hold an assignment mark or go on with a value.

    Quotes end on their line, triple ones wherever they are closed; an unclosed quote is no token. Each end is
    looked for once: what one quote doesn't find before the end of its line, a later one of the line doesn't either.
    """
    out: list[tuple[str, str, int, int]] = []
    at, size = 0, len(text)
    #: End of the line in which a quote character is known to be unclosed; triple quotes that are not closed at all.
    unclosed = {'"': -1, "'": -1}
    open_triples: set[str] = set()
    line = text.find("\n")
    line = size if line < 0 else line
    fresh = True
    while at < size:
        if at > line:
            line = text.find("\n", at)
            line = size if line < 0 else line
            fresh = True
        if fresh:
            fresh = False
            goes_on = out and out[-1][0] == "newline" and len(out) > 1 and out[-2][0] in ("mark", "plus", "open", "string")
            if not goes_on and text.find("=", at, line) < 0 and text.find(":", at, line) < 0:
                at = line + 1
                continue
        start = _START.search(text, at)
        if not start:
            break
        if start.start() > line:
            at = start.start()
            continue
        at = start.start()
        c = text[at]
        if c in "\"'":
            if text.startswith(c * 3, at) and c not in open_triples:
                end = text.find(c * 3, at + 3)
                if end >= 0:
                    out.append(("string", text[at : end + 3], at, end + 3))
                    at = end + 3
                    continue
                open_triples.add(c)
            if unclosed[c] != line:
                end = at + 1
                while end < line and text[end] != c:
                    # To the next quote or escape.
                    q, e = text.find(c, end, line), text.find("\\", end, line)
                    if e >= 0 and (q < 0 or e < q):
                        end = e + 2
                    else:
                        end = q if q >= 0 else line
                if end < line:
                    out.append(("string", text[at : end + 1], at, end + 1))
                    at = end + 1
                    continue
                unclosed[c] = line
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            at += 1
            continue
        kind = m.lastgroup
        if m[0] == "(" and out and out[-1][0] in ("mark", "plus", "open"):
            kind = "open"
        out.append((kind, m[0], m.start(), m.end()))
        at = m.end()
    return out


def _inner(raw: str, start: int, end: int) -> tuple[str, int, int]:
    """A string's value and place without its quotes; triple ones without the blanks around it."""
    if len(raw) >= 6 and raw[:3] == raw[0] * 3 and raw[-3:] == raw[:3]:
        inside = raw[3:-3]
        left = len(inside) - len(inside.lstrip())
        inside = inside.strip()
        return inside, start + 3 + left, start + 3 + left + len(inside)
    return raw[1:-1], start + 1, end - 1


def lexed_findings(text: str) -> list[Finding]:
    """Literals that end up in sensitive names."""
    #: What a name was given: the value, and (start, end) of each literal in it.
    known: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    out: dict[tuple[int, int], Finding] = {}
    tokens = lexed(text)
    i = 0
    targets: list[str] = []
    while i + 1 < len(tokens):
        kind, name, _, _ = tokens[i]
        if kind not in ("name", "string") or tokens[i + 1][0] != "mark" or tokens[i + 1][1] in ("==", "!=", "<=", ">="):
            i += 1
            targets = []
            continue
        target = name.strip("\"'").rpartition(".")[2] if kind == "name" else name.strip("\"'")
        targets.append(target)
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        size = 0
        i += 2
        chained, depth, waits = False, 0, True
        while i < len(tokens):
            kind, raw, start, end = tokens[i]
            if kind == "newline":
                # A value goes on within brackets, after +, or, as a string, on the line after the mark.
                if depth or (waits and i + 1 < len(tokens) and tokens[i + 1][0] == "string" and not (i + 2 < len(tokens) and tokens[i + 2][0] == "mark")):
                    i += 1
                    continue
                break
            if kind == "open":
                depth, i = depth + 1, i + 1
                continue
            if kind == "end" and raw == ")" and depth:
                depth, i = depth - 1, i + 1
                if depth:
                    continue
                break
            if kind == "plus" and spans:
                i, waits = i + 1, True
                continue
            if kind == "name" and i + 1 < len(tokens) and tokens[i + 1][0] == "mark" and not spans and not depth:
                chained = True  # a = b = literal: the inner pair comes next, its literals go to all targets
                break
            if not waits and not (depth and kind == "string"):
                break
            if kind == "string":
                value, start, end = _inner(raw, start, end)
                more = [(start, end)]
            elif kind == "bare":
                value, more = raw, [(start, end)]
            elif kind == "name":
                value, more = known.get(raw.rpartition(".")[2], (raw, [(start, end)]))
            else:
                break
            size += len(value)
            if size <= 2 * len(text) + len(value):  # longer only by repetition (x = x + x)
                parts.append(value)
            spans.extend(more)
            i, waits = i + 1, False
        if chained:
            continue
        given, targets = targets, []
        if not spans:
            continue
        spans = list(dict.fromkeys(spans))
        value = "".join(parts)
        if len(value) > 2 * len(text):  # each literal once, then the value as far as the text's length
            value = "".join(text[start:end] for start, end in spans) + value[: len(text)]
        known.update((t, (value, spans)) for t in given)
        target = max(given, key=sensitivity)
        score = literal_score(target, value)
        if score >= THRESHOLD:
            for start, end in spans:
                if start < end and ((start, end) not in out or out[start, end].score < score):
                    out[start, end] = Finding("named", start, end, start, end, target, score)
    return sorted(out.values(), key=lambda f: f.start)


def findings(text: str) -> list[Finding]:
    """Base and named spans, by start and then kind."""
    out = base_findings(text)
    if "=" in text or ":" in text:
        out += lexed_findings(text)
    return sorted(out, key=lambda f: (f.start, KINDS.index(f.kind), f.end))


def redact(text: str, by: str = "[SECRET]") -> str:
    """The text with the values of all findings replaced; overlapping values become one mark."""
    spans = sorted((f.value_start, f.value_end) for f in findings(text))
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(found: list[Finding]) -> str:
    return ",".join(f"{f.kind}:{f.start}:{f.end}" for f in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings): every finding of every row, as an array of (kind, start, end, name, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))
        for b in batches:
            got = [[{"kind": f.kind, "start": f.start, "end": f.end, "name": f.name, "score": f.score} for f in findings(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], names=["doc_id", "findings"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, findings array<struct<kind:string,start:int,end:int,name:string,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of a table made by scan()."""
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"] != "named")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("named"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with secrets replaced in text and n_chars (where present) counted anew.

    Every row stays, repeated ones too; null and empty texts stay as they are; an empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redact(t) if t else t)

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

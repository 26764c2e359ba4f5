"""Secrets in texts: fixed patterns, and literals assigned to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.frames import picked, slices, text_of

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

#: How sensitive a word of a name is; two-word entries stand for neighbours.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9,
    "apikey": 1.0, "api key": 1.0, "private key": 1.0, "access key": 1.0, "auth": 0.7, "bearer": 0.8, "signature": 0.6, "key": 0.55,
    "pin": 0.6, "login": 0.5, "salt": 0.6, "session": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|changeme|example|placeholder|your[_-].*|none|null|true|false|<.*>|\$\{[a-z_][a-z0-9_.]*\}|(?-i:\$[A-Z_][A-Z0-9_]*)|\{\{.*\}\})$")
LEAST_SCORE = 0.5
LEAST_LENGTH = 6

_OPERATOR = re.compile(r":=|=>|[=:]")
_LITERAL = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`""")
_BARE = re.compile(r"[A-Za-z0-9_+/.\-]+={0,2}")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _CAMEL.findall(name)]
    pairs = [" ".join(p) for p in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *pairs]), default=0.0)


def strength(literal: str) -> float:
    """How much a literal looks like a secret: its entropy, none for placeholders and short ones.  Passphrases hold blanks."""
    if len(literal) < LEAST_LENGTH or PLACEHOLDER.match(literal):
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, entropy / 3.0)


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str], list[tuple[int, int, str]]]]:
    """(name, literal spans, names on the right, bare values) of everything that looks like an assignment.

    A target is a name, quoted or not, before ``=``, ``:``, ``:=`` or ``=>``; its right side is a chain of literals and names joined by
    ``+``, or one bare value to the end of the word.
    """
    for op in _OPERATOR.finditer(text):
        at = op.start()
        while at and text[at - 1] in " \t":
            at -= 1
        quote = at > 0 and text[at - 1] in "\"'"
        end = at - quote
        start = end
        while start and text[start - 1] in _NAME_CHARS:
            start -= 1
        name = text[start:end].strip(".-")
        if not name or name[0].isdigit():
            continue
        pos, literals, names, bare = op.end(), [], [], []
        while True:
            while pos < len(text) and text[pos] in " \t":
                pos += 1
            m = _LITERAL.match(text, pos)
            if m:
                k = m.lastindex or 1
                literals.append(m.span(k))
            else:
                m = _NAME.match(text, pos)
                if m and (m.end() == len(text) or text[m.end()] not in _NAME_CHARS and text[m.end()] not in "+/=" or text[m.end()] == "+" and text[m.end() - 1:m.end()] != "+"):
                    names.append(m.group())
                    bare.append((*m.span(), m.group()))
                else:
                    m = _BARE.match(text, pos)
                    if m:
                        bare.append((*m.span(), m.group()))
                    break
            pos = m.end()
            while pos < len(text) and text[pos] in " \t":
                pos += 1
            if pos >= len(text) or text[pos] != "+":
                break
            pos += 1
        yield name, literals, names, bare


def literal_spans(text: str) -> list[tuple[int, int, str, float]]:
    """Literals that reach a sensitive name, directly or through other names, with their scores."""
    if "=" not in text and ":" not in text:
        return []
    held: dict[str, set[tuple[int, int]]] = defaultdict(set)
    flows: dict[str, set[str]] = defaultdict(set)
    defined = []
    for name, literals, names, bare in assignments(text):
        defined.append((name, bare))
        held[name].update(literals)
        for source in names:
            flows[source].add(name)
    targets = {name for name, _ in defined}
    for name, bare in defined:
        # a bare value is a literal unless it is the name of something that is assigned elsewhere
        held[name].update((a, b) for a, b, value in bare if value not in targets)
    worth = {name: sensitivity(name) for name in held}
    grew = [name for name, w in worth.items() if w]
    back: dict[str, set[str]] = defaultdict(set)
    for source, to in flows.items():
        for name in to:
            back[name].add(source)
    while grew:
        name = grew.pop()
        for source in back.get(name, ()):
            if source in worth and worth[source] < worth[name]:
                worth[source] = worth[name]
                grew.append(source)
    best: dict[tuple[int, int], float] = {}
    for name, spans in held.items():
        if worth[name]:
            for span in spans:
                best[span] = max(best.get(span, 0.0), worth[name] * strength(text[span[0]:span[1]]))
    return [(a, b, "literal", score) for (a, b), score in sorted(best.items()) if score >= LEAST_SCORE]


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans; a literal inside a base span adds nothing."""
    base = base_spans(text)
    # base spans come by start: the furthest end so far decides whether one of them holds a literal
    starts, ends = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    more = []
    for a, b, kind, _ in literal_spans(text):
        at = bisect_right(starts, a)
        if not at or ends[at - 1] < b:
            more.append((a, b, kind))
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b > at:
            out += [text[at:max(a, at)], mask if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])


def secrets(records: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Secret spans of whole texts.

    The library's own records hold notes, which cannot hold secrets, so the operator is general: ``records`` is any table with a ``key``
    and a ``text`` (configuration, manifest and metadata files that come with scores).  Kinds: ``assign``, ``access``, ``hex`` are
    fixed patterns; ``literal`` are literals in source or configuration syntax that reach a sensitive name.  Returns per row: the
    key, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` of the fixed patterns' spans, and all ``spans`` (kind:start:end,
    code points, comma-joined by start and kind).  A null text is empty: no spans, the digest of the empty string.  Every row
    returns, repeated or not; null keys stay null; other columns are not looked at.
    """
    src = picked(records, key=key, text=text).select("key", text_of("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, digests, spans = [], [], []
            for value in batch.column("text").to_pylist():
                base, every = scan(value)
                kinds = Counter(s[2] for s in base)
                counts.append([kinds[k] for k in KINDS[:3]])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(c, pa.int64()) for c in zip(*counts)], pa.array(digests), pa.array(spans)],
                ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = src.schema["key"].dataType.simpleString()
    found = src.mapInArrow(run, f"key {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return found.withColumnRenamed("key", key)


def without_secrets(text: str, mask: str = "[secret]"):
    """Column of the text with every span masked; null stays null."""
    @F.pandas_udf("string")
    def masked(values):
        return values.map(lambda v: v if v is None else redacted(v, scan(v)[1], mask))

    return masked(F.col(text))

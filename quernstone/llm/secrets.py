"""Secrets by assignment-aware lexing.

Three base patterns find assignments, access keys and long hexadecimal runs. The method lexes every text as source or
configuration: names, operators and literals, which are quoted, triple-quoted (over lines too) or, behind an operator,
bare up to a blank or separator. NAME = LITERAL, NAME: LITERAL, NAME => LITERAL, {"NAME": LITERAL} and chains of them
(A = B = LITERAL) give name-literal pairs; + joins literals. A literal that is a name assigned elsewhere in the text
stands for that name's value (of the last assignment before, else of the first after; a name that leads back to itself
stands for itself), so constants reach the names that use them. A pair scores by how sensitive its name's parts are and
how random its literal looks; from THRESHOLD on every literal that the value is made of is a finding of kind `named`.

Defined results: a null or empty text has no spans, counts 0 and the digest of the empty string; base kinds are matched
independently and may overlap; repeated rows get equal results; an empty table gives an empty result; other columns
are not looked at; ids pass through Arrow as they are. Offsets are code points.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: The base patterns. Long runs are asked for directly: a shorter run holds no longer one.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Parts of names and how sensitive they are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "bearer": 0.8, "private": 0.7, "key": 0.6, "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4, "dsn": 0.6, "jwt": 0.8,
}
PAIRED = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("client", "secret"): 1.0, ("auth", "token"): 1.0}
#: Literals that stand for no secret.
DUMMIES = frozenset("changeme password secret token example none null true false undefined placeholder your_password your_token xxxxxxxx test dummy todo".split())
THRESHOLD = 0.6
LEAST = 6
_QUOTED = r'''(?P<triple>"""(?:[^\\]|\\.)*?"""|'{3}(?:[^\\]|\\.)*?'{3})|(?P<quoted>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')'''
_LEX = re.compile(_QUOTED + r"""|(?P<op>=>|:=|==|!=|<=|>=|[=:+])|(?P<word>[A-Za-z_$][\w$.-]*+)|(?P<end>[\n;,{}()])""", re.S)
#: Behind an operator: a further name of a chain, a quoted literal, or a bare one that is no call.
_CHAIN = re.compile(r"([A-Za-z_$][\w$.-]*+)[ \t]*(?:=>|:=|=(?!=))[ \t]*(?=[^\s=])")
_VALUE = re.compile(_QUOTED + r"""|(?P<bare>[^\s,;"'(){}\[\]<>]++)(?![(\[])""", re.S)
_BLANKS = re.compile(r"[ \t]*+")
_ASSIGN_OPS = frozenset(("=", ":", ":=", "=>"))
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NEAR = re.compile(r"[=:]")


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return max([best, *(PAIRED.get(x, 0.0) for x in zip(parts, parts[1:], strict=False))])


def literal_score(value: str) -> float:
    """0 to 1: bits of entropy for each character, the length, and the kinds of characters."""
    if len(value) < LEAST or value.lower() in DUMMIES or len(set(value)) < 3:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in map(value.count, set(value)))
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, entropy / 3.5) * min(1.0, n / 12 + 0.25) * (0.6 + 0.2 * min(kinds, 2))


Part = tuple[str, bool, int, int]  # text, bare, start, end


def assignments(text: str, offset: int = 0) -> Iterator[tuple[list[str], list[Part]]]:
    """(names, parts of the value) of every assignment, in order."""
    at, names, parts, named_now = 0, [], [], None  # named_now: a name that an operator may follow
    while at < len(text):
        m = _LEX.search(text, at)
        if not m:
            break
        at, kind, s = m.end(), m.lastgroup, m[0]
        if kind == "op" and s in _ASSIGN_OPS and named_now:
            names, at = [named_now], _BLANKS.match(text, at).end()
            while c := _CHAIN.match(text, at):
                names.append(c[1])
                at = c.end()
            parts = []
            while v := _VALUE.match(text, at):
                cut = {"triple": 3, "quoted": 1, "bare": 0}[v.lastgroup]
                parts.append((v[0][cut : len(v[0]) - cut], not cut, offset + v.start() + cut, offset + v.end() - cut))
                at = v.end()
                plus = _BLANKS.match(text, at).end()
                if text[plus : plus + 1] != "+":
                    break
                at = _BLANKS.match(text, plus + 1).end()
            if parts:
                yield names, parts
            named_now = None
        elif kind in ("word", "quoted"):
            # a quoted key counts as a name, as in JSON
            named_now = s[1:-1] if kind == "quoted" else s
        else:
            named_now = None


def values(found: list[tuple[list[str], list[Part]]]) -> list[tuple[str, tuple[tuple[int, int], ...]]]:
    """Of each assignment the value's text and the literals that it is made of, with names replaced by their values."""
    defined: dict[str, list[int]] = {}
    for i, (names, _) in enumerate(found):
        for n in dict.fromkeys(names):
            defined.setdefault(n, []).append(i)

    def source(i: int, part: Part) -> int | None:
        at = defined.get(part[0]) if part[1] else None
        if not at:
            return None
        k = bisect.bisect_left(at, i)
        if k:
            return at[k - 1]
        return next((j for j in at[k : k + 2] if j != i), None)

    out: list[tuple[str, tuple[tuple[int, int], ...]] | None] = [None] * len(found)
    for i in range(len(found)):
        stack, path = [i], set()
        while stack:
            k = stack[-1]
            path.add(k)
            if out[k] is None:
                sources = [source(k, p) for p in found[k][1]]
                open_ = next((j for j in sources if j is not None and out[j] is None and j not in path), None)
                if open_ is not None:
                    stack.append(open_)
                    continue
                made = [(p[0], ((p[2], p[3]),)) if j is None or out[j] is None else out[j] for j, p in zip(sources, found[k][1], strict=True)]
                out[k] = ("".join(t for t, _ in made), tuple(dict.fromkeys(x for _, spans in made for x in spans)))
            path.discard(stack.pop())
    return out


def base(text: str) -> list[tuple[int, int, int]]:
    """The base spans as (start, place of the kind, end), by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if _NEAR.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def named(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals under sensitive names."""
    every = [x for offset, stretch in _stretches(text) for x in assignments(stretch, offset)]
    found: dict[tuple[int, int], float] = {}
    if any(name_score(n) for names, _ in every for n in names):
        for (names, _), (value, spans) in zip(every, values(every), strict=True):
            s = max(map(name_score, names))
            if s and (score := s * literal_score(value)) >= THRESHOLD:
                for span in spans:
                    found[span] = max(found.get(span, 0.0), score)
    return [(a, b, s) for (a, b), s in sorted(found.items())]


def _stretches(text: str) -> Iterator[tuple[int, str]]:
    """The lines with an operator, joined where they follow one another, and those between triple quotes; other lines hold no assignment."""
    at, held, start, quote = 0, [], 0, ""
    for line in text.split("\n"):
        if quote or "=" in line or ":" in line or "+" in line:
            if not held:
                start = at
            held.append(line)
            for q in (quote,) if quote else ('"""', "'''"):
                if line.count(q) % 2:
                    quote = "" if quote else q
                    break
        elif held:
            yield start, "\n".join(held)
            held = []
        at += len(line) + 1
    if held:
        yield start, "\n".join(held)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    if not text:
        return [], []
    return base(text), named(text) if _NEAR.search(text) else []


_COLUMNS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("top_score", pa.float64())]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            own, more = scan_text(text)
            listed = [(s, k, e, KINDS[k]) for s, k, e in own]
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in listed).encode()).hexdigest()
            every = sorted([*listed, *((s, 3, e, "named") for s, e, _ in more)])
            counts = [sum(k == i for _, k, _ in own) for i in range(3)]
            rows.append((*counts, digest, ",".join(f"{k}:{s}:{e}" for s, _, e, k in every), max((x for *_, x in more), default=0.0)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_COLUMNS)
        made = [pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *(n for n, _ in _COLUMNS)])


def op7_secrets(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, top_score double")

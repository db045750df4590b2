"""Secret scans: three fixed patterns, and assignment-aware lexing of name-literal pairs.

The lexer reads the syntax that source and configuration files share: ``name = literal``,
``name: literal``, ``name := literal``, ``"name": "literal"``, ``name => literal``.  A name
is an identifier or a dotted chain, of which the last part counts; a right-hand side is
a chain of quoted strings and names joined by ``+`` or ``.``, or one bare value.  Names
that were given a string before stand for it wherever they are read later (constant
propagation), so a literal is scored by every target it reaches.  A literal's score is
its most sensitive target's weight plus what its characters look like; from
``THRESHOLD`` on its span is reported as ``lexed``, at the place where it is written.

Spans count code points, end exclusive, over the whole text.  Defined results: a null
or empty text has no spans; repeated rows give repeated results; nothing is dropped for
length.  Only the text column is read and only added columns are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "lexed")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN_NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(map(_either_case, ASSIGN_NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
#: A text without any of these (lower-cased) has no match of ASSIGN.
ASSIGN_HINTS = ("passw", "secret", "token", "api")

#: Weights of names, the first fitting part counts.  Fixed values.
NAMES = [
    (re.compile(r"pass(word|wd|phrase)?$|^pwd$|_pwd$", re.I), 3.0),
    (re.compile(r"secret|private_?key|credential", re.I), 3.0),
    (re.compile(r"api_?key|access_?key|auth_?key|client_?key|encryption_?key|signing_?key", re.I), 3.0),
    (re.compile(r"token|bearer|^auth$|authorization", re.I), 2.5),
    (re.compile(r"connection_?string|conn_?str|dsn$", re.I), 2.0),
]
#: What stands where a secret will be filled in.  Fixed values.
PLACEHOLDER = re.compile(r"^(x+|\*+|\.+|-+|none|null|true|false|undefined|changeme|example|placeholder|test|your.*|<.*>|\$\{.*\}|\{\{.*\}\})$", re.I)
THRESHOLD = 4.0
#: What stands between a name and its literal.
OPERATOR = re.compile(r":=|=>|=(?!=)|:(?![:/])")
BLANKS = re.compile(r"[\x20\t]*+")
LINE = re.compile(r"[^\r\n]*+")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
CHAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z_][A-Za-z0-9_]*+)*+")
ATOM = re.compile(r"""[\x20\t]*+(?:"(?P<d>(?:[^"\\\r\n]|\\.)*+)"|'(?P<s>(?:[^'\\\r\n]|\\.)*+)'|(?P<n>[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)*+)(?![A-Za-z0-9+/_=-])|(?P<b>[^\s"',;(){}\[\]]++))""")
JOIN = re.compile(r"[\x20\t]*+(?:\+|\.(?=[\x20\t\"']))")


def looks(literal: str) -> float:
    """What a literal's characters add: length, mixed kinds of characters, and entropy."""
    n = len(literal)
    if n < 8 or PLACEHOLDER.match(literal) or " " in literal.strip():
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return 0.5 * (kinds - 1) + (entropy >= 2.5) * 0.5 + (entropy >= 3.25) * 0.5 + (n >= 20) * 0.5


def weight(name: str) -> float:
    last = re.split(r"[.-]", name)[-1] if not re.search(r"-", name) else name.replace("-", "_")
    return next((w for p, w in NAMES if p.search(last)), 0.0)


def name_before(text: str, low: int, at: int) -> str | None:
    """The longest name that ends where the operator at ``at`` begins, blanks and quotes aside, not reaching before ``low``."""
    while at > low and text[at - 1] in " \t":
        at -= 1
    quote = text[at - 1] if at > low and text[at - 1] in "\"'" else ""
    end = at - len(quote)
    first = end
    while first > low and text[first - 1] in NAME_CHARS:
        first -= 1
    if quote:
        return text[first:end] if first > low and text[first - 1] == quote and CHAIN.fullmatch(text, first, end) else None
    # parts from the last on, as far as they are identifiers; digits that lead one end the chain
    begin = stop = end
    for k in range(end - 1, first - 2, -1):
        if k < first or text[k] in ".-":
            head = k + 1
            while head < stop and text[head].isdigit():
                head += 1
            if head < stop:
                begin = head
            if head > k + 1 or head == stop:
                break
            stop = k
    return text[begin:end] or None


def lex(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name and look like a secret.

    Time is linear in the text: runs of name characters between operators are looked at
    once, and an assignment points to the earlier ones that it is made of.
    """
    if "=" not in text and ":" not in text:
        return []
    bound: dict[str, int] = {}
    made: list[list] = []  # of each assignment: spans of literals, and numbers of earlier assignments that hold some
    best: list[float] = []
    at, end = 0, -1
    for m in OPERATOR.finditer(text):
        if m.start() < at or (name := name_before(text, at, m.start())) is None:
            continue
        start = pos = BLANKS.match(text, m.end()).end()
        if end < start:
            end = LINE.match(text, start).end()
        if start == end == m.end():
            continue
        got: list = []
        while a := ATOM.match(text, pos, end):
            kind = a.lastgroup
            if kind in ("d", "s"):
                got.append(a.span(kind))
            elif kind == "n":
                if (old := bound.get(a["n"])) is not None:
                    if made[old]:
                        got.append(old)
                elif not got and len(a["n"]) >= 8 and re.search("[0-9]", a["n"]):
                    got.append(a.span("n"))  # a bare value that has the form of a name
            elif not got:
                got.append(a.span("b"))
            pos = a.end()
            if not (j := JOIN.match(text, pos, end)):
                break
            pos = j.end()
        bound[name] = len(made)
        made.append(got)
        best.append(weight(name))
        at = max(pos, start + 1) if got else start
    score: dict[tuple[int, int], float] = {}
    for k in range(len(made) - 1, -1, -1):
        if best[k]:
            for x in made[k]:
                if isinstance(x, int):
                    best[x] = max(best[x], best[k])
                else:
                    score[x] = max(score.get(x, 0.0), best[k])
    return sorted(s for s, w in score.items() if (x := looks(text[s[0] : s[1]])) and w + x >= THRESHOLD)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed patterns: leftmost matches, too short ones dropped."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """All spans as (start, kind, end), by start, then kind as listed, then end."""
    if not text:
        return []
    return sorted(base_spans(text) + [(s, 3, e) for s, e in lex(text)])


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end), sorted; empty where there is none."""
    spans = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(spans)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t)] for t in texts])

    return docs.withColumn("secrets", found(F.coalesce(F.col(text), F.lit(""))))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    spans = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.transform(F.filter("secrets", lambda s: s["kind"] != KINDS[3]), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"))

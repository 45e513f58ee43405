"""Secret scan: fixed key formats, and an assignment-aware lexer that follows literals to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_udf

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these stands in every text that ASSIGN matches.
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
MIN_ASSIGN, MIN_ACCESS = 6, 20

# Parts of names that hold secrets, with how sensitive each is; those of the second list must be whole words of a name.
SENSITIVE = (
    ("password", 1.0), ("passwd", 1.0), ("passphrase", 1.0), ("secret", 1.0), ("apikey", 1.0), ("accesskey", 1.0), ("privatekey", 1.0), ("credential", 0.9),
    ("signingkey", 1.0), ("encryptionkey", 1.0), ("connectionstring", 0.8), ("accesstoken", 0.9), ("authtoken", 0.9),
)
SENSITIVE_WORDS = {"token": 0.9, "tokens": 0.9, "pwd": 0.8, "auth": 0.6, "oauth": 0.6, "bearer": 0.8, "cookie": 0.5, "cookies": 0.5, "salt": 0.5}
#: Values that stand for a secret but aren't one: if they hold, begin with or are one of these.
HOLDS, BEGINS, IS = ("example", "changeme", "placeholder", "xxxx", "****"), ("your-", "your_", "your ", "<", "${", "{{"), {"none", "null", "true", "false", "undefined", "your"}

#: A literal in quotes of any kind (triple ones over lines), with a prefix as in b"", or a bare value.
_PART = re.compile(
    r"""(?:[A-Za-z@$]{0,2}+(?:"{3}((?:[^"\\]++|\\.|"(?!""))*+)"{3}|'{3}((?:[^'\\]++|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`)|([^\s"'`,;(){}\[\]+#]++))""", re.S
)
_BARE = 6
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
#: name (in quotes or not), subscripts, how it is bound. Nothing is bounded and nothing is read twice: all runs are possessive.
_HEAD = re.compile(
    r"""(?<![\w.$-])(["']?)([A-Za-z_$][\w.$-]*+)\1((?:[ \t]*+\[[ \t]*+(?:"[^"\n]*+"|'[^'\n]*+'|[^\]\["'\n]*+)[ \t]*+\])*+)\]?[?!]?[ \t]*+(:=|=>|=(?![=~])|:(?![:/]))[ \t]*+"""
    r"""|(?<![\w.$-])(?:var|const)[ \t]++([A-Za-z_]\w*+)[ \t]++(?=(?:string|\[\]byte)[ \t]*+=)"""
)
_BOUND = re.compile(r"[ \t]*+(?::=|=>|=(?![=~])|:(?![:/]))")
#: The type between a colon and the equals sign that binds the value.
_TYPE = re.compile(r"""(?:[^"'`,;{}()\[\]#=:\n]++|\[[^\]\n:=]*+\]|"[^"\n:=]*+"|'static\b)++=(?![=~>])[ \t]*+""")
#: A literal may begin on the next line, or within parentheses, where literals follow each other without a sign.
_LEAD = re.compile(r"""(?:[ \t]*+\\?\r?\n[ \t]*+|\(\s*+)(?=[A-Za-z@$]{0,2}["'`])""")
_BESIDE = re.compile(r"""\s*+(?=[A-Za-z@$]{0,2}["'`])""")
#: Names and values that no sign binds: elements, calls with a name and a literal, setters, user info of addresses, shell commands.
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*>")
_CALL = re.compile(r"""\(\s*+(["'])([A-Za-z_$][\w.$-]*+)\1\s*+,\s*+(?=["'`])|(?<![A-Za-z0-9])set_?([A-Za-z]\w*+)\(\s*+(?=["'`])""")
_USER = re.compile(r"""(?<=[A-Za-z0-9])://[^\s/:@"'<>]++:([^\s/@"'<>]++)@""")
_SHELL = re.compile(r"^[ \t]*+(?:export|setenv)[ \t]++([A-Za-z_]\w*+)[ \t]++([^\s=\"']\S*+)", re.M)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAME = re.compile(r"[A-Za-z_$][\w.$-]*$")
_ESCAPE = re.compile(r"\\(.)")
_HEADER = re.compile(r"-----[A-Z0-9 ]+-----")


def sensitivity(name: str) -> float:
    """How much a name says that its value is secret, from 0 to 1; separators and case don't count, but short words must be whole ones."""
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    whole = {w.lower() for w in _WORDS.findall(name)} & SENSITIVE_WORDS.keys()
    return max([w for word, w in SENSITIVE if word in flat] + [SENSITIVE_WORDS[w] for w in whole], default=0.0)


def randomness(value: str) -> float:
    """How much a literal looks like a key, from 0 to 1: Shannon entropy per character, its length, kinds of characters."""
    if "\n" in value or "-----" in value:  # lines of one key, without its header and footer
        value = "".join(line.strip() for line in _HEADER.sub("\n", value).splitlines())
    low = value.strip().lower()
    if len(value) < 6 or " " in value.strip() or low in IS or low.startswith(BEGINS) or any(p in low for p in HOLDS):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 4.0) * min(1.0, n / 12) * min(1.0, 0.4 + 0.2 * kinds)


def score_of(name: str, value: str) -> float:
    """A name's sensitivity times its value's randomness; a passphrase may have blanks."""
    w = sensitivity(name)
    if w and "passphrase" in re.sub(r"[^a-z]", "", name.lower()) and not value.lower().startswith(BEGINS):
        value = value.replace(" ", "")
    return w and w * randomness(value)


Parts = list[tuple[str, int, int]]


def literals(text: str, span: tuple[int, int] | None = None, known: ChainMap[str, Parts] | None = None) -> Iterator[tuple[str, str, int, int]]:
    """(name, literal, start, end) of each assignment, in source or configuration syntax, with constants propagated.

    A value that is the name of an earlier constant yields that constant's literal at the place where it was defined; of
    a sum of literals and constants each literal is yielded on its own, with the whole value as its text. What may be a
    type annotation is read both ways. Assignments within quotes are read too, but define nothing outside of them.
    """
    at, end = span or (0, len(text))
    known = ChainMap() if known is None else known
    typed = inner = -1  # up to where a type stands, which is no constant; where quotes were last read from within
    while m := _HEAD.search(text, at, end):
        name, after, readings, typed_to = m[5] or m[2] + m[3], m.end(), [], None
        if (m[5] or m[4] == ":") and (t := _TYPE.match(text, after, end)) and (value := _parts(text, t.end(), end, known)):
            readings.append(value)
            typed_to = t.end()
        # A bare word with digits before = may be a padded key instead of a type.
        if not m[5] and (value := _parts(text, after, end, known if typed_to is None else {})) and (typed_to is None or any(c.isdigit() for c in value[0][0][0])):
            readings.append(value)
        for k, (parts, quoted, _) in enumerate(readings):
            unique = list(dict.fromkeys(parts))
            if k == 0 and m.start() >= typed:
                known[name] = unique
            value_text = "".join(p[0] for p in parts)
            for _, a, b in unique:
                yield name, value_text, a, b
            for a, b in quoted:
                if a > inner and ("=" in (held := text[a:b]) or ":" in held):
                    inner = a
                    yield from literals(text, (a, b), known.new_child())
        if typed_to is not None:
            typed, at = typed_to, after
        else:
            at = readings[0][2] if readings else after


def _parts(text: str, at: int, end: int, known: Mapping[str, Parts]) -> tuple[Parts, list[tuple[int, int]], int] | None:
    """The literals of a value or sum at a place, its spans in quotes, and where it ends; None if there is none."""
    parts: Parts = []
    quoted = []
    lead = _LEAD.match(text, at, end)
    within = lead is not None and lead[0][0] == "("
    p = _PART.match(text, lead.end() if lead else at, end)
    if not p:
        return None
    while True:
        k = p.lastindex
        if k == _BARE and _NAME.match(p[k]) and p[k] in known:
            parts += known[p[k]]
        else:
            parts.append((_ESCAPE.sub(r"\1", p[k]), p.start(k), p.end(k)))
        if k != _BARE:
            quoted.append(p.span(k))
        plus = _PLUS.match(text, p.end(), end) or (_BESIDE.match(text, p.end(), end) if within else None)
        following = plus and _PART.match(text, plus.end(), end)
        if not following:
            # A bare name that is itself bound is read again as a name.
            return parts, quoted, p.start() if k == _BARE and _NAME.fullmatch(p[k]) and _BOUND.match(text, p.end(), end) else p.end()
        p = following


def unbound(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, literal, start, end) of what is named without an assignment: elements, calls, setters, user info in addresses, shell commands."""
    if "</" in text:
        yield from ((m[1], m[2], *m.span(2)) for m in _ELEMENT.finditer(text))
    if "(" in text:
        for m in _CALL.finditer(text):
            if value := _parts(text, m.end(), len(text), {}):
                yield from ((m[2] or m[3], p, a, b) for p, a, b in value[0])
    if "://" in text:
        yield from (("password", m[1], *m.span(1)) for m in _USER.finditer(text))
    if "export" in text or "setenv" in text:
        yield from ((m[1], m[2], *m.span(2)) for m in _SHELL.finditer(text))


def scan(text: str, threshold: float = 0.35) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float, str]]]:
    """Base spans (start, kind, end), kind 0 assign, 1 access, 2 hex, and what the lexer adds: (start, end, score, name).

    The lexer scores each literal by its name's sensitivity times its randomness and keeps those of ``threshold`` or
    more that no base span covers.
    """
    base = []
    if _ASSIGN_HINT.search(text):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more: dict[tuple[int, int], tuple[float, str]] = {}
    if any(c in text for c in "=:(") or "</" in text or "setenv" in text:
        starts, ends = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
        last: tuple[str, str] | None = None
        for name, value, a, b in chain(literals(text), unbound(text)):
            if last is None or last[0] is not name or last[1] is not value:
                last, score = (name, value), score_of(name, value)
            covering = bisect_right(starts, a)
            if b - a >= 3 and score >= threshold and not (covering and ends[covering - 1] >= b):
                more[a, b] = max(more.get((a, b), (0.0, "")), (score, name))
    return base, [(a, b, s, n) for (a, b), (s, n) in sorted(more.items())]


KINDS = ("assign", "access", "hex", "literal")
_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_of(text: str, threshold: float) -> list[tuple[int, int, int, float]]:
    """All spans of a text as (start, kind, end, score), in order; kinds as in KINDS."""
    base, more = scan(text, threshold)
    return sorted([(a, k, b, 1.0) for a, k, b in base] + [(a, 3, b, s) for a, b, s, _ in more])


def secret_spans(docs: DataFrame, threshold: float = 0.35, into: str = "secrets") -> DataFrame:
    """All columns of ``docs`` and ``into``: the spans found in the whole text, by start, then kind as in KINDS.

    Offsets are code points, ends exclusive; base kinds score 1. Null or empty text: an empty array. A column of docs
    that has that name is replaced. Null ids and repeated rows are kept, an empty table stays empty. Very long texts are read whole. Only texts go to Python.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in spans_of(t.as_py() or "", threshold)] for t in batch], kind)

    docs = docs.drop(into)
    return docs.withColumn(into, text_udf(find, _SPANS)(F.col("text").cast("string")))


def replaced(text: str, mark: str, threshold: float) -> str:
    """The text with each run of overlapping spans replaced by ``mark``; one pass over its spans."""
    parts, at = [], 0
    for a, _, b, _ in spans_of(text, threshold):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def redacted(docs: DataFrame, mark: str = "[SECRET]", threshold: float = 0.35) -> DataFrame:
    """``docs`` with every secret's characters in text replaced by ``mark`` (overlapping spans by one), n_chars following.

    Documents without secrets, and null texts, are unchanged; no row is dropped, an empty table stays empty. Very long texts are read whole. Other columns stay, whatever their names.
    """

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if (text := t.as_py()) is None else replaced(text, mark, threshold) for t in batch], pa.string())

    out = docs.withColumn("text", text_udf(clean, "string")(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The fixed report: doc_id, n_assign, n_access, n_hex, base_sha256, spans from the spans of ``secret_spans``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def span_sha256(spans: list[str]) -> str:
    """The digest of spans written as kind:start:end (for tests)."""
    return hashlib.sha256(",".join(spans).encode()).hexdigest()

"""Secret scan: fixed base patterns, and literals found by assignment-aware lexing.

Assignments are lexed into name-literal pairs (source code and configuration: `=`, `:`, `:=`, `=>`; quoted strings, also
of three quotes, bare values, concatenations and adjacent strings). A value goes on over line ends inside parentheses,
brackets and calls, after `+` or a backslash, as a string on the next line, and as a block scalar (`|`, `>`) of deeper
lines; the items of a list and the arguments of a call count one by one, what is looked up by name (`getenv("X")`, `env['X']`) not
at all. The body of a PEM private key belongs to its label. A name that was given a literal before, also as $NAME,
${NAME} or inside a string with double quotes, stands for that literal later on in the same text, so a constant that
reaches a sensitive name through other names is found where it was written. Values are known by their parts and counts
of characters, so that constants of any length can be built without being written out. The content of an XML element
belongs to its tag, and a bare value may stand alone on the next, deeper line.

A literal's score is the weight of its target name times how random it looks; scores from `threshold` on become spans of
kind `named` unless a base span holds them already. Base spans always stay. A name whose last word says that it holds
something about the secret (`token_type`, `key_id`) or whose words make it another kind of key (`sort_key`) weighs
nothing, and under names that aren't secrets by themselves (`key`, `salt`) a value made of words isn't random. Work is
linear in the text: a quote that its line doesn't close is passed over with all others of its kind on that line.

Null text counts as empty and has no spans; so has an empty text. Repeated rows get repeated results, an empty table
gives no rows, other columns are not read by scan() and kept by redact(). Positions are code points, the end is
exclusive.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run starts where the leftmost match does

#: Words of a target name and their weights.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "private": 0.6, "key": 0.6, "signature": 0.5, "salt": 0.5}
#: Last words of names that hold something about a secret, and words before "key" that make it no secret.
ABOUT = set("name names type id ids url uri path file filename dir field column length len size count limit expires expiry ttl header prefix suffix label format regex pattern hint policy version algorithm endpoint host port method mode".split())
PLAIN_KEYS = set("sort primary foreign public cache partition index order group row unique hash range map dict shortcut hot answer license product lookup join natural surrogate composite".split())
#: Weight from which a name is a secret by itself, and how much a value made of words loses below it.
CERTAIN, WORDS_LOSE = 0.9, 0.6
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|changeme|change_me|example|sample|placeholder|redacted|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%|env|string|str|int)$")

#: Score from which a literal counts, and the shortest literal.
THRESHOLD, SHORTEST = 0.45, 6
#: Where a quote may open a string: an apostrophe inside a word opens none, but after the prefix of a literal.
OPENS = {'"': '"', "'": r"(?:(?<![A-Za-z0-9])|(?<=\b[bBrRuUfF]))'", "`": "`"}
STRINGS = {q: rf"{OPENS[q]}(?:[^{q}\\\n]|\\.)*+{q}" for q in "\"'"} | {"`": "`[^`\n]*+`"}


def lexer(dead: frozenset[str]) -> re.Pattern:
    """Tokens where the quotes in `dead` open nothing; `open` is a quote that its line doesn't close."""
    strings = [*(f"{OPENS[q]}{q}{{2}}(?s:.*?){q}{{3}}" for q in "\"'" if q not in dead), *(x for q, x in STRINGS.items() if q not in dead)]
    quotes = "|".join(OPENS[q] for q in STRINGS if q not in dead)
    return re.compile(
        r"(?P<end>\n)|(?P<comment>(?:\#|//).*)" + (rf"|(?P<string>{'|'.join(strings)})|(?P<open>{quotes})" if quotes else "") + r"""|(?P<op>:=|=>|==|!=|<=|>=|->|=|:|\+|[,;(){}\[\]])|(?P<name>[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*)|(?P<bare>[^\s"'`,;(){}\[\]=:+\#]+)""",
        re.A,
    )


LEXERS = {frozenset(c): lexer(frozenset(c)) for n in range(4) for c in itertools.combinations("\"'`", n)}
WHOLE = frozenset()
BARE = re.compile(r"[^\s\"'`,;(){}\[\]#]+")
REFERENCE, REFERRING = re.compile(r"\$(?:\{(\w+)\}|(\w+))", re.A), re.compile(r"[^\s\"'`,;()\[\]#]+")
SIGN, INDENT = re.compile(r"[^\S\n]*(?::=|=>|=(?!=)|:)"), re.compile(r"[ -]*")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)[^<>]*>\s*([^<>\s](?:[^<>]*[^<>\s])?)\s*</\1>")
#: What follows the sign of a block scalar, and a private key in armour.
SCALAR = re.compile(r"[ \t]*[|>][+-]?\d?[+-]?[ \t]*(?:#.*)?\n")
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----((?s:.*?))-----END \1-----")
#: Calls whose argument is a name, and not the value.
LOOKUP = re.compile(r"(?i)(?:getenv|environ|env|get|getproperty|lookup|input|getpass|prompt|open)$")
#: Characters at both ends of a value that are kept as they are; bits of its size, beyond which its counts are scaled.
ENDS, SIZE_BITS = 64, 40
#: What may stand directly before a quote.
PREFIX = re.compile(r"[bBrRuUfF]{1,2}")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def weight(name: str) -> float:
    """How sensitive a target name is: the heaviest of its words, alone or two together; 0 if it is about a secret only."""
    words = [w.lower() for w in CAMEL.findall(name)]
    if not words or words[-1] in ABOUT or any(b in ("key", "keys") and a in PLAIN_KEYS for a, b in zip(words, words[1:])):
        return 0.0
    return max(SENSITIVE.get(w, 0.0) for w in [*words, *map("".join, zip(words, words[1:]))])


def wordy(text: str) -> float:
    """Share of the letters that belong to words: three or more that can be spoken."""
    parts = [p for p in CAMEL.findall(text) if not p.isdigit()]
    said = [p for p in parts if len(p) > 2 and re.search(r"(?i)[aeiouy]", p) and not re.search(r"(?i)[^aeiouy]{5}|[aeiouy]{4}", p)]
    return sum(map(len, said)) / max(1, sum(map(len, parts)))


class Value:
    """A literal, or several one after the other: counts of characters, both ends, and the parts that spans come from."""

    made = itertools.count()

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, parts: list["Value"] | None = None):
        self.parts, self.span, self.order = parts or [], span, next(Value.made)  # parts come before what they are in
        self.counts, self.size = Counter(text), len(text) + sum(p.size for p in self.parts)
        for p in self.parts:
            self.counts.update(p.counts)
        if (over := self.size.bit_length() - SIZE_BITS) > 0:
            self.counts = Counter({c: max(1, n >> over) for c, n in self.counts.items()})
            self.size = self.counts.total()
        self.head = (text + "".join(p.head for p in self.parts))[:ENDS] if len(self.parts) < 2 else self.joined(self.parts)
        self.tail = text[-ENDS:] if not self.parts else self.joined(self.parts[::-1], tail=True)

    @staticmethod
    def joined(parts: list["Value"], tail: bool = False) -> str:
        out = ""
        for p in parts:
            out = (p.tail + out)[-ENDS:] if tail else (out + p.head)[:ENDS]
            if len(out) == ENDS:
                break
        return out

    def shown(self) -> str:
        """The text, or its ends and each character of the middle once: the same to PLACEHOLDER."""
        if self.size <= ENDS:
            return self.head
        if self.size <= 2 * ENDS:
            return self.head + self.tail[2 * ENDS - self.size :]
        return self.head + "".join(self.counts - Counter(self.head) - Counter(self.tail)) + self.tail


def randomness(value: Value, certain: bool = True) -> float:
    """0 to 1: entropy of the characters and the classes they come from; less for words where the name isn't `certain`."""
    n, shown = value.size, value.shown()
    if n < SHORTEST or PLACEHOLDER.match(shown) or " " in shown.strip() and n < 12:
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in value.counts.values())
    kinds = "".join(value.counts)
    classes = sum(bool(re.search(p, kinds)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z\d\s]"))
    found = min(1.0, bits / 4) * (0.4 + 0.2 * classes if classes < 4 else 1.0)
    return found if certain else found * (1 - WORDS_LOSE * wordy(shown))


def located(scores: dict[int, tuple[Value, float]]) -> dict[tuple[int, int], float]:
    """Span -> the best score of the values that it is a part of, from {order: (value, score)}; each part is seen once."""
    out: dict[tuple[int, int], float] = {}
    todo = [-k for k in scores]
    heapq.heapify(todo)
    while todo:
        v, score = scores[-heapq.heappop(todo)]
        if v.span:
            out[v.span] = max(score, out.get(v.span, 0.0))
        for p in v.parts:
            if p.order not in scores:
                heapq.heappush(todo, -p.order)
            scores[p.order] = p, max(score, scores.get(p.order, (p, 0.0))[1])
    return out


def resolved(text: str, at: int, known: dict[str, Value]) -> Value:
    """The literal `text` that starts at `at`, with the constants that it refers to by $NAME or ${NAME}."""
    parts, last = [], 0
    for m in REFERENCE.finditer(text) if "$" in text else ():
        if (v := known.get(m[1] or m[2])) is not None:
            parts += [Value(text[last : m.start()], (at + last, at + m.start()))] * (m.start() > last) + [v]
            last = m.end()
    if not parts:
        return Value(text, (at, at + len(text)))
    return Value(parts=parts + [Value(text[last:], (at + last, at + len(text)))] * (last < len(text)))


def block(text: str, start: int, at: int) -> Value | None:
    """The lines from `at` on that are deeper than the line at `start`, or empty."""
    depth, parts = INDENT.match(text, start).end() - start, []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip():
            deep = len(line) - len(line.lstrip())
            if deep <= depth:
                break
            parts.append(Value(line.strip(), (at + deep, at + len(line.rstrip()))))
        at = end + 1
    return Value(parts=parts) if parts else None


def alone(text: str, line: int, at: int) -> Value | None:
    """A bare value that has its line to itself, at `at`, in a line that is deeper than the one at `line`."""
    m = BARE.match(text, at)
    start = text.rfind("\n", 0, at) + 1
    if not m or text[m.end() : m.end() + 1] not in ("", "\n", "\r") or re.search(r"(?<!=)=[^=]|:$", m.group()):
        return None
    return Value(m.group(), m.span()) if at - start > INDENT.match(text, line).end() - line else None


def values(text: str, line: int, at: int, known: dict[str, Value], dead: frozenset[str] = WHOLE) -> tuple[list[Value], int]:
    """(values after the sign that ends at `at`, in the line that starts at `line`; where they end)."""
    if m := SCALAR.match(text, at):
        return [v] if (v := block(text, line, m.end())) else [], m.end()
    found, parts, depth, more, fresh_line, last = [], [], 0, False, False, at
    skip = []  # depths of calls that look something up by a name
    while m := LEXERS[dead].search(text, at):
        kind, t, a, b = m.lastgroup, m.group(), m.start(), m.end()
        at = b
        if kind == "open":
            dead = dead | {t}
            continue
        if kind == "end":
            dead = WHOLE
            if depth == 0 and not more and (parts or found or fresh_line and text[last:a].strip()):
                break
            fresh_line = True
            continue
        if kind == "comment":
            continue
        if depth == 0 and fresh_line and not more and kind != "string":
            if not parts and not found and kind in ("name", "bare") and (v := alone(text, line, a)):
                parts, last = [v], v.span[1]
            break
        if depth and kind in ("name", "string") and SIGN.match(text, b):
            break  # an argument or key with a value of its own
        if kind == "string":
            k = 3 if len(t) >= 6 and t[:3] in ('"""', "'''") else 1
            if depth == 0 and fresh_line and not more and SIGN.match(text, b):
                break  # a name of its own
            if not skip:
                parts.append(Value(t[k:-k], (a + k, b - k)) if t[0] == "'" else resolved(t[k:-k], a + k, known))
            more = False
        elif kind == "name" and PREFIX.fullmatch(t) and text[b : b + 1] in ('"', "'"):
            pass
        elif t in ("(", "["):
            depth, more = depth + 1, False
        elif t in (")", "]"):
            if not depth:
                break
            depth -= 1
            while skip and skip[-1] > depth:
                skip.pop()
        elif t == "," and depth:
            found += [Value(parts=parts)] if parts else []
            parts = []
        elif t == "+":
            more = True
        elif kind == "bare" and t == "\\" and text[b : b + 1] == "\n":
            more = True
        elif kind == "name" and text[b : b + 1] in ("(", "[") and not (parts and not more and not depth):
            if text[b] == "[" or LOOKUP.search(t):
                skip.append(depth + 1)
            more = False
        elif kind == "name" and (v := known.get(t.lstrip("$"))) is not None and text[b : b + 1] not in ("$", "{") and (depth or not parts or more):
            parts += [] if skip else [v]
            more = False
        elif kind in ("name", "bare") and depth == 0 and not parts and (m := (REFERRING if t[0] == "$" else BARE).match(text, a)):
            parts.append(resolved(m.group(), a, known))
            at = last = m.end()
            n = LEXERS[dead].search(text, at)
            if n and n.group() == "+":
                continue
            break
        elif depth == 0 or t in ("{", "}", ";"):
            break
        last = b
    else:
        at = len(text)
    return found + ([Value(parts=parts)] if parts else []), last


def pairs(text: str, at: int, end: int, known: dict[str, Value]) -> Iterator[tuple[str, Value]]:
    """(name, value) for each assignment whose sign is in the line from `at` to `end`."""
    line, before, dead = at, None, WHOLE
    while (m := LEXERS[dead].search(text, at, end)) and m.lastgroup != "end":
        kind, t = m.lastgroup, m.group()
        at = m.end()
        if kind == "open":
            dead = dead | {t}
        if t in ("=", ":", ":=", "=>") and before:
            found, stop = values(text, line, at, known, dead)
            for v in found:
                yield before, v
            if found and stop <= end and not SIGN.match(text, stop):
                at, before = max(at, stop), None
                continue
        before = t.strip("\"'`") if kind in ("name", "string") else None


def base(text: str) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) by the fixed patterns."""
    found = [(0, m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if "=" in text or ":" in text else []
    found += [(1, m.start(), m.end(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(2, m.start(), m.end(), 1.0) for m in HEX.finditer(text)]


def scan_text(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int, float]]:
    """All spans of a text by start, then kind."""
    found = base(text)
    scores: dict[int, tuple[Value, float]] = {}

    def judge(name: str, value: Value) -> None:
        if (w := weight(name)) >= threshold and (score := w * randomness(value, w >= CERTAIN)) >= threshold:
            scores[value.order] = value, max(score, scores.get(value.order, (value, 0.0))[1])

    if "=" in text or ":" in text:
        known: dict[str, Value] = {}
        at = 0
        for line in text.split("\n"):
            if "=" in line or ":" in line:
                for name, value in pairs(text, at, at + len(line), known):
                    judge(name, value)
                    if value.size:
                        known[name.lstrip("$")] = value
            at += len(line) + 1
    for m in ELEMENT.finditer(text) if "</" in text else ():
        judge(m[1], Value(m[2], m.span(2)))
    for m in PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        lines = [Value(x.group(), x.span()) for x in re.compile(r"\S+").finditer(text, m.start(2), m.end(2))]
        judge(m[1], Value(parts=lines))
    starts = sorted((a, b) for _, a, b, _ in found)
    furthest = list(itertools.accumulate((b for _, b in starts), max))
    held = lambda a, b: (i := bisect_right(starts, a, key=lambda x: x[0])) and furthest[i - 1] >= b
    found += [(3, a, b, s) for (a, b), s in located(scores).items() if b > a and not held(a, b)]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def scan(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>> of every whole text."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for k, a, b, s in scan_text(t or "", threshold)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["doc_id", "spans"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact(df: DataFrame, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """The table with every span of its text replaced by `mark` (overlapping spans by one); n_chars follows if it is there."""
    bounded_batches(df.sparkSession)
    names, text_at = df.columns, df.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for _, a, b, _ in scan_text(text, threshold):
            if b > last:
                out += [text[last:a], mark] if a >= last else []
                last = b
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[text_at] = pa.array([clean(t) for t in batch.column(text_at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = df.mapInArrow(run, df.schema)
    return out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in names else out


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

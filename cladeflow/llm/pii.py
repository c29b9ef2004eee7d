"""Personal data in text: plain forms, and disguised forms found by offset-preserving deobfuscation.

Plain forms are matched on the text itself: e-mail addresses, IPv4 addresses, payment cards and phone
numbers, leftmost and without overlaps within a kind. Each pattern is scanned in time linear in the text.

Disguised forms are found on a normalised text that three transducers make in turn: one folds look-alike
characters (compatibility forms, Cyrillic and Greek letters that look Latin, invisible characters), one
turns runs of spelled digits into digits, one turns disguised signs ("[at]", " dot ", "&#64;") into "@" and
".". Each transducer writes, beside its output, the pieces of its input that it rewrote, so a span of the
output is mapped back to code points of the source, through all three. A disguised span is kept where it
covers a rewritten piece and is not inside a plain span of its kind (of an address whose first half is
disguised, the patterns see the rest); plain spans always stay.

A run of spelled digits needs three words or numbers, two of them spelled digits, to be read as a number. All
scans are linear in the text: no window and no cap bounds a local part, a domain or the number of dots.

Defined cases: null and empty texts have no spans; texts are never cut; rows repeat with their spans;
offsets are code points with an exclusive end; spans are ordered by start, then kind, then end.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.session import ship, table, trimmed

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,plain:boolean>>"

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY_DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """A match is a run of local characters up to an "@" that a domain follows; the run begins after the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)  # "@" is no local character: no later run reaches past it
            at = text.find("@", at + 1)
    return out


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the plain forms."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not ANY_DIGIT.search(text):
        return out
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "." in text:
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
                out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


class Rewritten:
    """Output of a transducer and the pieces it rewrote: (begin, end) in the output and in the input."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        out, self.pieces, done, size = [], [], 0, 0
        for a, b, new in edits:
            out += [text[done:a], new]
            size += a - done
            self.pieces.append((size, size + len(new), a, b))
            size += len(new)
            done = b
        out.append(text[done:])
        self.text = "".join(out)
        self.begins = [p[0] for p in self.pieces]

    def touches(self, begin: int, end: int) -> bool:
        """Whether a span of the output holds a rewritten piece, or a part of one."""
        i = bisect_left(self.begins, end) - 1  # the last piece before the end: those before it end sooner
        return i >= 0 and self.pieces[i][1] > begin

    def source(self, begin: int, end: int) -> tuple[int, int]:
        """The span of the input behind a span that is not empty of the output."""
        return self._left(begin), self._right(end)

    def _left(self, at: int) -> int:
        i = bisect_right(self.begins, at) - 1
        if i < 0:
            return at
        lo, hi, a, b = self.pieces[i]
        return a if lo <= at < hi else at - hi + b

    def _right(self, at: int) -> int:
        i = bisect_right(self.begins, at - 1) - 1
        if i < 0:
            return at
        lo, hi, _, b = self.pieces[i]
        return b if at - 1 < hi else at - hi + b


#: Cyrillic and Greek letters that look like the Latin letters below them.
ALIKE = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲυχικα",
    "ABESIJKMHOPCTYXaeijopcyxsdqwhlABEZHIKMNOPTYXovpcuxika",
    strict=True,
))
INVISIBLE = "­​‌‍⁠﻿"
ODD = re.compile("[" + "".join(ALIKE) + INVISIBLE + r"\u00a0\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2000-\u200a\u2010-\u2015\u2024\u202f\u2070-\u2079\u2080-\u2089\u2212\u2460-\u24ff\u3000\u3002\ufe50-\ufe6b\uff01-\uff5e\uffe0-\uffee\U0001d400-\U0001d7ff]")
#: What compatibility folding leaves as it is.
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "。": "."}


def _fold(c: str) -> str:
    if c in ALIKE:
        return ALIKE[c]
    if c in INVISIBLE:
        return ""
    digit = unicodedata.decimal(c, None)
    new = SIGNS.get(c) or (str(digit) if digit is not None else unicodedata.normalize("NFKC", c))
    return new if new.isascii() else c


def fold_alike(text: str) -> Rewritten | None:
    """Look-alike and compatibility characters to ASCII, invisible characters to nothing."""
    edits = [(m.start(), m.end(), new) for m in ODD.finditer(text) if (new := _fold(m[0])) != m[0]]
    return Rewritten(text, edits) if edits else None


#: Digits as spelled in English, French, German and Spanish.
SPELLED = (
    "zero oh zéro null cero", "one un une eins uno", "two deux zwei zwo dos", "three trois drei tres", "four quatre vier cuatro",
    "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve",
)
DIGIT = {w: str(i) for i, words in enumerate(SPELLED) for w in words.split()}
#: Names of signs between spelled digits.
SIGN = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-"}
WORD = "|".join(sorted([*DIGIT, *SIGN, "double", "triple"], key=len, reverse=True))
DIGIT_WORD = "|".join(sorted(DIGIT, key=len, reverse=True))
GAP = r"[ \t,\-/()]++"
#: Words that say how often the next digit stands.
TIMES = {"double": 2, "triple": 3}
#: At least three spelled or written digits or signs in a row; of them two must be spelled digits.
RUN = re.compile(rf"(?<![\w])(?:(?:{WORD})|[0-9]+|\+)(?:{GAP}(?:(?:{WORD})(?!\w)|[0-9]+(?!\w)))" + "{2,}", re.I)
#: Cheap tests before that: a word of these must be there (the others are common words, no run has them alone).
TELLING = frozenset(DIGIT) - {"un", "une", "oh"}
TO_BLANK = str.maketrans(",-/()", "     ")
RUN_GATE = re.compile(rf"(?:{DIGIT_WORD})[ ,\-/()]+(?:{WORD}|[0-9])|[0-9][ ,\-/()]+(?:{DIGIT_WORD})")
PART = re.compile(rf"{WORD}|[0-9]+|\+", re.I)


def spelled_digits(text: str) -> Rewritten | None:
    """Runs of spelled digits to digits; signs spelled between them become signs."""
    low = text.lower()
    if TELLING.isdisjoint(low.translate(TO_BLANK).split()) or not RUN_GATE.search(low):
        return None
    edits = []
    for m in RUN.finditer(text):
        parts = [p[0].lower() for p in PART.finditer(m[0])]
        if sum(p in DIGIT for p in parts) >= 2 and not TELLING.isdisjoint(parts):
            digits = [DIGIT.get(p) or SIGN.get(p) or p for p in parts]
            new = "".join("" if p in TIMES else d * TIMES.get(before, 1) for before, p, d in zip(["", *parts], parts, digits, strict=False))
            edits.append((m.start(), m.end(), new))
    return Rewritten(text, edits) if edits else None


OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
#: A sign takes the blanks around it; none begins inside a run of blanks, so each run is read once.
BEGIN = r"(?<![ \t])[ \t]*+"
AT = rf"(?:{BEGIN}{OPEN}[ \t]*+(?:at|@|arroba)[ \t]*+{CLOSE}[ \t]*+|{BEGIN}&(?:#64|#x40|commat);[ \t]*+|%40|_at_|-at-)"
DOT = rf"(?:{BEGIN}{OPEN}[ \t]*+(?:dot|\.|punkt|punto|point)[ \t]*+{CLOSE}[ \t]*+|{BEGIN}&(?:#46|#x2e|period);[ \t]*+|_dot_|-dot-)"
SPACED_AT = r"(?:(?<![ \t])[ \t]++(?:at|@|arroba)[ \t]++|(?<![ \t])[ \t]++@|@[ \t]++)"
SPACED_DOT = r"(?<![ \t])[ \t]++(?:dot|punkt|punto|\.)[ \t]++"
#: Every sign that an address may be built with, disguised or not, from left to right.
ANY_SIGN = re.compile(rf"(?=[ \t\[({{<&%_@.-])(?:({AT})|({SPACED_AT}|@)|({DOT}|{SPACED_DOT})|\.)", re.I)
PLAIN_DOT, STRONG_AT, SOME_AT, SOME_DOT = 0, 1, 2, 3
LABEL_RUN = re.compile(r"[A-Za-z0-9-]++")
#: Last labels after which an address is believed though only its "at" is spelled, and the dots are plain.
ENDINGS = frozenset("com org net edu gov info io de fr es uk eu".split())
#: Cheap tests on the lower-case text: a bracketed or coded sign or a spelled dot; a blank beside "@"; a
#: spelled "at"; a name with a well-known ending.
SIGN_GATE = re.compile(r"(?:at|dot|[@.]|arroba|punkt|punto|point)[ \t]*+[\])}>]|&(?:#|commat|period)|%40|[_-](?:at|dot)[_-]|[ \t](?:dot|punkt|punto|\.)[ \t]")
SPACED_GATE = re.compile(r"@[ \t]|[ \t]@")
AT_WORD_GATE = re.compile(r"[ \t](?:at|arroba)[ \t]")
WELL_KNOWN_GATE = re.compile(rf"\.(?:{'|'.join(sorted(ENDINGS))})(?![a-z0-9-])")
NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{DOT}|{SPACED_DOT})(?=[0-9])", re.I)


class Signs:
    """Where the signs of a text begin and end, and their kinds."""

    def __init__(self, text: str) -> None:
        self.text, self.begins, self.ends, self.kinds = text, array("q"), array("q"), array("b")
        for m in ANY_SIGN.finditer(text):
            self.begins.append(m.start())
            self.ends.append(m.end())
            self.kinds.append(m.lastindex or PLAIN_DOT)

    def local_begin(self, at: int, done: int) -> int | None:
        """Where the local part before sign `at` begins, not before `done`: local characters, parted by dots of any kind."""
        text, end, i = self.text, self.begins[at], at
        begin = end
        while True:
            piece, lowest = begin, max(done, self.ends[i - 1] if i else 0)
            while begin > lowest and text[begin - 1] in LOCAL_CHARS:
                begin -= 1
            if begin == end:
                return None
            if begin > lowest or not i or self.begins[i - 1] <= done:
                return begin
            kind, before = self.kinds[i - 1], self.begins[i - 1]
            if kind in (STRONG_AT, SOME_AT) or kind == SOME_DOT and (begin == piece or text[before - 1] not in LOCAL_CHARS):
                return begin
            begin, i = before, i - 1

    def domain_end(self, at: int) -> tuple[int, int] | None:
        """(end, number of its last dot) of the domain after sign `at`: labels parted by dots of any kind, at least one dot."""
        text, i, found = self.text, at, None
        while True:
            begin, more = self.ends[i], i + 1 < len(self.begins)
            stop = self.begins[i + 1] if more else len(text)
            m = LABEL_RUN.match(text, begin, stop)
            label = m[0].rstrip("-") if m else ""
            if not label or label[0] == "-":
                return found
            if i > at:
                found = begin + len(label), i
            if begin + len(label) < stop or not more or self.kinds[i + 1] in (STRONG_AT, SOME_AT):
                return found
            i += 1


def disguised_signs(text: str) -> Rewritten | None:
    """Spelled or bracketed "at" and "dot" to signs, where an address or a number is built with them.

    The signs part the text; an address is a sign for "@" with the pieces around it, as far as they hold nothing
    but characters of a name. A piece is looked at once as a local part and once as a domain, so the time
    is linear in the text, whatever the length of an address and the number of its dots.
    """
    low = text.lower()
    edits: list[tuple[int, int, str]] = []
    spelled = SIGN_GATE.search(low) is not None
    at_word = AT_WORD_GATE.search(low) is not None and (spelled or WELL_KNOWN_GATE.search(low) is not None)
    if spelled or at_word or SPACED_GATE.search(low):
        signs, done = Signs(text), 0
        for k, kind in enumerate(signs.kinds):
            at, after_at = signs.begins[k], signs.ends[k]
            if kind not in (STRONG_AT, SOME_AT) or at < done:
                continue
            found = signs.domain_end(k)
            begin = found and signs.local_begin(k, done)
            if begin is None or found is None:
                continue
            end, last = found
            first = bisect_left(signs.begins, begin, 0, k)
            dots = [[(signs.begins[j], signs.ends[j], ".") for j in part if signs.kinds[j] == SOME_DOT] for part in (range(first, k), range(k + 1, last + 1))]
            own = [(at, after_at, "@")] if text[at:after_at] != "@" else []
            known = signs.kinds[last] == PLAIN_DOT and text[signs.ends[last] : end].lower() in ENDINGS
            sure = kind == STRONG_AT or text[at:after_at].strip() == "@" or dots[1] or known
            if (own or dots[0] or dots[1]) and sure:
                edits += [*dots[0], *own, *dots[1]]
                done = end
    if spelled:
        begins = [a for a, _, _ in edits]
        dots = [(x.start(), x.end(), ".") for x in NUMBER_DOT.finditer(text)]
        free = [x for x in dots if (i := bisect_left(begins, x[1])) == 0 or edits[i - 1][1] <= x[0]]
        edits = sorted(edits + free)
    return Rewritten(text, edits) if edits else None


TRANSDUCERS = (fold_alike, spelled_digits, disguised_signs)


def find_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, index of kind, end, plain) in order of start, kind, end."""
    plain = plain_spans(text)
    out = [(a, k, b, True) for a, k, b in plain]
    steps, now = [], text
    for step in TRANSDUCERS:
        if not (step is fold_alike and now.isascii()) and (r := step(now)):
            steps.append(r)
            now = r.text
    if steps:
        ends = [[(x, y) for x, k2, y in plain if k2 == k] for k in range(len(KINDS))]
        for a, k, b in plain_spans(now):
            changed = False
            for r in reversed(steps):
                changed = changed or r.touches(a, b)
                a, b = r.source(a, b)
            i = bisect_right(ends[k], (a, len(text))) - 1
            if changed and not (i >= 0 and b <= ends[k][i][1]):
                out.append((a, k, b, False))
        out.sort()
    return out


def find_pii(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """df with an array of the spans of its whole texts (SPANS)."""
    ship(df.sparkSession)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != spans_col), T.StructField(spans_col, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("plain", T.BooleanType())])))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "plain": p} for s, k, e, p in find_spans(t.as_py() or "")] for t in b.column(at)]
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema) if f.name != spans_col}
            yield pa.record_batch(cols | {spans_col: pa.array(found, kind)})

    return df.mapInArrow(trimmed(run), schema)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of its texts replaced by its kind in angle brackets; spans that overlap become one."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def clean(text: str) -> str:
        out, done = [], 0
        for a, k, b, _ in find_spans(text):
            if a >= done:
                out += [text[done:a], f"<{KINDS[k].upper()}>"]
            done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    def run(batches):
        for b in batches:
            new = pa.array([None if (t := x.as_py()) is None else clean(t) for x in b.column(at)], pa.string())
            yield pa.record_batch([new if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(trimmed(run), df.schema)


def written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: spans of every whole document; counts and hash of the plain ones, all of them written out."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    plain = F.filter("pii", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["plain"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(F.encode(written_out(plain), "UTF-8"), 256).alias("base_sha256"), written_out(F.col("pii")).alias("spans"))

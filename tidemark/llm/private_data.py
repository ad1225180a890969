"""Personal data (operator 8): offset-preserving deobfuscation in front of the identifier patterns.

Chained transducers rewrite a text (homoglyphs, spelled digits, at/dot disguises) and keep for every character of
the result the source interval it came from. Identifiers found in the rewritten text are mapped back to the source.
Rows are independent: one Arrow pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    # A match can only begin where a run of digits does, and ends where one does; the run is not tried again from within.
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A run of what an email's first part may hold is skipped as a whole when no @ follows, so long runs cost once.
_MAIL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_MAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]")

#: Letters that look like ASCII ones, and invisible characters. Full-width and mathematical forms and
#: other digit alphabets follow a rule (see _homoglyph).
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвАЕОРСУХІЈЅКМТВНαοερνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbAEOPCYXIJSKMTBHaoepvikABEZHIKMNOPTYX", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
DASHES = "‐‑‒–—−"
#: Spelled digits.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
#: A run of at least four digit words, perhaps mixed with digits; "plus" may lead it, "dot"/"point" may stand inside.
_SPELLED_RUN = re.compile(
    rf"(?<!\w)(?:plus[\s-]+)?(?:(?:{_WORD}|[0-9]+)(?:[\s,.-]+(?:dot[\s-]+|point[\s-]+)?)){{3,}}(?:{_WORD}|[0-9]+)(?!\w)", re.I
)
_SPELLED_TOKEN = re.compile(rf"(?<!\w)(?:{_WORD}|plus|dot|point)(?!\w)", re.I)
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_WORD})[\s,.-]+(?:{_WORD}|[0-9]+|dot|point)(?!\w)", re.I)
_AT = r"\[\s*(?:at|@)\s*\]|\(\s*(?:at|@)\s*\)|\{\s*(?:at|@)\s*\}|<\s*(?:at|@)\s*>"
_DOT = r"\[\s*(?:dot|\.)\s*\]|\(\s*(?:dot|\.)\s*\)|\{\s*(?:dot|\.)\s*\}|<\s*(?:dot|\.)\s*>"
_BRACKET_HINT = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]", re.I)
_BRACKETED = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
#: Endings that a domain spelled with bare words may have; other words after "dot" are prose.
ENDINGS = "com org net edu gov mil int info biz name io ai app dev co me tv us uk ca au nz ie de fr es it nl be ch at pt pl se no dk fi eu ru cn jp kr in br mx ar cl za"
#: Bare words count only where the whole address is spelled: name at host dot domain. The search starts from each "at".
_ENDING = re.compile("|".join(ENDINGS.split()), re.I)
_BARE_HINT = re.compile(r"\sdot\s", re.I)
_BARE_AT = re.compile(r"(?<!\S)at(?!\S)|@", re.I)
_BARE_DOT = re.compile(r"\s+dot\s+", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
#: Four numbers of up to three digits with written dots between them.
_WRITTEN_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s+dot\s+[0-9]{1,3}){3}(?!\w)", re.I)
_ODD = re.compile("[" + "".join(LOOKALIKES) + INVISIBLE + DASHES + "！-～٠-٩۰-۹①-⑨\U0001d400-\U0001d7ff@＠．。]")


def _homoglyph(ch: str) -> str:
    code = ord(ch)
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if ch in INVISIBLE:
        return ""
    if ch in DASHES:
        return "-"
    if ch == "。":
        return "."
    if 0xFF01 <= code <= 0xFF5E:  # full-width forms stand at a fixed distance
        return chr(code - 0xFEE0)
    if 0x0660 <= code <= 0x0669:
        return str(code - 0x0660)
    if 0x06F0 <= code <= 0x06F9:
        return str(code - 0x06F0)
    if 0x2460 <= code <= 0x2468:  # circled 1 to 9
        return str(code - 0x245F)
    if 0x1D7CE <= code <= 0x1D7FF:  # mathematical digits, five alphabets of ten
        return str((code - 0x1D7CE) % 10)
    if 0x1D400 <= code <= 0x1D6A3:  # mathematical letters, alphabets of 52
        k = (code - 0x1D400) % 52
        return chr(65 + k) if k < 26 else chr(97 + k - 26)
    return ch


class Traced:
    """A rewritten text; character i came from source[start[i]:end[i]]."""

    def __init__(self, text: str, start: list[int], end: list[int]):
        self.text, self.start, self.end = text, start, end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace the intervals of ``edits`` (in order, disjoint); new characters map to the whole replaced interval."""
        out, start, end, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        out.append(self.text[at:])
        return Traced("".join(out), start + self.start[at:], end + self.end[at:])


def deobfuscated(text: str) -> Traced | None:
    """The rewritten text, or None where no transducer changes anything."""
    lower = text.lower() if len(text.lower()) == len(text) else text
    odd = _ODD.search(text) and [m for m in _ODD.finditer(text) if m[0] != "@"]
    if not (odd or _BRACKET_HINT.search(text) or " dot " in lower or "\ndot" in lower or "dot\n" in lower or _SPELLED_HINT.search(text)):
        return None
    n = len(text)
    t = Traced(text, list(range(n)), list(range(1, n + 1)))
    if odd:
        t = t.rewrite([(m.start(), m.end(), _homoglyph(m[0])) for m in odd])
    if _BRACKET_HINT.search(t.text):
        edits = []
        for m in _BRACKETED.finditer(t.text):
            edits.append((_back(t.text, m.start(), edits[-1][1] if edits else 0), _ahead(t.text, m.end()), "@" if m["at"] else "."))
        t = t.rewrite(edits)
    if _BARE_HINT.search(t.text):
        t = t.rewrite(_bare_edits(t.text))
        t = t.rewrite([(x.start(), x.end(), ".") for m in _WRITTEN_IP.finditer(t.text) for x in _BARE_DOT.finditer(t.text, m.start(), m.end())])
    if _SPELLED_HINT.search(t.text):
        t = t.rewrite(_spelled_edits(t.text))
    return None if t.text == text else t


def _back(text: str, at: int, low: int) -> int:
    """Where the white space that ends at ``at`` begins, ``low`` at least."""
    while at > low and text[at - 1].isspace():
        at -= 1
    return at


def _ahead(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _bare_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of addresses in bare words: name words joined by dots, an at, host words joined by written dots, an ending.

    Both sides of an at are walked as far as the next one at most, so the work is linear in the text.
    """
    places = [m.span() for m in _BARE_AT.finditer(text)]
    edits: list[tuple[int, int, str]] = []
    done = 0
    for k, (begin, end) in enumerate(places):
        low = max(done, places[k - 1][1] if k else 0)
        high = places[k + 1][0] if k + 1 < len(places) else len(text)
        left, right = _back(text, begin, low), _ahead(text, end)
        domain, stop = _host_edits(text, right, high)
        if not domain:
            continue
        name, start = _name_edits(text, left, low)
        if start is None:
            continue
        edits += [*name, (left, right, "@"), *domain]
        done = stop
    return edits


def _host_edits(text: str, at: int, high: int) -> tuple[list[tuple[int, int, str]], int]:
    """Edits of the written dots up to the last word that is an ending, and where it ends; none if no word is."""
    edits: list[tuple[int, int, str]] = []
    kept, stop = 0, at
    word = _HOST.match(text, at, high)
    while word:
        dot = _BARE_DOT.match(text, word.end(), high)
        word = _HOST.match(text, dot.end(), high) if dot else None
        if word:
            edits.append((dot.start(), dot.end(), "."))
            after = text[word.end() : word.end() + 1]
            if _ENDING.fullmatch(word[0]) and not (after.isalnum() or after == "_"):
                kept, stop = len(edits), word.end()
    return edits[:kept], stop


def _name_edits(text: str, at: int, low: int) -> tuple[list[tuple[int, int, str]], int | None]:
    """Edits of the written dots of the name that ends at ``at``, and where it begins; None if there is no name."""
    edits: list[tuple[int, int, str]] = []
    kept, start = 0, None
    while True:
        begin = at
        while begin > low and text[begin - 1] in _NAME:
            begin -= 1
        if begin == at:
            break
        before = text[begin - 1 : begin]
        if not (before.isalnum() or before in ("_", ".", "@")):
            kept, start = len(edits), begin
        if before == "." and begin - 1 > low:
            at = begin - 1
            continue
        word = _back(text, begin, low)
        if word == begin or word - 3 <= low or text[word - 3 : word].lower() != "dot" or not text[word - 4].isspace():
            break
        at = _back(text, word - 3, low)
        edits.append((at, begin, "."))
    return edits[:kept][::-1], start


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED_RUN.finditer(text):
        if not re.search(rf"(?<!\w)(?:{_WORD})(?!\w)", run[0], re.I):
            continue
        at = None
        for x in re.finditer(r"\w+", run[0]):
            word = x[0].lower()
            new = SPELLED.get(word) or {"plus": "+", "dot": ".", "point": "."}.get(word)
            a, b = run.start() + x.start(), run.start() + x.end()
            if at is not None and a > at:  # what stands between digit words goes, except a written dot
                gap = text[at:a]
                edits.append((at, a, "." if gap.strip() == "." else ""))
            if new is not None:
                edits.append((a, b, new))
            at = b
    return edits


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The email pattern's leftmost matches. Only a run that is followed by @ can start one, at the run's first character."""
    at = text.find("@")
    done = 0
    while at >= 0:
        rest = _MAIL_REST.match(text, at)
        begin = at
        while begin > done and _MAIL_RUN.match(text[begin - 1]):
            begin -= 1
        if rest and begin < at:
            yield begin, rest.end()
            done = rest.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def identifiers(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind by the base patterns: leftmost, not overlapping; failing matches are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if _DIGITS.search(text):
        if text.count(".") >= 3:
            for m in PATTERNS["ip"].finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found["ip"].append(m.span())
        for m in PATTERNS["card"].finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            for m in PATTERNS["phone"].finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
    return found


def private_spans(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(base spans per kind, all spans in order): the method adds spans that reach beyond every base span of their kind."""
    base = identifiers(text or "")
    spans = [(k, a, b) for k in KINDS for a, b in base[k]]
    traced = deobfuscated(text) if text else None
    if traced is not None:
        for kind, places in identifiers(traced.text).items():
            taken = base[kind]
            k = 0
            for a, b in places:
                source = min(traced.start[a:b]), max(traced.end[a:b])
                while k < len(taken) and taken[k][1] < source[1]:
                    k += 1
                if k == len(taken) or taken[k][0] > source[0]:
                    spans.append((kind, *source))
    return base, sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def private_data(docs: DataFrame) -> DataFrame:
    """doc_id, text_spans, counts and digest of the base spans for every row of ``docs`` (doc_id, text; others ignored).

    Offsets are code points of the source text, end exclusive. A null or empty text has no spans. Repeated rows are
    scanned each for itself; an empty table gives an empty result. Very long texts are scanned whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("base_sha256", "spans", *(f"n_{k}" for k in KINDS))}
            for text in batch.column(1):
                base, spans = private_spans(text.as_py())
                for k in KINDS:
                    rows[f"n_{k}"].append(len(base[k]))
                flat = sorted(((k, a, b) for k in KINDS for a, b in base[k]), key=lambda s: (s[1], KINDS.index(s[0])))
                rows["base_sha256"].append(hashlib.sha256(_joined(flat).encode()).hexdigest())
                rows["spans"].append(_joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[c], kind) for c, kind in columns)], ["doc_id", *(c for c, _ in columns)])

    columns = [*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data(table(spark, sf_dir, "documents"))

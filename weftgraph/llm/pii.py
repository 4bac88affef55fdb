"""Personal data behind disguises, found with offsets of the source.

Two transducers rewrite a text: one character by character (look-alike letters, wide
forms, odd digits and spaces, invisible characters), one token by token (spelled
digits, "at" and "dot" in words or brackets). Each keeps, for every stretch of its
output, the stretch of its input, so spans of identifiers that are detected in the
rewritten text lead back to the source's characters. What the plain text shows by
itself is detected there, and always kept.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm import _common as C

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long"

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters that look like Latin ones.
CYRILLIC = dict(zip("аеорсухіјѕԁһԛԝѵӏґгпАВЕЗКМНОРСТХІЈЅУҮԌԚԜ", "aeopcyxijsdhqwvlrrnABE3KMHOPCTXIJSYYGQW"))
GREEK = dict(zip("οανικρυγτωϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "oavikpuytwcjABEZHIKMNOPTYXC"))
PHONETIC = dict(zip("ɑɡɩɪʏɴʀʟʜʙ", "agiiynrlhb"))
ARMENIAN = dict(zip("օսհոցզյՍՕ", "ouhngqjUO"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᎻᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEHKLMPSTVWZ"))
MARKS = dict(zip("‐‑‒–—―−․。﹒｡﹫", "-------....@"))
LOOK_ALIKES = CYRILLIC | GREEK | PHONETIC | ARMENIAN | CHEROKEE | MARKS
#: Letters and marks of the languages that the Latin script writes, and common quotes: nothing to rewrite.
SUSPECT = re.compile("[^\x00-\x9f\xa1-\xac\xae-ɏ‘’“-„…€]")
INVISIBLE = "­​‌‍⁠﻿"

DIGITS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
}
_WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_AT, _DOT = "(?:at|arroba|arobase|klammeraffe)", "(?:dot|punkt|point|punto)"
_OPEN, _SHUT, _GAP = r"[\[({<]{1,2} ?", r" ?[\])}>]{1,2}", "[ _-]{1,2}"
_APART = r"(?: {1,2}\. {1,2}(?=(?-i:[a-z0-9])))"
_DOTTED = rf"(?:{_GAP}{_DOT}{_GAP}| {{0,2}}{_OPEN}(?:{_DOT}|\.){_SHUT} {{0,2}}|{_APART})"
TOKENS = re.compile(
    rf"(?P<at> {{0,2}}{_OPEN}(?:{_AT}|@){_SHUT} {{0,2}})"
    rf"|(?P<apart> {{1,2}}@ {{1,2}}(?=[A-Za-z0-9-]{{1,63}}(?:{_DOTTED}|\.)[A-Za-z0-9]))"
    rf"|(?P<dot>{_DOTTED}(?=[A-Za-z0-9]))"
    rf"|(?P<bare>{_GAP}{_AT}{_GAP}(?=[A-Za-z0-9-]{{1,63}}(?:{_DOTTED}|(?P<plain>\.)[A-Za-z])))"
    rf"|(?<!\w)(?P<digit>{_WORD})(?!\w)(?P<comma> ?[,;] ?(?={_WORD}(?!\w)))?"
    rf"|(?<!\w)(?P<plus>plus {{1,2}})(?=[0-9]|{_WORD}(?!\w))",
    re.IGNORECASE,
)
#: Without one of these, what TOKENS finds makes no identifier. The text is in lower case, and the words that a pattern starts from are looked for first.
_BETWEEN = r"[ ().,;_\[\]{}<>-]*"
_BRACKETED = re.compile(rf"[\[({{<]{{1,2}} ?(?:{_AT}|{_DOT}|@|\.){_SHUT}")
_SPACED = re.compile(r"@ {1,2}[a-z0-9-]| \. {1,2}[a-z0-9]")
_LOOSE_IP = re.compile(r"[0-9] {1,2}\. {1,2}[0-9]")
_HINTS = [
    (frozenset(w.encode() for w in re.findall(r"\w+", _AT)), re.compile(rf"{_AT}{_GAP}[a-z0-9-]{{1,63}}(?:\.[a-z]|{_GAP}{_DOT}| {{1,2}}\. )")),
    (frozenset(w.encode() for w in re.findall(r"\w+", _DOT)), re.compile(rf"[ _-]{_DOT}{_GAP}[a-z0-9]")),
    (frozenset(w.encode() for w in DIGITS if w.isascii()), re.compile(rf"{_WORD}{_BETWEEN}(?:{_WORD}(?!\w)|[0-9]|{_DOT})|(?:[0-9+]|plus|{_DOT}){_BETWEEN}{_WORD}(?!\w)")),
    (frozenset([b"plus"]), re.compile(r"plus {1,2}[0-9]")),
]
_LETTERS = bytes(i if i < 128 and chr(i).isalnum() else 32 for i in range(256))
#: Letters that patterns take for i and s where case does not count, though they are not their lower case.
_ODD_CASES = (("ı", "i"), ("ſ", "s"), ("\u0307", ""))


def _lower(text: str) -> str:
    low = text.lower()
    if not low.isascii():
        for odd, plain in _ODD_CASES:
            low = low.replace(odd, plain)
    return low


def _hinted(text: str) -> bool:
    low = _lower(text)
    if any(c in low for c in "[({<") and _BRACKETED.search(low):
        return True
    if " . " in low and ("@" in low or _LOOSE_IP.search(low)) or "@" in low and _SPACED.search(low):
        return True
    if not low.isascii() and ("fünf" in low or "zéro" in low):
        return True
    words = low.encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    return any(not known.isdisjoint(words) and pattern.search(low) for known, pattern in _HINTS)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and not overlapping; matches that fail their check are dropped. Linear in the text."""
    emails, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            floor = max(last, text.rfind("@", last, m.start()) + 1)
            start = floor + len(text[floor : m.start()].rstrip(LOCAL))
            if start < m.start():
                emails.append((start, last := m.end()))
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and _luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return dict(zip(KINDS, (emails, ips, cards, phones)))


class Rewritten:
    """The output of a transducer: stretches (text, start, end in the input, whether it was rewritten)."""

    def __init__(self, stretches):
        self.stretches = [s for s in stretches if s[0]]
        self.at = [0]
        for s in self.stretches:
            self.at.append(self.at[-1] + len(s[0]))
        self.text = "".join(s[0] for s in self.stretches)

    def back(self, start: int, end: int) -> tuple[int, int, int]:
        """(start, end in the input, number of stretches rewritten or dropped) for a span of the output."""
        i, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        first, last = self.stretches[i], self.stretches[j]
        begin = first[1] if first[3] else first[1] + start - self.at[i]
        stop = last[2] if last[3] else last[1] + end - self.at[j]
        dropped = sum(a[2] != b[1] for a, b in zip(self.stretches[i:j], self.stretches[i + 1 : j + 1]))
        return begin, stop, dropped + sum(s[3] for s in self.stretches[i : j + 1])


def _character(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c.isspace():
        return " "
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)  # wide, mathematical, circled, raised and lowered forms
    return plain if len(plain) == 1 and plain.isascii() else c


def characters(text: str) -> Rewritten | None:
    """Look-alike, wide and invisible characters made plain; None where there are none."""
    if text.isascii() or not SUSPECT.search(text):
        return None
    out, done, changed = [], 0, False
    for m in SUSPECT.finditer(text):
        if (plain := _character(m[0])) != m[0]:
            changed = True
            out += [(text[done : m.start()], done, m.start(), False), (plain, m.start(), m.end(), True)]
            done = m.end()
    return Rewritten([*out, (text[done:], done, len(text), False)]) if changed else None


def _named(text: str, end: int) -> bool:
    """Whether the word before ``end`` looks like an account rather than like a word of prose."""
    word = text[max(0, end - 64) : end]
    word = word[len(word.rstrip(LOCAL)) :].strip("._-")
    return any(c in "._%+-0123456789" for c in word)


def tokens(text: str) -> Rewritten | None:
    """Spelled digits, "at" and "dot" made plain; None where there are none."""
    if not _hinted(text):
        return None
    out, done = [], 0
    for m in TOKENS.finditer(text):
        kind = m.lastgroup if m.lastgroup != "plain" else "bare"
        if m["bare"] is not None and m["plain"] and not _named(text, m.start()):
            continue
        out.append((text[done : m.start()], done, m.start(), False))
        done = m.end()
        if m["digit"] is not None:
            out.append((DIGITS[_lower(m["digit"])], m.start("digit"), m.end("digit"), True))
            if m["comma"]:
                out.append((" ", m.end("digit"), m.end(), False))
        else:
            plain = {"at": "@", "apart": "@", "bare": "@", "dot": ".", "plus": "+"}[kind]
            out.append((plain, m.start(), m.end(), True))
    return Rewritten([*out, (text[done:], done, len(text), False)]) if out else None


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(the spans that the plain text shows, all spans), each by kind, then start.

    A disguised span that overlaps a plain one of its kind counts only if it holds all of
    it and one rewritten stretch more (two for kinds of digits, as a digit word may just follow a number).
    """
    base = detect(text)
    plain = [(kind, *s) for kind in KINDS for s in base[kind]]
    first = characters(text)
    second = tokens(first.text if first else text)
    if not first and not second:
        return plain, plain
    spans = set(plain)
    for kind, found in detect(second.text if second else first.text).items():
        for start, end in found:
            n = 0
            for step in (second, first):
                if step:
                    start, end, more = step.back(start, end)
                    n += more
            met = [s for s in base[kind] if s[0] < end and start < s[1]]
            if n and (start, end) not in met and (not met or n >= 1 + (kind != "email") and all(start <= s[0] and s[1] <= end for s in met)):
                spans.add((kind, start, end))
    return plain, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1:]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans, n_base: a row for each row of docs.

    docs: doc_id, text; other columns are ignored. A null text is an empty one without
    spans (base_sha256 is that of the empty string); a null doc_id stays null; repeated rows
    give repeated results; an empty table gives an empty one. Offsets count code points.
    """

    def run(batches):
        C.let_go()
        for batch in batches:
            ids, texts = C.rows_of(batch, "doc_id", "text")
            found = [find(t or "") for t in texts]
            counts = [pa.array([sum(s[0] == kind for s in spans) for _, spans in found], pa.int64()) for kind in KINDS]
            columns = [pa.array(ids, pa.int64()), *counts, pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([_joined(s) for _, s in found], pa.string()), pa.array([len(b) for b, _ in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_base"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, T.StructType.fromDDL(SCHEMA))


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans, the union by the first one's kind."""
    out, done = [], 0
    for kind, start, end in sorted(find(text)[1], key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` replaced and ``n_chars`` (where there is one) counted anew.

    All other columns stay, also under names that differ in case alone, and so do null texts, whose n_chars is null. A row's result depends on its text alone, so
    repeated rows give repeated results; an empty table gives an empty one.
    """
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else redacted(t) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        if n_at is not None:
            columns[n_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[n_at].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return C.by_batch(docs, lambda: run)

"""Personal data in text, also when it is disguised, as spans of the original text.

Base patterns (email, ip, card, phone) run on the text itself. Then a chain of transducers
undoes disguises: homoglyphs and wide forms, zero-width characters, spelled digits, and at/dot
written as words or in brackets. Each transducer is a list of edits (start, end, replacement); the
composition keeps, for every normalised character, the source span it comes from, so what is
found there is mapped back to code points of the source. Every transducer sees every text, so what
is found does not depend on what else the text holds. A span found that way is added unless a
base span of its kind contains it, so spans of a kind may overlap; redaction makes them one.

Defined cases: null text counts as empty; repeated rows give the same spans; text without personal
data gives zero counts, the digest of the empty string and an empty list; an empty table gives no
rows; other columns are ignored. Texts are read whole, in time that grows with their length: every
pattern starts where a run of its characters does, or is found from a sign inside and read backwards.
"""

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from string import ascii_letters, digits as DIGITS

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows

KINDS = ("email", "ip", "card", "phone")
# The patterns, with a start that no shorter match could have and runs taken whole, which leaves the
# leftmost matches as they are. Addresses are found from their "@", see ``_emails``.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = ascii_letters + DIGITS + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in found.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    digits = _NO_DIGIT.sub("", found)
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return 10 <= len(digits) <= 15


Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost first."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        domain = _DOMAIN.match(text, free) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", free)


def detect(text: str) -> list[Span]:
    """Spans of the base patterns, in order of start, then kind."""
    found = [(start, 0, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        for kind in ("ip", "card") + ("phone",) * ("+" in text):
            place = KINDS.index(kind)
            found += [
                (m.start(), place, m.end()) for m in PATTERNS[kind].finditer(text) if _passes(kind, m.group())
            ]
    return sorted(found)


# Characters that look like an ASCII one; wide forms follow by rule.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M",
    "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a",
    "\ufe6b": "@", "\u2024": ".", "\u3002": ".", "\uff61": ".",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
HOMOGLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_ZEROS = (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
HOMOGLYPHS |= {chr(zero + d): str(d) for zero in _ZEROS for d in range(10)}
HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
# Digits as words in the four languages of the corpora, and other names of zero.
SPELLED = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
} | {"oh": "0", "zwo": "2", "nought": "0"}
# Top-level names after "at" and a plain dot. An explicit "dot", or "@", lets any alphabetic name follow.
TOP_LEVEL = "com|org|net|edu|gov|io|info|biz|co|de|fr|es|uk|eu|example|test"
COUNTRIES = (
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd"
    " cf cg ch ci ck cl cm cn cr cu cv cw cx cy cz dj dk dm do dz ec ee eg er et fi fj fk fm fo ga gd ge gf gg gh gi gl"
    " gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw"
    " ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne"
    " nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si"
    " sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug us uy uz va vc ve vg"
    " vi vn vu wf ws ye yt za zm zw"
).split()
# Of these, words that follow "at one point" in English prose.
_PROSE = set("am as at be by do in is it me my no so to us".split())

_ODD = re.compile("[" + re.escape("".join(HOMOGLYPHS) + HIDDEN) + "]")
_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_WORDS})\b", re.I)
_PLUS = r"(?:\bplus\b[\s-]*|\+\s*)?"
_RUN = re.compile(
    rf"{_PLUS}(?<!\w)(?:(?:{_WORDS})|[0-9]+)(?:[\s,.()-]{{1,3}}(?:(?:{_WORDS})|[0-9]+))+(?!\w)", re.I
)
_BRACKETED = re.compile(
    r"[\[({<]\s*+(?:(?P<at>at|@|arroba|klammeraffe)|dot|\.|punto|punkt|point)\s*+[\])}>]\s*+", re.I
)
_PLUS_SIGN = re.compile(r"plus\b[\s-]*|\+\s*", re.I)
_DOT_WORD = r"\s+(?:dot|punto|punkt|point)\s+"
# An address is found from its "at": the domain follows it, and the name before it is read backwards.
_SPOKEN_AT = re.compile(
    r"(?<=[A-Za-z0-9_%+-])(?:\s+(?:at|(?P<far>arroba|arobase|klammeraffe))\s+|\s*(?P<sign>@)\s*)"
    r"(?!(?:the|a|an|this|that|my|our|your|his|her|its|their)\b)"  # "looked at the dot com boom"
    rf"(?=(?P<domain>[A-Za-z0-9-]+(?:(?:{_DOT_WORD}|\.)[A-Za-z0-9-]+)*(?:"
    r"\s+(?:dot|punto|punkt)\s+(?!(?:the|and|or)\b)[a-z]{2,}"
    rf"|\s+point\s+(?:{TOP_LEVEL}|{'|'.join(c for c in COUNTRIES if c not in _PROSE)}|(?(far)[a-z]{{2,}}|(?!)))"
    # "stopped at home.It was late"
    rf"|\.(?:{TOP_LEVEL}|(?-i:(?![A-Z][a-z]))(?:{'|'.join(COUNTRIES)})|(?(sign)[a-z]{{2,}}|(?(far)[a-z]{{2,}}|(?!))))"
    r")\b))", re.I,
)
_AT_WORD = re.compile(r"at\s(?<=\sat\s)")
_FAR = ("arroba", "arobase", "klammeraffe")
_SPOKEN_NAME, _POINTED_NAME = (
    re.compile(rf"[A-Za-z0-9_%+-]+(?:(?:\.|\s+(?:{dots})\s+)[A-Za-z0-9_%+-]+)*", re.I)
    for dots in ("tod|otnup|tknup", "tod|otnup|tknup|tniop")
)
_POINT = re.compile(r"\spoint\s", re.I)
_SPOKEN_DOT = re.compile(_DOT_WORD, re.I)
_DOT_ALONE = re.compile(r"(?<=\s)(?:dot|punto|punkt|point)(?=\s)", re.I)
_NUMBER_DOT = re.compile(
    rf"(?:(?<=[0-9])|\b(?P<word>{_WORDS}))(?P<dot>{_DOT_WORD})(?=[0-9]|(?:{_WORDS})\b)", re.I
)

Edit = tuple[int, int, str]
_FEWEST_SPELLED = 3


def _look_alikes(text: str) -> list[Edit]:
    if text.isascii():
        return []
    return [(m.start(), m.end(), HOMOGLYPHS.get(m.group(), "")) for m in _ODD.finditer(text)]


_TO_SPACE = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes([32] * 128)
_SPELLED_WORDS = {w.encode() for w in SPELLED if w.isascii()} | {w for w in SPELLED}
_WORD = re.compile(r"[^\W_]+")


def _spelled_run(text: str) -> bool:
    """Whether digit words stand beside numbers, or enough of them follow one another."""
    if text.isascii():
        words = text.encode().lower().translate(_TO_SPACE).split()
    else:
        words = _WORD.findall(text.lower())
    if _SPELLED_WORDS.isdisjoint(words):
        return False
    n, number = 0, False
    for word in words:
        if word in _SPELLED_WORDS:
            n += 1
        elif word.isdigit():
            number = True
        else:
            n, number = 0, False
        if n >= _FEWEST_SPELLED or n and number:
            return True
    return False


def _spelled_digits(text: str) -> list[Edit]:
    """Runs of digit words, as digits side by side; separators of such a run go, its dots stay.

    A run of fewer words beside numbers keeps its separators; it must then hold an identifier.
    """
    edits = []
    if not _spelled_run(text):
        return edits
    for run in _RUN.finditer(text):
        words = list(_SPELLED.finditer(text, run.start(), run.end()))
        if len(words) < _FEWEST_SPELLED:
            edits += _few_digits(run, words)
            continue
        first = run.start()
        if text[first : first + 4].lower() == "plus":
            edits.append((first, first + 4, "+"))
        end = None
        for part in re.finditer(rf"(?:{_WORDS})|[0-9]+|\+|plus", run.group(), re.I):
            at, stop = run.start() + part.start(), run.start() + part.end()
            if end is not None and at > end:
                edits.append((end, at, "." if "." in text[end:at] else ""))
            if part.group().lower() in SPELLED:
                edits.append((at, stop, SPELLED[part.group().lower()]))
            end = stop
    return edits


def _few_digits(run: re.Match, words: list[re.Match]) -> list[Edit]:
    """The words of a run as digits, if an identifier comes of it that holds one of them."""
    if not words or not _DIGIT.search(run.group()):
        return []
    plus = _PLUS_SIGN.match(run.group())
    edits = [(run.start(), run.start() + plus.end(), "+")] if plus else []
    edits += [(w.start(), w.end(), SPELLED[w.group().lower()]) for w in words if w.group().lower() in SPELLED]
    rebuilt = Mapped(run.group())
    rebuilt.apply((a - run.start(), b - run.start(), new) for a, b, new in edits)
    for start, _, end in detect(rebuilt.text):
        a, b = rebuilt.source_span(start, end)
        if any(a <= w.start() - run.start() < b for w in words):
            return edits
    return []


def _dots_between_numbers(text: str) -> list[Edit]:
    if not _DOT_ALONE.search(text):
        return []
    return [(m.start("dot"), m.end("dot"), ".") for m in _NUMBER_DOT.finditer(text)]


def _at_and_dot(text: str) -> list[Edit]:
    """Bracketed signs with the blanks around them, which are read backwards from the bracket."""
    edits, done = [], 0
    if not any(b in text for b in "[({<"):
        return edits
    for m in _BRACKETED.finditer(text):
        start = done + len(text[done : m.start()].rstrip())
        done = m.end()
        edits.append((start, done, "@" if m["at"] else "."))
    return edits


def _spoken_addresses(text: str) -> list[Edit]:
    edits, backwards, done = [], None, 0
    if "@" not in text:
        low = text.lower()
        if not (_AT_WORD.search(low) or any(word in low for word in _FAR)):
            return edits
    for at in _SPOKEN_AT.finditer(text):
        if at.start() < done:
            continue
        backwards = backwards or text[::-1]
        pointed = at["far"] or _POINT.search(at["domain"])  # else "in point bob at mail dot com" grows
        name = (_POINTED_NAME if pointed else _SPOKEN_NAME).match(backwards, len(text) - at.start(), len(text) - done)
        if name is None:
            continue
        for low, high in ((len(text) - name.end(), at.start()), at.span("domain")):
            edits += [(m.start(), m.end(), ".") for m in _SPOKEN_DOT.finditer(text, low, high)]
        if at.group() != "@":
            edits.append((at.start(), at.end(), "@"))
        done = at.end("domain")
    return sorted(edits)


CHAIN: tuple[Callable[[str], list[Edit]], ...] = (
    _look_alikes, _at_and_dot, _spoken_addresses, _dots_between_numbers, _spelled_digits,
)


class Mapped:
    """A text and, for each of its characters, the span of the source it stands for."""

    def __init__(self, source: str):
        self.text = source
        self.starts = np.arange(len(source))
        self.ends = self.starts + 1

    def apply(self, edits: Iterable[Edit]) -> None:
        """Replace non-overlapping spans, given in order."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            if a < at:
                continue
            text += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            at = b
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.starts = np.concatenate([*starts, self.starts[at:]])
            self.ends = np.concatenate([*ends, self.ends[at:]])

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


def _undone(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, spans of the source found after the chain); none of the latter where it changes nothing."""
    base = detect(text)
    mapped = None
    for transducer in CHAIN:
        edits = transducer(mapped.text if mapped else text)
        if edits:
            mapped = mapped or Mapped(text)
            mapped.apply(edits)
    if mapped is None or mapped.text == text:
        return base, []
    spans = []
    for start, kind, end in detect(mapped.text):
        a, b = mapped.source_span(start, end)
        spans.append((a, kind, b))
    return base, spans


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each in order of start, then kind.

    A span of the chain is added unless a base span of its kind contains it: where only part of an
    address is disguised, its base match is shorter than the address.
    """
    base, undone = _undone(text)
    added = set(undone).difference(base)
    if added:
        # Base spans of a kind do not overlap, so only the last one that starts before a span can contain it.
        own = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
        starts = [[a for a, _ in spans] for spans in own]
        for a, kind, b in list(added):
            at = bisect_right(starts[kind], a) - 1
            if at >= 0 and b <= own[kind][at][1]:
                added.discard((a, kind, b))
    return base, sorted([*base, *added])


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def detect_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans."""
    counts = [f"n_{k}" for k in KINDS]
    schema = arrow_schema(
        doc_id=pa.int64(), **dict.fromkeys(counts, pa.int64()), base_sha256=pa.string(), spans=pa.string()
    )

    def rows(batches):
        for batch in batch_rows(batches):
            found = [find_all(t or "") for t in batch.column("text").to_pylist()]
            number = [[sum(k == i for _, k, _ in base) for base, _ in found] for i in range(len(KINDS))]
            digest = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, number), pa.array(digest, pa.string()),
                 pa.array([listed(x) for _, x in found], pa.string())],
                schema=schema,
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = ", ".join(f"{c} long" for c in counts)
    return source.mapInArrow(rows, f"doc_id long, {columns}, base_sha256 string, spans string")


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    merged: list[list[int]] = []
    for start, kind, end in find_all(text)[1]:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([start, kind, end])
    parts, at = [], 0
    for start, kind, end in merged:
        parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; ``n_chars`` of a changed text follows it."""
    names = docs.columns

    def rows(batches):
        for batch in batch_rows(batches):
            at = names.index("text")
            old = batch.column(at).to_pylist()
            new = [t if t is None else redact(t) for t in old]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.column(at).type))
            if "n_chars" in names:
                place = names.index("n_chars")
                n = [c if a == b else len(b) for a, b, c in zip(old, new, batch.column(place).to_pylist())]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(n, batch.column(place).type))
            yield batch

    return docs.mapInArrow(rows, docs.schema)

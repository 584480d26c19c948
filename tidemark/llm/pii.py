"""Personal data, also in disguise: transducers rewrite a text and keep every character's origin.

The base formats are searched in the text as it is.  Then transducers rewrite it: look-alike characters
become the ASCII ones, spelled digits become digits, and disguised @ and dots become the signs.  Each
rewritten character knows the span of the source it stands for, so what the same detectors find in the
rewritten text is reported by offsets of the source.  Such spans are added where they hold a rewritten
character and overlap no base span of their kind.

Most texts hold nothing of the kind; whole batches are first searched for traces of any format or disguise by
linear-time expressions, and only texts with a trace are looked at one by one.

Offsets are code points, ends exclusive.  Null and empty texts have no spans; repeated rows get equal
spans; spans are ordered by kind and start; extra columns don't matter; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

#: The base formats.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a run of digits is tried from its start alone
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Look-alikes of ASCII characters outside the compatibility forms.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k",
    "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".",
    "。": ".", "·": ".", " ": " ", " ": " ", " ": " ",
}
#: Digits as words.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
SIGN_WORDS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-"}
LEAST_DIGITS = 4  # spelled digits in a row that are taken for a number


def _homoglyphs() -> dict[int, str]:
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {zero + d: str(d) for d in range(10)}
    return table


HOMOGLYPHS = _homoglyphs()
_HOMOGLYPH = re.compile("[" + re.escape("".join(map(chr, HOMOGLYPHS))) + "]")
_SPOKEN = {w: str(d) for words in DIGIT_WORDS.values() for d, w in enumerate(words.split())} | SIGN_WORDS
#: Letters that (?i) takes for ASCII ones and lower() doesn't turn into them.
_FOLDED = str.maketrans("\u017f\u0131\u0130\u212a", "siik")
_ONE = "|".join(sorted(_SPOKEN, key=lambda w: (-len(w), w)))
_DIGIT = "|".join(sorted((w for w in _SPOKEN if _SPOKEN[w].isdigit()), key=lambda w: (-len(w), w)))
_TOKEN = re.compile(rf"(?i:{_ONE})")
_HINT = re.compile(rf"\b(?i:{_DIGIT})[\s,-]{{1,3}}(?i:{_ONE})\b")
_SPELLED = re.compile(rf"\b(?:(?i:plus|más)[\s,-]{{1,3}})?(?i:{_DIGIT})(?:[\s,-]{{1,3}}(?i:{_ONE}))+\b")
_AT_BRACKET = r"\s?[\[({<]\s?(?i:at|arroba|chez)\s?[\])}>]\s?"
_DOT_BRACKET = r"\s?[\[({<]\s?(?i:dot|point|punkt|punto)\s?[\])}>]\s?"
_DOT_WORD = r"\s(?i:dot|point|punkt|punto)\s"
_LABEL = r"[A-Za-z0-9-]+"
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:"
    rf"(?P<at1>{_AT_BRACKET}){_LABEL}(?:(?:\.|{_DOT_BRACKET}|{_DOT_WORD}){_LABEL})+"
    rf"|(?P<at2>\s(?i:at|arroba)\s){_LABEL}(?:(?:{_DOT_BRACKET}|{_DOT_WORD}){_LABEL})+"
    rf"|(?P<at3>@){_LABEL}(?:(?:\.|{_DOT_BRACKET}|{_DOT_WORD}){_LABEL})+)"
)
_AT_HINT = re.compile(r"(?i)[\[({<\s](?:dot|point|punkt|punto)[\])}>\s]|[\[({<]\s?(?:at|arroba|chez)\s?[\])}>]")
_ANY_DOT = re.compile(f"{_DOT_BRACKET}|{_DOT_WORD}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ is reached by the whole run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] in LOCAL:
            low -= 1
        found = DOMAIN.match(text, at + 1) if low < at else None
        if found:
            end = found.end()
            yield low, end
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind."""
    out = {"email": list(emails(text)), "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p or "0") < 256 for p in (x.lstrip("0") for x in m.group().split("."))):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


@dataclass
class Aligned:
    """A rewritten text; character i stands for source characters low[i] to high[i]."""

    text: str
    low: array
    high: array
    changed: bytearray

    @classmethod
    def of(cls, text: str) -> Aligned:
        n = len(text)
        return cls(text, array("q", range(n)), array("q", range(1, n + 1)), bytearray(n))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """Replaces spans (ascending, apart from each other) of this text."""
        if not edits:
            return self
        text, low, high, changed, at = [], array("q"), array("q"), bytearray(), 0
        for start, end, new in edits:
            text.append(self.text[at:start])
            low.extend(self.low[at:start])
            high.extend(self.high[at:start])
            changed.extend(self.changed[at:start])
            text.extend(new)
            low.extend(array("q", [self.low[start]]) * len(new))
            high.extend(array("q", [self.high[end - 1]]) * len(new))
            changed.extend(b"\1" * len(new))
            at = end
        text.extend(self.text[at:])
        return Aligned(
            "".join(text), low + self.low[at:], high + self.high[at:], changed + self.changed[at:]
        )


def homoglyphs(a: Aligned) -> Aligned:
    return a.rewrite([(m.start(), m.end(), HOMOGLYPHS[ord(m.group())]) for m in _HOMOGLYPH.finditer(a.text)])


def spelled_digits(a: Aligned) -> Aligned:
    """Runs of digit words: each word becomes its sign, and what stands between them goes."""
    edits = []
    for run in _SPELLED.finditer(a.text):
        words = [(m.start() + run.start(), m.end() + run.start(), _SPOKEN[m.group().translate(_FOLDED).lower()]) for m in _TOKEN.finditer(run.group())]
        if sum(sign.isdigit() for _, _, sign in words) < LEAST_DIGITS:
            continue
        for k, (start, end, sign) in enumerate(words):
            if k:
                edits.append((words[k - 1][1], start, ""))
            edits.append((start, end, sign))
    return a.rewrite(edits)


def signs(a: Aligned) -> Aligned:
    """Disguised @ and dots of what then reads as an address."""
    edits = []
    for m in _DISGUISED.finditer(a.text):
        at = next(m.span(g) for g in ("at1", "at2", "at3") if m.group(g))
        if at[1] - at[0] > 1:
            edits.append((*at, "@"))
        edits += [(d.start(), d.end(), ".") for d in _ANY_DOT.finditer(a.text, at[1], m.end())]
    return a.rewrite(edits)


def added(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans of the source that only the rewritten text shows."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    steps: list[Callable[[Aligned], Aligned]] = []
    if not text.isascii() and _HOMOGLYPH.search(text):
        steps.append(homoglyphs)
    if steps or _HINT.search(text):
        steps.append(spelled_digits)
    if steps or _AT_HINT.search(text):
        steps.append(signs)
    if not steps:
        return out
    a = Aligned.of(text)
    for step in steps:
        a = step(a)
    if a.text == text:
        return out
    for kind, spans in detect(a.text).items():
        for low, high in spans:
            if any(a.changed[low:high]):
                start, end = a.low[low], a.high[high - 1]
                after = bisect_left(base[kind], (end,))  # base spans are ascending and apart from each other
                if not after or base[kind][after - 1][1] <= start:
                    out[kind].append((start, end))
    return out


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans) of each kind, ascending."""
    base = detect(text or "")
    more = added(text or "", base)
    return base, {k: sorted([*base[k], *more[k]]) for k in KINDS}


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def _traces() -> list[str]:
    """RE2 expressions, one of which each text matches that has any span."""
    space = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"  # as Python's \s
    gap = space[:-1] + ",-]{1,3}"
    points = sorted(HOMOGLYPHS)
    return [
        "@",
        r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
        r"[0-9](?:[\x20-]?[0-9]){12}",
        r"\+[0-9]",
        "[" + "".join(f"\\x{{{c:x}}}" for c in points) + "]",
        rf"(?i)(?:{_DIGIT}){gap}(?:{_ONE})",
        "[\u0131\u0130]",  # (?i) doesn't fold these here
        rf"(?i)(?:[\[({{<]|{space})(?:dot|point|punkt|punto)(?:[\])}}>]|{space})",
        rf"(?i)[\[({{<]{space}?(?:at|arroba|chez){space}?[\])}}>]",
    ]


TRACES = _traces()


def suspects(texts: pa.Array) -> list[int]:
    """Rows whose text may have a span."""
    found = None
    for trace in TRACES:
        own = pc.match_substring_regex(texts, trace)
        found = own if found is None else pc.or_(found, own)
    return pc.indices_nonzero(pc.fill_null(found, False)).to_pylist()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        counts = {k: [0] * n for k in KINDS}
        digests, spans = [_NOTHING] * n, [""] * n
        rows = suspects(batch["text"])
        for row, text in zip(rows, batch["text"].take(pa.array(rows, pa.int64())), strict=True):
            base, every = find(text.as_py())
            for kind in KINDS:
                counts[kind][row] = len(base[kind])
            digests[row] = hashlib.sha256(written(base).encode()).hexdigest()
            spans[row] = written(every)
        columns = [*(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=names)


_NOTHING = hashlib.sha256(b"").hexdigest()


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan, RESULT)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

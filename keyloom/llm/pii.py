"""Personal identifiers, found behind disguises and reported at their places in the source text.

Two transducers rewrite a text and keep, for each character they write, the span of source characters it stands for:
the first folds homoglyphs, full-width forms and foreign digits and drops invisible characters; the second turns spelled
digits ("four one five") into digits and at/dot disguises ("jane (at) mail dot example dot com") into @ and full stops.
Identifiers are detected in the result, and their spans are mapped back by composition of the two maps.

Plan: one Arrow pass, no shuffle.  A linear-time scan of each batch (RE2) picks the texts that hold any sign of an identifier; only these
are rewritten.  Every text is scanned whole.

Defined results: null and empty texts hold nothing; rows with a null doc_id report their identifiers with a null doc_id;
repeated rows report each; overlapping finds are settled by kind (in the order of KINDS), then by place, then by length; offsets count
code points; find_identifiers reads only doc_id and text, and mask_identifiers passes all other columns through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import Disjoint, text_slices

_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝвкмнтгАВЕКМНОРСТУХІЈЅοανρικτυχγωΑΒΕΖΗΙΚΜΝΟΡΤΥΧɡıɑ∙․。｡﹒‐‑‒–—−∕⁄",
        "aeopcyxijshdqwbkmhtrABEKMHOPCTYXIJSoavpiktuxywABEZHIKMNOPTYXgia.....------//",
    )
)
_DIGIT_WORDS = {
    w: str(i)
    for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for i, w in enumerate(words.split())
} | {"oh": "0", "o": "0"}
_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD}|\d)(?:[\s,.\-]{{1,3}}(?:{_WORD}|\d)(?!\w))+", re.I)
_ELEMENT = re.compile(rf"{_WORD}(?!\w)|\d|[\s,.\-]+", re.I)
_DOT_WORD = "(?:dot|punkt|punto|point)"
_DOT = rf"(?:(?<!\s)\s*[\[({{<]\s*{_DOT_WORD}\s*[\])}}>]\s*|(?<!\s)\s+{_DOT_WORD}\s+|\.)"
_AT = re.compile(r"(?<!\s)(?:\s*[\[({<]\s*(?:at|arroba|chez)\s*[\])}>]\s*|\s+(?:at|arroba)\s+|\s*@\s*)", re.I)
_HOST = re.compile(rf"[\w\-]+(?:{_DOT}[\w\-]+)*?{_DOT}[a-z]{{2,}}(?![\w\-])(?:{_DOT}[a-z]{{2,}}(?![\w\-]))*", re.I)
_ATOM = re.compile(r"[\w+%\-]")
_DOT_WORDS = frozenset(_DOT_WORD.strip("(?:)").split("|"))
_OPEN, _CLOSE = "[({<", "])}>"
_DOTS = re.compile(_DOT, re.I)
_HAS_DOT_WORD = re.compile(_DOT_WORD, re.I)
_UNUSUAL = re.compile("[^\x00-¬®-ɏ]|[ı²³¹]")
_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}"
#: for RE2, whose \s is narrower and whose (?i) knows neither the dotted capital nor the dotless small i: all that can lead to a find
_SIGNS = "|".join(
    (
        r"[0-9@\x{ad}\x{b2}\x{b3}\x{b9}\x{130}\x{131}\x{17f}\x{250}-\x{10ffff}]|AKIA|gh[pousr]_|sk-|eyJ|(?:[0-9A-Fa-f]{1,4}:){7}",
        rf"(?i:token|secret|password|passwd|api[_-]?key)[\"']?[{_SPACE}]*[=:]",
        rf"[\[({{<][{_SPACE}]*(?i:at|arroba|chez)[{_SPACE}]*[\])}}>]",
        rf"\b(?i:{_DOT_WORD})\b|[{_SPACE}](?i:at|arroba)[{_SPACE}]+[^{_SPACE}]*(?i:{_DOT_WORD})",
        rf"(?:\b(?i:{_WORD})\b[{_SPACE},.\-]{{1,3}}){{2}}\b(?i:{_WORD})\b",
    )
)


class Mapped:
    """A rewritten text and, for each of its characters, the span of source characters that it stands for."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With each (begin, end, replacement) applied; edits are in order and don't overlap."""
        if not edits:
            return self
        n = len(self.text)
        starts = np.arange(n) if self.starts is None else self.starts
        ends = np.arange(1, n + 1) if self.ends is None else self.ends
        pieces, s, e, at = [], [], [], 0
        for a, b, new in [*edits, (n, n, "")]:
            pieces.append(self.text[at:a])
            s.append(starts[at:a])
            e.append(ends[at:a])
            if new:
                pieces.append(new)
                s.append(np.full(len(new), starts[a]))
                e.append(np.full(len(new), ends[b - 1]))
            at = b
        return Mapped("".join(pieces), np.concatenate(s), np.concatenate(e))


def _folded(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() else _LOOKALIKES.get(plain, c)


def fold_characters(m: Mapped) -> Mapped:
    return m.rewritten([(x.start(), x.end(), new) for x in _UNUSUAL.finditer(m.text) if (new := _folded(x.group())) != x.group()])


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED.finditer(text):
        parts = list(_ELEMENT.finditer(run.group()))
        words = sum(p.group()[0].isalpha() for p in parts)
        if words < 3:
            continue
        base, spelled_before = run.start(), False
        for p, following in zip(parts, [*parts[1:], None]):
            piece = p.group()
            if piece[0].isalpha():
                edits.append((base + p.start(), base + p.end(), _DIGIT_WORDS[piece.lower()]))
                spelled_before = True
            elif piece.isdigit():
                spelled_before = False
            elif following is not None and (spelled_before or following.group()[0].isalpha()):
                edits.append((base + p.start(), base + p.end(), "" if piece.isspace() else "-"))
    return edits


def _dot_before(text: str, low: int, end: int) -> int:
    """Where a full stop, plain or disguised, that ends at end begins; -1 if there is none."""

    def blanks(at: int) -> int:
        while at > low and text[at - 1].isspace():
            at -= 1
        return at

    if end > low and text[end - 1] == ".":
        return end - 1
    at = blanks(end)
    closed = at > low and text[at - 1] in _CLOSE
    if not closed and at == end:
        return -1
    word_end = blanks(at - 1) if closed else at
    for word in _DOT_WORDS:
        begin = word_end - len(word)
        if begin >= low and text[begin:word_end].lower() == word:
            at = blanks(begin)
            if not closed:
                return at if at < begin else -1
            return blanks(at - 1) if at > low and text[at - 1] in _OPEN else -1
    return -1


def _local_begin(text: str, low: int, end: int) -> int:
    """Where the name before an at sign at end begins, not before low; -1 if there is none.  Looks at no more than the name and what stands in front of it."""
    begin, at = -1, end
    while at >= 0:
        start = at
        while start > low and _ATOM.match(text[start - 1]):
            start -= 1
        if start == at:
            break
        if start == low or text[start - 1] != ".":
            begin = start
        at = _dot_before(text, low, start)
    return begin


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    done = 0
    dotted = _HAS_DOT_WORD.search(text) is not None
    for at in _AT.finditer(text):
        sign = at.group().strip()
        bare = sign[0] not in "@[({<"
        if bare and not dotted:
            continue
        host = _HOST.match(text, at.end())
        if host is None or bare and not _HAS_DOT_WORD.search(host.group()):
            continue
        begin = _local_begin(text, done, at.start())
        if begin < 0:
            continue
        edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(text, begin, at.start()) if d.group() != "."]
        if at.group() != "@":
            edits.append((at.start(), at.end(), "@"))
        edits += [(host.start() + d.start(), host.start() + d.end(), ".") for d in _DOTS.finditer(host.group()) if d.group() != "."]
        done = host.end()
    return edits


def undisguise(m: Mapped) -> Mapped:
    m = m.rewritten(_spelled_edits(m.text))
    return m.rewritten(_address_edits(m.text))


# detection


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _phone(s: str) -> bool:
    n = len(_digits(s))
    return 7 <= n <= 15 and (s[0] in "+(" or n >= 10 and not s.isdigit() or bool(re.fullmatch(r"\d{10,12}|\d{3}[\s.\-]\d{4}", s)))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind -> (pattern, test). Group "v", where there is one, is the identifier.
KINDS = {
    "email": (re.compile(r"(?<![\w.+%\-])[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}(?![\w\-])"), None),
    "secret": (
        re.compile(r"""(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]+)(?![A-Za-z0-9])|(?i:token|secret|password|passwd|api[_-]?key)["']?\s*[=:]\s*["']?(?P<v>[A-Za-z0-9+/_\-.]{8,}=*)"""),
        None,
    ),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    "ip": (re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)|(?<![\w:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![\w:])"), None),
    "card": (re.compile(r"(?<![\d\-+])\d(?:[ \-]?\d){12,18}(?![\d\-])"), lambda s: s.isdigit() or luhn(_digits(s)) or bool(re.fullmatch(r"\d{4}([ \-]\d{4}){3}", s))),
    "ssn": (re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"), None),
    "phone": (re.compile(r"(?<![\w.+\-])(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{1,5}\)|\d{2,5})(?:[\s.\-/]?\d{2,5}){1,5}(?![\w\-]|\.\d)"), _phone),
}


def identifiers(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, normalised value) of a text's identifiers by place; begin and end count source characters."""
    m = undisguise(fold_characters(Mapped(text)))
    taken = Disjoint()
    for kind, (pattern, test) in KINDS.items():
        for x in pattern.finditer(m.text):
            group = "v" if "v" in pattern.groupindex and x.group("v") is not None else 0
            if test is None or test(x.group(group)):
                taken.add((*x.span(group), kind, x.group(group)))
    return [(kind, *m.source(a, b), value) for a, b, kind, value in taken.rows]


def _suspects(batch: pa.RecordBatch) -> np.ndarray:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(batch.column("text"), _SIGNS), False).to_numpy(zero_copy_only=False))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole, "text"):
            at, found = [], []
            for i in _suspects(batch):
                for x in identifiers(batch.column("text")[i].as_py()):
                    at.append(i)
                    found.append(x)
            kinds, begins, ends, values = zip(*found) if found else ((), (), (), ())
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())], ["doc_id", "kind", "begin", "end", "value"])


def find_identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, begin, end, value): one row for each identifier; value is its undisguised form."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find, "doc_id long, kind string, begin int, end int, value string")


def masked(text: str) -> str:
    pieces, at = [], 0
    for kind, a, b, _ in identifiers(text):
        if a >= at:
            pieces += [text[at:a], f"<{kind.upper()}>"]
            at = b
    return "".join(pieces) + text[at:]


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        suspects = _suspects(batch)
        if len(suspects):
            column = batch.column("text")
            flags = np.zeros(batch.num_rows, bool)
            flags[suspects] = True
            new = pa.array([masked(column[i].as_py()) for i in suspects], column.type)
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pc.replace_with_mask(column, pa.array(flags), new))
        yield batch


def mask_identifiers(docs: DataFrame) -> DataFrame:
    """docs with each identifier in text replaced by its kind, as <EMAIL>, and n_chars, if there, counted anew; all other columns as they are."""
    out = docs.mapInArrow(_mask, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out

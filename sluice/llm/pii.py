"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Kinds with a fixed contract (email, ip, card, phone) keep every span that passes their
own test. Further kinds (iban: mod-97; ssn: valid ranges) are proposed by pattern, confirmed
by validator, and kept if their score reaches ``THRESHOLD``: a prior per kind, raised by
the validator and by context words within ``CONTEXT`` code points before the span, and
lowered by words that speak against it.

Defined results: null or empty text has no spans and zero counts; offsets are code
points, end exclusive; spans of different kinds may overlap; repeated rows are judged each; very long texts are read
whole, about 2 MB of texts (or one text) at a time; an empty table gives no rows. Columns other than the id and
the text are ignored by the query and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.store import table
from sluice.llm.wordbytes import pieces

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
CONTEXT = 48
THRESHOLD = 0.5
MASK = {k: f"[{k.upper()}]" for k in KINDS}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ssn_valid(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


#: prior, words that speak for a kind, words that speak against it
SCORES = {
    "email": (0.9, frozenset({"mail", "email", "contact", "write"}), frozenset()),
    "ip": (0.7, frozenset({"ip", "host", "server", "address"}), frozenset({"version", "release", "section"})),
    "card": (0.8, frozenset({"card", "visa", "mastercard", "payment", "credit"}), frozenset({"isbn", "order", "serial"})),
    "phone": (0.8, frozenset({"phone", "tel", "call", "mobile", "fax"}), frozenset()),
    "iban": (0.8, frozenset({"iban", "bank", "account", "transfer", "konto", "compte", "cuenta"}), frozenset()),
    "ssn": (0.35, frozenset({"ssn", "social", "security"}), frozenset({"order", "part", "invoice", "isbn"})),
}


def score(kind: str, text: str, start: int) -> float:
    prior, good, bad = SCORES[kind]
    near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start])}
    return max(0.0, min(1.0, prior + 0.3 * bool(near & good) - 0.3 * bool(near & bad)))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap: the local part is all that stands directly
    before an ``@``, back to the last match."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            floor = domain.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, as their contract fixes them."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") else "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def more_spans(text: str) -> list[Span]:
    """Confirmed spans of the further kinds."""
    if not _DIGIT.search(text):
        return []
    found = [("iban", m) for m in _IBAN.finditer(text) if mod97(m[0])]
    found += [("ssn", m) for m in _SSN.finditer(text) if ssn_valid(m[0])] if "-" in text else []
    spans = [Span(k, m.start(), m.end(), score(k, text, m.start())) for k, m in found]
    return [s for s in spans if s.score >= THRESHOLD]


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind as listed."""
    rank = {k: i for i, k in enumerate(KINDS)}
    base = sorted((Span(k, a, b, score(k, text, a)) for k, a, b in base_spans(text)), key=lambda s: (s.start, rank[s.kind]))
    return base, sorted(base + more_spans(text), key=lambda s: (s.start, rank[s.kind]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans are one."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], MASK[s.kind]]
        at = max(at, s.end)
    out.append(text[at:])
    return "".join(out)


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and, of every row, base: a list and spans: a list of (kind, start, end, score)."""
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = [find_spans(t or "") for t in batch.column("text").to_pylist()]
            arrays = [pa.array([[vars(s) for s in g[k]] for g in got], item) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<kind:string,start:long,end:long,score:double>>"
    return rows.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in its text replaced; all rows and columns stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts = [t if t is None else masked(t, find_spans(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = {k: [] for k in BASE}
            sha, spans = [], []
            for text in batch.column("text").to_pylist():
                base, every = find_spans(text or "")
                for k in BASE:
                    n[k].append(sum(s.kind == k for s in base))
                sha.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                spans.append(join_spans(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(n[k], pa.int64()) for k in BASE], pa.array(sha), pa.array(spans)], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")

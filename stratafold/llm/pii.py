"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Four base kinds (email, ip, card, phone) are reported whenever their own test passes; their spans are fixed by the
contract of :func:`find`.  The method adds spans of further kinds when their score reaches ``ACCEPT``: ``iban`` (mod-97), ``card_short`` of
13 to 15 digits (Luhn) and ``phone_local`` of ten digits.  A score starts at the kind's ``PRIOR``; words of its ``CONTEXT`` within ``NEAR``
characters raise it by ``RAISE``, words of ``AGAINST`` lower it by ``LOWER``.  So an ``iban`` next to the word "invoice" needs the word "bank" or
"account" beside it, and a ``card_short`` or ``phone_local`` needs a word for it.  Base spans have scores too, but stay whatever the score is.

Patterns run in linear time: a run of digits or of mailbox characters is looked at from its start only, with the matches of a scan from every
position (see the tests).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

ACCEPT, NEAR, RAISE, LOWER = 0.5, 48, 0.3, 0.3
EMAIL_HEAD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts at the first digit of a run, and takes its last run whole.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
LOCAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
#: Scores before context; words that speak for a kind, in the languages the rules serve; words that speak against numbers as personal data.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.7, "card_short": 0.4, "phone_local": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "carte", "karte", "kreditkarte", "tarjeta"),
    "card_short": ("card", "visa", "credit", "carte", "karte", "kreditkarte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "telefonnummer", "teléfono", "téléphone"),
    "phone_local": ("phone", "call", "tel", "mobile", "fax", "telefon", "telefonnummer", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "kontonummer", "compte", "cuenta"),
}
AGAINST = {k: ("version", "invoice", "order", "isbn", "serial", "part no") for k in ("ip", "card", "phone", "iban", "card_short", "phone_local")}
KINDS = ("email", "ip", "card", "phone", "iban", "card_short", "phone_local")
BASE = KINDS[:4]
_CUT_HEAD, _CUT_TAIL = re.compile(r"^\w+"), re.compile(r"\w+$")


def _words(words: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})s?(?!\w)")


_FOR, _AGAINST = {k: _words(w) for k, w in CONTEXT.items()}, {k: _words(w) for k, w in AGAINST.items()}
_SEPARATORS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def score_of(text: str, start: int, end: int, kind: str) -> float:
    """Score of a span from its kind and the words around it, 0 to 1.  Whole words count (and their plurals), not parts of others."""
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    # A word that the border of the window cuts is none.
    before = _CUT_HEAD.sub("", before) if start > NEAR and text[start - NEAR - 1].isalnum() else before
    after = _CUT_TAIL.sub("", after) if end + NEAR < len(text) and text[end + NEAR].isalnum() else after
    around = f"{before} {after}".lower()
    score = PRIOR[kind] + RAISE * bool(_FOR[kind].search(around)) - LOWER * bool(_AGAINST[kind].search(around) if kind in _AGAINST else 0)
    return min(max(score, 0.0), 1.0)


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost and non-overlapping, sought from each ``@``."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        # To the left no further than the last match or the last "@": neither can be part of this one.
        own = text[max(end, text.rfind("@", 0, at) + 1) : at]
        start = at - len(own) + len(own.rstrip(EMAIL_HEAD))
        tail = EMAIL_TAIL.match(text, at + 1) if start < at else None
        if tail:
            out.append((start, tail.end()))
            end = tail.end()
        at = text.find("@", max(end, at + 1))
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find(text: str) -> dict[str, list[tuple[int, int, float]]]:
    """Accepted spans of each kind as (start, end, score), in code points.

    Base kinds: leftmost non-overlapping matches, those that fail their test are dropped and not tried anew."""
    out: dict[str, list[tuple[int, int, float]]] = {k: [] for k in KINDS}

    def add(kind: str, start: int, end: int) -> None:
        score = score_of(text, start, end, kind)
        if kind in BASE or score >= ACCEPT:
            out[kind].append((start, end, score))

    for a, b in emails(text):
        add("email", a, b)
    for m in IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            add("ip", *m.span())
    for m in CARD.finditer(text):
        digits = m[0].translate(_SEPARATORS) if m.end() - m.start() < 64 else ""  # 19 digits with separators are shorter
        if 13 <= len(digits) <= 19 and luhn(digits):
            add("card" if len(digits) >= 16 else "card_short", *m.span())
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            add("phone", *m.span())
    for m in IBAN.finditer(text):
        compact = m[0].replace(" ", "")
        if len(compact) <= 34 and mod97(compact):
            add("iban", *m.span())
    taken = [s[:2] for s in out["card"] + out["phone"]]
    for m in LOCAL.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            add("phone_local", *m.span())
    return out


def joined(spans: dict[str, list[tuple[int, int, float]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b, _ in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int, float]]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced once."""
    flat = sorted((a, b, k) for k, own in spans.items() for a, b, _ in own)
    out, end = [], 0
    for a, b, k in flat:
        if a >= end:
            out += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, whatever its id: the id, counts of the base kinds, ``base_sha256``, ``spans``, ``scores`` (of the spans, in
    their order, two decimals), and the ``redacted`` text.

    A null text counts as empty and stays null.  Further columns do not matter.  An empty table gives no rows."""

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: list[list[int]] = [[] for _ in BASE]
        digests, spans, scores, texts = [], [], [], []
        for text in batch["text"].to_pylist():
            found = find(text or "")
            for c, k in zip(counts, BASE, strict=True):
                c.append(len(found[k]))
            digests.append(hashlib.sha256(joined(found, BASE).encode()).hexdigest())
            spans.append(joined(found, KINDS))
            scores.append(",".join(f"{s:.2f}" for k in KINDS for _, _, s in found[k]))
            texts.append(None if text is None else redact(text, found) if spans[-1] else text)
        yield pa.RecordBatch.from_arrays(
            [batch["id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), pa.array(scores), pa.array(texts, pa.string())],
            names,
        )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = T._parse_datatype_string("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, redacted string")
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *made])
    names = schema.names
    return map_arrow(source, scan, schema)

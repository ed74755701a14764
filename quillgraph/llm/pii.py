"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, URL schemes, identifier cues) in one pass over a
text; from each anchor a local parser walks to the boundaries of an address or account and validates it. A parser never
looks further than the span it validates, and no position is read twice by the same parser, so a text costs its length.

Base kinds, each leftmost and non-overlapping: email, ip, card, phone. Further kinds: iban (cue IBAN, mod-97 check),
login (a URL that carries a user name, user[:password]@host) and secret (a cue such as token or password, then = or :
and a quoted or bare value of 16 and more characters).

Defined results: a null or empty text has no spans; a null doc_id stays null; repeated rows give repeated rows; other
columns of the input are not read, so they may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "iban", "login", "secret")
BASE = KINDS[:4]
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_iban bigint, n_login bigint, n_secret bigint"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

# Cues before secrets.
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_OCTETS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_NUMBER = re.compile(r"[0-9]+")
_PHONE = re.compile(r"[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\x20:#=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+(?::[A-Za-z0-9._~%!$&'()*+,;=-]*)?@[A-Za-z0-9.-]+[A-Za-z0-9]")
_SECRET = re.compile(r"[\x20\t]{0,3}[=:][\x20\t]{0,3}([\"']?)([A-Za-z0-9+/_.=-]{16,})\1")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    found.add_word("IBAN", ("iban", 4))
    for cue in CUES:
        for word in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(word, ("secret", len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def mod97(account: str) -> bool:
    left = 0
    for c in account[4:] + account[:4]:
        left = (left * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return left == 1


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every span, sorted."""
    out: list[tuple[int, int, int]] = []
    email_from = ip_from = card_from = phone_from = login_from = secret_from = 0
    for last, (what, length) in anchors.iter(text):
        if what == "digit":
            if last >= card_from:
                run = _DIGITS.match(text, last)
                card_from = run.end()
                if run.end() - last >= 14:
                    digits = run.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((last, 2, run.end()))
            if last >= ip_from:
                dotted = _OCTETS.match(text, last)
                if dotted is None:
                    ip_from = _NUMBER.match(text, last).end()
                else:
                    ip_from = dotted.end()
                    parts = (p.lstrip("0") for p in dotted.group().split("."))
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                        out.append((last, 1, dotted.end()))
        elif what == "at":
            domain = _DOMAIN.match(text, last + 1)
            if domain is not None:
                start = last
                while start > email_from and text[start - 1] in _LOCAL:
                    start -= 1
                if start < last:
                    email_from = domain.end()
                    out.append((start, 0, domain.end()))
        elif what == "plus":
            if last >= phone_from and (number := _PHONE.match(text, last + 1)) is not None:
                phone_from = number.end()
                if 10 <= sum(c in "0123456789" for c in number.group()) <= 15:
                    out.append((last, 3, number.end()))
        elif what == "iban":
            account = _IBAN.match(text, last + 1)
            if account is not None and mod97(account[1].replace(" ", "")):
                out.append((account.start(1), 4, account.end(1)))
        elif what == "scheme":
            if last >= login_from and (login := _LOGIN.match(text, last + 1)) is not None:
                login_from = login.end()
                out.append((login.start(), 5, login.end()))
        elif last >= secret_from and (secret := _SECRET.match(text, last + 1)) is not None:
            secret_from = secret.end()
            out.append((secret.start(2), 6, secret.end(2)))
    return sorted(out)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in slices(batches):
        counts, digests, spans = [[] for _ in KINDS], [], []
        for text in batch.column(1).to_pylist():
            found = spans_of(text or "", anchors)
            for kind, column in enumerate(counts):
                column.append(sum(k == kind for _, k, _ in found))
            said = [f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found]
            base = ",".join(x for x, (_, kind, _) in zip(said, found, strict=True) if kind < len(BASE))
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            spans.append(",".join(said))
        numbers = [pa.array(column, pa.int64()) for column in counts]
        yield pa.RecordBatch.from_arrays([batch.column(0), *numbers[:4], pa.array(digests, pa.string()), pa.array(spans, pa.string()), *numbers[4:]], names=NAMES)


def find_pii(documents: DataFrame) -> DataFrame:
    """One row per document: counts by kind, all spans (code points, end exclusive), a digest of the base spans."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_rows, SCHEMA)


def mask_pii(documents: DataFrame) -> DataFrame:
    """documents with every span of text replaced by its kind in angle brackets; overlapping spans become one."""
    at_column = documents.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()

        def masked(text: str | None) -> str | None:
            if text is None:
                return None
            parts, at = [], 0
            for start, kind, end in spans_of(text, anchors):
                if end > at:
                    parts += [text[at:start], f"<{KINDS[kind]}>"] if start >= at else []
                    at = end
            return "".join(parts) + text[at:]

        for batch in slices(batches):
            texts = pa.array([masked(text) for text in batch.column(at_column).to_pylist()], pa.string())
            yield batch.set_column(at_column, "text", texts)

    return documents.mapInArrow(rows, documents.schema)

"""Personal data in whole texts: Aho-Corasick anchors, each expanded by a local parser and validated."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PLACE = re.compile(r"[^\s<>\"'`]*[A-Za-z0-9/_~#=&-]")
_IBAN = re.compile(r"[\s:#.]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Z0-9])")
_SSN = re.compile(r"[\s:#.]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Automaton over the cues; every cue names the parser that its hit starts."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("://", ("url", 3))
    for digit in "0123456789":
        found.add_word(digit, ("digits", 1))
    for cue in ("IBAN", "Iban", "iban"):
        found.add_word(cue, ("iban", len(cue)))
    for cue in ("SSN", "ssn", "Social Security Number", "social security number"):
        found.add_word(cue, ("ssn", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def email_at(text: str, at: int, begin: int) -> tuple[int, int] | None:
    """The address around the at-sign; its local part does not reach before `begin`."""
    start = at
    while start > begin and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def addresses_in(text: str, chain: re.Match) -> Iterator[tuple[int, int]]:
    """Numbers joined by dots hold an address in every four of them."""
    for quad in _QUAD.finditer(text, chain.start(), chain.end()):
        if all(len(part) < 4 or not part[:-3].strip("0") for part in quad.groups()) \
                and all(int(part[-3:]) <= 255 for part in quad.groups()):
            yield quad.span()


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), ordered by kind as in KINDS and then by start."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    email_from = ip_from = card_from = url_from = 0
    for last, (cue, width) in anchors().iter(text):
        at = last - width + 1
        if cue == "digits":
            if at >= ip_from:
                chain = _DOTTED.match(text, at)
                spans["ip"].extend(addresses_in(text, chain))
                ip_from = chain.end()
            if at >= card_from:
                chain = _SPACED.match(text, at)
                card_from = chain.end()
                if card_from - at >= 16:
                    digits = chain[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(chain.span())
        elif cue == "email":
            found = email_at(text, at, email_from)
            if found:
                spans["email"].append(found)
                email_from = found[1]
        elif cue == "phone":
            dial = _DIAL.match(text, at)
            if dial and 8 <= sum(c in "0123456789" for c in dial[0]) <= 15:
                spans["phone"].append(dial.span())
        elif cue == "url" and at >= url_from:
            start = at
            while start > url_from and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            place = _PLACE.match(text, last + 1) if start < at else None
            if place:
                spans["url"].append((start, place.end()))
                url_from = place.end()
        elif cue == "iban":
            code = _IBAN.match(text, last + 1)
            if code and iban_valid(code[1]):
                spans["iban"].append(code.span(1))
        elif cue == "ssn":
            number = _SSN.match(text, last + 1)
            if number and number[1][:3] not in ("000", "666") and number[1][0] != "9":
                spans["ssn"].append(number.span(1))
    return [(kind, a, b) for kind in KINDS for a, b in spans[kind]]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py() or "")]
                 for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id and spans (kind, start, end in code points, end exclusive).

    One automaton pass over the whole text finds at-signs, plus signs, digits, schemes and identifier
    cues; a parser expands each anchor to its boundaries and validates it (address parts, Luhn, number
    of digits, IBAN check digits). Spans of one kind never overlap; kinds may.

    NULL and empty texts have no spans; a NULL doc_id stays NULL; repeated rows each give a row; an
    empty table gives an empty result; other columns are ignored.
    """
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(
        _scan, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def contract(found: DataFrame) -> DataFrame:
    """The digest columns of `op1_pii`."""
    spans = F.col("spans")
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}") for k in BASE_KINDS]
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *count, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(spans).alias("spans"))

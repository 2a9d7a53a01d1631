"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, scheme separators and identifier cues) in one
pass over a text; deterministic local parsers then expand each anchor to its boundaries and validate what they find. A
map-only job without a shuffle: work is linear in the text, and a worker holds one slice of rows at a time.

Base kinds (email, ip, card, phone) are found as a leftmost, non-overlapping search of their patterns finds them; a
match that fails validation is dropped and not retried. Added kinds, kept (but for url) only where they touch no base span:
  url      an address with credentials, scheme://user:password@host
  iban     an account after a cue, valid by its check digits
  account  6 to 17 digits after an account cue
  ssn      ddd-dd-dddd after a cue, in an issued range

Defined results: null or empty texts have no spans; repeated rows give the same spans; an empty table gives an empty
table; other columns pass through, except that one named like an output column is replaced. Offsets count code points,
ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.common import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "iban", "ssn")

#: Cues of identifiers, by the kind of identifier they announce.
CUES = {"account": ("account", "acct", "konto", "compte", "cuenta"), "iban": ("iban",), "ssn": ("ssn", "social security")}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
_GAP = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|#))?\s*[:=#]?\s*", re.I)
_VALUES = {
    "account": re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])"),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor, kind in [("@", "email"), ("+", "phone"), ("://", "url"), *((d, "number") for d in "0123456789")]:
        found.add_word(anchor, (kind, len(anchor)))
    for kind, cues in CUES.items():
        for cue in cues:
            for written in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(written, (kind, len(written)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (2 * d - 9 if d > 4 else 2 * d) if i % 2 else d
    return total % 10 == 0


def _iban(written: str) -> int:
    """Length of the longest valid account number at the start of what was written; 0 if there is none."""
    head = int("".join(str(int(c, 36)) for c in written[:4]))  # two letters and two digits: six digits
    body = n = longest = 0
    for end, c in enumerate(written, 1):
        if c != " ":
            n += 1
            if n > 4:
                value = int(c, 36)
                body = (body * (100 if value > 9 else 10) + value) % 97
            if 15 <= n <= 34 and (body * 1_000_000 + head) % 97 == 1:
                longest = end
    return longest


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All (start, end, kind) of a text, by start, then by kind as listed."""
    base: list[tuple[int, int, str]] = []
    more: list[tuple[int, int, str]] = []
    email_from = ip_from = card_from = phone_from = 0
    for last, (kind, n) in anchors.iter(text):
        at = last - n + 1
        if kind == "number":
            if at >= card_from:
                # The first digit past the last chain of digits starts the next one.
                chain = _CARD.match(text, at)
                card_from = chain.end() if chain else at + 1
                if chain:
                    digits = chain[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        base.append((at, card_from, "card"))
            if at >= ip_from:
                quad = _IP.match(text, at)
                ip_from = quad.end() if quad else _DIGITS.match(text, at).end()
                if quad and all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in quad[0].split("."))):
                    base.append((at, ip_from, "ip"))
        elif kind == "email":
            start = at
            while start > email_from and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                email_from = domain.end()
                base.append((start, email_from, "email"))
        elif kind == "phone":
            number = _PHONE.match(text, at) if at >= phone_from else None
            if number:
                phone_from = number.end()
                if 9 <= sum("0" <= c <= "9" for c in number[0]) <= 15:
                    base.append((at, phone_from, "phone"))
        elif kind == "url":
            start = at
            while start and text[start - 1] in _SCHEME:
                start -= 1
            rest = _USERINFO.match(text, last + 1) if start < at else None
            if rest:
                more.append((start, rest.end(), "url"))
        elif not (at and text[at - 1].isalnum()):
            value = _VALUES[kind].match(text, _GAP.match(text, last + 1).end())
            if value and value.start() > last + 1:
                end = value.start() + _iban(value[0]) if kind == "iban" else value.end()
                if end > value.start():
                    more.append((value.start(), end, kind))
    if more:
        more = [m for m in dict.fromkeys(more) if m[2] == "url" or not any(m[0] < b[1] and b[0] < m[1] for b in base)]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base + more, key=lambda s: (s[0], order[s[2]], s[1]))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the kind it starts with in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find(docs: DataFrame, text: str = "text", spans: str = "spans", clean: str | None = None) -> DataFrame:
    """docs with an array of (start, end, kind); with the redacted text in column `clean`, if one is named."""
    names = [spans] + ([clean] if clean else [])
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in {n.lower() for n in names}])
    fields = [T.StructField(spans, SPANS)] + ([T.StructField(clean, T.StringType())] if clean else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(text).to_pylist()
                found = [spans_of(t, anchors) if t else [] for t in texts]
                more = [pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found], _SPANS)]
                if clean:
                    more.append(pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by placeholders, in the same columns; a null text stays null."""
    found = find(docs, text, "__pii_spans", "__pii_clean")
    return found.select(*[F.col("__pii_clean").alias(c) if c == text else found[c] for c in docs.columns])

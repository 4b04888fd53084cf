"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, digits, plus signs and identifier cues
(`password=`, `AKIA`, ...). From each anchor a deterministic local parser expands to the boundaries of the candidate and
validates it (octet range, Luhn, IBAN check digits, digit counts). Every parser moves left to right, so spans of a kind
never overlap and no text is read more than a constant number of times. Map-only: no shuffle, whatever the skew.

Defined results: null text counts as empty; a row is returned for each input row (repeated rows, null ids included);
columns of the input other than the id and text are ignored by `find` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, pieces

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "iban")
ORDER = {k: i for i, k in enumerate(KINDS)}

#: Cues before a value that is a secret; a separator and the value follow.
CUES = ("password", "passwd", "secret", "api_key", "apikey", "token")
_AUTOMATON = None

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS_DOTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'`|\\^{}]+")
_SECRET = re.compile(r"\s?[:=]\s?[\"']?([A-Za-z0-9_\-+/=.]{6,})")
_AWS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        a.add_word("://", ("scheme", 3))
        for cue in CUES:
            for form in (cue, cue.upper(), cue.capitalize()):
                a.add_word(form, ("cue", len(form)))
        for cue in ("AKIA", "ASIA"):
            a.add_word(cue, ("aws", 4))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The IBAN whose first check digit stands at `at`, if one does."""
    if at < 2 or not (m := _IBAN.match(text, at - 2)) or (at > 2 and text[at - 3].isalnum()):
        return None
    code = m[0].replace(" ", "")
    if not 15 <= len(code) <= 34:
        return None
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return m.span() if int(number) % 97 == 1 else None


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed in KINDS."""
    found: list[tuple[int, int, str]] = []
    end = dict.fromkeys((*KINDS, "digits"), 0)
    for last, (anchor, width) in _automaton().iter(text):
        at = last - width + 1
        if anchor == "digit":
            if at >= end["digits"]:  # the first digit of a run of digits and single dots
                m = _DIGITS_DOTS.match(text, at)
                end["digits"] = m.end()
                groups = m[0].split(".")
                place = at
                for i in range(0, len(groups) - 3, 4):
                    four = groups[i : i + 4]
                    stop = place + sum(map(len, four)) + 3
                    if all(len(g.lstrip("0")) <= 3 and int(g[-3:]) <= 255 for g in four):
                        found.append((place, stop, "ip"))
                    place = stop + 1
            if at >= end["card"]:
                if m := _CARD.match(text, at):
                    end["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((*m.span(), "card"))
                else:
                    end["card"] = at + 1
            if at >= end["iban"] and (s := _iban(text, at)):
                end["iban"] = s[1]
                found.append((*s, "iban"))
        elif anchor == "at":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end["email"] = m.end()
                found.append((start, m.end(), "email"))
        elif anchor == "plus":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                end["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((*m.span(), "phone"))
        elif anchor == "scheme":
            start = at
            while start > end["url"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _URL_REST.match(text, at + 3)):
                stop = at + 3 + len(m[0].rstrip(".,;:!?)]"))
                if stop > at + 3:
                    end["url"] = stop
                    found.append((start, stop, "url"))
        elif at >= end["secret"]:
            m = _SECRET.match(text, at + width) if anchor == "cue" else _AWS.match(text, at)
            if m:
                start, stop = m.span(1) if anchor == "cue" else m.span()
                end["secret"] = stop
                found.append((start, stop, "secret"))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in angle brackets."""
    out, done = [], 0
    for start, stop, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, stop)
    return "".join([*out, text[done:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id (as `doc_id`) and `spans`, an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, T.StructType([rows.schema["doc_id"], T.StructField("spans", SPANS)]))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with the spans of its text column replaced by placeholders; null stays null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            k = batch.schema.get_field_index(text_col)
            texts = [t and redacted(t, spans_of(t)) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return df.mapInArrow(scan, df.schema)


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from the spans of `find`."""

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count_of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count_of(k) for k in BASE]
    return df.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(documents(spark, sf_dir)))


QUERY = ("op8_pii_anchors", query)


def base_sha256(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in BASE).encode()).hexdigest()

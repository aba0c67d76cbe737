"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors of a text: at-signs, dots and plus signs before digits, digits, ``://`` and
identifier cues. From each anchor a small deterministic parser expands to the boundaries of an email, an address or an
account number and validates it. The four base kinds follow fixed rules, each leftmost and without overlap in its kind:

* email: a maximal run of local characters before ``@`` and dotted labels after it
* ip: four dotted digit groups, dropped if a part is over 255
* card: digits with single spaces or hyphens between, kept with 13 to 19 digits that pass the Luhn sum
* phone: ``+`` and digits with spaces, dots, brackets or hyphens between, kept with 9 to 15 digits

Further kinds that the method adds: ``url_login`` (credentials before the host of a URL), ``access_key`` (a cloud key id),
``secret`` (a value after a password or token cue) and ``iban`` (an account number after its cue, with a valid check number).
Cues count in any case. Null text is empty text; offsets are code points, end exclusive; repeated rows and null ids stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import table

# Kinds in the order of their spans, cues that introduce a secret, the prefixes of key ids.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url_login", "access_key", "secret", "iban")
CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
KEY_IDS = ("akia", "asia")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]+@")
KEY_ID = re.compile(r"[A-Z0-9]{20}(?![A-Za-z0-9])")
SECRET = re.compile(r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{8,})")
IBAN = re.compile(r"[\s:#=-]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
DOTTED = re.compile(r"[0-9]\.[0-9]")


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", [f"+{d}" for d in range(10)]), ("0", "0123456789"), (":", ["://"]), ("key", KEY_IDS)):
        for word in words:
            out.add_word(word, (kind, len(word)))
    for cue in CUES:
        out.add_word(cue, ("cue", len(cue)))
    out.add_word("iban", ("iban", 4))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def lowered(text: str) -> str:
    """A-Z in lower case; every character keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes.lower() touches A-Z only


def account(number: str) -> bool:
    """Whether the check number of an IBAN (without spaces) is right."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def find_spans(text: str, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All (kind, start, end), in order of kind and start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    free = dict.fromkeys(BASE + ADDED, 0)  # the first position not yet used by a kind
    for end, (anchor, length) in auto.iter(lowered(text)):
        at = end - length + 1
        if anchor == "@":
            start, low = at, free["email"]
            while start > low and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := HOST.match(text, at)):
                found["email"].append((start, m.end()))
                free["email"] = m.end()
        elif anchor == "0":
            if at >= free["card"] and (m := NUMBER.match(text, at)):
                free["card"] = m.end()
                digits = "".join(c for c in m[0] if c in DIGITS)
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((at, m.end()))
            if at >= free["ip"] and DOTTED.match(text, at):  # the last digit before a dot: expand to its group's start
                start = at
                while start > free["ip"] and text[start - 1] in DIGITS:
                    start -= 1
                if m := QUAD.match(text, start):
                    free["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        found["ip"].append((start, m.end()))
        elif anchor == "+":
            if at >= free["phone"] and (m := PHONE.match(text, at)):
                free["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found["phone"].append((at, m.end()))
        elif anchor == ":":
            if m := LOGIN.match(text, at):
                found["url_login"].append((at + 3, m.end() - 1))
        elif anchor == "key":
            if (at == 0 or not text[at - 1].isalnum()) and (m := KEY_ID.match(text, at)):
                found["access_key"].append((at, m.end()))
        elif anchor == "iban":
            if at >= free["iban"] and (m := IBAN.match(text, end + 1)) and account(m[1].replace(" ", "")):
                found["iban"].append(m.span(1))
                free["iban"] = m.end()
        elif at >= free["secret"] and (m := SECRET.match(text, end + 1)) and any(c in DIGITS for c in m[1]):
            free["secret"] = m.end()
            found["secret"].append(m.span(1))
    return [(k, a, b) for k in BASE + ADDED for a, b in sorted(found[k])]


SCHEMA = "_spans array<struct<kind:string,start:int,end:int>>"


def _spans(n_cols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(x.as_py() or "", auto)] for x in batch.column(n_cols)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(spans, kind)], [*batch.schema.names[:n_cols], "_spans"])

    return run


def personal_data(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``_spans``, an array of (kind, start, end)."""
    base = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"{n} {t}" for n, t in base.dtypes[: len(keep)])
    out = base.mapInArrow(_spans(len(keep)), f"{kinds}, {SCHEMA}")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "_spans")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, BASE), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("_spans")).alias("spans"))

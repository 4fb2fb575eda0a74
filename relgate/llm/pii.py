"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors in a text: at-signs, schemes, digits, plus
signs before digits, and words that announce an identifier. A small parser for each kind
expands an anchor to the left and right as far as its grammar allows, and validates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgate.llm.common import pieces, worker_cache

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("iban", "ssn", "account", "acct", "passport")
SECRET_CUES = ("token", "secret", "password", "api_key", "apikey")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9]++")
GROUPED_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
DIALLED = re.compile(r"[\x20().0-9-]++")
REST_OF_URL = re.compile(r"[^\s<>\"'|]+")
ACCOUNT = re.compile(r"(?:\s*(?:no|nr|number)\b)?[\s.:#=]{0,4}([A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){5,33})")
SECRET = re.compile(r"[\s\"':=]{1,6}([A-Za-z0-9_+/-]{16,})")


def _luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _iban(code: str) -> bool:
    code = code.replace(" ", "").replace("-", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("plus", 2))
    for kind, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, as (kind, start, end) by start and then kind.

    Spans of one kind never overlap; a match that fails its check is passed over as a
    whole. Offsets count code points, and the end is exclusive.
    """
    found: list[tuple[str, int, int]] = []
    past = dict.fromkeys(KINDS, 0)  # where the search of a kind goes on
    for last, (anchor, width) in worker_cache("pii", _automaton).iter(text):
        at = last - width + 1
        if anchor == "digit":
            if at >= past["card"]:
                m = GROUPED_DIGITS.match(text, at)
                past["card"] = m.end()
                if m.end() - at >= 14:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        found.append(("card", at, m.end()))
            if at >= past["ip"]:
                if m := ADDRESS.match(text, at):
                    past["ip"] = m.end()
                    parts = [p.lstrip("0") for p in m.group().split(".")]
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                        found.append(("ip", at, m.end()))
                else:
                    past["ip"] = DIGITS.match(text, at).end()
        elif anchor == "at":
            start = at
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                past["email"] = m.end()
                found.append(("email", start, m.end()))
        elif anchor == "plus":
            m = DIALLED.match(text, at + 2)
            dialled = m.group().rstrip(" ().-") if m else ""
            if at >= past["phone"] and len(dialled) >= 2:
                past["phone"] = at + 2 + len(dialled)
                if 10 <= 1 + sum(map(str.isdigit, dialled)) <= 15:
                    found.append(("phone", at, past["phone"]))
        elif anchor == "scheme":
            m = REST_OF_URL.match(text, last + 1)
            if at >= past["url"] and m and (rest := m.group().rstrip(".,;:!?)")):
                past["url"] = last + 1 + len(rest)
                found.append(("url", at, past["url"]))
        elif at >= past[anchor] and not text[at - 1 : at].isalnum():
            m = (ACCOUNT if anchor == "account" else SECRET).match(text, last + 1)
            if m and (end := _account_end(m)) if anchor == "account" else m and (end := m.end(1)):
                past[anchor] = end
                found.append((anchor, m.start(1), end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _account_end(m: re.Match) -> int:
    """The end of the identifier: a whole valid IBAN, or else its first run with six digits."""
    words = re.split(r"(?<=[\x20-])", m.group(1))
    for n in range(len(words), 0, -1):
        if _iban("".join(words[:n])):
            return m.start(1) + len("".join(words[:n]).rstrip(" -"))
    first = re.match(r"[A-Za-z]{0,3}[0-9]+(?:[\x20-][0-9]+)*", m.group(1))
    return m.start(1) + first.end() if first and sum(map(str.isdigit, first.group())) >= 6 else 0


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become the first's."""
    parts, past = [], 0
    for kind, start, end in spans:
        if start >= past:
            parts += [text[past:start], f"<{kind.upper()}>"]
        past = max(past, end)
    return "".join([*parts, text[past:]])


def find_spans(df: DataFrame, key: str, text: str, redacted: bool = False) -> DataFrame:
    """``key``, ``spans`` and, if asked for, the ``redacted`` text of every row.

    A null text counts as empty and is returned as null; a null key is kept; repeated rows
    are all returned; other columns are dropped, so no name can clash.
    """
    key_type = df.schema[key].dataType
    schema = f"key {key_type.simpleString()}, spans {SPANS}" + ", redacted string" * redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(
            pa.struct(
                [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]
            )
        )
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            found = [find(t) if t else [] for t in texts]
            rows = [
                [{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in spans]
                for t, spans in zip(texts, found)
            ]
            out = [batch.column(0), pa.array(rows, kind_of)]
            names = ["key", "spans"]
            if redacted:
                clean = [redact(t, s) if s else t for t, s in zip(texts, found)]
                out.append(pa.array(clean, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def count_of(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

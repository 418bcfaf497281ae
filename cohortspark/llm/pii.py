"""Personal data (operator 6): patterns propose spans, checksums confirm, context adjusts the score.

``find_pii`` returns one row per document with an array of spans.  Proposals
come from regular expressions; card numbers must pass Luhn and account numbers
(IBAN) mod 97; words near a span (``CONTEXT``) raise or lower its score.  The
four base kinds are kept whatever their score; the further kinds are kept from
``min_score`` on.

Defined results: null and empty text give no spans; repeated rows are
returned as often as they occur; null doc_id is passed through; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import by_text_chars, map_arrow

# Kinds in the order used to break ties at one start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")

# Score before context, and words (lower case) that shift it when they stand within WINDOW characters.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": (("mail", "contact", "write"), ()),
    "ip": (("ip", "address", "host", "server"), ("version", "release")),
    "card": (("card", "visa", "credit", "payment"), ("isbn", "serial")),
    "phone": (("phone", "call", "tel", "mobile", "fax"), ()),
    "iban": (("iban", "account", "bank", "konto"), ("serial",)),
    "ssn": (("ssn", "social", "security"), ("part", "serial", "order")),
}
WINDOW = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    s = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern has no character outside EMAIL_RUN, so each match lies in
    one maximal run around an @; only those runs are searched."""
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@-")
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > 0 and text[lo - 1] in allowed:
            lo -= 1
        hi = EMAIL_RUN.match(text, at).end()
        for m in EMAIL.finditer(text, lo, hi):
            yield m.span()
        at = text.find("@", hi)


def _score(kind: str, low: str, start: int, end: int) -> float:
    near = low[max(0, start - WINDOW):start] + " " + low[end:end + WINDOW]
    up, down = CONTEXT[kind]
    s = BASE_SCORE[kind] + 0.2 * any(w in near for w in up) - 0.3 * any(w in near for w in down)
    return min(1.0, max(0.0, s))


def spans_of(text: str | None, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), code points, end exclusive, by start then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m.group().split(".") if len(p.lstrip("0")) <= 3) \
                and all(len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    extra: list[tuple[str, int, int]] = []
    for m in IBAN.finditer(text):
        s = m.group().replace(" ", "")
        if len(s) <= 34 and mod97(s):
            extra.append(("iban", *m.span()))
    extra += [("ssn", *m.span()) for m in SSN.finditer(text)]
    if not found and not extra:
        return []
    low = text.lower() if len(text.lower()) == len(text) else text
    out = [(k, a, b, _score(k, low, a, b)) for k, a, b in found]
    out += [x for x in ((k, a, b, _score(k, low, a, b)) for k, a, b in extra) if x[3] >= min_score]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_pii(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, spans)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("score", pa.float64())]))

    def scan(batches):
        for b in by_text_chars(batches, 8_000_000):
            rows = [[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in spans_of(t, min_score)]
                    for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan,
                     f"doc_id long, spans {SPAN}")


def digest(found: DataFrame) -> DataFrame:
    """Columns of the op6 query from ``find_pii``'s spans."""
    def named(kinds):
        inside = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(inside, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(k):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    base = KINDS[:4]
    return found.select("doc_id", *[count(k) for k in base], F.sha2(named(base), 256).alias("base_sha256"),
                        named(KINDS).alias("spans"),
                        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
                        .alias("max_score"))

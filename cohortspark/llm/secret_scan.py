"""Secret scans (operator 5); DataFrame functions only.

Base patterns (assignments, access keys, long hexadecimal strings) are kept as
they match.  Further spans come from entropy: every run of ``CANDIDATE``
characters is walked by a window of ``window`` characters; the counts of the
window's characters and the sum of c * log2(c) over them are carried along and
change only by the character that enters and the one that leaves.  A run whose
largest window entropy reaches the threshold of its character class is reported
as ``entropy``, unless it lies inside a base span, is an identifier or a path
as a whole (ALLOW_RUN), or the window that scores holds a word that marks
examples (ALLOW_PART).

Defined results: null and empty text give no spans; repeated rows and null
doc_id pass through; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import let, match_spans

# Patterns of the base kinds, in the order that breaks ties.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: class of a run -> its pattern and the entropy in bits from which it is reported, first match decides
CLASSES = (
    ("digits", r"^[0-9_=/+-]+$", 3.25),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("word", r"^[A-Za-z]?[a-z_/-]+$|^[A-Z_/-]+$", 4.1),
    ("letters", r"^[A-Za-z_/-]+$", 4.1),
    ("alnum", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"^[A-Za-z0-9+/=_-]+$", 3.8),
)
ALLOW_PART = r"(?i)example|sample|dummy|placeholder|changeme|abcdefgh|12345678|xxxxxx|lorem"
ALLOW_RUN = (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
             r"|^/?(?:[a-z]{2,}[-_/]){2,}[a-z]{2,}$")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"  # of CANDIDATE


def best_window(run, window: int):
    """struct<bits, at>: largest Shannon entropy (bits) of a window of ``window`` characters in a run at least that
    long, and where the first such window starts."""
    # characters as places in the alphabet; what is not in it shares the last place
    codes = F.transform(F.split(run, "(?!^)(?!$)"), lambda c: (
        F.position(c, F.lit(ALPHABET)) + len(ALPHABET)) % (len(ALPHABET) + 1))

    def bits(c):  # c * log2(c), 0 for no character
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def walk(cs):
        first = F.slice(cs, 1, window)
        counts = F.transform(F.sequence(F.lit(0), F.lit(len(ALPHABET))), lambda k: F.size(F.filter(first, lambda c: c == k)))
        begin = let(counts, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, c: a + bits(c)), lambda t: F.struct(
            t.alias("total"), t.alias("least"), F.lit(0).alias("at"), v.alias("counts"))))

        def step(acc, i):  # from the window that starts at i - 1 to the one that starts at i
            out, new = F.get(cs, i - 1), F.get(cs, i + window - 1)
            was, has = F.get(acc["counts"], out), F.get(acc["counts"], new)
            total = acc["total"] - bits(was) + bits(was - 1) - bits(has) + bits(has + 1)
            counts = F.transform(acc["counts"], lambda v, k: v - (k == out).cast("int") + (k == new).cast("int"))
            moved = F.struct(total.alias("total"), F.least(acc["least"], total).alias("least"),
                             F.when(total < acc["least"], i).otherwise(acc["at"]).alias("at"), counts.alias("counts"))
            return F.when(out == new, acc).otherwise(moved)

        more = F.when(F.size(cs) > window, F.sequence(F.lit(1), F.size(cs) - window)).otherwise(
            F.array().cast("array<int>"))
        best = F.aggregate(more, begin, step)
        return F.struct((F.log2(F.lit(float(window))) - best["least"] / window).alias("bits"), best["at"].alias("at"))

    return let(codes, walk)


def max_entropy(run, window: int):
    """Largest Shannon entropy (bits) of a window of ``window`` characters in a run at least that long."""
    return best_window(run, window)["bits"]


def threshold(run):
    out = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES):
        out = F.when(F.rlike(run, F.lit(pattern)), F.lit(bits)).otherwise(out)
    return out


def find_secrets(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans array<struct<start,rank,end,kind,bits>>, by start then kind.

    start and end in code points, end exclusive; rank is the kind's place in
    KINDS; bits is the entropy of an ``entropy`` span, else null.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    low = F.lower(t)
    spelt = F.lit(False)
    for w in ("passw", "secret", "token", "api"):
        spelt = spelt | F.contains(low, F.lit(w))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

    def hits(gate, regex, keep):
        return F.filter(F.when(gate, match_spans(t, regex)).otherwise(none), keep)

    def kind(name, spans, bits=None):
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(name)).alias("rank"), s["end"].alias("end"),
            F.lit(name).alias("kind"), (bits(s) if bits else F.lit(None).cast("double")).alias("bits")))

    assign = hits(spelt, ASSIGN,
                  lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 1)) >= MIN_ASSIGN)
    access = hits(F.contains(t, F.lit("AKIA")), ACCESS, lambda s: s["end"] - s["start"] >= MIN_ACCESS)
    # maximal runs: asking for the least length right away finds the same spans as dropping shorter ones
    hexes = hits(F.rlike(t, F.lit(HEX[:-1] + f"{{{MIN_HEX}}}")), HEX[:-1] + f"{{{MIN_HEX},}}", lambda s: F.lit(True))
    runs = hits(F.rlike(t, F.lit(CANDIDATE)), CANDIDATE, lambda s: ~F.rlike(s["match"], F.lit(ALLOW_RUN)))
    rows = rows.select("doc_id", F.concat(kind("assign", assign), kind("access", access), kind("hex", hexes)).alias("base"),
                       runs.alias("runs"))
    outside = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))
    def score(r):
        return let(best_window(r["match"], window), lambda e: F.struct(
            r["start"].alias("start"), F.lit(KINDS.index("entropy")).alias("rank"), r["end"].alias("end"),
            F.lit("entropy").alias("kind"), e["bits"].alias("bits"), threshold(r["match"]).alias("limit"),
            F.rlike(F.substring(r["match"], e["at"] + 1, F.lit(window)), F.lit(ALLOW_PART)).alias("allowed")))

    scored = F.transform(outside, score)
    kept = F.transform(F.filter(scored, lambda s: (s["bits"] >= s["limit"]) & ~s["allowed"]), lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["bits"].alias("bits")))
    return rows.select("doc_id", F.array_sort(F.concat("base", kept)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Columns of the op5 query."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(k):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("entropy"))

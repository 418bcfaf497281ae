"""Token counts with overlap resynchronisation for huge documents (operator 8).

Documents up to ``chunk_chars + overlap`` are encoded whole.  Longer ones are
cut into chunks that overlap by ``overlap`` characters; the chunks are spread
over the cluster and encoded with offsets.  Two neighbours are spliced at the
first position in their overlap that is a token boundary in both and proven
stable: an ASCII mark, digit or letter stands before it and a blank or line
feed after it.  No alternative of the byte-level pattern runs from a character
that is no space over one that is, and special strings hold no space, so there
the encoding of the whole text has a boundary whatever surrounds it.  Where an
overlap has no such position, the document is cut again with four times the
overlap, until a chunk reaches the end of the text: a document without any
stable position is encoded in one piece.

Defined results: null and empty text have 0 bytes and 0 tokens; repeated rows
(also with one doc_id) are counted one by one; null doc_id passes through;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import RELEASE, by_text_chars, map_arrow, saved

_TOKENIZERS: dict = {}
_COUNTERS: dict = {}


def _release() -> None:
    _TOKENIZERS.clear()
    _COUNTERS.clear()


RELEASE["token_counts"] = _release


def tokenizer(path: str):
    """One tokenizer per worker process; single-threaded, Spark runs the tasks."""
    if path not in _TOKENIZERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


class PieceCounter:
    """Numbers of tokens of texts of Latin-1 characters by their pieces.

    A byte-level tokenizer cuts a text into pieces and merges inside each piece
    only, so a text has the tokens of its pieces.  The pieces of a batch are cut
    by the pattern that the library documents for this cutter, written out for
    Latin-1 (its letters, digits and spaces do not depend on the version of
    Unicode); each distinct piece is encoded by the library once and its number
    of tokens kept.  Other texts, and texts that may hold a special string, go
    to the library whole.
    """

    # Contractions and character classes of the cutter's pattern.
    LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    SPACES = "\t-\r \u0085\u00a0"
    KEPT = 200_000  # pieces of at most 32 characters: some 30 MB

    def __init__(self, path: str):
        import json
        import re
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.library = tokenizer(path)
        # a piece counted by itself needs the plain byte-level cutter and nothing that looks beyond a piece
        self.applies = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                        and spec["normalizer"] is None and spec["post_processor"] is None
                        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]))
        self.special = [x["content"] for x in spec["added_tokens"]]
        a, d, w = self.LETTERS, self.DIGITS, self.SPACES
        self.cut = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{a}]+| ?[{d}]+| ?[^{w}{a}{d}]+|[{w}]+(?![^{w}])|[{w}]+").findall
        self.beyond = re.compile("[^\x00-\xff]").search
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        plain = [self.applies and self.beyond(t) is None and not any(x in t for x in self.special) for t in texts]
        rest = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        pieces = [self.cut(t) if p else None for t, p in zip(texts, plain)]
        if len(self.known) > self.KEPT:
            self.known.clear()
        known = self.known
        new = list(set().union(*[p for p in pieces if p]).difference(known)) if any(pieces) else []
        fresh = dict(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False))))
        known.update((k, n) for k, n in fresh.items() if len(k) <= 32)
        lookup = known if len(fresh) == 0 else {**fresh, **known} if any(len(k) > 32 for k in fresh) else known
        return [len(next(rest)) if p is None else sum(map(lookup.__getitem__, p)) for p in pieces]


def counter(path: str) -> PieceCounter:
    """One per worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def stable_positions(text: str, lo: int, hi: int) -> list[int]:
    """Positions p in [lo, hi) with a printable ASCII character before and a blank or line feed at p."""
    return [p for p in range(max(lo, 1), min(hi, len(text))) if text[p] in " \n" and "!" <= text[p - 1] <= "~"]


def _whole(docs: DataFrame, path: str) -> DataFrame:
    def count(batches):
        t = counter(path)
        for b in by_text_chars(batches, 1_000_000):
            n = t.counts([x or "" for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    return map_arrow(docs.select("doc_id", "n_bytes", "text"), count, "doc_id long, n_bytes long, n_tokens long",
                     keeps="token_counts")


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """rid, doc_id, n_bytes, k (chunk number), text: chunk k starts at k * chunk."""
    def cut(batches):
        for b in by_text_chars(batches, 8_000_000):
            rows = {n: [] for n in ("rid", "doc_id", "n_bytes", "k", "text")}
            for rid, doc, size, text in zip(*(c.to_pylist() for c in b.columns)):
                k = 0
                while True:
                    end = (k + 1) * chunk + overlap
                    for n, v in zip(rows, (rid, doc, size, k, text[k * chunk:end])):
                        rows[n].append(v)
                    k += 1
                    if end >= len(text):
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.string() if n == "text" else pa.int64()) for n, v in rows.items()], list(rows))

    cut_rows = map_arrow(docs.select("rid", "doc_id", "n_bytes", "text"), cut,
                         "rid long, doc_id long, n_bytes long, k long, text string")
    return cut_rows.repartition("rid", "k")


def _inner(text: str, chunk: int, overlap: int) -> tuple[int, int]:
    """Stable positions around the part of a chunk that lies in no overlap; (len, len) if there are none."""
    lo = next(iter(stable_positions(text, overlap, 2 * overlap)), None)
    hi = next(reversed(stable_positions(text, chunk - overlap, chunk)), None) if len(text) > chunk else None
    return (lo, hi) if lo is not None and hi is not None and lo < hi else (len(text), len(text))


def _encoded(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Per chunk its tokens and, by absolute position, the stable token
    boundaries of its first and last overlap with the tokens before each."""
    def encode(batches):
        t, fast = tokenizer(path), counter(path)
        for b in by_text_chars(batches, 1_000_000):
            ks, texts = b.column(3).to_pylist(), b.column(4).to_pylist()
            out = []
            for k, text in zip(ks, texts):
                # offsets are needed in the overlaps only: between two stable positions the tokens are just counted
                lo, hi = _inner(text, chunk, overlap)
                head, tail = (t.encode(x, add_special_tokens=False).offsets for x in (text[:lo], text[hi:]))
                between = fast.counts([text[lo:hi]])[0] if lo < hi else 0
                starts = np.concatenate(([s for s, _ in head], np.full(between, lo), [hi + s for s, _ in tail])).astype(np.int64)

                def marks(lo, hi):
                    at = [p for p in stable_positions(text, lo, hi)]
                    before = np.searchsorted(starts, at, side="left") if at else []
                    return [{"at": k * chunk + p, "before": int(n)} for p, n in zip(at, before)
                            if n < len(starts) and starts[n] in (p, p + 1)]

                out.append((len(starts), marks(0, overlap), marks(chunk, chunk + overlap)))
            mark = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
            n, head, tail = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(n, pa.int64()), pa.array(head, mark), pa.array(tail, mark)],
                ["rid", "doc_id", "n_bytes", "k", "n", "head", "tail"])

    mark = "array<struct<at:long,before:long>>"
    return map_arrow(chunks, encode,
                     f"rid long, doc_id long, n_bytes long, k long, n long, head {mark}, tail {mark}",
                     keeps="token_counts")


def _spliced(coded: DataFrame) -> DataFrame:
    """rid, doc_id, n_bytes, n_tokens; n_tokens is null if a seam has no common stable boundary."""
    w = Window.partitionBy("rid").orderBy("k")
    seam = coded.withColumn("next", F.lead("head").over(w)).withColumn("last", F.lead("k").over(w).isNull())
    at = F.array_min(F.array_intersect(F.transform("tail", lambda m: m["at"]), F.transform("next", lambda m: m["at"])))
    seam = seam.withColumn("at", at)

    def before(marks):
        return F.get(F.filter(marks, lambda m: m["at"] == F.col("at")), 0)["before"]

    # tokens of this chunk from the splice on, and of the next one up to it, are counted twice
    twice = F.when(F.col("last"), F.lit(0)).otherwise(F.col("n") - before("tail") + before("next"))
    return (seam.withColumn("twice", twice).groupBy("rid")
            .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                 F.when(F.count("twice") == F.count(F.lit(1)), F.sum("n") - F.sum("twice")).alias("n_tokens")))


def count_tokens(docs: DataFrame, path: str, chunk_chars: int = 32768, overlap: int = 512) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_tokens); path: the tokenizer file."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       text.alias("text"))
    limit = chunk_chars + overlap
    small = _whole(base.where(F.octet_length("text") <= limit), path)
    # rid tells repeated rows apart; the huge rows are written with it once, so that it stays
    huge = saved(base.where(F.octet_length("text") > limit).withColumn("rid", F.monotonically_increasing_id()), "huge-texts")
    done = saved(_spliced(_encoded(_chunks(huge, chunk_chars, overlap), path, chunk_chars, overlap)), "token-counts")
    parts = [small, done.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")]
    left = done.where("n_tokens is null")
    while not left.isEmpty():
        overlap *= 4
        again = huge.join(left.select("rid"), "rid", "left_semi")
        done = saved(_spliced(_encoded(_chunks(again, chunk_chars, overlap), path, chunk_chars, overlap)), "token-counts")
        parts.append(done.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
        left = done.where("n_tokens is null")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

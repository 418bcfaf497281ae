"""Substring dedup with a count-min prefilter (operator 11).

A window is ``size`` consecutive words of one text.  A word goes if a window
that covers it stands in a document with a smaller doc_id as well.

1. Anchors: the anchor of a window is the least hash among its ``gram``-word
   grams, so equal windows have equal anchors; consecutive windows with one
   anchor form a segment (at most SEGMENT windows).  A window occurs in no
   more documents than its anchor.
2. Each partition counts the documents per anchor in a count-min sketch with
   counters that stop at two; the sketch is cut into slices, partition
   sketches are merged slice by slice.  A window's estimate is that of its
   anchor: never too small, so no repeated window is lost.
3. Only segments estimated at two or more go on.  The merged sketch has about
   four counters an anchor.  Up to ``broadcast_slices`` slices (16 KB each) it
   is broadcast and the texts are read a second time with it; a larger one
   stays a table: distinct anchors are shuffled to their slice, and the
   segments are joined to the anchors that pass.
4. Exact grouping.  Segments with the same words (hash of all of them) are one
   class: its first document keeps them, all others lose every window.  Only
   where an anchor has several classes are their windows compared one by one,
   once a class, each window by the hash of its words: the least document per
   window decides.  Copies thus collapse before any window is exploded.
5. The spans go back to the texts, whose other words are joined by blanks.

Hot classes (more than one occurrence in HOT) are broadcast, at most HOT of
them; sums and minima per class, window and anchor are combined before the
shuffle.  Equality is that of 64-bit hashes, of the anchor and of the words.

Defined results: null, empty and short texts have no window and keep all
words; windows repeated within one document only stay; rows that repeat a
doc_id are judged one by one and none is earlier than the other; rows with
null doc_id keep everything and are never the earlier document; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import by_text_chars, map_arrow, saved
from cohortspark.llm.shingles import mix
from cohortspark.llm.words import Words, sliding_min

SEGMENT = 64
SLICE_BITS = 16
CELLS = 1 << SLICE_BITS          # two rows of half as many counters
BYTES_A_CELL = 32                # bytes of text per counter: about four counters an anchor
HOT = 4096


def _segments(w: Words, size: int, gram: int):
    """Per text (anchors, starts, ends) of its segments by window number in the batch, plus the hashes of all windows."""
    seq = w.sequence()
    anchor = sliding_min(seq.all_of(gram, 1), size - gram + 1)
    out = []
    for lo, hi in zip(w.offsets[:-1], w.offsets[1:] - size + 1):
        if hi <= lo:
            out.append(None)
            continue
        m = anchor[lo:hi]
        run = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
        length = np.diff(np.concatenate((run, [len(m)])))
        parts = -(-length // SEGMENT)
        first = np.repeat(run, parts) + SEGMENT * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        ends = np.concatenate((first[1:], [len(m)]))
        out.append((m[first], lo + first, lo + ends))
    return seq, out


def _cells(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, counter in the first row, counter in the second row."""
    h = mix(anchors, 7)
    row = np.uint64(CELLS // 2 - 1)
    at = (h >> np.uint64(64 - bits)) if bits else np.zeros(len(h), dtype=np.uint64)
    return (at.astype(np.int64), (h & row).astype(np.int64),
            ((h >> np.uint64(SLICE_BITS)) & row).astype(np.int64) + CELLS // 2)


def _partition_sketches(docs: DataFrame, size: int, gram: int, bits: int) -> DataFrame:
    """(slice, ones, twos): counters of a part of the documents that stand at one and at two or more."""
    def rows(anchors):
        at, c0, c1 = _cells(np.concatenate(anchors), bits)
        cells = np.concatenate(((at << SLICE_BITS) | c0, (at << SLICE_BITS) | c1))
        cells, counts = np.unique(cells, return_counts=True)
        names = np.unique(cells >> SLICE_BITS)
        edges = np.searchsorted(cells, np.append(names, (names[-1] if len(names) else 0) + 1) << SLICE_BITS)
        low, more = (cells & (CELLS - 1)).astype("<u2"), counts > 1
        out = [(low[a:b][~more[a:b]].tobytes(), low[a:b][more[a:b]].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([x for x, _ in out], pa.binary()),
                                           pa.array([y for _, y in out], pa.binary())], ["slice", "ones", "twos"])

    def count(batches):
        held, n = [], 0
        for b in by_text_chars(batches, 1_000_000):
            _, parts = _segments(Words(b.column(0).to_pylist()), size, gram)
            for p in parts:
                if p is not None:
                    held.append(np.unique(p[0]))  # a document counts an anchor once
                    n += len(held[-1])
            if n >= 400_000:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return map_arrow(docs.select("text"), count, "slice long, ones binary, twos binary", keeps="words")


def _merged(sketches: DataFrame) -> DataFrame:
    """(slice, counters): two bits a counter, 0, 1 or 2 for more."""
    def add(batches):
        now, v = None, None

        def row():
            packed = v.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([packed.tobytes()], pa.binary())],
                                              ["slice", "counters"])

        for b in batches:
            for s, ones, twos in zip(*(c.to_pylist() for c in b.columns)):
                if s != now:
                    if now is not None:
                        yield row()
                    now, v = s, np.zeros(CELLS, dtype=np.uint8)
                for data, by in ((ones, 1), (twos, 2)):
                    at = np.frombuffer(data, dtype="<u2")
                    v[at] = np.minimum(v[at] + by, 2)
        if now is not None:
            yield row()

    return map_arrow(sketches.repartition("slice").sortWithinPartitions("slice"), add, "slice long, counters binary")


def _estimate(packed: np.ndarray, at: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """The sketch's estimate, 0 to 2: the least of both counters; packed[slice] are a slice's bytes."""
    def value(c):
        return (packed[at, c >> 2] >> ((c & 3) * 2).astype(np.uint8)) & 3

    return np.minimum(value(c0), value(c1))


def _rows(docs: DataFrame, size: int, gram: int, bits: int, sketch=None) -> DataFrame:
    """Segments (those that the broadcast sketch estimates at two or more): doc_id, fp, a (first window), n (windows),
    m (anchor), ctx (hash of all words), hashes (of the windows)."""
    names = ["doc_id", "fp", "a", "n", "m", "ctx", "hashes"]

    def cut(batches):
        packed = sketch.value if sketch is not None else None
        for b in by_text_chars(batches, 1_000_000):
            w = Words(b.column(2).to_pylist())
            seq, parts = _segments(w, size, gram)
            some = [i for i, p in enumerate(parts) if p is not None]
            if not some:
                continue
            m, lo, hi = (np.concatenate(c) for c in zip(*(parts[i] for i in some)))
            of = np.repeat(some, [len(parts[i][0]) for i in some])
            if packed is not None:
                keep = _estimate(packed, *_cells(m, bits)) > 1
                m, lo, hi, of = m[keep], lo[keep], hi[keep], of[keep]
            if not len(m):
                continue
            n = hi - lo
            ends = np.cumsum(n)
            at = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
            windows = seq.hashes(at, at + size, 2).view(np.int64)
            ctx = seq.hashes(lo, hi + size - 1, 4).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(windows, pa.int64()))
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(lo - w.offsets[of], pa.int64()),
                 pa.array(n, pa.int64()), pa.array(m.view(np.int64), pa.int64()), pa.array(ctx, pa.int64()), lists], names)

    return map_arrow(docs.select("doc_id", "fp", "text"), cut,
                     "doc_id long, fp long, a long, n long, m long, ctx long, hashes array<long>", keeps="words")


def _passing_anchors(docs: DataFrame, merged: DataFrame, size: int, gram: int, bits: int) -> DataFrame:
    """Distinct anchors estimated at two or more, each looked up in its slice where that slice is."""
    def anchors(batches):
        for b in by_text_chars(batches, 1_000_000):
            _, parts = _segments(Words(b.column(0).to_pylist()), size, gram)
            found = [p[0] for p in parts if p is not None]
            if found:
                m = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_cells(m, bits)[0], pa.int64()), pa.array(m.view(np.int64), pa.int64()),
                     pa.nulls(len(m), pa.binary())], ["slice", "m", "counters"])

    def look(batches):
        now, packed = None, None
        for b in batches:
            slices, ms, counters = b.column(0).to_numpy(), b.column(1), b.column(2)
            heads = np.flatnonzero(np.asarray(ms.is_null()))
            for lo, hi in zip(np.concatenate(([0], heads)), np.concatenate((heads, [len(slices)]))):
                if hi > lo and ms[int(lo)].as_py() is None:
                    now, packed = slices[lo], np.frombuffer(counters[int(lo)].as_py(), dtype=np.uint8)[None, :]
                    lo += 1
                if hi > lo:
                    m = ms.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
                    assert (slices[lo:hi] == now).all()
                    at, c0, c1 = _cells(m.view(np.uint64), bits)
                    yield pa.RecordBatch.from_arrays([pa.array(m[_estimate(packed, at * 0, c0, c1) > 1], pa.int64())], ["m"])

    asked = map_arrow(docs.select("text"), anchors, "slice long, m long, counters binary", keeps="words")
    both = merged.select("slice", F.lit(None).cast("long").alias("m"), "counters").unionByName(asked)
    return map_arrow(both.repartition("slice").sortWithinPartitions("slice", "m"), look, "m long").distinct()


def _estimated_repeated(docs: DataFrame, size: int, gram: int, broadcast_slices: int) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (int(total) // BYTES_A_CELL // CELLS).bit_length())
    merged = saved(_merged(_partition_sketches(docs, size, gram, bits)), "sketch")
    if (1 << bits) <= broadcast_slices:
        packed = np.zeros((1 << bits, CELLS // 4), dtype=np.uint8)
        for r in merged.toLocalIterator():
            packed[r["slice"]] = np.frombuffer(r["counters"], dtype=np.uint8)
        sketch = docs.sparkSession.sparkContext.broadcast(packed)
        out = saved(_rows(docs, size, gram, bits, sketch), "segments")
        sketch.destroy()
        return out
    passing = _passing_anchors(docs, merged, size, gram, bits)
    return saved(_rows(docs, size, gram, bits).join(passing, "m"), "segments")


def repeated_spans(docs: DataFrame, size: int, gram: int = 16, broadcast_slices: int = 2048) -> DataFrame:
    """docs(doc_id, fp, text) -> doc_id, fp, spans array<struct<s,e>> (word places to remove, not merged)."""
    seen = _estimated_repeated(docs.where("doc_id is not null"), size, min(gram, size), broadcast_slices)
    classes = saved(seen.groupBy("m", "ctx").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c"),
                                                 F.any_value("hashes").alias("hashes")), "segment-classes")
    several = classes.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("m")
    windows = saved(classes.join(several, "m", "left_semi")
                    .select("m", "ctx", "first", F.posexplode("hashes").alias("i", "h")), "segment-windows")
    least = (windows.groupBy("m", "h").agg(F.min("first").alias("least"), F.max("first").alias("most"))
             .where("least < most").select("m", "h", "least"))
    late = (windows.join(least, ["m", "h"]).where("least < first")
            .groupBy("m", "ctx").agg(F.collect_list("i").alias("late")))
    useful = saved(classes.select("m", "ctx", "first", "c").join(late, ["m", "ctx"], "left")
                   .where("c > 1 or late is not null"), "segment-classes")
    total = useful.agg(F.sum("c")).first()[0] or 0
    places = seen.select("doc_id", "fp", "a", "n", "m", "ctx")
    hot = useful.where(F.col("c") * HOT > total)
    on = ["m", "ctx"]
    hit = (places.join(F.broadcast(hot), on).drop("c")
           .unionByName(places.join(F.broadcast(hot.select(*on)), on, "left_anti")
                        .join(useful.where(F.col("c") * HOT <= total), on).drop("c")))
    spans = (F.when(F.col("doc_id") > F.col("first"),
                    F.array(F.struct(F.col("a").alias("s"), (F.col("a") + F.col("n") + size - 1).alias("e"))))
             .otherwise(F.transform("late", lambda i: F.struct((F.col("a") + i).alias("s"),
                                                               (F.col("a") + i + size).alias("e")))))
    return (hit.select("doc_id", "fp", spans.alias("spans")).where("spans is not null")
            .groupBy("doc_id", "fp").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def remove_repeats(docs: DataFrame, size: int = 50, gram: int = 16, broadcast_slices: int = 2048) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, removed array<struct<start,end>> (word places), kept (text)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    spans = repeated_spans(base, size, gram, broadcast_slices)
    rows = base.where("doc_id is not null").join(spans, ["doc_id", "fp"], "left").select("doc_id", "spans", "text")
    nowhere = base.where("doc_id is null").select("doc_id", F.lit(None).cast("array<struct<s:long,e:long>>").alias("spans"), "text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for b in by_text_chars(batches, 1_000_000):
            out = {"n_words": [], "n_removed": [], "removed": [], "kept": []}
            for at, text in zip(b.column(1), b.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                n, gone, merged = len(words), 0, []
                if at.is_valid and len(at.values):
                    lo, hi = (at.values.field(k).to_numpy() for k in ("s", "e"))
                    depth = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
                    covered = np.cumsum(depth)[:n] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
                    merged = [{"start": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2])]
                    gone = int(covered.sum())
                    words = [words[i] for i in np.flatnonzero(~covered)]
                for k, v in zip(out, (n, gone, merged, b" ".join(words).decode("utf-8", "surrogatepass"))):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), span, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(out.values(), types)]],
                                             ["doc_id", *out])

    return map_arrow(rows.unionByName(nowhere), cut, "doc_id long, n_words long, n_removed long, "
                     "removed array<struct<start:long,end:long>>, kept string")

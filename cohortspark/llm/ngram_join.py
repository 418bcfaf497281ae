"""N-gram Jaccard join with signature trees (operator 2).

Documents link when the Jaccard similarity of their sets of k-word shingles is
at least num/den.  The result is exact up to equality of 64-bit shingle
hashes: per document the size of its set and the smallest document it reaches.

1. Documents with equal sets form a class, its smallest doc_id stands for it.
2. Each class is entered under its prefix tokens: the n - ceil(t * n) + 1
   first shingles in an order common to all documents.  Linked sets share a
   prefix token, so only classes under one token can link.  Shingles that a
   share of about ``heavy`` of all documents hold come last in that order:
   common passages do not make large groups.
3. Tokens with several classes form groups (one of those with the same
   classes: count, smallest, largest and xor of 64-bit hashes).  In a group a signature tree is
   built (nodes hold OR-combined bitmaps and size ranges) and walked against
   itself; a pair of nodes is left out when the maximum possible overlap is
   too small for the sizes, or when all its members are connected already.
   What remains is a forest of possible links.  Groups beyond ``group_rows``
   are dealt into blocks and each pair of blocks is one group.
4. Components of possible links are clusters; all true links lie inside one.
   For clustered classes the full sets are formed from the texts and the same
   walk, now with exact intersections, gives a forest of true links.  Large
   clusters are dealt into blocks in the same way.
5. Components of true links give the answer.

Defined results: null and empty text (no words) have an empty set, linked with
nothing; with fewer than k words the whole sequence is the one shingle;
repeated rows belong to one class; rows with one doc_id are one node; rows
with null doc_id join the class of their set but never stand for it; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import BATCH_CHARS, BROADCAST_IDS, by_text_chars, components, map_arrow, saved
from cohortspark.llm.shingles import bitmap, mix, shingle_sets

LEAF = 32
REPORT_SHINGLES = 1_500_000  # shingles that a task holds before it reports the frequent ones: 12 MB, twice while they are joined
REPORT_LEAST = 4


def _heavy_shingles(docs: DataFrame, k: int, heavy: float) -> np.ndarray:
    """Shingles that about ``heavy`` of all documents hold or more, sorted.

    Counted over all documents in blocks: a shingle held by a share ``heavy``
    of all documents has at least half that share in blocks that together hold
    half its documents, so blocks report only shingles from half the share on
    and sums from a quarter on are taken.  The number taken is at most
    4 / heavy times the mean set size, which bounds what reaches the driver.
    Only the order of work depends on this list, never the result.
    """
    def count(batches):
        def report():
            all_s = np.concatenate(held)
            held.clear()
            many, n = frequent(all_s, max(REPORT_LEAST, heavy / 2 * docs_seen))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(many.view(np.int64), 0)),
                 pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(many), np.int64), docs_seen))],
                ["token", "n", "docs"])

        held, size, docs_seen = [], 0, 0
        for b in by_text_chars(batches, BATCH_CHARS):
            sets = shingle_sets(b.column(0).to_pylist(), k)
            held += sets
            size += sum(map(len, sets))
            docs_seen += len(sets)
            if size > REPORT_SHINGLES:
                yield report()
                held, size, docs_seen = [], 0, 0
        if size:
            yield report()

    got = map_arrow(docs.select("text"), count, "token long, n long, docs long").groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    got = saved(got, "heavy")
    total = got.agg(F.sum("docs")).first()[0] or 0
    rows = got.where((F.col("docs") == 0) & (F.col("n") >= max(8, heavy / 4 * total))).select("token").collect()
    return np.sort(np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64))


def frequent(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur ``least`` times or more, in order, and how often; sorts ``x`` in place."""
    x.sort()
    gap = math.ceil(least) - 1
    ends = x[gap:]  # a value so frequent stands at both ends of a stretch
    many = np.unique(ends[ends == x[:len(ends)]])
    return many, np.searchsorted(x, many, side="right") - np.searchsorted(x, many)


def _sets(docs: DataFrame, k: int, num: int, den: int, heavy: np.ndarray) -> DataFrame:
    """doc_id, n, fp1, fp2, prefix array<long>, bits binary."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(heavy)

    def fields(batches):
        h = known.value
        for b in by_text_chars(batches, BATCH_CHARS):
            n, fp1, fp2, bits, flat, ends = [], [], [], [], [], [0]
            for s in shingle_sets(b.column(1).to_pylist(), k):
                size = len(s)
                n.append(size)
                fp1.append(np.add.reduce(mix(s, 3)) if size else np.uint64(0))
                fp2.append(np.bitwise_xor.reduce(mix(s, 4)) if size else np.uint64(0))
                bits.append(bitmap(s))
                take = size - (-(-num * size // den)) + 1 if size else 0
                if take and len(h):
                    common = h[np.minimum(np.searchsorted(h, s), len(h) - 1)] == s
                    first = s[~common][:take]
                    if len(first) < take:
                        first = np.concatenate((first, s[common][:take - len(first)]))
                else:
                    first = s[:take]
                flat.append(first)
                ends.append(ends[-1] + len(first))
            tokens = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(fp1, np.uint64).view(np.int64)),
                 pa.array(np.array(fp2, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens)), pa.array(bits, pa.binary())],
                ["doc_id", "n", "fp1", "fp2", "prefix", "bits"])

    return map_arrow(docs, fields, "doc_id long, n long, fp1 long, fp2 long, prefix array<long>, bits binary")


class SignatureTree:
    """Rows (size, bitmap as integer, bits wide) in order of size; nodes are
    (lo, hi, OR of bitmaps, least size, largest size, fewest bits, left, right)."""

    def __init__(self, sizes: list[int], maps: list[int], num: int, den: int, check: Callable[[int, int], bool]):
        self.sizes, self.maps, self.num, self.den, self.check = sizes, maps, num, den, check
        self.ones = [m.bit_count() for m in maps]
        self.parent = list(range(len(sizes)))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def build(self, lo: int, hi: int):
        if hi - lo <= LEAF:
            union = 0
            for m in self.maps[lo:hi]:
                union |= m
            return (lo, hi, union, min(self.sizes[lo:hi]), max(self.sizes[lo:hi]), min(self.ones[lo:hi]), None, None)
        mid = (lo + hi) // 2
        a, b = self.build(lo, mid), self.build(mid, hi)
        return (lo, hi, a[2] | b[2], min(a[3], b[3]), max(a[4], b[4]), min(a[5], b[5]), a, b)

    def enough(self, overlap: int, sizes: int) -> bool:
        return overlap * (self.den + self.num) >= self.num * sizes

    def root(self, node) -> int:
        """The component of all rows below a node, -1 if there are several."""
        find, r = self.find, self.find(node[0])
        for i in range(node[0] + 1, node[1]):
            if find(i) != r:
                return -1
        return r

    def possible(self, u, v) -> bool:
        if not self.enough(min(u[4], v[4]), max(u[3] + v[3], 0)) or v[3] * self.num > u[4] * self.den \
                or u[3] * self.num > v[4] * self.den:
            return False
        both = (u[2] & v[2]).bit_count()
        most = min(u[4] - max(0, u[5] - both), v[4] - max(0, v[5] - both))
        return self.enough(most, u[3] + v[3])

    def rows(self, lo: int, hi: int, lo2: int, hi2: int) -> None:
        """All pairs of two leaves (or of one with itself)."""
        sizes, maps, find = self.sizes, self.maps, self.find
        for i in range(lo, hi):
            n, m = sizes[i], maps[i]
            for j in range(max(i + 1, lo2), hi2):
                if sizes[j] * self.num > n * self.den:
                    break  # rows are in order of size
                if n * self.num > sizes[j] * self.den:
                    continue
                a, b = find(i), find(j)
                if a == b:
                    continue
                both = m & maps[j]
                common = both.bit_count()
                most = min(n - (self.ones[i] - common), sizes[j] - (self.ones[j] - common))
                if self.enough(most, n + sizes[j]) and self.check(i, j):
                    self.parent[max(a, b)] = min(a, b)
                    self.links.append((i, j))

    def walk(self) -> list[tuple[int, int]]:
        """A forest of the links among the rows."""
        if len(self.sizes) <= LEAF:
            self.rows(0, len(self.sizes), 0, len(self.sizes))
            return self.links
        todo = [("self", self.build(0, len(self.sizes)), None)]
        while todo:
            kind, u, v = todo.pop()
            if kind == "self":
                if u[6] is None:
                    self.rows(u[0], u[1], u[0], u[1])
                else:
                    todo += [("cross", u[6], u[7]), ("self", u[7], None), ("self", u[6], None)]
                continue
            if not self.possible(u, v):
                continue
            r = self.root(u)
            if r >= 0 and r == self.root(v):
                continue
            if u[6] is None and v[6] is None:
                self.rows(u[0], u[1], v[0], v[1])
            elif u[6] is not None and (v[6] is None or u[1] - u[0] >= v[1] - v[0]):
                todo += [("cross", u[7], v), ("cross", u[6], v)]
            else:
                todo += [("cross", u, v[7]), ("cross", u, v[6])]
        return self.links


def _fold(m: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        m = (m >> bits) | (m & ((1 << bits) - 1))
    return m


def forest(rows: list[tuple[int, int, bytes]], num: int, den: int,
           check: Callable[[int, int], bool] = lambda i, j: True) -> list[tuple[int, int]]:
    """Links (indexes into rows) that join what the links among (id, size,
    bitmap) rows join.  Bitmaps are as wide as their set is large; sets of one
    link have widths that are equal or next to each other, so one tree per
    width takes its own rows and, folded, those of the next width.
    """
    if len(rows) < 2:
        return []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][2]))
    widths = sorted({len(r[2]) for r in rows})
    out = []
    for w in widths:
        own = [i for i in order if len(rows[i][2]) in (w, 2 * w)]
        if len(widths) > 1 and all(len(rows[i][2]) != w for i in own):
            continue
        upper = [len(rows[i][2]) != w for i in own]
        tree = SignatureTree([rows[i][1] for i in own],
                             [_fold(int.from_bytes(rows[i][2], "little"), 8 * len(rows[i][2]), 8 * w) for i in own],
                             num, den, lambda a, b: not (upper[a] and upper[b]) and check(own[a], own[b]))
        out += [(own[a], own[b]) for a, b in tree.walk()]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``keys`` columns, in order of arrival."""
    held, key = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if held:
                    yield held
                held, key = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield held


def _dealt(df: DataFrame, blocks) -> DataFrame:
    """Adds b1 <= b2: with one block (0, 0), else every pair of blocks that holds the row's own block."""
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1),
                        lambda j: F.struct(F.least(own, j).alias("b1"), F.greatest(own, j).alias("b2")))
    return df.withColumn("b", F.explode(pairs)).withColumns({"b1": F.col("b.b1"), "b2": F.col("b.b2")}).drop("b")


def _possible_links(classes: DataFrame, num: int, den: int, group_rows: int) -> DataFrame:
    tokens = classes.select(F.explode("prefix").alias("token"), "rep")
    shared = (tokens.groupBy("token").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count(F.lit(1)).alias("c"),
                                          F.bit_xor(F.xxhash64("rep")).alias("x")).where("a <> z"))
    # tokens with the same classes make the same group: the copies of a text share most of theirs
    shared = shared.groupBy("a", "z", "c", "x").agg(F.min("token").alias("token")).select("token", "c")
    rows = tokens.join(shared, "token").join(classes.select("rep", "n", "bits"), "rep")
    dealt = _dealt(rows, F.ceil(F.col("c") / group_rows))
    grouped = (dealt.repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2")
               .select("token", "b1", "b2", "rep", "n", "bits"))

    def link(batches):
        out: list[tuple[int, int]] = []
        seen: set[tuple[int, int]] = set()  # one pair often shares many tokens
        for g in _groups(batches, 3):
            for i, j in forest(g, num, den):
                pair = (g[i][0], g[j][0]) if g[i][0] < g[j][0] else (g[j][0], g[i][0])
                if pair not in seen:
                    seen.add(pair)
                    out.append(pair)
            if len(seen) > 500_000:
                seen.clear()
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return map_arrow(grouped, link, "src long, dst long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _true_links(docs: DataFrame, clusters: DataFrame, k: int, num: int, den: int, block_shingles: int) -> DataFrame:
    """clusters(rep, label, n) -> edges between reps whose full sets link."""
    total = clusters.groupBy("label").agg(F.sum("n").alias("total"))
    member = _dealt(clusters.join(total, "label"), F.ceil(F.col("total") / block_shingles))
    member = saved(member.select("rep", "label", "b1", "b2"), "clusters")
    ids = member.select("rep").distinct()
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(side, docs["doc_id"] == side["rep"], "left_semi")

    def full(batches):
        for b in by_text_chars(batches, BATCH_CHARS):
            sets = [s.tobytes() for s in shingle_sets(b.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    sets = map_arrow(texts, full, "rep long, shingles binary")
    grouped = (member.join(sets, "rep").repartition("label", "b1", "b2").sortWithinPartitions("label", "b1", "b2")
               .select("label", "b1", "b2", "rep", "shingles"))

    def link(batches):
        for g in _groups(batches, 3):
            sets = [np.frombuffer(s, dtype=np.uint64) for _, s in g]
            rows = [(r, len(s), bitmap(s)) for (r, _), s in zip(g, sets)]

            def check(i, j):
                a, b = sets[i], sets[j]
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int(np.count_nonzero(b[at] == a))
                return common * den >= num * (len(a) + len(b) - common)

            links = forest(rows, num, den, check)
            if links:
                yield _edges([(rows[i][0], rows[j][0]) for i, j in links])

    return map_arrow(grouped, link, "src long, dst long")


def near_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, heavy: float = 0.002,
                group_rows: int = 20_000, block_shingles: int = 8_000_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id); similarity num / den, shingles of k words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = saved(_sets(docs, k, num, den, _heavy_shingles(docs, k, heavy)), "sets")
    classes = sets.where("n > 0").groupBy("n", "fp1", "fp2").agg(
        F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = saved(classes.where("rep is not null"), "classes")
    clusters = components(saved(_possible_links(classes, num, den, group_rows), "possible"), "possible")
    clusters = clusters.withColumnRenamed("node", "rep").join(classes.select("rep", "n"), "rep")
    linked = components(saved(_true_links(docs, clusters, k, num, den, block_shingles), "links"), "links")
    named = (classes.select("n", "fp1", "fp2", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
             .select("n", "fp1", "fp2", F.coalesce("label", "rep").alias("component_id")))
    return (sets.select("doc_id", "n", "fp1", "fp2").join(named, ["n", "fp1", "fp2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))

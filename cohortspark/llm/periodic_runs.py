"""Periodic runs of words by maximal pairs in the LCP-interval tree (operator 12).

A run is a stretch of words with smallest period q and at least
max(min_length, min_exponent * q) words that no neighbouring word extends.
A maximal pair (i, i + q, l) is two equal stretches of l words that differ in
the word before and in the word after.  With l >= (min_exponent - 1) * q and
l + q >= min_length the two overlap or touch, so the words from i to i + q + l
have period q, and as the pair is maximal nothing extends them: such pairs are
exactly the runs, and of several pairs over one stretch the least distance is
its smallest period.

Per batch of texts, in numpy: words and gram hashes, salted by text; suffixes
that share their first ``gram`` words within their text are put in suffix
order by doubling, and the ranks of all doublings give the LCP of neighbours.
The LCP-interval tree of each group is then walked bottom up.  A node keeps
the positions below it in one sorted list and in one list per left word;
joining two children, each position of the smaller one looks for the nearest
position of the larger one with another left word within l / (min_exponent - 1)
on either side.  There is at most one such pair a side: two would make their
common stretch periodic in both distances, so that one would not be maximal.
Groups that have one left word only, or whose closest positions are too far
apart for their largest LCP, have no such pair and are not walked.

A text is one row of one task; its arrays take some 150 bytes a word.

Defined results: null, empty and blank texts have no words; repeated rows and
rows with null doc_id are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import by_text_chars, map_arrow
from cohortspark.llm.shingles import mix
from cohortspark.llm.words import Sums, Words


class Suffixes:
    """Positions of the batch whose first ``gram`` words stand twice in their text (and those a gram further on,
    alone in their group), in suffix order."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, gram: int):
        n = len(words)
        self.words, self.doc, self.gram = words, doc, gram
        grams = Sums(words, 0xD6E8FEB86659FD93).all_of(gram, 1)
        within = np.flatnonzero(doc[:len(grams)] == doc[gram - 1:])
        key = mix(grams[within] ^ mix(doc[within].astype(np.uint64), 5), 6)
        order = np.argsort(key)
        key, at = key[order], within[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        tied = at[np.union1d(same, same + 1)]
        # the suffix order needs the grams of the tied places and of those a gram further on, word by word
        at = np.unique(np.concatenate((tied, tied + gram)))
        at = at[at < n]
        columns = [doc[at]]
        for j in range(gram):
            on = np.minimum(at + j, n - 1)
            columns.append(np.where((at + j < n) & (doc[on] == doc[at]), words[on], np.uint64(0)))
        order = np.lexsort(columns[::-1])
        at = at[order]
        head = np.zeros(len(at), dtype=bool)
        head[:1] = True
        for c in columns:
            c = c[order]
            head[1:] |= c[1:] != c[:-1]
        #: rank tables: levels[j][i] equal at two places if their first gram * 2 ** j words are
        rank = -1 - np.arange(n + 1, dtype=np.int64)
        rank[at] = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        self.order, self.levels = at, [rank]
        k, todo = gram, np.flatnonzero(~(head & np.append(head[1:], True)))  # places of the order that are still tied
        while len(todo):
            rank = self.levels[-1]
            now = self.order[todo]
            ahead = now + k
            after = np.where(ahead < n, rank[np.minimum(ahead, n)], -1 - ahead)
            by = np.lexsort((after, rank[now]))
            now, after, first = now[by], after[by], rank[now][by]
            self.order[todo] = now
            split = np.concatenate(([True], (first[1:] != first[:-1]) | (after[1:] != after[:-1])))
            fresh = rank.copy()
            fresh[now] = np.maximum.accumulate(np.where(split, todo, 0))
            self.levels.append(fresh)
            todo = todo[~(split & np.append(split[1:], True))]
            k *= 2

    def lcp(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the suffixes at x and y (x != y, same text) have in common."""
        n, size = len(self.words), np.zeros(len(x), dtype=np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            step, rank = self.gram << j, self.levels[j]
            while True:  # one step a level but for the first, which is never wrong to try again
                u, v = np.minimum(x + size, n), np.minimum(y + size, n)
                ok = (rank[u] == rank[v]) & (u < n) & (v < n)
                if not ok.any():
                    break
                size += np.where(ok, step, 0)
        for _ in range(self.gram - 1):
            u, v = x + size, y + size
            far = np.maximum(u, v) < n
            u, v = np.minimum(u, n - 1), np.minimum(v, n - 1)
            ok = far & (self.words[u] == self.words[v]) & (self.doc[u] == self.doc[x]) & (self.doc[v] == self.doc[x])
            size += ok
            if not ok.any():
                break
            # a place that differed once stays different: its words do not change
        return size


def _pairs(positions: list[int], lcps: list[int], left: Callable[[int], int], ratio: int, report) -> None:
    """Walks the LCP-interval tree of suffixes in order (lcps[i]: of positions[i] and [i + 1]) and reports
    (i, j, l): nearest maximal pairs with j - i <= l / ratio."""

    def join(a, b, size):
        """Both are (sorted positions, left word -> sorted positions); pairs between them have LCP ``size``."""
        if len(a[0]) < len(b[0]):
            a, b = b, a
        every, classes = a
        reach = size // ratio
        for w, own in b[1].items():
            others = [c for v, c in classes.items() if v != w]
            if not others:
                continue
            for i in own:
                k = bisect_left(every, i)
                near = (k and i - every[k - 1] <= reach) or (k < len(every) and every[k] - i <= reach)
                if not near:
                    continue
                below = above = None
                for c in others:
                    k = bisect_left(c, i)
                    if k and (below is None or c[k - 1] > below):
                        below = c[k - 1]
                    if k < len(c) and (above is None or c[k] < above):
                        above = c[k]
                if below is not None and i - below <= reach:
                    report(below, i, size)
                if above is not None and above - i <= reach:
                    report(i, above, size)
        for w, own in b[1].items():
            mine = classes.setdefault(w, [])
            for i in own:
                insort(mine, i)
                insort(every, i)
        return a

    def leaf(i):
        return [i], {left(i): [i]}

    stack: list[tuple[int, tuple]] = []  # open intervals: LCP, positions so far
    now = leaf(positions[0])
    for i, size in enumerate(lcps):
        while stack and stack[-1][0] > size:
            depth, rest = stack.pop()
            now = join(rest, now, depth)
        if stack and stack[-1][0] == size:
            now = join(stack.pop()[1], now, size)
        stack.append((size, now))
        now = leaf(positions[i + 1])
    while stack:
        depth, rest = stack.pop()
        now = join(rest, now, depth)


def runs_of(words: np.ndarray, doc: np.ndarray, min_length: int, min_exponent: int) -> dict[int, dict]:
    """doc number -> {(start, end): period} by place in the batch; doc: text number of each word, ascending."""
    ratio = min_exponent - 1
    # the least LCP that a pair of a run can have: q = 1 asks for min_length - 1 words, larger q for more
    gram = min(max(ratio * q, min_length - q) for q in range(1, min_length + 1))
    found: dict[int, dict] = {}
    if len(words) <= gram:
        return found
    s = Suffixes(words, doc, gram)
    at = s.order
    if not len(at):
        return found
    left = np.where((at > 0) & (doc[at - 1] == doc[at]), words[at - 1].view(np.int64), np.int64(-1) - doc[at])
    group = s.levels[0][at]
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(head, len(at)))
    of = np.repeat(np.arange(len(head)), size)
    same = np.concatenate((of[1:] == of[:-1], [False]))
    nxt = np.minimum(np.arange(len(at)) + 1, len(at) - 1)
    mixed = np.maximum.reduceat((same & (left != left[nxt])).astype(np.int8), head) > 0
    by_place = np.lexsort((at, of))
    gaps = np.append(np.diff(at[by_place]), 0)
    gaps = np.where(same, gaps, np.iinfo(np.int64).max)
    closest = np.minimum.reduceat(gaps, head)
    some = np.flatnonzero(mixed[of] & same)
    lcps = np.zeros(len(at), dtype=np.int64)
    lcps[some] = s.lcp(at[some], at[some + 1])
    most = np.maximum.reduceat(lcps, head)
    for g in np.flatnonzero(mixed & (closest * ratio <= most)):
        a, b = head[g], head[g] + size[g]
        runs = found.setdefault(int(doc[at[a]]), {})
        place = dict(zip(at[a:b].tolist(), left[a:b].tolist()))

        def report(i, j, common):
            q, stretch = j - i, (i, j + common)
            if q + common >= min_length and runs.get(stretch, q) >= q:
                runs[stretch] = q

        _pairs(at[a:b].tolist(), lcps[a:b - 1].tolist(), place.__getitem__, ratio, report)
    return found


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Places kept of n words: a word that stands in a run after its first period goes.  None: all."""
    if not runs:
        return None
    step = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.flatnonzero(np.cumsum(step[:n]) == 0)


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, order=None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, runs array<struct<start,length,period>> (by start, then period; word
    places from 0) and collapsed (the kept words joined by blanks).

    ``order(doc_id, n)`` may give the places of the words to take instead of all n in turn."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs have two periods and two words at least")
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches):
        for b in by_text_chars(batches, 2_000_000):
            ids, w = b.column(0).to_pylist(), Words(b.column(1).to_pylist())
            taken = [order(i, int(n)) if order else None for i, n in zip(ids, np.diff(w.offsets))]
            hashes = w.hashes
            if any(t is not None for t in taken):
                hashes = np.concatenate([w.hashes[lo:hi] if t is None else w.hashes[lo:hi][t]
                                         for t, lo, hi in zip(taken, w.offsets[:-1], w.offsets[1:])])
            doc = np.repeat(np.arange(len(ids)), np.diff(w.offsets))
            found = runs_of(hashes, doc, min_length, min_exponent)
            out_runs, out_text = [], []
            for k, part in enumerate(w.parts):
                lo = int(w.offsets[k])
                runs = sorted((i - lo, j - i, q) for (i, j), q in found.get(k, {}).items())
                words = part.split()
                if taken[k] is not None:
                    words = [words[i] for i in taken[k]]
                kept = collapsed(len(words), runs)
                if kept is not None:
                    words = [words[i] for i in kept]
                out_runs.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                out_text.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out_runs, run), pa.array(out_text, pa.string())],
                                             ["doc_id", "runs", "collapsed"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), find,
                     "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string", keeps="words")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word order that the registered query asks for: with h = crc32(doc_id), g = h // 10 and h % 10 = 0 the
    words from a = g % n on repeat the first p = 1 + (n - a) // (3 + g % 8) of them.  Null doc_id: as they are."""
    import zlib
    if doc_id is None or n == 0:
        return None
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def digest(found: DataFrame) -> DataFrame:
    """find_runs() -> doc_id, n_runs, start, length, period and exponent_milli of the run with the greatest
    length / period (then least start, then period), runs_sha256, collapsed_sha256."""
    def better(a, b):
        x, y = a["length"].cast("decimal(19,0)") * b["period"], b["length"].cast("decimal(19,0)") * a["period"]
        return F.when(a.isNull() | (y > x), b).otherwise(a)  # runs come by start, then period: the first one wins a tie

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in
                                                                         ("start", "length", "period")])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), text.alias("t"), "collapsed")
    return rows.select("doc_id", "n_runs", *[F.col("b")[k].alias(k) for k in ("start", "length", "period")],
                       F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
                       F.sha2("t", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

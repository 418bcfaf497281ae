"""Benchmark decontamination by latent semantic retrieval (operator 4).

1. Words are hashed into ``FEATURES`` buckets; document frequencies of the
   buckets are counted over all documents and give the idf weights; none is
   below ``LEAST_IDF``, so that no word of a passage is lost however many
   documents hold it.
2. Benchmark items are cut into passages of at most ``WINDOW`` words.  A
   randomised SVD of their TF-IDF matrix, distributed over the passages (range
   finder with one power step, then the small problem), gives the latent
   space of a block of about ``block_passages`` passages.  It has as many
   dimensions as the block has passages, so that it holds each of them whole.
   Directions outside the span of the benchmark passages add nothing
   to a cosine with a passage, so no other rows are needed for it.
3. Every document is cut into windows of ``WINDOW`` words that overlap by
   half, folded into the latent space, and compared by cosine with all
   passages.  A window whose projection is already too short for ``cosine``
   is left out before the comparison.  Words of a widespread passage weigh
   little, so windows that share a run of ``RUN`` words with a passage (or all
   of a shorter passage) are candidates too, whatever their cosine.
4. Candidates are confirmed on the words: the longest common subsequence as a
   share of the passage, and the share of the passage's answer words (its
   rarest third) that occur.  A leak needs ``lcs`` of the passage in order, or
   ``lcs_paraphrase`` of it together with ``answer`` of its answer words.

One search over the documents handles up to ``BLOCKS`` blocks; these, their
latent vectors (at most FEATURES x rank numbers each) and the idf weights are
what is broadcast.  With more blocks the leaks of each search are written.

Defined results: null and empty texts (on either side) leak nothing; words are
runs of ASCII letters, digits and non-ASCII characters, lower-cased; a document
leaks an item once, with its best passage (ties: earliest window); repeated
rows give their pair once; rows with null doc_id or item_id give no pair; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import BATCH_CHARS, by_text_chars, map_arrow, saved
from cohortspark.llm.shingles import word_hashes

FEATURES = 1 << 16
WINDOW = 64
LEAST_IDF = 0.1
RUN = 5
BLOCKS = 8
SEARCHED_CHARS = 1_000_000  # bytes of text searched at once, hashed in slices of BATCH_CHARS
COMPARED = 2048  # windows compared with all passages at once
PROJECTED = 256  # windows projected at once, at most WINDOW rows of the latent space each

_GAP = np.ones(256, dtype=bool)
_GAP[128:] = False
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _GAP[_lo:_hi] = False


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t and t.lower() for t in texts], _GAP)


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of every bucket over all documents, LEAST_IDF or more."""
    def count(batches):
        df, seen = np.zeros(FEATURES, dtype=np.int64), 0
        for b in by_text_chars(batches, BATCH_CHARS):
            words, at = _words(b.column(0).to_pylist())
            owner = np.repeat(np.arange(b.num_rows), np.diff(at))
            key = np.sort((owner << 16) | _buckets(words))
            df += np.bincount(key[np.concatenate(([True], key[1:] != key[:-1]))] & (FEATURES - 1) if len(key) else key,
                              minlength=FEATURES)
            seen += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], seen))],
                                         ["bucket", "n"])

    sums = map_arrow(docs.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = {r["bucket"]: r["n"] for r in sums.collect()}  # at most FEATURES + 1 rows
    total = got.pop(-1, 0)
    df = np.zeros(FEATURES)
    if got:
        df[list(got)] = list(got.values())
    return np.maximum(np.log((1 + total) / (1 + df)), LEAST_IDF)


def passages_of(words: np.ndarray) -> Iterator[np.ndarray]:
    """Windows of at most WINDOW words, half overlapping, that cover all words."""
    lo = 0
    while lo < len(words):
        yield words[lo:lo + WINDOW]
        if lo + WINDOW >= len(words):
            return
        lo += WINDOW // 2


def passages(bench: DataFrame) -> DataFrame:
    """bench(item_id, text) -> item_id, words (hashes) of every passage, repeated ones once."""
    def cut(batches):
        for b in by_text_chars(batches, BATCH_CHARS):
            words, at = _words(b.column(1).to_pylist())
            found = [(i, p.tobytes()) for i, lo, hi in zip(b.column(0).to_pylist(), at[:-1], at[1:])
                     for p in passages_of(words[lo:hi])]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()),
                                              pa.array([p for _, p in found], pa.binary())], ["item_id", "words"])

    return map_arrow(bench.select("item_id", "text"), cut, "item_id long, words binary").distinct()


def _rows(batches, idf: np.ndarray) -> Iterator[np.ndarray]:
    """Dense TF-IDF rows of unit length, one per benchmark passage."""
    for b in batches:
        for p in b.column(b.schema.get_field_index("words")).to_pylist():
            yield tfidf(np.frombuffer(p, dtype=np.uint64), idf)


def tfidf(words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.bincount(_buckets(words), minlength=FEATURES) * idf
    return v / (np.linalg.norm(v) or 1.0)


def _summed(df: DataFrame, fn, width: int) -> dict[int, np.ndarray]:
    """``fn(batches)`` yields (key, vector) partial sums; adds them by key over the cluster."""
    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for k, v in fn(batches):
            sums[k] = sums[k] + v if k in sums else v
        yield _vectors(sums)

    def fold(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(v)
                sums[k] = sums[k] + x if k in sums else x
        yield _vectors(sums)

    schema = "key long, vec binary"
    out = map_arrow(map_arrow(df, part, schema).repartition("key"), fold, schema)
    return {r["key"]: np.frombuffer(r["vec"]) for r in out.collect()}  # at most FEATURES rows of ``width`` numbers


def _vectors(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()), pa.array([np.asarray(v, dtype=float).tobytes() for v in sums.values()],
                                                    pa.binary())], ["key", "vec"])


def randomised_svd(bench: DataFrame, idf: np.ndarray, rank: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, V): right singular vectors of the passages' TF-IDF matrix, rows for the buckets that occur."""
    wide = rank + 8

    def sketch(batches):
        omega: dict[int, np.ndarray] = {}  # a bucket's random row follows from seed and bucket; some are kept

        def normal(i):
            if i not in omega:
                if len(omega) >= 4096:
                    omega.clear()
                omega[i] = np.random.default_rng((seed, int(i))).standard_normal(wide)
            return omega[i]

        for row in _rows(batches, idf):
            at = np.flatnonzero(row)
            y = np.zeros(wide)
            for i in at:
                y += row[i] * normal(i)
            for i in at:
                yield int(i), row[i] * y

    z = _summed(bench.select("words"), sketch, wide)
    buckets = np.array(sorted(z), dtype=np.int64)
    if not len(buckets):
        return buckets, np.zeros((0, 1), dtype=np.float32)
    q, r = np.linalg.qr(np.stack([z[i] for i in buckets]))
    sound = np.abs(np.diag(r)) > 1e-9 * max(1e-300, np.abs(np.diag(r)).max())
    q = q[:, sound]
    place = np.full(FEATURES, -1)
    place[buckets] = np.arange(len(buckets))

    def gram(batches):
        for row in _rows(batches, idf):
            at = np.flatnonzero(row)
            b = row[at] @ q[place[at]]
            yield 0, np.outer(b, b).ravel()

    g = _summed(bench.select("words"), gram, q.shape[1] ** 2)[0].reshape(q.shape[1], -1)
    value, vector = np.linalg.eigh(g)
    best = np.argsort(-value)[:rank]
    return buckets, (q @ vector[:, best]).astype(np.float32)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each place."""
    ends = len(words) - n + 1
    h = words[:max(0, ends)].copy()
    for k in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k:ends + k]
    return h


def run_index(passages: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of RUN words of the passages and whole shorter passages, by length: (length, first 20 bits that
    occur, hashes in order, passage and place of each)."""
    found: dict[int, list] = {}
    for i, p in enumerate(passages):
        n = min(RUN, len(p))
        h = run_hashes(p, n)
        found.setdefault(n, []).append((h, np.full(len(h), i), np.arange(len(h))))
    out = []
    for n, parts in sorted(found.items()):
        h, owner, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        seen = np.zeros(1 << 20, dtype=bool)
        seen[h >> np.uint64(44)] = True
        out.append((n, seen, h[order], owner[order], place[order]))
    return out


def shared_runs(index, words: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, passage) pairs, in order: the two windows that hold a passage where a run of it stands.
    Texts are words[at[t]:at[t + 1]] and have the windows first[t]:first[t + 1]."""
    windows, owners = [], []
    for n, seen, hashes, owner, place in index:
        h = run_hashes(words, n)
        hit = np.flatnonzero(seen[h >> np.uint64(44)])
        text = np.searchsorted(at, hit, side="right") - 1
        inside = hit + n <= at[text + 1]
        hit, text = hit[inside], text[inside]
        lo = np.searchsorted(hashes, h[hit])
        many = np.searchsorted(hashes, h[hit], side="right") - lo
        ends = np.cumsum(many)
        entry = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many - lo, many)
        hit, text = np.repeat(hit, many), np.repeat(text, many)
        start = (hit - at[text] - place[entry]) // (WINDOW // 2)  # of the passage; before the text if cut there
        for k in (0, 1):
            windows.append(np.clip(first[text] + start + k, first[text], first[text + 1] - 1))
            owners.append(owner[entry])
    if not windows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = np.unique(np.stack([np.concatenate(windows), np.concatenate(owners)]), axis=1)
    return pairs[0], pairs[1]


def lcs_length(passage: list[int], window: list[int]) -> int:
    """Longest common subsequence by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, w in enumerate(passage):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(passage)) - 1
    s = full
    for w in window:
        m = masks.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(passage) - s.bit_count()


def find_leaks(docs: DataFrame, bench: DataFrame, rank: int = 256, cosine: float = 0.25, lcs: float = 0.7,
               lcs_paraphrase: float = 0.5, answer: float = 0.8, block_passages: int = 256) -> DataFrame:
    """docs(doc_id, text), bench(item_id, text) -> doc_id, item_id, start_word, cosine, lcs_share, answer_share."""
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    schema = "doc_id long, item_id long, start_word long, cosine double, lcs_share double, answer_share double"
    idf = inverse_frequencies(docs)
    bench = saved(passages(bench), "passages")
    blocks = bench.count() // block_passages + 1
    parts = []
    for lo in range(0, blocks, BLOCKS):
        spaces = [_space(bench.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k), idf, rank)
                  for k in range(lo, min(lo + BLOCKS, blocks))]
        shared = docs.sparkSession.sparkContext.broadcast((idf.astype(np.float32), [x for x in spaces if x[3]]))
        found = map_arrow(docs, _search(shared, cosine, lcs, lcs_paraphrase, answer), schema)
        if blocks > BLOCKS:
            found = saved(found, "leaks")
            shared.destroy()
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine", (-F.col("start_word")).alias("back"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.back")).alias("start_word"), "b.cosine", "b.lcs_share", "b.answer_share")


def _space(block: DataFrame, idf: np.ndarray, rank: int) -> tuple:
    """Latent space of a block's passages with all the search needs of them."""
    items, words = [], []
    for r in block.collect():  # one block of the stated query set
        items.append(r["item_id"])
        words.append(np.frombuffer(r["words"], dtype=np.uint64))
    buckets, v = randomised_svd(block, idf, max(rank, len(words)))
    place = np.full(FEATURES, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets))
    latent = np.zeros((len(items), v.shape[1]), dtype=np.float32)
    rare = []
    for i, p in enumerate(words):
        row = tfidf(p, idf)
        at = np.flatnonzero(row)
        latent[i] = row[at] @ v[place[at]]
        distinct = np.unique(p)
        rare.append(set(distinct[np.argsort(-idf[_buckets(distinct)], kind="stable")][:max(1, len(distinct) // 3)].tolist()))
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return place, v, latent, items, [w.tolist() for w in words], rare, run_index(words)


def _projections(window: np.ndarray, nxt: np.ndarray, hit: np.ndarray, edge: np.ndarray, v: np.ndarray,
                 row: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows in the latent space of windows that begin with the half ``window`` and end with the half ``nxt`` (may be
    the same: a last half); the known words of half i are hit[edge[i]:edge[i + 1]]."""
    half_at = np.union1d(window, nxt)  # half windows, each projected once
    a, z = edge[half_at], edge[half_at + 1]
    take = np.concatenate([hit[i:j] for i, j in zip(a, z)])
    ends = np.cumsum(z - a)
    vecs = v[row[take]]
    vecs *= w[take][:, None]
    some = z > a
    halves = np.zeros((len(half_at), v.shape[1]), dtype=np.float32)
    if some.any():
        halves[some] = np.add.reduceat(vecs, (ends - (z - a))[some], axis=0)
    proj = halves[np.searchsorted(half_at, window)]
    two = nxt != window
    proj[two] += halves[np.searchsorted(half_at, nxt[two])]
    return proj


def _search(shared, cosine, lcs, lcs_paraphrase, answer):
    def search(batches):
        weight, spaces = shared.value
        half = WINDOW // 2
        for b in by_text_chars(batches, SEARCHED_CHARS):
            hashed = [_words(x.column(1).to_pylist()) for x in by_text_chars(iter([b]), BATCH_CHARS)]
            all_words = np.concatenate([x for x, _ in hashed])
            size = np.concatenate([np.diff(x) for _, x in hashed])
            at = np.concatenate(([0], np.cumsum(size)))
            ids = b.column(0).to_pylist()
            n_blocks = -(-size // half)
            first = np.concatenate(([0], np.cumsum(n_blocks)))
            total = int(first[-1])
            out = []
            if total and spaces:
                within = np.arange(len(all_words)) - np.repeat(at[:-1], size)
                of = np.repeat(first[:-1], size) + within // half
                bucket = _buckets(all_words)
                w = weight[bucket]
                norm2 = np.bincount(of, weights=w * w, minlength=total)
                follows = np.ones(total, dtype=bool)  # the next block belongs to the same text
                follows[first[1:][n_blocks > 0] - 1] = False
                pair = lambda x: x + np.where(follows, np.append(x[1:], 0), 0)
                norm = np.sqrt(pair(norm2))
                for place, v, latent, items, passages, rare, index in spaces:
                    row = place[bucket]
                    hit = np.flatnonzero(row >= 0)
                    known2 = np.bincount(of[hit], weights=w[hit] ** 2, minlength=total)
                    known = pair(known2)
                    run_of, run_passage = shared_runs(index, all_words, at, first)
                    marked = np.zeros(total, dtype=bool)
                    marked[run_of] = True
                    # |projection| <= sqrt(words) times the length of the known part: repeated words add up
                    live = np.flatnonzero(marked | (known * 4 >= (cosine * norm) ** 2))
                    edge = np.searchsorted(of[hit], np.arange(total + 1))
                    for c in range(0, len(live), COMPARED):
                        part = live[c:c + COMPARED]
                        proj = np.empty((len(part), v.shape[1]), dtype=np.float32)
                        for k in range(0, len(part), PROJECTED):
                            some = part[k:k + PROJECTED]
                            proj[k:k + PROJECTED] = _projections(some, some + follows[some], hit, edge, v, row, w)
                        long_enough = np.flatnonzero(marked[part] | ((proj * proj).sum(axis=1) >= (cosine * norm[part]) ** 2))
                        sims = proj[long_enough] @ latent.T / norm[part[long_enough]][:, None]
                        wanted = sims >= cosine
                        r = slice(*np.searchsorted(run_of, [part[0], part[-1] + 1]))
                        wanted[np.searchsorted(part[long_enough], run_of[r]), run_passage[r]] = True
                        for x, i in zip(*np.nonzero(wanted)):
                            blk = int(part[long_enough[x]])
                            doc = int(np.searchsorted(first, blk, side="right")) - 1
                            start = (blk - int(first[doc])) * half
                            # half a window on both sides: the passage may lie across the edge
                            text = all_words[at[doc] + max(0, start - half // 2):
                                             min(at[doc + 1], at[doc] + start + WINDOW + half // 2)].tolist()
                            p = passages[i]
                            share = lcs_length(p, text) / len(p)
                            found = len(rare[i].intersection(text)) / len(rare[i])
                            if share >= lcs or (share >= lcs_paraphrase and found >= answer):
                                out.append((ids[doc], items[i], start, float(sims[x, i]), share, found))
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 ["doc_id", "item_id", "start_word", "cosine", "lcs_share", "answer_share"])

    return search

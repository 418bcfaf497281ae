"""Substring dedup, periodic runs and the prefix trie against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cohortspark.llm import periodic_runs, prefix_trie, substring_dedup
from cohortspark.llm.words import Words

DOCS = "doc_id long, text string, spans string, a int, m long, runs int, kept string"
TURNS = "conv_id long, turn long, role string, text string, name string, depth int, path string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def words_of(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)

    def some(n, k=400):
        return [f"w{rnd.randint(1, k)}" for _ in range(n)]

    shared = [some(rnd.randint(20, 70)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = some(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            w += rnd.choice(shared) + some(rnd.randint(0, 15))
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[5][1]) for i in range(30)]                 # a large group of copies
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, rows[5][1]), (None, None), (203, "one two"),
             (204, "again " * 400), (205, "again " * 300), (206, ("é ß 中国 😀 \xa0x " * 40)), (206, rows[6][1]), (206, rows[6][1]),
             (207, "a b c " * 9 + " ".join(some(300))), (208, " ".join(some(40_000, 5000)))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in texts], DOCS).repartition(5)


@pytest.mark.parametrize("size,gram,slices", [(20, 6, 2048), (20, 6, 0), (8, 16, 2048), (1, 1, 2048)])
def test_substring_dedup(docs, texts, size, gram, slices):
    first = {}
    for i, t in texts:
        if i is not None:
            w = words_of(t)
            for j in range(len(w) - size + 1):
                key = tuple(w[j:j + size])
                first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, t in texts:
        w = words_of(t)
        gone = [False] * len(w)
        for j in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[j:j + size])] < i:
                gone[j:j + size] = [True] * size
        spans = tuple((m.start(), m.end()) for m in re.finditer("x+", "".join("x" if g else "." for g in gone)))
        want[i, len(w), sum(gone), spans, " ".join(x for x, g in zip(w, gone) if not g)] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, tuple((s.start, s.end) for s in r.removed), r.kept)
                              for r in substring_dedup.remove_repeats(docs, size, gram, slices).collect())
    assert got == want


def test_sketch_never_underestimates():
    rnd = np.random.default_rng(3)
    docs = [np.unique(rnd.integers(0, 50_000, 3000, dtype=np.uint64)) for _ in range(40)]
    counts = np.bincount(np.concatenate(docs).astype(np.int64), minlength=50_000)
    v = np.zeros((2, substring_dedup.CELLS), dtype=np.int64)
    for d in docs:
        at, c0, c1 = substring_dedup._cells(d, 1)
        np.add.at(v, (at, c0), 1)
        np.add.at(v, (at, c1), 1)
    v = np.minimum(v, 2).astype(np.uint8)
    packed = np.stack([x.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8) for x in v])
    keys = np.arange(50_000, dtype=np.uint64)
    est = substring_dedup._estimate(packed, *substring_dedup._cells(keys, 1))
    assert (est >= np.minimum(counts, 2)).all()


def brute_runs(w, min_length, min_exponent):
    out = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((i, j - i, q) for (i, j), q in out.items())


def test_runs_are_exact():
    rnd = random.Random(2)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            w = [str(rnd.randint(1, rnd.choice([1, 2, 3, 30]))) for _ in range(rnd.choice([0, 1, 5, 6, 7, 40, 120]))]
            for _ in range(rnd.randint(0, 3)):
                block = [str(rnd.randint(1, 3)) for _ in range(rnd.randint(1, 8))]
                at = rnd.randint(0, len(w))
                w[at:at] = (block * 9)[:rnd.randint(len(block), 9 * len(block))]
            texts.append(w)
        batch = Words([" ".join(w) for w in texts])
        length, exponent = rnd.choice([(6, 4), (6, 4), (2, 2), (4, 3)])
        found = periodic_runs.runs_of(batch.hashes, np.repeat(np.arange(len(texts)), np.diff(batch.offsets)), length, exponent)
        for k, w in enumerate(texts):
            lo = int(batch.offsets[k])
            assert sorted((i - lo, j - i, q) for (i, j), q in found.get(k, {}).items()) == brute_runs(w, length, exponent)


def test_periodic_runs_query(docs, texts):
    got = collections.Counter(tuple(r) for r in periodic_runs.digest(
        periodic_runs.find_runs(docs, order=periodic_runs.planted)).collect())
    want = collections.Counter()
    for i, t in texts:
        w = words_of(t)
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        if n > 10_000:
            assert len(set(zip(w, w[1:], w[2:], w[3:], w[4:]))) > n - 10  # nothing repeats but by chance
            runs = []
        else:
            runs = brute_runs(w, 6, 4)
        drop = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        want[(i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
              sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
              sha(" ".join(x for k, x in enumerate(w) if k not in drop)))] += 1
    assert got == want


@pytest.fixture(scope="module")
def turns(spark):
    rnd = random.Random(4)
    rows = []
    start = [("user", "hello"), ("assistant", "hi é"), ("user", "more 😀")]
    for c in list(range(0, 130)) + list(range(500, 540)):
        v = start[:rnd.randint(0, 3)] + [(rnd.choice(["user", None, ""]), rnd.choice(["a", "bb", None, "", "ccc ccc"]))
                                         for _ in range(rnd.randint(1, 9))]
        rows += [(c, k if k else None, *t) for k, t in enumerate(v)]
    rows += [(900, k, "user", f"turn {k % 7}") for k in range(150)]     # a deep one and its copies
    rows += [(900 + j, k, "user", f"turn {k % 7}") for j in (1, 2, 3) for k in range(150 - j)]
    rows += [(None, 1, "user", "lost"), (950, 3, "a", "x"), (950, 3, "a", "x"), (951, 1, "a", "long " * 50_000)]
    return rows


def test_prefix_trie(spark, turns):
    df = spark.createDataFrame([(*t, "n", 1, "p") for t in turns], TURNS).repartition(4)
    own = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        v = tuple(own.get(c - c % 100, [])[:h] + v[h:])
        for d in range(len(v) + 1):
            members[v[:d]].add(c)
        ends[v].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += children[k] == 0
        if k:
            saved[k] += (len(members[k]) - 1) * len(k[-1][1])
            children[k[:-1]] += 1
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    want = collections.Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
         sha(",".join(map(str, sorted(ends[k]))))) for k, m in members.items())
    trie = prefix_trie.build_trie(prefix_trie.with_shared_starts(prefix_trie.conversations(df))).drop("name", "parent")
    assert trie.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert collections.Counter(tuple(r) for r in trie.collect()) == want


def test_pieces_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    df = spark.createDataFrame([(i, None, None, None, "", 0, "") for i in range(100)], TURNS)
    rows = prefix_trie.build_trie(prefix_trie.conversations(df)).orderBy("depth").collect()
    assert [(r.n_convs, r.n_leaves) for r in rows] == [(100, 1), (100, 1)]
    assert [r.ends_sha256 for r in rows] == [sha(""), sha(",".join(map(str, range(100))))]


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert periodic_runs.digest(periodic_runs.find_runs(docs)).count() == 0
    turns = spark.createDataFrame([], TURNS)
    assert prefix_trie.build_trie(prefix_trie.with_shared_starts(prefix_trie.conversations(turns))).count() == 0

"""Line dedup against brute force on texts from a small pool of lines."""

import random
import re

import pytest

from cohortspark.llm import line_dedup

SCHEMA = "doc_id long, text string, h string, w int, start int"


def lines_of(text):
    """(line number, line, words) of the lines that are not blank."""
    out = []
    for p, m in enumerate(re.finditer(line_dedup.LINE, text.lower())):
        t = m.group().strip(" \n\r\t")
        if t:
            out.append((p, t, t.count(" ") + 1))
    return out


def brute(texts, min_words):
    """doc_id -> line numbers in maximal stretches of min_words words that stood before (earlier text, or earlier here)."""
    done = {i: lines_of(t) for i, t in texts if i is not None and t}
    gone = {i: set() for i in done}
    for i, a in done.items():
        for j, b in done.items():
            if j > i:
                continue
            for shift in range(1 - len(a), len(b)):
                if i == j and shift >= 0:
                    continue
                k = max(0, -shift)
                while k < len(a) and k + shift < len(b):
                    e = k
                    while e < len(a) and e + shift < len(b) and a[e][1] == b[e + shift][1]:
                        e += 1
                    if sum(x[2] for x in a[k:e]) >= min_words:
                        gone[i].update(x[0] for x in a[k:e])
                    k = max(e, k) + 1
    return gone


@pytest.mark.parametrize("min_words,longest", [(50, 40), (12, 6), (1, 3)])
def test_everything_repeated_goes(spark, min_words, longest):
    rnd = random.Random(min_words)
    pool = [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(1, longest))) for _ in range(25)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 14)):
            own = " ".join(f"o{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(1, longest)))
            at = rnd.randrange(len(pool))
            parts += pool[at:at + rnd.randint(1, 6)] if rnd.random() < 0.5 else [rnd.choice(pool + [own])]
        texts.append((i, "".join(x + rnd.choice(["\n", ". ", "!\n", "\n\n"]) for x in parts)))
    texts += [(100 + i, texts[3][1]) for i in range(20)] + [(200, None), (201, ""), (None, texts[4][1]), (202, "same line here\n" * 300)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], SCHEMA).repartition(4)
    want = brute(texts, min_words)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_words).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        assert set(got[i].removed) == want.get(i, set()), i
        assert got[i].n_removed == len(got[i].removed)

"""Language ID by rank-order profiles (operator 9).

A language's profile is the ranked list of its ``profile_size`` most frequent
character 1- to 3-grams (letters only, lower case, words padded by a blank).
A document's own ranked list is compared with every profile by the
out-of-place distance: the sum over its n-grams of the difference of ranks, or
of ``profile_size`` where the profile lacks the n-gram.  The nearest profile
names the language.

Learning is one distributed count over all training rows: each task sums its
(language, n-gram) counts in numpy, Spark adds the partial counts and ranks
them per language; only profile_size rows a language reach the driver.

Defined results: null text or text without a letter gives ``und`` with score
0; without training rows every row is ``und``; equal distances go to the
first language by name, equal counts to the smaller n-gram; rows with null
lang are never learned from; repeated rows and null doc_id pass through;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import BATCH_CHARS, RELEASE, by_text_chars, map_arrow

FOLD_ROWS = 300_000  # counts that a task holds besides its sums; speed and memory only
_LETTER: list[np.ndarray] = []
RELEASE["lang_id"] = _LETTER.clear


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter folded to 16 bits, 0 for what is no letter."""
    if not _LETTER:
        lut = np.zeros(0x110000, dtype=np.uint16)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                lut[cp] = (ord(low) if len(low) == 1 else cp) & 0xFFFF or 1
        _LETTER.append(lut)
    return _LETTER[0]


def gram_counts(texts: list[str | None], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) over all texts; n-grams are 48-bit integers.

    owner[i] (< 2**14) is the number under which the n-grams of texts[i] are
    counted.  Sorted by owner, then n-gram.
    """
    joined = "\n".join(t or "" for t in texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = _letters()[cps].astype(np.int64)
    own = np.repeat(owner.astype(np.int64), np.array([len(t or "") + 1 for t in texts]))
    keep = (s != 0) | np.concatenate(([False], s[:-1] != 0))
    s, own = s[keep], own[keep]
    if not len(s):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    s = np.concatenate(([0], s))
    own = np.concatenate((own[:1], own))
    pad = 0xFFFF
    one = s != 0
    keys = [(own[one] << 48) | (pad << 32) | (pad << 16) | s[one]]
    a, b = s[:-1], s[1:]
    keys.append((np.where(a != 0, own[:-1], own[1:]) << 48) | (pad << 32) | (a << 16) | b)
    if len(s) > 2:
        mid = s[1:-1] != 0
        keys.append(((own[1:-1] << 48) | (s[:-2] << 32) | (s[1:-1] << 16) | s[2:])[mid])
    keys = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> 48, keys & ((1 << 48) - 1), counts


def learn_profiles(docs: DataFrame, profile_size: int = 400) -> dict[str, list[int]]:
    """docs(text, lang): language -> its n-grams by falling count."""
    def count(batches):
        names: list[str] = []
        total: list[tuple[np.ndarray, ...]] = []

        def fold():
            own, gram, n = (np.concatenate(x) for x in zip(*total))
            key = (own << 48) | gram
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            total[:] = [(key[first] >> 48, key[first] & ((1 << 48) - 1), np.add.reduceat(n, first))]

        def emit():
            fold()
            own, gram, n = total.pop()
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in own], pa.string()), pa.array(gram), pa.array(n, pa.int64())],
                ["lang", "gram", "n"])

        for b in by_text_chars(batches, BATCH_CHARS):
            langs = b.column(1).to_pylist()
            for x in set(langs) - set(names):
                names.append(x)
            at = {x: i for i, x in enumerate(names)}
            got = gram_counts(b.column(0).to_pylist(), np.array([at[x] for x in langs]))
            if len(got[0]):
                total.append(got)
                if sum(len(x[0]) for x in total[1:]) > max(FOLD_ROWS, len(total[0][0])):
                    fold()
            if len(names) > 8000:  # numbers of languages must fit the key: hand on and start anew
                if total:
                    yield emit()
                names.clear()
        if total:
            yield emit()

    rows = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    sums = map_arrow(rows, count, "lang string, gram long, n long", keeps="lang_id").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.select("lang", "gram", rank.alias("r")).where(F.col("r") <= profile_size)
    out: dict[str, list[int]] = {}
    for x in sorted(top.collect(), key=lambda x: (x["lang"], x["r"])):
        out.setdefault(x["lang"], []).append(x["gram"])
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], profile_size: int = 400) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score).

    score is 1 minus the distance as a share of the largest possible one.
    """
    langs = sorted(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
    ranks = np.full((len(grams), len(langs)), -1, dtype=np.int32)
    for j, x in enumerate(langs):
        ranks[np.searchsorted(grams, np.array(profiles[x], dtype=np.int64)), j] = np.arange(len(profiles[x]))

    def score(batches):
        for b in by_text_chars(batches, BATCH_CHARS):
            texts = b.column(1).to_pylist()
            best, value = ["und"] * len(texts), np.zeros(len(texts))
            own, gram, n = gram_counts(texts, np.arange(len(texts)))
            if len(own) and langs:
                order = np.argsort((own << 40) + ((1 << 40) - 1 - n), kind="stable")
                own, gram = own[order], gram[order]
                start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                size = np.diff(np.append(start, len(own)))
                place = np.arange(len(own)) - np.repeat(start, size)
                top = place < profile_size
                own, gram, place = own[top], gram[top], place[top]
                at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                r = np.where((grams[at] == gram)[:, None], ranks[at], -1)
                dist = np.where(r >= 0, np.abs(r - place[:, None]), profile_size)
                start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                total = np.add.reduceat(dist, start, axis=0)
                used = np.diff(np.append(start, len(own)))
                near = total.argmin(axis=1)
                for d, j, v in zip(own[start], near, 1 - total.min(axis=1) / (used * profile_size)):
                    best[d], value[d] = langs[j], v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(value)],
                                             ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score,
                     "doc_id long, lang_pred string, score double", keeps="lang_id")


def held_out(doc_id="doc_id"):
    """Rows kept away from learning: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profile_size: int = 400) -> DataFrame:
    """Learn from the rows that are not held out, predict all rows."""
    profiles = learn_profiles(docs.where(~held_out()), profile_size)
    return predict(docs, profiles, profile_size)

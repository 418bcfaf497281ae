"""Memory of the pipeline's tasks: a worker's arrays follow a slice of its batch, not the batch."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import bpe, decontaminate, lang_id, ngram_join
from cohortspark.llm.common import map_arrow

RND = random.Random(3)
VOCABULARY = ["".join(RND.choice("etaoinshrdlucm") for _ in range(RND.randint(2, 8))) for _ in range(3000)]
TEXTS = [" ".join(RND.choices(VOCABULARY, k=400)) for _ in range(2000)]  # about 4.4 MB


class Caught(Exception):
    pass


def task_of(module, monkeypatch, make):
    """The function that ``make`` hands to the first map_arrow."""
    def catch(df, fn, schema, keeps=None):
        raise Caught(fn)

    with monkeypatch.context() as m:
        m.setattr(module, "map_arrow", catch)
        with pytest.raises(Caught) as e:
            make()
    return e.value.args[0]


def peak_mb(fn, *columns):
    names, arrays = zip(*columns)
    batch = pa.RecordBatch.from_arrays(list(arrays), list(names))
    list(fn(iter([batch.slice(0, 50)])))  # tables that a worker keeps
    tracemalloc.start()
    list(fn(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


IDS, TEXT = ("doc_id", pa.array(range(len(TEXTS)), pa.int64())), ("text", pa.array(TEXTS))
LANG = ("lang", pa.array([("en", "fr")[i % 2] for i in range(len(TEXTS))]))


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_language(df, monkeypatch):
    learn = task_of(lang_id, monkeypatch, lambda: lang_id.learn_profiles(df))
    assert peak_mb(learn, TEXT, LANG) < 45
    grams = list(range(400))
    score = task_of(lang_id, monkeypatch, lambda: lang_id.predict(df, {"en": grams, "fr": grams}))
    assert peak_mb(score, IDS, TEXT) < 45


def test_shingles(df, monkeypatch):
    count = task_of(ngram_join, monkeypatch, lambda: ngram_join._heavy_shingles(df, 5, 0.002))
    assert peak_mb(count, TEXT) < 40
    sets = task_of(ngram_join, monkeypatch, lambda: ngram_join._sets(df, 5, 80, 100, np.zeros(0, np.uint64)))
    assert peak_mb(sets, IDS, TEXT) < 25


def test_leaks(df, monkeypatch):
    count = task_of(decontaminate, monkeypatch, lambda: decontaminate.inverse_frequencies(df))
    assert peak_mb(count, TEXT) < 18
    idf = np.ones(decontaminate.FEATURES)
    rng = np.random.default_rng(1)
    passages = [decontaminate._words([" ".join(RND.choices(VOCABULARY, k=60))])[0] for _ in range(256)]
    buckets = np.unique(decontaminate._buckets(np.concatenate(passages)))
    place = np.full(decontaminate.FEATURES, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets))
    v = np.linalg.qr(rng.standard_normal((len(buckets), 256)))[0].astype(np.float32)
    latent = np.zeros((256, 256), dtype=np.float32)
    space = (place, v, latent, list(range(256)), [p.tolist() for p in passages], [set(p.tolist()) for p in passages],
             decontaminate.run_index(passages))
    search = decontaminate._search(SimpleNamespace(value=(idf.astype(np.float32), [space])), 0.25, 0.7, 0.5, 0.8)
    assert peak_mb(search, IDS, TEXT) < 60


def test_bpe(df, monkeypatch):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = task_of(bpe, monkeypatch, lambda: bpe.encode_digest(df, path))
    list(encode(iter([pa.RecordBatch.from_arrays([IDS[1], TEXT[1]], ["doc_id", "text"])])))  # its words are known then
    assert peak_mb(encode, IDS, TEXT) < 12


@pytest.mark.parametrize("least", [1, 2, 4, 4.5, 40])
def test_frequent(least):
    x = np.random.default_rng(4).geometric(0.05, 500).astype(np.uint64)
    values, n = np.unique(x, return_counts=True)
    got = ngram_join.frequent(x, least)
    assert got[0].tolist() == values[n >= least].tolist() and got[1].tolist() == n[n >= least].tolist()
    assert not len(ngram_join.frequent(x[:3], 40)[0])


def test_batches_to_workers(spark):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    long = spark.range(0, 60, 1, 1).selectExpr("repeat('some text ', 30000) text")
    got = [r["n"] for r in map_arrow(long, size, "n long").collect()]
    assert sum(got) > 17e6 and max(got) < 5e6

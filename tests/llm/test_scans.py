"""License and secret scans against brute force on random texts; long texts; forms that must be found."""

import hashlib
import random
import re
import time

import pytest

from cohortspark.llm import license_scan, secret_scan
from cohortspark.llm.common import match_spans
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, base int, spans string, found string, words int"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def test_license_base_against_brute_force(spark):
    rnd = random.Random(8)
    parts = ["MIT", "mit", "license", "License", "apache", "general", "public", "GENERAL", "Public", "İ", "é", "x1", ",", ".", " ", "\n",
             "-", "licensee", "\x7f", "😀", "_"]
    texts = [None, "", "mit license " * 3000] + [
        "".join(rnd.choice(parts) + rnd.choice([" ", " ", "", "-", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scan_licenses(table(spark, texts))).collect()}
    phrases = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
        places = [(k, label) for p, label in phrases for k in range(len(w)) if tuple(w[k:k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@pytest.mark.parametrize("text,label", [
    ("This is free software: GNU GPL v3", "gpl-3.0"), ("released under GPLv2", "gpl-2.0"), ("GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("LGPL-2.1-only", "lgpl-2.1"), ("Apache-2.0", "apache-2.0"), ("AGPLv3", "agpl-3.0"), ("under the GNU GPL.", "gpl"),
    ("MPL-2.0", "mpl-2.0")])
def test_short_names(spark, text, label):
    got = license_scan.digest(license_scan.scan_licenses(table(spark, ["before " + text + " after"]))).first()
    assert label in got.labels.split(",")


def base_spans(t):
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m.group(1)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out)


def test_secret_base_against_brute_force(spark):
    rnd = random.Random(4)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ": ", "'", '"', " ", "\n", "AKIA", "ABCDEFGH12345678", "0123456789abcdef",
             "deadbeef", "x", "é", "😀", "abc", "._-", "hunter2", "İ", "K"]
    texts = [None, "", "token=abcdef12 " * 2000] + [
        "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(500)]
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.find_secrets(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in (0, 1, 2)]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("text,found", [
    ("key qwhzkxjvbnpdtyfgmlrcseuaio here", True), ("KEY QWHZKXJVBNPDTYFGMLRCSEUAIO here", True),
    ("aB3dE5fG7hI9jK1lM3nO5pQ7rS9t-path-to-file", True), ("aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU2w/example", True),
    ("id 83910274659018273645", True), ("some/path/to/another/file/name", False), ("this-is-example-this-is-example", False),
    ("123e4567-e89b-12d3-a456-426614174000", False), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaa", False)])
def test_entropy_spans(spark, text, found):
    got = secret_scan.digest(secret_scan.find_secrets(table(spark, [text]))).first()
    assert (got.n_entropy > 0) is found


def test_spans_of_a_long_text(spark):
    text = "".join(f"ab{'é' * (i % 3)}x{i} " for i in range(40_000))
    began = time.time()
    rows = spark.createDataFrame([(text,)], "t string").select(F.inline(match_spans(F.col("t"), "x[0-9]+"))).collect()
    assert [(r.start, r.end, r.match) for r in rows] == [(m.start(), m.end(), m.group()) for m in re.finditer("x[0-9]+", text)]
    assert time.time() - began < 60
    assert spark.createDataFrame([("",)], "t string").select(match_spans(F.col("t"), "x").alias("m")).first().m == []

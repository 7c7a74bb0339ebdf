"""Importance resampling against plain Python, its radix selection against sorting, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [zlib.crc32(w.encode()) % importance.BUCKETS for w in WORD.findall(lowered)]


def wanted(docs, target):
    """Rows (doc_id, n_features, weight, score, rank) for rows (doc_id, text)."""
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    found = []
    for doc_id, text in docs:
        own = buckets(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + importance.BUCKETS) / ((s[b] + 1) * (all_t + importance.BUCKETS)))) for b in own]
        h = int(hashlib.sha256(f"{importance.SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(own) if own else 0
        found.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in found if r[1] >= importance.LEAST_WORDS), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(able[: importance.PERCENT * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, found), key=repr)


def test_words_of_odd_texts():
    texts = ["Ab-c9 Été", "", None, "x", "y" * 300 + "\x00" + "y", "ß\U0001f600a", " "]
    for rows in (pa.array(texts), pa.array(["zz", *texts], pa.large_string())[1:], pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        found, at = importance.word_buckets(rows)
        assert [found[at == i].tolist() for i in range(len(rows))] == [buckets(x) for x in rows.to_pylist()]


def test_resample_against_python(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma", "déjà", "x1", "the", "of"]
    docs = [(int(i), " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 60, 400))]
    docs += [(7, docs[7][1])] * 3 + [(None, "one two " * 30), (None, "one two " * 30), (500, None), (501, ""), (502, "-- !"), (503, "Beta " * 40_000)]
    target = ["alpha beta beta", None, "déjà"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("id", "n", "w", "weight", "rank", "_row", "_down", "bucket")})
    found = importance.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == wanted(docs, target)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, f"word{i} " * 25) for i in range(20)], "doc_id long, text string")
    assert importance.resample(none, some.select("text")).collect() == []
    assert sorted(map(tuple, importance.resample(some, none.select("text")).collect()), key=repr) == wanted([tuple(r) for r in some.collect()], [])


@pytest.mark.parametrize("hot", [False, True])
def test_radix_selection_against_sorting(spark, hot):
    """A third of all rows on one key, negative and far apart keys; exactly k rows don't exceed the bound."""
    rng = np.random.default_rng(11)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(-(1 << 62), 1 << 62, 300), rng.integers(-3, 3, 300), strict=True))]
    rows = [(-5, 2, i) if hot and i % 3 == 0 else (a % 7 - 3 if hot else a, b, i) for a, b, i in rows]
    frame = spark.createDataFrame(rows, "a long, b long, c long")
    for k in (1, 2, 99, 150, 299, 300):
        bound = importance.kth_key(frame, ["a", "b", "c"], k)
        assert frame.where(importance._not_above(["a", "b", "c"], bound)).count() == k
        assert sorted(map(tuple, frame.where(importance._not_above(["a", "b", "c"], bound)).collect())) == sorted(rows)[:k]


def test_ranks_over_many_parts(spark):
    frame = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"), F.lit("x").alias("other"))
    assert all(r.rank == r.k + 1 for r in importance.ranked(frame, ["k"], "rank").collect())

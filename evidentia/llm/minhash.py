"""MinHash fingerprints: universal hash permutations of word shingles in numpy, bands joined in Spark, Jaccard verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType

from evidentia.llm.components import connected_components
from evidentia.llm.shared import materialize, small_batches

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 16
SIMILARITY = 0.8
#: A bucket's texts are compared with so many of them at once.
LEADERS = 32
_BLOCK, _ROWS = 1 << 20, 256
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_MODULUS = 1 << 64


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    draw = rng.integers(0, _MODULUS, (2, PERMUTATIONS), np.uint64, endpoint=False)
    return draw[0] | np.uint64(1), draw[1]


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``size`` (a power of two) of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, _MODULUS)):
        powers = np.ones(1, np.uint64)
        while len(powers) < size:
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), _MODULUS))])
        out.append(powers)
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> np.ndarray:
    """A polynomial hash per word, the same wherever the word stands; long texts go block by block, cut at white space."""
    letters = np.frombuffer(data.lower(), np.uint8)
    found, at = [], 0
    while at < len(letters):
        end = min(len(letters), at + _BLOCK)
        while end < len(letters) and not _SPACE[letters[end]]:
            end += 1
        block = letters[at:end]
        at = end
        inside = np.concatenate([[False], ~_SPACE[block], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            powers, inverse = _powers(1 << max(12, int(len(block)).bit_length()))
            run = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * powers[: len(block)], out=run[1:])
            found.append(_mixed((run[ends] - run[starts]) * inverse[starts]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash per run of ``width`` words (of all of them, if they are fewer; none for no words)."""
    words = _word_hashes(text.encode())
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(total)]
    return _mixed(total)


def signature(text: str) -> np.ndarray:
    """A byte per permutation, from the least permuted shingle hash; all 0 for a text without words."""
    hashes = shingles(text)
    if not len(hashes):
        return np.zeros(PERMUTATIONS, np.uint8)
    times, plus = _permutations()
    least = np.full(PERMUTATIONS, _MODULUS - 1, np.uint64)
    for i in range(0, len(hashes), _ROWS):
        np.minimum(least, (hashes[i : i + _ROWS, None] * times + plus).min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(56)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: the share of equal bytes, less what chance makes equal."""
    return float(max(0.0, ((a == b).mean() - 1 / 256) / (1 - 1 / 256)))


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


_FOUND = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, tail) of a range of documents in order, then those that follow the range, of which the first counts."""
    shape = pa.schema(_FOUND)
    held, ended = None, False
    for batch in batches:
        rows = []
        for doc, text, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ended:
                continue
            text = text or ""
            mark = signature(text)
            if held:
                before, words, own = held
                changed = edited(words, text)
                other = signature(changed)
                rows.append((before, len(words), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, mark)))
            held, ended = (doc, text, mark), bool(tail)
        columns = zip(*rows, strict=True) if rows else [[]] * len(shape)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)


def fingerprints_with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, with those of its edited text and its likeness to the next document.

    The next document is that of the next larger id, after the last that of the first; null ids come first, and rows of one id
    follow each other in order of their texts, null texts first. A null text is empty. Two texts without words are alike.
    A single document is its own next one. No rows give no rows.

    The texts are dealt to ranges of ids in one shuffle; the documents that begin a range are also sent to the range before.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    splits = rows.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = np.unique(np.array(splits if n > 1 else [], np.int64))

    @F.arrow_udf(IntegerType())
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    first = {r["p"]: r["k"] for r in rows.select(place(key).alias("p"), key.alias("k")).groupBy("p").agg(F.min("k").alias("k")).collect()}
    order = sorted(first)
    before = {first[p]: order[i - 1] for i, p in enumerate(order)}

    @F.arrow_udf(ArrayType(IntegerType()))
    def places(keys: pa.Array) -> pa.Array:
        values = keys.to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, values, side="right").tolist()
        return pa.array([[p, before[k]] if k in before else [p] for p, k in zip(at, values.tolist(), strict=True)], pa.list_(pa.int32()))

    dealt = rows.select("doc_id", "text", F.posexplode(places(key)).alias("tail", "part"))
    parts = dealt.repartitionById(len(bounds) + 1, "part").select("doc_id", "text", F.col("tail").cast("int").alias("tail"))
    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return parts.sortWithinPartitions("tail", "doc_id", "text").mapInArrow(_neighbours, shape)


@F.arrow_udf(BinaryType())
def _signatures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([signature(x or "").tobytes() for x in batch.to_pylist()], pa.binary())


@F.arrow_udf(ArrayType(LongType()))
def _shingle_sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([np.unique(shingles(x or "")).view(np.int64) for x in batch.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(DoubleType())
def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    found = []
    for x, y in zip(a, b, strict=True):
        x, y = x.values.to_numpy(), y.values.to_numpy()
        both = len(np.intersect1d(x, y, assume_unique=True))
        found.append(both / max(1, len(x) + len(y) - both) if len(x) or len(y) else 1.0)
    return pa.array(found, pa.float64())


def _pairs(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, leaders: int = LEADERS) -> DataFrame:
    """(id, class_id) per row: class_id is the least id reachable by verified pairs.

    Rows of equal texts are one node. A pair counts if two texts share a bucket in a band of the signatures and the exact Jaccard
    similarity of their shingle sets is ``similarity`` or more. A bucket compares its texts with its ``leaders`` least ones. Those
    similar to a leader leave with it; as 1 less the similarity is a metric, they can only be similar to texts whose similarity
    to that leader is 2 * similarity - 1 or more, and are compared with these. What is left is a bucket again, until none is.
    Null texts are empty; texts without words are one class. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", F.sha2("text", 256))
    texts = keyed.groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(texts.select("node", _signatures("text").alias("mark"), _shingle_sets("text").alias("shingles")), "minhash")
    width = PERMUTATIONS // BANDS
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.substring("mark", b * width + 1, width).alias("value")) for b in range(BANDS)]))
    left = materialize(sets.select("node", bands.alias("b")).select("node", "b.band", "b.value"), "minhash-bands")
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))

    def judge(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.join(a, "u").join(b, "v").select("u", "v", _jaccard("x", "y").alias("jaccard")), "minhash-pairs")

    bucket, enough = ["band", "value"], F.col("jaccard") >= similarity
    edges = None
    while edges is None or not left.isEmpty():
        order = F.row_number().over(Window.partitionBy(*bucket).orderBy("node"))
        led = left.withColumn("order", order).where(F.col("order") <= leaders).select(*bucket, F.col("node").alias("lead"))
        met = left.join(led, bucket).where("node != lead").select("node", "lead", *bucket, *_pairs("node", "lead"))
        judged = judge(met.select("u", "v").distinct())
        met = materialize(met.join(judged, ["u", "v"]).select("node", "lead", *bucket, "jaccard"), "minhash-met")
        taken = met.where(enough).groupBy("node", *bucket).agg(F.min("lead").alias("lead"))
        near = met.where(~enough & (F.col("jaccard") >= 2 * similarity - 1 - 1e-9)).select(F.col("node").alias("mate"), "lead", *bucket)
        chained = taken.join(near, [*bucket, "lead"]).where("node != mate").select(*_pairs("node", "mate")).distinct()
        chained = judge(chained.join(judged, ["u", "v"], "left_anti"))
        found = judged.unionAll(chained).where(enough).select("u", "v")
        edges = found if edges is None else edges.unionAll(found)
        gone = taken.select("node", *bucket).unionAll(led.select(F.col("lead").alias("node"), *bucket))
        left = materialize(met.select("node", *bucket).distinct().join(gone, ["node", *bucket], "left_anti"), "minhash-bands")
    roots = connected_components(edges)
    members = keyed.select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    classes = members.groupBy("root").agg(F.min("id").alias("class_id"))
    return members.join(classes, "root").select(F.col("id").alias(id_col), "class_id")

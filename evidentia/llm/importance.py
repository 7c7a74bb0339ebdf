"""Importance resampling of documents towards the word distribution of a target.

Words are hashed into a fixed number of buckets. A bucket's gain says how much more often the target uses it; a document's weight is the mean
gain of its words, looked up in one array. Gumbel noise of the id makes the highest scores a draw in proportion to the weights. The score that
just makes it is found by radix selection: each round counts the rows by one more digit of the composite key, so that only the drawn rows are
sorted at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evidentia.llm.shared import byte_view, materialize, small_batches

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Bits of a digit of the radix selection: so many counts at most reach the driver in a round.
DIGIT = 16
_LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of every stretch of ``data``: a byte of all stretches at a time, long ones each by itself."""
    order = np.argsort(-sizes, kind="stable")
    at, ascending = starts[order], sizes[order][::-1]
    crc = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for j in range(min(_LONG_WORD, int(ascending[-1])) if len(sizes) else 0):
        n = len(sizes) - int(np.searchsorted(ascending, j, side="right"))
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    found = np.empty(len(sizes), np.uint32)
    found[order] = ~crc
    for i in np.flatnonzero(sizes > _LONG_WORD):
        found[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return found


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word of the texts, in order. A word never crosses rows; null texts have none."""
    data, offsets = byte_view(texts)
    data = _LOWER[data]
    inside = _INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] |= inside[offsets[:-1][np.diff(offsets) > 0]]
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    outside = np.flatnonzero(np.append(~inside, True))
    ends = np.minimum(outside[np.searchsorted(outside, starts)], offsets[rows + 1])
    return (crc32_of(data, starts, ends - starts) % np.uint32(BUCKETS)).astype(np.int64), rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(word_buckets(batch.column(0))[0], minlength=BUCKETS)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many words of all texts fall into a bucket; summed per task before the shuffle, ``BUCKETS`` rows at most."""
    return texts.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, gain) of every bucket: ``floor(1000 * ln)`` of how many times as often the target uses it, with one word more in each bucket."""
    spark = docs.sparkSession
    counted = bucket_counts(docs, text_col).withColumn("t", F.lit(0)).unionAll(bucket_counts(target, text_col).select("bucket", F.lit(0), F.col("n")))
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).alias("n"), F.lit(0).alias("t"))
    sums = materialize(counted.unionAll(every).groupBy("bucket").agg(F.sum("n").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "gains")
    all_s, all_t = (F.lit(float(x)) for x in sums.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1) * (all_s + BUCKETS) / ((F.col("s") + 1) * (all_t + BUCKETS))
    return sums.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths, told by the id alone; a null id is written as nothing."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def _digit(word: str, k: int) -> Column:
    """The k-th digit from above of a signed 64-bit word, in an order of unsigned digits."""
    biased = F.col(word).bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(biased, 64 - DIGIT * (k + 1)).bitwiseAND((1 << DIGIT) - 1)


def kth_key(rows: DataFrame, words: list[str], k: int) -> tuple[int, ...]:
    """A bound that exactly ``k`` of the rows don't exceed, comparing the 64-bit ``words`` in turn.

    ``words`` tell all rows apart and ``k`` is from 1 to their number. Every round counts the rows that agree with the digits found so far by
    their next digit; a round sends 2**DIGIT counts to the driver at most. It ends early where all that agree are wanted.
    """
    per_word = 64 // DIGIT
    left, found = rows, []
    for word in words:
        for j in range(per_word):
            counts = sorted(left.groupBy(_digit(word, j).alias("digit")).count().collect())
            for digit, n in counts:
                if k <= n:
                    break
                k -= n
            found.append(digit)
            if k == n:
                rest = len(words) * per_word - len(found)
                found += [(1 << DIGIT) - 1] * rest
                return tuple(_joined(found[i : i + per_word]) for i in range(0, len(found), per_word))
            left = left.where(_digit(word, j) == digit)
    raise ValueError("the words don't tell all rows apart")


def _joined(digits: list[int]) -> int:
    value = 0
    for d in digits:
        value = value << DIGIT | d
    return value - (1 << 63)


def _not_above(words: list[str], bound: tuple[int, ...]) -> Column:
    last = F.col(words[-1]) <= bound[-1]
    return last if len(words) == 1 else (F.col(words[0]) < bound[0]) | ((F.col(words[0]) == bound[0]) & _not_above(words[1:], bound[1:]))


def ranked(rows: DataFrame, order: list[str], rank: str) -> DataFrame:
    """``rows`` with their number from 1 in ``order``: range-partitioned, sorted by part, and moved on by the sizes of the parts before."""
    place = "_place"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned(place, 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for i, n in sizes:
        starts.append((i, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(rank, F.col("_before") + F.col(place).bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", place)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``: those drawn have a rank, from 1, the others null.

    Of the N rows of ``least_words`` words or more, floor(percent * N / 100) are drawn: the highest scores, ties to the smaller id, rows without
    an id last, equal rows of one id one after the other. Null and wordless texts have weight 0 and are never drawn. Other columns are left
    out, whatever their names. No rows give no rows; an empty target draws by how rare a document's words are.
    """
    small_batches(docs.sparkSession)
    table = np.zeros(BUCKETS, np.int64)
    for bucket, gain in gains(docs, target, text_col).collect():  # BUCKETS rows, whatever the corpus
        table[bucket] = gain

    @F.arrow_udf(StructType([StructField("n", LongType()), StructField("weight", LongType())]))
    def weighed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            buckets, rows = word_buckets(batch)
            n = np.bincount(rows, minlength=len(batch)).astype(np.int64)
            ends = np.cumsum(n)
            run = np.concatenate([[0], np.cumsum(table[buckets])])
            yield pa.StructArray.from_arrays([pa.array(n), pa.array((run[ends] - run[ends - n]) // np.maximum(n, 1))], ["n", "weight"])

    found = docs.select(F.col(f"`{id_col}`").alias("id"), weighed(F.col(f"`{text_col}`").cast("string")).alias("w"))
    scored = found.select("id", F.col("w.n").alias("n_features"), F.col("w.weight").alias("weight")).withColumn("score", F.col("weight") + noise(F.col("id")))
    keys = ["_down", "_id", "_row"]
    scored = scored.withColumns({"_down": -F.col("score"), "_id": F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1)), "_row": F.monotonically_increasing_id()})
    scored = materialize(scored, "scored")
    able = F.col("n_features") >= least_words
    k = percent * scored.where(able).count() // 100
    chosen = able & _not_above(keys, kth_key(scored.where(able).select(*keys), keys, k)) if k else F.lit(False)
    drawn = ranked(scored.where(chosen), keys, "rank")
    every = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

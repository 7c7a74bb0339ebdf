"""SimHash fingerprints and near-duplicate groups by anchor-point covering.

Two 64-bit fingerprints within 2 bits of each other differ in at most one bit of their upper or of
their lower half. In each half the anchors are a covering code: the perfect [31,26] code (covering
radius 1) over 31 bits, with the 32nd bit kept whole. Every fingerprint is at home with the anchor that
covers it, and is replicated to every anchor within covering radius plus one; two fingerprints whose
halves differ in one bit at most therefore meet at the home of either. Candidates are compared in full
at the anchor, so the links are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from evidentia.llm.components import connected_components
from evidentia.llm.shared import dealt, free_name, materialize, salt, small_batches, with_least

SEED = 42
BITS = 64
#: The compare at an anchor covers one or two differing bits, as each half's code spends one of them.
THRESHOLD = 2
_CHUNK = 1 << 16


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; without words 0, with fewer than ``shingle`` words of them all."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    width = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, n, counts = xxhash.xxh64_digest, len(starts), np.zeros(BITS, np.int64)
    for i in range(0, n, _CHUNK):
        hashes = b"".join([digest(text[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


@F.arrow_udf(LongType())
def simhash(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(x) for x in text.cast(pa.binary()).to_pylist()], pa.int64())


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _syndrome(half: Column) -> Column:
    """Of the low 31 bits: the exclusive or of the positions (1 to 31) of the bits that are set."""
    total = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        total = total + F.bit_count(half.bitwiseAND(F.lit(mask))) % 2 * (1 << k)
    return total


def _masks(near: bool) -> Column:
    """By syndrome: what to flip to reach the home anchor, or all anchors within one bit more than the radius."""
    free = 1 << 31
    rows = []
    for s in range(32):
        home = 1 << (s - 1) if s else 0
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if s and 0 < i < (i ^ s)]
        rows.append([home, home | free, *pairs] if near else [home])
    return F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in rows])


def _anchored(fingerprints: DataFrame, near: bool) -> DataFrame:
    """fp -> (half, anchor, fp): a row for each half's home anchor or for each anchor nearby."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), low.alias("bits")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("bits"))))
    at = fingerprints.select("fp", halves.alias("h")).select("fp", "h.half", "h.bits")
    return at.select("fp", "half", "bits", F.explode(F.element_at(_masks(near), _syndrome(F.col("bits")).cast("int") + 1)).alias("mask")).select(
        "half", F.col("bits").bitwiseXOR(F.col("mask")).alias("anchor"), "fp"
    )


def links(fingerprints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs (u, v), u < v, that differ in at most 2 bits."""
    homes = _anchored(fingerprints, near=False).withColumnRenamed("fp", "u")
    nearby = _anchored(fingerprints, near=True).withColumnRenamed("fp", "v")
    return (
        dealt(homes).join(dealt(nearby), ["half", "anchor"])
        .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD))
        .select("u", "v")
        .distinct()
    )


def _placed(prints: DataFrame) -> DataFrame:
    """(fp, root, least, cells) of ``prints`` (id, fp, cell): the group's least fingerprint, the print's least id and the cells its rows are in."""
    cells = prints.groupBy("fp", "cell").agg(F.min("id").alias("least"))
    nodes = materialize(cells.groupBy("fp").agg(F.min("least").alias("least"), F.collect_list("cell").alias("cells")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp")))
    placed = nodes.join(dealt(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(placed, "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp, component_id) per row of ``docs``; component_id is the least id reachable by links.

    Rows of one fingerprint, exact copies among them, are one node, so a group of copies costs one row in
    the search whatever its size. A null or wordless text has fingerprint 0 and links like any other.
    Repeated ids are kept, one result row per input row; null ids never are the least unless there is no
    other. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    prints = materialize(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp")), "simhash")
    celled = prints.withColumn("cell", salt("id"))
    classes = with_least(_placed(celled), "root", "least", "component_id").select("fp", F.explode("cells").alias("cell"), "component_id")
    return celled.join(dealt(classes), ["fp", "cell"]).select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of the least id.

    Of texts that differ under the least id of a group that of the least fingerprint stays, then that of the least
    digest, null texts first. An id may stay with several groups, one text of it for each. A row without an id stays
    only in a group where no row has one. Of rows of the same id and text any one stays. All columns are kept, whatever
    their names.
    """
    small_batches(docs.sparkSession)
    print_, digest, row = (free_name(docs, x) for x in ("_fp", "_digest", "_row"))
    # the row's number is written beside the print: it is never computed again
    marked = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(print_, simhash(F.col(text_col)))
    marked = materialize(marked.withColumn(digest, F.coalesce(F.sha2(F.col(text_col), 256), F.lit(""))), "simhash-marked")
    celled = marked.select(F.col(id_col).alias("id"), F.col(print_).alias("fp"), F.col(digest).alias("digest"), F.col(row).alias("row")).withColumn("cell", salt("row"))
    # one candidate per group: reduced in cells of a print first, so that copies are never gathered
    order = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col("fp").alias("fp"), F.col("digest").alias("digest"), F.col("row").alias("row"))
    best = celled.withColumn("best", order).groupBy("fp", "cell").agg(F.min("best").alias("best")).groupBy("fp").agg(F.min("best").alias("best"))
    roots = _placed(celled).select("fp", "root")
    one = best.join(dealt(roots), "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = one.select(F.col("best.row").alias(row))
    return marked.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A file is a stream of token ids in which an end-of-document id follows every document; nothing tells where documents begin. Tasks read
blocks of fixed size by their offsets, whatever the size of a file, and search them for the id in numpy, each by itself. A prefix scan over
what is known of a file's blocks (how many ids, how many separators, where the last one is) then tells every block where it starts, how many
documents ended before it and where the document that is open at its start began.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.packing import RANKS, ordinary
from evidentia.llm.shared import materialize, small_batches

END_ID = 50256
#: Ids in a block that a task reads at once.
BLOCK = 1 << 20
#: Names of documents in one row of the list that is written beside the files.
NAMES = 4096
_DTYPES = {2: "<u2", 4: "<u4"}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path)


def _writer(folder: str, ranks: str, end_id: int):
    shape = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that is run again writes another file; only the files that its rows name count
        path, out, size, first, names = f"{folder}/{uuid.uuid4().hex}.bin", None, 0, 0, []
        rows: list[tuple[int, list]] = []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    system, inner = _opened(path)
                    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(inner)
                ids = np.array([*ordinary(text.as_py() or "", ranks), end_id], "<u2")
                out.write(ids.tobytes())
                size += ids.nbytes
                names.append(doc.as_py())
                if len(names) == NAMES:
                    rows.append((first, names))
                    first, names = first + NAMES, []
        if out is not None:
            out.close()
            rows += [(first, names)] if names else []
            for first, names in rows:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([first]), pa.array([names], pa.list_(pa.int64()))], schema=shape)

    return write


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, end_id: int = END_ID) -> DataFrame:
    """Write the tokens of ``docs`` to flat files in ``folder``, which all executors share, one per partition that has rows.

    Returns rows (file, bytes, first, doc_ids): the documents that stand in a file, in order, ``NAMES`` to a row, ``first`` being the
    number of those before. The scan doesn't use it. Ids are little-endian and of 16 bits. Null texts are empty documents. What
    Python can't open by its URI can't be written.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_writer(folder, ranks, end_id), "file string, bytes long, first long, doc_ids array<long>")


def list_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files at ``path`` that aren't empty; they aren't opened."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def find_separators(files: DataFrame, end_id: int = END_ID, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Files (file, bytes) -> (file, block, size, ends) per block: its number of ids and where in it the separators are.

    ``width`` is the bytes of an id. A task reads the blocks it is dealt and nothing else; an empty file has no blocks. A file that doesn't
    end with a whole id raises an error when run.
    """
    step = block * width
    last = F.floor((F.col("bytes") - 1) / step).cast("long")
    whole = F.when(F.col("bytes") % width == 0, F.col("file")).otherwise(F.raise_error(F.concat(F.lit("no whole ids in "), "file")))
    asked = files.where("bytes > 0").select(whole.alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    shape = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = _opened(file)
                with system.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(step, number * step), _DTYPES[width])
                ends = np.flatnonzero(ids == end_id).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number]), pa.array([len(ids)]), pa.array([ends], pa.list_(pa.int32()))], schema=shape)

    return asked.repartition("file", "block").mapInArrow(scan, "file string, block long, size long, ends array<int>")


def count_tokens(found: DataFrame) -> DataFrame:
    """Blocks (file, block, size, ends) -> (file, place, start, n_tokens, closed) per document, ``place`` being its number in the file.

    The separator doesn't count. What follows the last separator of a file is a document that isn't closed; a file that ends
    with a separator has none. The scan goes over one row of three numbers per block of a file. No rows give no rows.
    """
    found = materialize(found, "separators")
    n = F.size("ends")
    slim = found.select("file", "block", "size", n.alias("n"), F.element_at("ends", F.when(n > 0, -1)).alias("last"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.withColumn("opened", F.col("offset") + F.col("last") + 1)
    state = placed.select(
        "file", "block", "offset", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"), F.coalesce(F.max("opened").over(before), F.lit(0)).alias("open"),
        F.coalesce("opened", F.max("opened").over(before), F.lit(0)).alias("tail"), F.lead("block").over(order).isNull().alias("final"),
    )
    each = found.join(state, ["file", "block"])
    starts = F.transform("ends", lambda e, i: F.when(i == 0, F.col("open")).otherwise(F.col("offset") + F.get("ends", i - 1) + 1))
    rows = F.zip_with(starts, "ends", lambda s, e: F.struct(s.alias("start"), (F.col("offset") + e - s).alias("n_tokens"), F.lit(True).alias("closed")))
    finish = F.col("offset") + F.col("size")
    open_end = F.when(F.col("final") & (F.col("tail") < finish), F.array(F.struct(F.col("tail").alias("start"), (finish - F.col("tail")).alias("n_tokens"), F.lit(False).alias("closed")))).otherwise(F.array())
    listed = each.select("file", "ended", F.posexplode(F.concat(rows, open_end)).alias("nth", "doc"))
    return listed.select("file", (F.col("ended") + F.col("nth")).alias("place"), "doc.start", "doc.n_tokens", "doc.closed")


def named(counts: DataFrame, written: DataFrame) -> DataFrame:
    """``counts`` with the ``doc_id`` of every document, from the rows of ``write_token_files``."""
    names = written.select("file", F.col("first").alias("_first"), "doc_ids")
    keyed = counts.withColumn("_first", F.col("place") - F.col("place") % NAMES)
    return keyed.join(names, ["file", "_first"]).withColumn("doc_id", F.get("doc_ids", (F.col("place") % NAMES).cast("int"))).drop("_first", "doc_ids")

"""What readers return, as tables: OCR trees, and the replies of a remote reader in JSON.

Readers, catalogues and remote services are given by the caller as functions over batches (``read_with``, ``search_with``); nothing here opens a
connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.geometry import line_height
from evidentia.functions.labels import as_confidence
from evidentia.functions.text import SPACE, collapse

_BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
_WORDS = f"array<struct<text: string, confidence: double, bbox: {_BOX}>>"
#: The tree that a recogniser returns for an image.
TREE = f"text string, blocks array<struct<paragraphs: array<struct<lines: array<struct<text: string, confidence: double, bbox: {_BOX}, words: {_WORDS}>>>>>>"
READING = "title string, author string, confidence int, title_alternates array<string>, author_alternates array<string>, raw_text string, reason string"
READ_BY_REMOTE = "read from the cover by the remote reader"
ALTERNATIVE = "another reading that the remote reader offers"
#: Words that mean that nothing was read.
NOTHING_READ = "(?i)^(null|none|n/a|unknown|unreadable)$"


def photos(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, modificationTime, length, content) of image files; the id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "modificationTime", "length", "content")


def lines_of(trees: DataFrame, tree: str = "tree") -> DataFrame:
    """Trees (scan_id, pass_no, tree, page_height) -> lines (scan_id, pass_no, line_no, text, confidence, bbox, height, words, page_height).

    Blank words and lines are left out; white space in a line is one space. A line's height is the upper median of its words'.
    """
    none = F.expr(f"cast(array() as {_WORDS})")
    flat = F.flatten(F.transform(F.flatten(F.transform(F.coalesce(f"{tree}.blocks", F.array()), lambda b: F.coalesce(b["paragraphs"], F.array()))), lambda p: F.coalesce(p["lines"], F.array())))

    def line(x: Column) -> Column:
        words = F.filter(F.coalesce(x["words"], none), lambda w: _trimmed(w["text"]) != "")
        return F.struct(collapse(x["text"]).alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("bbox"), words.alias("words"))

    kept = F.filter(F.transform(flat, line), lambda x: x["text"] != "")
    rest = [c for c in trees.columns if c != tree]
    rows = trees.select(*rest, F.posexplode(kept).alias("line_no", "l"))
    return rows.select(*rest, "line_no", "l.text", "l.confidence", "l.bbox", "l.words", line_height(F.col("l.words"), F.col("l.bbox")).alias("height"))


def texts_of(trees: DataFrame, tree: str = "tree") -> DataFrame:
    """(scan_id, pass_no, text, mean_confidence): the tree's own text or its lines, and the mean confidence of all its words, 0 without any."""
    keys = ["scan_id", "pass_no"]
    found = lines_of(trees.select(*keys, tree), tree)
    joined = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("lines"), F.flatten(F.collect_list("words")).alias("words"))
    total = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["confidence"])
    mean = F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, total / F.size("words")).otherwise(0.0)
    whole = F.coalesce(f"{tree}.text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), F.lit(""))
    return trees.select(*keys, tree).join(joined, keys, "left").select(*keys, whole.alias("text"), mean.alias("mean_confidence"))


def reply_text(payload: Column) -> Column:
    """The text of the first candidate of a remote reader's JSON reply, its parts joined; null if there is none."""
    shape = "candidates array<struct<content: struct<parts: array<variant>>>>"
    parts = F.get(F.from_json(payload, shape)["candidates"], F.lit(0))["content"]["parts"]
    texts = F.filter(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "variant")), lambda t: F.schema_of_variant(t) == "STRING")
    joined = F.array_join(F.transform(texts, lambda t: F.try_variant_get(t, "$", "string")), "")
    return F.when(_trimmed(joined) != "", joined)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _said(value: Column) -> Column:
    """A variant's text, trimmed; null if it is no text, blank, or a word for nothing."""
    text = _trimmed(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")))
    return F.when((text != "") & ~text.rlike(NOTHING_READ), text)


def _alternates(record: Column, field: str, winner: Column) -> Column:
    """The texts of an array, without repeats in whatever case and without the winner; none if it isn't an array."""
    listed = F.coalesce(F.try_variant_get(record, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.filter(F.transform(listed, _said), lambda x: x.isNotNull())
    first = F.filter(texts, lambda x, i: ~F.exists(F.slice(texts, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return F.filter(first, lambda x: ~x.eqNullSafe(winner))


def parse_readings(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """``replies`` with the fields of ``READING`` and ``error``: null, or "malformed" for a text without a JSON object that parses.

    A fence, a preamble or an array around the object do no harm. A reading without title and author has confidence 0.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(raw), r"(?i)^\s*```(?:json)?", ""), r"```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    rows = replies.withColumn("_record", F.when(inner != "", F.try_parse_json(inner)))
    record = F.col("_record")

    def field(name: str) -> Column:
        return F.try_variant_get(record, f"$.{name}", "variant")

    rows = rows.withColumns({"title": _said(field("title")), "author": _said(field("author"))})
    sure = F.when(F.schema_of_variant(field("confidence")) == "STRING", F.try_variant_get(record, "$.confidence", "string")).otherwise(F.try_variant_get(record, "$.confidence", "double").cast("string"))
    rows = rows.withColumns(
        {
            "confidence": F.when(F.col("title").isNull() & F.col("author").isNull(), 0).otherwise(as_confidence(sure)),
            "title_alternates": _alternates(record, "titleAlternates", F.col("title")),
            "author_alternates": _alternates(record, "authorAlternates", F.col("author")),
            "raw_text": F.coalesce(_said(field("rawText")), F.lit("")),
            "reason": F.coalesce(_said(field("reason")), F.lit(READ_BY_REMOTE)),
            "error": F.when(record.isNull(), F.lit("malformed")),
        }
    )
    return rows.drop("_record")


def detections_of(readings: DataFrame) -> DataFrame:
    """Readings that aren't malformed as detections: nothing read is an empty text, the source is the remote reader."""
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author")]
    return readings.where("error is null").select("scan_id", *empty, "confidence", "reason", "title_alternates", "author_alternates", F.lit("ai").alias("source"), "raw_text")


def evidence_of(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections with ``raw_text`` -> lines and hypotheses in the shapes that the identification takes.

    Every line that isn't blank has the reading's confidence and an empty box. The hypotheses are the reading and its first two other titles.
    """
    parts = F.filter(F.transform(F.split("raw_text", r"\r?\n"), _trimmed), lambda x: x != "")
    zero = F.lit(0.0)
    box = F.struct(*[zero.alias(e) for e in ("x0", "y0", "x1", "y1")])
    lines = detections.select("scan_id", F.lit(0).alias("pass_no"), F.posexplode(parts).alias("line_no", "text"), F.col("confidence").cast("double").alias("confidence"), box.alias("bbox"), F.expr(f"cast(array() as {_WORDS})").alias("words"))
    sure = F.col("confidence").cast("double")
    own = F.struct(F.col("title").alias("title"), (sure / 100).alias("score"), F.col("reason").alias("reason"))
    others = F.transform(F.slice("title_alternates", 1, 2), lambda t: F.struct(t.alias("title"), (F.greatest(zero, sure - 20) / 100).alias("score"), F.lit(ALTERNATIVE).alias("reason")))
    ranked = detections.select("scan_id", "author", sure.alias("author_confidence"), F.posexplode(F.concat(F.array(own), others)).alias("nth", "h"))
    return lines, ranked.select("scan_id", (F.col("nth") + 1).alias("rank"), "h.title", "author", "h.score", "h.reason", "author_confidence")


Batches = Iterator[pd.DataFrame]


def read_with(images: DataFrame, reader: Callable[[pd.DataFrame], pd.DataFrame], shape: str) -> DataFrame:
    """Images through a reader that the caller gives: batches (image_id, ...) -> rows of ``shape``.

    A reader that fails on a batch is asked for each of its images alone; an image it fails on gives a row with ``error`` and nulls, and
    the others go on. ``shape`` must have image_id and error.
    """

    def work(batches: Batches) -> Batches:
        def alone(row: pd.DataFrame) -> pd.DataFrame:
            try:
                return reader(row)
            except Exception as e:  # whatever a reader raises is its answer for this image
                return pd.DataFrame({"image_id": row["image_id"], "error": [f"{type(e).__name__}: {e}"]})

        names = [x.split()[0] for x in shape.split(", ")]
        for batch in batches:
            try:
                found = reader(batch)
            except Exception:  # found out image by image
                found = pd.concat([alone(batch.iloc[i : i + 1]) for i in range(len(batch))])
            found = found.reindex(columns=names)
            yield pd.DataFrame({n: pd.Series(found[n].tolist(), dtype=object) for n in names})

    return images.mapInPandas(work, shape)


def search_with(queries: DataFrame, client: Callable[[str, int], list[dict]], limit: int = 5) -> DataFrame:
    """(scan_id, query_no, query) through a catalogue client that the caller gives -> (scan_id, query_no, place, title, author_name, edition_count).

    A client that fails gives a row with ``error`` and no document; a query without documents gives no row.
    """

    def work(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for scan, number, query in batch.itertuples(index=False):
                try:
                    found = client(query, limit)
                except Exception as e:  # a failed search is no reason to fail the scan
                    rows.append((scan, number, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(scan, number, i, d.get("title"), d.get("author_name"), d.get("edition_count"), None) for i, d in enumerate((found or [])[:limit], 1)]
            yield pd.DataFrame(rows, columns=["scan_id", "query_no", "place", "title", "author_name", "edition_count", "error"])

    return queries.select("scan_id", "query_no", "query").mapInPandas(work, "scan_id long, query_no int, place int, title string, author_name array<string>, edition_count int, error string")

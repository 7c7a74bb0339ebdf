"""Reading by a chain of remote models, and by the device where they fail.

A model is a function over a batch of images that the caller gives; nothing here opens a connection. Each image is routed by itself: an answer
that says the model is gone sends it to the next model, any other failure sends it to the second reader at once, and a batch with failures goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.labels import classify_failure, describe_failure, is_model_retired
from evidentia.sources.readings import detections_of, parse_readings, reply_text
from evidentia.sources.scratch import stored

ANSWER = "status int, body string, raised string"


@dataclass(frozen=True)
class Model:
    """``ask(batch)`` answers a batch of images (image_id, ...) with rows (image_id, status, body), an HTTP status and a text; it may raise."""

    name: str
    ask: Callable[[pd.DataFrame], pd.DataFrame]


def _answers(images: DataFrame, model: Model) -> DataFrame:
    """``images`` with the model's answer. A batch that raises is asked image by image; what an image raises is its answer (``raised``)."""

    def one(row: pd.DataFrame) -> tuple:
        try:
            got = model.ask(row).iloc[0]
            return int(got["status"]), got["body"], None
        except Exception as e:  # a model may raise anything
            kind = "timeout" if isinstance(e, TimeoutError) or "abort" in type(e).__name__.lower() or "timeout" in type(e).__name__.lower() else "network"
            return None, None, kind

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                got = model.ask(batch).set_index("image_id")
                rows = [(int(got.at[i, "status"]), got.at[i, "body"], None) for i in batch["image_id"]]
            except Exception:  # found out image by image
                rows = [one(batch.iloc[i : i + 1]) for i in range(len(batch))]
            answers = pd.DataFrame(rows, columns=["status", "body", "raised"], dtype=object)
            yield pd.concat([batch.reset_index(drop=True), answers], axis=1)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields)
    return images.mapInPandas(work, f"{shape}, {ANSWER}")


def _failure(status: Column, body: Column, text: Column) -> Column:
    """The kind of failure of an answer, null where it holds a text that can be parsed."""
    good = status.between(200, 299)
    return F.when(F.col("raised").isNotNull(), F.col("raised")).when(~good, classify_failure(status, body)).when(text.isNull(), F.lit("malformed"))


def read_by_models(images: DataFrame, models: list[Model]) -> DataFrame:
    """``images`` (image_id, ...) with ``model``, ``tried`` and the fields of a reading, or with ``error``, the kind of failure.

    Models are asked in order, each only for the images whose models so far are all gone; if all are, the failure is the server's. A name that
    is listed again is asked once.
    """
    if not models:
        raise ValueError("no model is configured")
    first: dict[str, Model] = {}
    for m in models:
        first.setdefault(m.name, m)
    order = list(first.values())
    left, settled = images, None
    for nth, model in enumerate(order, 1):
        answered = stored(_answers(left, model), "answers")
        gone = F.coalesce(is_model_retired(F.col("status"), F.col("body")), F.lit(False))
        last = nth == len(order)
        done = (answered if last else answered.where(~gone)).withColumns({"model": F.lit(model.name), "tried": F.lit(nth)})
        settled = done if settled is None else settled.unionByName(done)
        left = answered.where(gone).select(*images.columns)
        if last or left.isEmpty():
            break
    text = F.when(F.col("status").between(200, 299), reply_text(F.col("body")))
    rows = settled.withColumn("raw", text).withColumn("_failed", _failure(F.col("status"), F.col("body"), F.col("raw")))
    parsed = parse_readings(rows)
    return parsed.withColumn("error", F.coalesce("_failed", "error")).drop("_failed", "status", "body", "raised")


def read_with_fallback(images: DataFrame, models: list[Model], device: Callable[[DataFrame], DataFrame], wanted: Column | None = None) -> DataFrame:
    """Detections of all ``images`` (image_id, ...): by the models where ``wanted`` holds, by ``device`` for the others and for those that failed.

    ``device(images)`` gives detections (scan_id, title, author, confidence, reason, title_alternates, author_alternates, source, raw_text); it sees each image at
    most once. ``fell_back`` says what went wrong before, ``failure`` is its kind; both are null where nothing did.
    """
    asked = images if wanted is None else images.where(F.coalesce(wanted, F.lit(False)))
    readings = stored(read_by_models(asked, models).withColumnRenamed("image_id", "scan_id"), "remote")
    good = detections_of(readings).withColumns({"failure": F.lit(None).cast("string"), "fell_back": F.lit(None).cast("string")})
    failed = readings.where("error is not null").select("scan_id", F.col("error").alias("failure"), describe_failure(F.col("error")).alias("fell_back"))
    done = good.select(F.col("scan_id").alias("image_id"))
    own = device(images.join(done, "image_id", "left_anti")).join(failed, "scan_id", "left")
    return good.unionByName(own.select(*good.columns))

"""Language identification with hyperdimensional letter-trigram profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors,
each permuted (rotated) by its place; a document's vector bundles (adds) the vectors of its trigrams; a
language's prototype bundles those of its sample documents. The prediction is the prototype of the largest
cosine with the document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from evidentia.llm.shared import free_name, small_batches

DIMENSIONS = 1024
SYMBOLS = 128
#: Learning takes about this many documents of each language, chosen by a hash of their ids.
SAMPLE_PER_LANGUAGE = 1000
UNDETERMINED = "und"
#: Two standard deviations of the cosine of unrelated vectors, and how many letters a text has to have to be refused for less. Short texts of a
#: language and those of one word over and over come as low as 2.1 deviations.
LEAST, ENOUGH = 2 / DIMENSIONS**0.5, 20
_PIECE, _DOCS, _COLUMNS = 1 << 19, 128, 2048


@lru_cache(1)
def _symbols() -> np.ndarray:
    """By code point: 0 for what is no letter, a to z, and 101 symbols that all other letters share."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = code - 96 if 97 <= code <= 122 else 27 + code % 101
    return table


@lru_cache(1)
def _item_memory() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = np.random.default_rng(10).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams with a letter in the middle, and the place in ``texts`` that each comes from."""
    joined = "\n".join(texts).lower()
    if len(joined) != sum(map(len, texts)) + len(texts) - 1:  # a few letters grow in lower case
        texts = [x.lower() for x in texts]
        joined = "\n".join(texts)
    codes = _symbols()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts])[: len(codes)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    codes, owner = codes[keep].astype(np.int32), owner[keep]
    codes = np.pad(codes, 1)
    middle = codes[1:-1]
    inside = middle > 0
    return ((codes[:-2] << 14) | (middle << 7) | codes[2:])[inside], owner[inside]


def encode(texts: list[str]) -> np.ndarray:
    """A row of bundled trigram vectors per text; zero where a text has no letter."""
    first, second, third = _item_memory()
    out = np.zeros((len(texts), DIMENSIONS), np.float64)
    place = np.zeros(SYMBOLS**3, np.int32)

    def flush(batch: list[tuple[int, str]]) -> None:
        grams, owner = _trigrams([x for _, x in batch])
        if not len(grams):
            return
        place[grams] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        counts = np.bincount(owner * len(used) + place[grams], minlength=len(batch) * len(used)).reshape(len(batch), -1).astype(np.float32)
        place[used] = 0
        total = np.zeros((len(batch), DIMENSIONS), np.float32)
        for i in range(0, len(used), _COLUMNS):
            g = used[i : i + _COLUMNS]
            total += counts[:, i : i + _COLUMNS] @ (first[g >> 14] * second[g >> 7 & 127] * third[g & 127])
        np.add.at(out, [row for row, _ in batch], total)

    batch, size = [], 0
    for row, text in enumerate(texts):
        for i in range(0, max(1, len(text)), _PIECE):
            piece = text[max(0, i - 2) : i + _PIECE]
            batch.append((row, piece))
            size += len(piece)
            if len(batch) >= _DOCS or size >= _PIECE:
                flush(batch)
                batch, size = [], 0
    if batch:
        flush(batch)
    return out


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) -> a bundle per language of what a task has; a few documents are held at a time."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for i in range(0, batch.num_rows, _DOCS):
            part = batch.slice(i, _DOCS)
            for lang, vector in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                total[lang] = total.get(lang, 0.0) + vector
    if total:
        vectors = pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), vectors], ["lang", "vector"])


def learn(docs: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[float]]:
    """Prototypes by language, from about ``sample`` documents of each, chosen by a hash of their ids.

    Rows without text, language or id, and those that ``may_learn`` excludes, are not learned from. What reaches the
    driver is one vector per language.
    """
    rows = docs.where(may_learn & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang is not null and id is not null")
    shares = {r["lang"]: min(1.0, sample / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return {}
    share = F.create_map(*[x for lang, p in shares.items() for x in (F.lit(lang), F.lit(p))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    parts = chosen.mapInArrow(_bundled, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("place", "value"))
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
    found = sums.select("lang", F.transform("v", lambda x: x["value"]).alias("vector")).collect()
    return {r["lang"]: r["vector"] for r in sorted(found, key=lambda r: r["lang"]) if any(r["vector"])}


def predictor(prototypes: dict[str, list[float]]):
    """A column function: text -> struct<lang_pred, score>; score is the best cosine, 0 at least."""
    names = list(prototypes)
    matrix = np.array([prototypes[x] for x in names], np.float64).reshape(len(names), DIMENSIONS)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    shape = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def judge(texts: list[str]) -> tuple[list[str], np.ndarray]:
        vectors = encode(texts)
        norms = np.linalg.norm(vectors, axis=1)
        if not names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cosines = vectors @ matrix.T / np.maximum(norms, 1e-9)[:, None]
        lang = [names[b] if n else UNDETERMINED for b, n in zip(cosines.argmax(axis=1), norms > 0, strict=True)]
        return lang, np.where(norms > 0, np.clip(cosines.max(axis=1), 0, 1), 0.0)

    @F.arrow_udf(shape)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lang, score = [], np.zeros(0)
            for i in range(0, len(batch), _DOCS):  # the vectors of few documents are held at a time
                some, scores = judge([x or "" for x in batch.slice(i, _DOCS).to_pylist()])
                lang += some
                score = np.concatenate([score, scores])
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """Documents kept out of learning: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) per row.

    Learns from the rows that are not held out; neither language, source nor id is an input of a prediction. Null
    texts and texts without a letter are ``und`` with score 0; so is everything where nothing could be learned.
    Ties go to the first language by name. Repeated rows stay, no rows give no rows.
    """
    small_batches(docs.sparkSession)
    prototypes = learn(docs, ~held_out(id_col), text_col, lang_col, id_col)
    guess = predictor(prototypes)(F.col(text_col))
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), guess.alias("guess")).select(id_col, "held_out", "guess.lang_pred", "guess.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: Sequence[str] | None = None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` in a language: one of ``languages``, or any that could be learned.

    Null texts and texts without a letter go. So do texts of ``ENOUGH`` letters or more whose cosine with every prototype is below ``least``,
    which is as near as unrelated vectors may come by chance: other scripts, noise, code. Shorter texts can't be told apart and stay.
    Repeated rows stay, all columns stay, no rows give no rows. Where no row has a language to learn from, none can be told apart: all stay.
    """
    small_batches(docs.sparkSession)
    prototypes = learn(docs, ~held_out(id_col), text_col, lang_col, id_col)
    if not prototypes:
        return docs
    guess = free_name(docs, "_guess")
    found = docs.withColumn(guess, predictor(prototypes)(F.col(text_col)))
    lang, score = F.col(guess)["lang_pred"], F.col(guess)["score"]
    kept = found.where((lang != UNDETERMINED) & ((score >= least) | (F.regexp_count(F.col(text_col), F.lit(r"\p{L}")) < ENOUGH)))
    return (kept if languages is None else kept.where(lang.isin(list(languages)))).drop(guess)

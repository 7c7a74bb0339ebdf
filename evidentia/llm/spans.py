"""Substring deduplication by sliding spans of sentences.

From every sentence on, the shortest run of several consecutive sentences that has enough words is a span. A passage may also begin and end
inside sentences, or be one: of all runs of ``WORDS`` words, those of the least hash among ``WINDOW`` that follow each other are spans too. Which
these are is told by the words alone, so equal runs of WORDS + WINDOW - 1 words share one wherever they stand. Spans are hashed, joined over all
documents, and what a span covers which is not the first of its kind is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from evidentia.llm.minhash import _mixed, _powers
from evidentia.llm.shared import free_name, materialize, small_batches

#: A span of sentences has so many of them, and so many words, at least. From this number of words on, documents that share a span nearly always
#: share more than it; of those that share a shorter one a growing part shares nothing else (stock phrases, greetings). See the README for figures.
SENTENCES = 2
SENTENCE_WORDS = 15
#: Words of a run that neither begins nor ends with a sentence; fewer words are more often a quotation, a name or a list than a copy.
WORDS = 38
#: One word, or so many in turn, over and over is no passage.
REPEATING = 4
#: Of so many runs of words in a row one is a span at least. It is below ``WORDS``, so that spans leave no gap inside a passage; with it every
#: repeated run of WORDS + WINDOW - 1 words holds a span.
WINDOW = 12
_BLOCK = 1 << 20
_WHITE = np.array([chr(i).isspace() for i in range(0x3002)])
_BREAK = re.compile(r"[.!?]+\s+|\s*\n\s*")


def _cuts(text: str) -> list[int]:
    """Where sentences begin, and the end of the last one."""
    cuts = [0, *(m.end() for m in _BREAK.finditer(text))]
    return cuts if cuts[-1] == len(text) else [*cuts, len(text)]


def sentences(text: str) -> list[str]:
    """The pieces of a text between ends of sentences or lines, each with the white space after it; joined they are the text."""
    cuts = _cuts(text)
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _lowered(text: str) -> str:
    """Lower case of as many code points."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, whatever its case, and where it begins; long texts go block by block, cut at white space."""
    points = np.frombuffer(_lowered(text).encode("utf-32-le", "surrogatepass"), "<u4")
    hashes, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(points):
        end = min(len(points), at + _BLOCK)
        while end < len(points) and not chr(points[end]).isspace():
            end += 1
        block = points[at:end]
        inside = np.concatenate([[False], ~_WHITE[np.minimum(block, len(_WHITE) - 1)], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        powers, inverse = _powers(1 << max(12, len(block).bit_length()))
        run = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * powers[: len(block)], out=run[1:])
        hashes.append(_mixed((run[ends] - run[starts]) * inverse[starts]))
        begins.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(begins)


def _one_over_and_over(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which runs of words are the first few of them over and over; runs have twice ``REPEATING`` words at least."""
    found = np.zeros(len(starts), bool)
    for p in range(1, REPEATING + 1):
        odd = ~found & (hashes[starts] == hashes[starts + p]) & (hashes[ends - 1] == hashes[ends - 1 - p])
        for i in np.flatnonzero(odd).tolist():
            found[i] = np.array_equal(hashes[starts[i] + p : ends[i]], hashes[starts[i] : ends[i] - p])
    return found


Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def span_hashes(hashes: np.ndarray, first: np.ndarray, least: int = SENTENCES, words: int = SENTENCE_WORDS) -> Spans:
    """Hash, first sentence and end of every span, from the hashes of a text's words and the number of each sentence's first word (with the end after the last).

    What is hashed are the words, and which of them begin a sentence.
    """
    n = len(first) - 1
    start = np.arange(n)
    end = np.maximum(start + least, np.searchsorted(first, first[:-1] + words))
    start, end = start[end <= n], end[end <= n]
    marked = hashes.copy()
    marked[first[:-1][first[:-1] < first[1:]]] ^= np.uint64(0x9E3779B97F4A7C15)
    powers, inverse = _powers(1 << max(12, len(marked).bit_length()))
    run = np.zeros(len(marked) + 1, np.uint64)
    np.cumsum(marked * powers[: len(marked)], out=run[1:])
    a, b = first[start], first[end]
    told = ~_one_over_and_over(hashes, a, b)
    return _mixed((run[b] - run[a]) * inverse[a])[told].view(np.int64), start[told], end[told]


def _sliding(values: np.ndarray, window: int, of: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``window`` values in a row, by doubling."""
    size = 1
    while size * 2 <= window:
        values, size = of(values[:-size], values[size:]), size * 2
    return of(values[: len(values) - (window - size)], values[window - size :])


def _runs(hashes: np.ndarray, words: int) -> np.ndarray:
    """The value of every run of ``words`` words as a number whose digits are the words' hashes, put together from shorter runs."""
    value, size, power = hashes, 1, 0xD6E8FEB86659FD93
    for bit in bin(words)[3:]:
        value = value[:-size] * np.uint64(power) + value[size:]
        size, power = size * 2, power * power % 2**64
        if bit == "1":
            value = value[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[size:]
            size, power = size + 1, power * 0xD6E8FEB86659FD93 % 2**64
    return value


def run_hashes(hashes: np.ndarray, words: int = WORDS, window: int = WINDOW) -> Spans:
    """Hash, first word and end of the chosen runs of ``words`` words, in order; they may overlap."""
    if len(hashes) - words + 1 < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = _mixed(_runs(hashes, words))
    # a run is chosen if it is the least of any of the windows that hold it, ties too
    most = _sliding(np.pad(_sliding(runs, window, np.minimum), window - 1), window, np.maximum)
    chosen = np.flatnonzero(most == runs)
    chosen = chosen[~_one_over_and_over(hashes, chosen, chosen + words)]
    return runs[chosen].view(np.int64), chosen, chosen + words


def spans_of(text: str, cuts: list[int]) -> Spans:
    """Hash, begin and end (of the white space after it) of every span of a text whose sentences lie between ``cuts``; case and white space don't count."""
    hashes, begins = _words(text)
    bounds = np.array(cuts)
    told, start, end = span_hashes(hashes, np.searchsorted(begins, bounds))
    run, head, tail = run_hashes(hashes)
    begins = np.append(begins, len(text))
    return np.concatenate([told, run]), np.concatenate([bounds[start], begins[head]]), np.concatenate([bounds[end], begins[tail]])


_FOUND = StructType([StructField("hashes", ArrayType(LongType())), StructField("inside", BooleanType())])


@F.arrow_udf(_FOUND)
def _hashes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A text's distinct span hashes, and whether it has any of them twice."""
    for batch in texts:
        rows, inside = [], []
        for text in batch.to_pylist():
            every = spans_of(text or "", _cuts(text or ""))[0]
            rows.append(np.unique(every))
            inside.append(len(rows[-1]) < len(every))
        yield pa.StructArray.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(inside, pa.bool_())], ["hashes", "inside"])


_CLEANED = StructType([StructField("text", StringType()), StructField("sentences", LongType()), StructField("removed", LongType())])


@F.arrow_udf(_CLEANED)
def _without(texts: pa.Array, repeated: pa.Array) -> pa.Array:
    """Texts without what repeated spans cover, and spans that stood in the same text before; a sentence that lost a word counts as removed.

    Null instead of repeated spans says that the text has none of either kind.
    """
    cleaned, counts, removed = [], [], []
    for text, known in zip(texts.to_pylist(), repeated.to_pylist(), strict=True):
        cuts = _cuts(text or "")
        counts.append(len(cuts) - 1)
        if known is None or not text:
            cleaned.append(text)
            removed.append(0)
            continue
        told, begins, ends = spans_of(text, cuts)
        gone = np.isin(told, np.array(known, np.int64))
        # of a span that stands in the text more than once the earliest stays, unless another document was first
        order = np.lexsort((begins, told))
        gone[order[1:]] |= told[order[1:]] == told[order[:-1]]
        edge = np.zeros(len(text) + 1, np.int32)
        np.add.at(edge, begins[gone], 1)
        np.add.at(edge, ends[gone], -1)
        lost = np.cumsum(edge[:-1]) > 0
        edges = np.flatnonzero(np.diff(lost, prepend=True, append=True)).tolist()
        cleaned.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if lost.any() else text)
        removed.append(int(np.count_nonzero(np.logical_or.reduceat(lost, cuts[:-1]))))
    return pa.StructArray.from_arrays([pa.array(cleaned, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["text", "sentences", "removed"])


def _document(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: the id, or the text where there is none."""
    return [F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)))]


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cleaned, and ``n_sentences`` and ``n_removed``, sentences before and those of them that are removed or lost words.

    The first of equal spans is the one of the least id, documents without one coming last, and the earliest there. Rows of one id are one
    document: a span that any of them is first with stays in all of them; rows without an id are told apart by their texts. Null texts stay
    null. No rows give no rows. A column named like an added one is replaced.
    """
    small_batches(docs.sparkSession)
    unknown, document, spans, cleaned = (free_name(docs, x) for x in ("_unknown", "_document", "_spans", "_cleaned"))
    ids = [c.alias(n) for c, n in zip(_document(id_col, text_col), (unknown, document), strict=True)]
    held = materialize(docs.select(*ids, _hashes(F.col(text_col)).alias(spans)), "spans")
    runs = held.select(unknown, document, F.explode(f"{spans}.hashes").alias("h"))
    known = F.min(F.when(~F.col(unknown), F.col(document)))
    first = runs.groupBy("h").agg(known.alias("known"), F.min(document).alias("other"), F.count("*").alias("n")).where("n > 1")
    first = first.select("h", F.col("known").isNull().alias("first_unknown"), F.coalesce("known", "other").alias("first"))
    later = runs.join(first, "h").where((F.col(unknown) != F.col("first_unknown")) | (F.col(document) != F.col("first")))
    # a document that repeats itself alone has an empty list
    inside = held.where(f"{spans}.inside").select(unknown, document, F.lit(None).cast("long").alias("h"))
    covered = later.select(unknown, document, "h").unionByName(inside).groupBy(unknown, document).agg(F.collect_set("h").alias(spans))
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *ids).join(covered, [unknown, document], "left")
    rows = rows.withColumn(cleaned, _without(F.col(text_col), F.col(spans)))
    out = [F.col(cleaned)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in kept]
    return rows.select(*out, F.col(cleaned)["sentences"].alias("n_sentences"), F.col(cleaned)["removed"].alias("n_removed"))

"""Cards from the detections of one batch, and their edits in review.

A card is (batch_id, card_no, items, title, author, confidence, reason, source, reader, title_alternates, author_alternates, cover). A batch is
one sitting's photos.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.labels import UNSURE_BELOW
from evidentia.functions.text import normalise_all, similarity_of

THRESHOLD = 0.85
TITLE, AUTHOR = 0.75, 0.25
READING = ["title", "author", "confidence", "reason", "source", "reader"]
_EXTRA = {"reader": "string", "title_alternates": "array<string>", "author_alternates": "array<string>", "cover": "binary"}
CARD = "batch_id long, card_no int, items array<long>, title string, author string, confidence int, reason string, source string, reader string, title_alternates array<string>, author_alternates array<string>, cover binary"


def detection_similarity(title: Column, author: Column, other_title: Column, other_author: Column) -> Column:
    """0 to 1 for two detections with normalised titles and authors: authors count where both have one."""
    titles = similarity_of(title, other_title)
    both = (author != "") & (other_author != "")
    return F.when(both, titles * TITLE + similarity_of(author, other_author) * AUTHOR).otherwise(titles)


def _alike(detections: DataFrame, field: str, least: float) -> DataFrame:
    """(batch_id, pairs): by batch the pairs of its distinct readings of a field that are ``least`` or more alike, with how much.

    A batch's readings are gathered in one row; they are compared there, each with those after it.
    """
    own = detections.select("batch_id", normalise_all(F.col(field)).alias("n")).where("n <> ''").distinct()
    listed = own.groupBy("batch_id").agg(F.sort_array(F.collect_list("n")).alias("all"))
    row = listed.select("batch_id", "all", F.posexplode("all").alias("at", "a"))
    pairs = row.select("batch_id", "a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b"))
    return pairs.withColumn("alike", similarity_of(F.col("a"), F.col("b"))).where(F.col("alike") >= least)


def _cards(key: tuple, batch: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """In order of arrival every detection joins the first card that is similar to its present reading, or starts one."""
    known = {(f, a, b): x for f, a, b, x in zip(pairs["field"], pairs["a"], pairs["b"], pairs["alike"], strict=True)}

    def alike(field: str, a: str, b: str) -> float:
        return 1.0 if a == b else known.get((field, min(a, b), max(a, b)), 0.0) if a and b else 0.0

    cards: list[dict] = []
    for row in batch.sort_values("item_no", kind="stable").to_dict("records"):
        card = None
        for c in cards if row["title"] else ():
            score = alike("title", c["title_key"], row["title_key"])
            if c["author"] and row["author"]:
                score = score * TITLE + alike("author", c["author_key"], row["author_key"]) * AUTHOR
            if score >= THRESHOLD:
                card = c
                break
        if card is None:
            cards.append({**row, "card_no": len(cards), "items": [row["item_no"]]})
            continue
        card["items"].append(row["item_no"])
        if row["confidence"] > card["confidence"]:
            card |= {k: row[k] for k in ("title", "title_key", "confidence", "reason", "source", "reader")}
            if row["author"]:
                card |= {k: row[k] for k in ("author", "author_key")}
            if row["cover"] is not None:
                card["cover"] = row["cover"]
    names = [x.split()[0] for x in CARD.split(", ")]
    return pd.DataFrame([[c[n] for n in names] for c in cards], columns=names)


def group_detections(detections: DataFrame) -> DataFrame:
    """(batch_id, item_no, title, author, confidence, reason, source[, reader, title_alternates, author_alternates, cover]) -> cards.

    A more confident detection gives the card its reading, its author if it has one, and its cover; the alternates stay the first one's. The
    outcome depends on the order of arrival, so a batch is folded as a whole; how alike readings are is worked out before, in columns.
    """
    given = [F.col(c) if c in detections.columns else F.lit(None).cast(t).alias(c) for c, t in _EXTRA.items()]
    rows = detections.select("batch_id", "item_no", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author")], F.coalesce("confidence", F.lit(0)).cast("int").alias("confidence"), "reason", "source", *given)
    keyed = rows.withColumns({f"{f}_key": normalise_all(F.col(f)) for f in ("title", "author")})
    # a title can only be similar enough with at least this likeness, were the authors equal
    least = (THRESHOLD - AUTHOR) / TITLE - 1e-9
    pairs = _alike(rows, "title", least).withColumn("field", F.lit("title")).unionByName(_alike(rows, "author", 0.0).withColumn("field", F.lit("author")))
    return keyed.groupBy("batch_id").cogroup(pairs.groupBy("batch_id")).applyInPandas(_cards, CARD)


def split_cards(cards: DataFrame) -> DataFrame:
    """A row per photo of each card, in their order (``place``)."""
    return cards.select("batch_id", "card_no", F.posexplode("items").alias("place", "item_no"))


def merge_cards(cards: DataFrame, into: str = "merged_no") -> DataFrame:
    """Cards with the same ``into`` number become one: the first one's reading, everybody's photos."""
    first = F.min_by(F.struct("title", "author", "confidence", "reason", "source"), "card_no").alias("c")
    lists = F.array_sort(F.collect_list(F.struct("card_no", "items")))
    return cards.groupBy("batch_id", into).agg(first, F.flatten(F.transform(lists, lambda x: x["items"])).alias("items")).select("batch_id", into, "c.*", "items")


def discard_cards(cards: DataFrame, gone: DataFrame) -> DataFrame:
    """``cards`` without those of ``gone`` (batch_id, card_no)."""
    return cards.join(gone.select("batch_id", "card_no"), ["batch_id", "card_no"], "left_anti")


def edit_cards(cards: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (batch_id, card_no, title, author) laid over the cards of those numbers; nulls change nothing."""
    keys = ["batch_id", "card_no"]
    edited = cards.alias("c").join(changes.select(*keys, F.col("title").alias("_title"), F.col("author").alias("_author")), keys, "left")
    new = {"title": F.coalesce("_title", "c.title"), "author": F.coalesce("_author", "c.author")}
    return edited.select(*[new.get(c, F.col(f"c.{c}") if c not in keys else F.col(c)).alias(c) for c in cards.columns])


def insert_after(cards: DataFrame, new: DataFrame) -> DataFrame:
    """``cards`` with the cards of ``new``, each after the card whose ``card_no`` it names; all are numbered again from 0."""
    both = cards.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = F.row_number().over(Window.partitionBy("batch_id").orderBy("card_no", "_new")) - 1
    return both.withColumn("card_no", order.cast("int")).drop("_new")


def shown_warnings(confidence: Column, warnings: Column) -> Column:
    """Warnings about a photo's quality, which are told only where the reading is unsure."""
    return F.when(confidence < UNSURE_BELOW, warnings).otherwise(F.array().cast("array<string>"))

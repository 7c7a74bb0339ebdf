"""Groups of similar detections over any number of them: a similarity join that loses no pair, and connected components.

This isn't the grouping of a sitting (``group``), whose outcome depends on the order of arrival: here a chain of similar readings is one group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import normalise_all, similarity_of, tokens_of
from evidentia.operators.group import AUTHOR, THRESHOLD, TITLE, detection_similarity
from evidentia.sources.scratch import stored

GRAM = 2
_SLACK = 1e-9


def _words(text: Column) -> Column:
    return F.array_distinct(tokens_of(text))


def _grams(text: Column) -> Column:
    """Neighbouring letters, each with how many of its like stand before it, so that sets of them count repeats."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, GRAM))
    numbered = F.transform(pieces, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pieces, F.lit(1), i), lambda x: x == g)).cast("string")))
    return F.when(F.length(text) >= GRAM, numbered).otherwise(F.array().cast("array<string>"))


def _prefixes(texts: DataFrame, parts: Column, length: Column, kind: str) -> DataFrame:
    """(n, m, kind, part): of each text's parts, from the rarest, as many as ``length`` says; m is the number of parts."""
    listed = texts.select("n", F.size(parts).alias("m"), length.alias("_keep"), F.explode(parts).alias("part"))
    df = listed.groupBy("part").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("df", "part"))
    return listed.join(df, "part").withColumn("_place", place).where("_place <= _keep").select("n", "m", F.lit(kind).alias("kind"), "part")


def similar_texts(texts: DataFrame, least: float) -> DataFrame:
    """Distinct normalised texts (n), none empty -> (a, b, alike), a < b, of all pairs with a ``similarity_of`` of ``least`` or more.

    For ``least`` of 0.7 or more. A pair is that alike only if (1) the edit distance is at most 1 - least of the longer text, or (2) the words
    in common are at least 2 * least - 1 of both texts' mean number of words. Either has a bound on how many of its rarest parts a text can
    miss, letter pairs for (1) and words for (2): texts that share none of their first rarest parts are never compared. Lengths must fit too.
    """
    share = 2 * least - 1
    size = F.size(_words(F.col("n")))
    fewest = share / (2 - share)  # of a text's words that any partner of (2) has
    by_words = _prefixes(texts, _words(F.col("n")), size - F.ceil(size * fewest - _SLACK) + 1, "word")
    longest = F.length("n") / least
    edits = F.floor(longest * (1 - least) + _SLACK)
    by_grams = _prefixes(texts, _grams(F.col("n")), edits * GRAM + 1, "gram").withColumn("m", F.length("n"))
    keyed = stored(by_words.unionByName(by_grams), "similar-keys")
    other = keyed.select(F.col("n").alias("b"), F.col("m").alias("bm"), "kind", "part")
    ratio = F.when(F.col("kind") == "word", fewest).otherwise(least)
    fits = (F.least("m", "bm") >= F.greatest("m", "bm") * ratio - _SLACK) & (F.col("n") < F.col("b"))
    pairs = keyed.join(other, ["kind", "part"]).where(fits).select(F.col("n").alias("a"), "b").distinct()
    return pairs.withColumn("alike", similarity_of(F.col("a"), F.col("b"))).where(F.col("alike") >= least)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of one orderable type -> (node, root): every node of an edge with the least node it is connected to.

    Each round a node takes the least root among its neighbours', then its root's root; it ends when no root changes.
    """
    both = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    both = stored(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "component-edges")
    now = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).withColumn("root", F.least("node", "root")), "component-roots")
    while True:
        told = both.join(now.withColumnsRenamed({"node": "v"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("told"))
        taken = now.join(told, "node").select("node", F.col("root").alias("before"), F.least("root", "told").alias("root"))
        higher = taken.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = stored(taken.join(higher, "root").select("node", F.least("root", "above").alias("root"), "before"), "component-roots")
        if after.where("root <> before").isEmpty():
            return after.select("node", "root")
        now = after.select("node", "root")


def similar_groups(detections: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_no, title, author) -> (item_no, group_no): items connected by detections ``threshold`` or more alike; group_no is the least item.

    Equal readings are one node, so that many copies make no pairs. An item with a blank title is a group by itself. A title can only be alike
    enough with at least the likeness that equal authors would leave to it.
    """
    keys = [normalise_all(F.coalesce(c, F.lit(""))).alias(f"{c}_key") for c in ("title", "author")]
    rows = stored(detections.select("item_no", *keys), "similar-items")
    readings = rows.where("title_key <> ''").groupBy("title_key", "author_key").agg(F.min("item_no").alias("node"))
    readings = stored(readings, "similar-readings")
    floor = max((threshold - AUTHOR) / TITLE - _SLACK, 0.7) if threshold >= AUTHOR + 0.7 * TITLE else math.nan
    if math.isnan(floor):
        raise ValueError("threshold is too low for a join that skips pairs")
    titles = readings.select(F.col("title_key").alias("n")).distinct()
    alike = similar_texts(titles, floor)
    same = titles.select(F.col("n").alias("a"), F.col("n").alias("b"))
    left = readings.select(F.col("title_key").alias("a"), F.col("author_key").alias("x"), F.col("node").alias("u"))
    right = readings.select(F.col("title_key").alias("b"), F.col("author_key").alias("y"), F.col("node").alias("v"))
    edges = alike.select("a", "b").join(left, "a").join(right, "b")
    edges = edges.where(detection_similarity(F.col("a"), F.col("x"), F.col("b"), F.col("y")) >= threshold).select("u", "v")
    roots = components(edges.unionByName(_one_title(readings, threshold)))
    found = readings.join(roots, "node", "left").select("title_key", "author_key", F.coalesce("root", "node").alias("group_no"))
    return rows.join(found, ["title_key", "author_key"], "left").select("item_no", F.coalesce("group_no", "item_no").alias("group_no"))


def _one_title(readings: DataFrame, threshold: float) -> DataFrame:
    """(u, v) that connect the readings of one title whose authors differ.

    A reading without an author is alike to all of its title. Those with authors are alike if the authors are enough so, which equal titles make
    a likeness of (threshold - TITLE) / AUTHOR: above 0.7 that is a join of its own, else the authors of a title meet in pairs by distinct author.
    """
    blank = readings.where("author_key = ''").select("title_key", F.col("node").alias("u"))
    named = readings.where("author_key <> ''").select("title_key", "author_key", F.col("node").alias("v"))
    first = blank.join(named, "title_key").select("u", "v")
    a = named.select("title_key", F.col("author_key").alias("x"), F.col("v").alias("u"))
    close = a.join(named, "title_key").where(F.col("u") < F.col("v"))
    return first.unionByName(close.where(similarity_of(F.col("x"), F.col("author_key")) * AUTHOR + TITLE >= threshold).select("u", "v"))

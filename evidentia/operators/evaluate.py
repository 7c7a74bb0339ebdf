"""Accuracy of readings against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import edit_similarity, normalise
from evidentia.sources.scratch import stored

FUZZY = 0.7
CONFIDENT = 60
UNSURE = 55


def author_hit(expected: Column, got: Column) -> Column:
    """Similar names, or the expected surname, if longer than two letters, among the words read."""
    surname = F.element_at(F.split(normalise(expected), " "), -1)
    return (edit_similarity(expected, got) >= FUZZY) | ((F.length(surname) > 2) & F.array_contains(F.split(normalise(got), " "), surname))


def score_rows(truth: DataFrame, got: DataFrame) -> DataFrame:
    """Truth (id, title, author) joined with readings (id, title, author, confidence, ...), one row per id of both."""
    g = got.select("id", F.col("title").alias("got_title"), F.col("author").alias("got_author"), *[c for c in got.columns if c not in ("id", "title", "author")])
    rows = truth.select("id", F.col("title").alias("expected_title"), F.col("author").alias("expected_author"), *[c for c in truth.columns if c not in ("id", "title", "author")]).join(g, "id")
    alike = edit_similarity(F.col("expected_title"), F.col("got_title"))
    return rows.withColumns(
        {
            "title_exact": normalise(F.col("expected_title")) == normalise(F.col("got_title")),
            "title_fuzzy": alike >= FUZZY,
            "title_similarity": F.round(alike, 2),
            "author_hit": author_hit(F.col("expected_author"), F.col("got_author")),
        }
    )


#: The median is looked for between these quantiles, which are known to within one row in ``ACCURACY``.
AROUND, ACCURACY = (0.499, 0.501), 10_000


def upper_median_of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value): the upper median of a column of numbers per group, by position in its order; nulls don't count.

    No group is sorted: a sketch of each gives two values around its middle, the rows below are counted, and only the distinct values between the two
    are put in order. Should the rank not lie between them, the group's least and greatest value take their place.
    """
    given = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(value).alias("_v"))
    keys = [f"_g{i}" for i in range(len(by))]
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    bounds = given.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", list(AROUND), ACCURACY).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    bounds = stored(bounds.select(*keys, (F.floor(F.col("_n") / 2) + 1).alias("_rank"), F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"), "_min", "_max"), "median-bounds")
    other = bounds.select(*[F.col(k).alias(f"{k}_") for k in keys], "_rank", "_low", "_high", "_min", "_max")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]

    def counted(limits: DataFrame) -> DataFrame:
        """Rows below the limits, as one value that is null, and each value between them, with how often it stands there."""
        met = given.join(limits, same, "inner") if keys else given.crossJoin(limits)
        return met.where(v <= high).groupBy(*keys, "_rank", F.when(v >= low, v).alias("_v")).agg(F.count("*").alias("_n"))

    def chosen(counts: DataFrame) -> DataFrame:
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
        placed = counts.withColumns({"_upto": upto, "_before": upto - F.col("_n")})
        return placed.where(F.col("_v").isNotNull() & (F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))).select(*keys, "_v")

    found = stored(chosen(counted(other)), "medians")
    got = found.select(*[F.col(k).alias(f"{k}__") for k in keys])
    missed = other.join(got, [F.col(f"{k}_").eqNullSafe(F.col(f"{k}__")) for k in keys], "left_anti") if keys else (other if found.isEmpty() else other.limit(0))
    rest = missed.withColumns({"_low": F.col("_min"), "_high": F.col("_max")})
    every = found if missed.isEmpty() else found.unionByName(chosen(counted(rest)))
    return every.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], F.col("_v").alias(value))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: covers, exact and fuzzy titles, authors, and readings that are confident and wrong."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("covers"), F.count_if("title_exact").alias("title_exact"), F.count_if("title_fuzzy").alias("title_fuzzy"), F.count_if("author_hit").alias("author_hit"),
        F.count_if(~F.col("title_fuzzy") & (F.coalesce("confidence", F.lit(0)) >= CONFIDENT)).alias("confidently_wrong"),
    )


def expected_behaviour(rows: DataFrame) -> DataFrame:
    """Scored rows with ``expect`` (book, author, uncertain) -> ``as_expected``."""
    fuzzy, author = F.col("title_fuzzy"), F.col("author_hit")
    ok = F.when(F.col("expect") == "book", fuzzy & author).when(F.col("expect") == "author", author).otherwise((F.col("confidence") < UNSURE) & ~fuzzy)
    return rows.withColumn("as_expected", ok)



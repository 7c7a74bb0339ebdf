"""Mixing sources to target weights by entropy balancing.

A document's rate is the expected number of its copies. Among all rates between 0 and the cap that give every source its target number of
words, those nearest to 1 in relative entropy are min(cap, exp(multiplier * size / scale)), with one multiplier per source. The multipliers
solve the convex dual. Spark sums the documents of a source by level of size once; the safeguarded Newton steps then run over each source's
levels, of which there are few thousand at most, all steps and all sources in one job. The rates are rounded into copies by systematic
rounding in order of size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.shared import free_name, joined_small, materialize, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Newton steps; a step that would leave the bracket halves it instead.
ROUNDS = 100
#: Sizes below this are levels of their own; above, a level spans this part of its power of two.
FINE = 256
#: Rates are whole numbers of these parts, so that sums of rates are exact.
PARTS = 1_000_000
#: So many starting points of the systematic rounding are compared per source.
STARTS = 32
_SOURCE = ["has_source", "source_key"]
_LEVEL = [*_SOURCE, "level"]


def level_of(size: Column) -> Column:
    """Sizes by level: exact up to ``2 * FINE``, then ``FINE`` levels for every doubling."""
    power = F.greatest(F.lit(0), F.length(F.bin(size)) - FINE.bit_length())
    return power * (2 * FINE) + F.floor(size / F.pow(F.lit(2.0), power))


def _keyed(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Source, size, level and draw, by which documents of one level are dealt and ordered, of a document."""
    text, size = F.col(text_col), word_count(F.col(text_col))
    told = F.concat_ws("\x01", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))
    return [
        F.col(source_col).isNotNull().alias("has_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"), size.alias("size"),
        level_of(size).alias("level"), F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long").alias("draw"),
    ]


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(has_source, source_key, source_size) per source -> the same with ``target``.

    Sources in order of code points, the null source last, get the weights in turn. Targets stop at ``cap`` times the
    source's size and what is over goes to the others by weight: the level of a water-filling. Sources are ranked against each other, so
    one task sees a row of each.
    """
    order = Window.orderBy(F.col("has_source").desc(), "source_key")
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", cap * F.col("source_size"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("has_source").desc(), "source_key")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    leveled = ranked.withColumn("place", F.row_number().over(by_room)).withColumn(
        "water", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    )
    leveled = leveled.withColumn("full", F.col("water") * F.col("weight") >= F.col("most"))
    water = F.min_by("water", F.when(~F.col("full"), F.col("place"))).over(whole)
    return leveled.select(*_SOURCE, "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.coalesce(water, F.lit(0.0)) * F.col("weight")).alias("target"))


def _tilted(multiplier: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(700.0), multiplier * x)))


def multiplier(sizes: Column, target: Column, cap: int = CAP, rounds: int = ROUNDS) -> Column:
    """The multiplier at which ``sizes``, an array of (x: size by scale, words), give ``target`` words: Newton's method on the logarithm.

    It is sought inside a bracket: a step that would leave it halves it, or doubles the multiplier while one end is open.
    """

    def step(state: Column, _: Column) -> Column:
        at = state["at"]

        def add(sums: Column, s: Column) -> Column:
            words = s["words"] * _tilted(at, s["x"], cap)
            free = at * s["x"] < F.log(F.lit(float(cap)))
            return F.struct((sums["got"] + words).alias("got"), (sums["slope"] + F.when(free, words * s["x"]).otherwise(0.0)).alias("slope"))

        sums = F.aggregate(sizes, F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("slope")), add)

        def move(found: Column) -> Column:
            got = found["got"]
            low = F.when(got < target, F.greatest(state["low"], at)).otherwise(state["low"])
            high = F.when(got > target, F.least(state["high"], at)).otherwise(state["high"])
            newton = at - F.log(got / target) * F.try_divide(got, found["slope"])
            halved = F.when(high >= 1e6, F.greatest(at * 2, F.lit(1.0))).when(low <= -1e6, F.least(at * 2, F.lit(-1.0))).otherwise((low + high) / 2)
            inside = F.coalesce((newton > low) & (newton < high) & ~F.isnan(newton), F.lit(False))
            return F.struct(F.when(got == target, at).when(inside, newton).otherwise(halved).alias("at"), low.alias("low"), high.alias("high"))

        return F.get(F.transform(F.array(sums), move), F.lit(0))

    begin = F.struct(F.lit(0.0).alias("at"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step, lambda s: s["at"])


def _levels(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """By source and level: n, mean size, source_size, target, and ``parts``, the rate in parts."""
    levels = materialize(sized.groupBy(*_LEVEL).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-levels")
    mean = F.col("words") / F.col("n")
    totals = levels.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size"), F.sum(F.col("words") * mean).alias("squares"), F.array_sort(F.collect_list(F.struct("level", mean.alias("mean"), "words"))).alias("levels"))
    scaled = totals.withColumn("scale", F.coalesce(F.try_divide("squares", "source_size"), F.lit(1.0)))
    sources = targets(totals.select(*_SOURCE, "source_size"), weights, share, cap).join(scaled.drop("source_size"), _SOURCE)
    sizes = F.transform("levels", lambda s: F.struct((s["mean"] / F.col("scale")).alias("x"), s["words"].cast("double").alias("words")))
    full, none = F.col("target") >= cap * F.col("source_size"), F.col("target") <= 0
    solved = materialize(sources.select(*_SOURCE, "source_size", "target", "scale", F.when(~full & ~none, multiplier(sizes, F.col("target"), cap)).alias("multiplier"), full.alias("full"), none.alias("none")), "mix-sources")
    rate = F.when(F.col("none"), 0.0).when(F.col("full"), float(cap)).otherwise(_tilted(F.col("multiplier"), mean / F.col("scale"), cap))
    return joined_small(levels, solved, _SOURCE).select(*_LEVEL, "n", mean.alias("mean"), "source_size", "target", F.round(rate * PARTS).cast("long").alias("parts"))


def _rounded(levels: DataFrame) -> DataFrame:
    """``levels`` with ``each``, the copies that all documents of a level get, and ``extra``, how many of them get one more."""
    upto = Window.partitionBy(*_SOURCE).orderBy("level")
    run = levels.withColumn("to", F.sum(F.col("n") * F.col("parts")).over(upto)).withColumn("from", F.col("to") - F.col("n") * F.col("parts"))
    copies = F.expr(f"(to + start) div {PARTS} - (`from` + start) div {PARTS}")
    tried = run.withColumn("start", F.explode(F.array(*[F.lit(PARTS * k // STARTS) for k in range(STARTS)])))
    off = tried.groupBy(*_SOURCE, "start").agg(F.round(F.abs(F.sum(copies * F.col("mean")) - F.first("target")), 3).alias("off"))
    starts = off.groupBy(*_SOURCE).agg(F.min(F.struct("off", "start"))["start"].alias("start"))
    placed = joined_small(run, starts, _SOURCE)
    each = F.expr(f"parts div {PARTS}")
    extra = F.greatest(F.lit(0), F.least(F.col("n"), copies - F.col("n") * each))
    return placed.select(*_LEVEL, "n", "source_size", "target", each.cast("int").alias("each"), extra.alias("extra"), F.ceil(F.sqrt(F.col("n")) / 4).cast("long").alias("cells"))


def _plan(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Per source and level ``source_size``, ``target``, ``each`` and ``up_to``: by cell the draw up to which one copy more is given.

    The documents of a level are dealt to cells by their draw, about four times as many documents to a cell as there are cells; the cells share
    the level's extra copies in order, and in a cell the least draws get them.
    """
    levels = materialize(_rounded(_levels(sized, weights, share, cap)), "mix-rounded")
    some = levels.where("extra > 0").select(*_LEVEL, "n", "extra", "cells")
    dealt = joined_small(sized.select(*_LEVEL, "draw"), some, _LEVEL).withColumn("cell", F.pmod("draw", "cells"))
    in_cell = Window.partitionBy(*_LEVEL, "cell").orderBy("draw")
    placed = dealt.repartition(*_LEVEL, "cell").withColumn("place", F.row_number().over(in_cell))
    cells = materialize(placed.select(*_LEVEL, "n", "extra", "cells", "cell", "draw", "place"), "mix-cells")
    counts = cells.groupBy(*_LEVEL, "n", "extra", "cell").agg(F.count("*").alias("m"))
    so_far = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(*_LEVEL).orderBy("cell")))
    part = "cast(floor(cast(extra as decimal(19,0)) * cast({} as decimal(19,0)) / n) as long)"
    shared = so_far.select(*_LEVEL, "cell", (F.expr(part.format("upto")) - F.expr(part.format("(upto - m)"))).alias("wanted")).where("wanted > 0")
    last = cells.join(shared, [*_LEVEL, "cell"]).where("place = wanted").select(*_LEVEL, "cells", "cell", "draw")
    least = F.lit(-1).cast("long")
    lists = last.groupBy(*_LEVEL, "cells").agg(F.sort_array(F.collect_list(F.struct("cell", "draw"))).alias("found"))
    # an array by cell, -1 where a cell gives nothing
    by_cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda c: F.coalesce(F.try_element_at(F.map_from_entries("found"), c), least))
    whole = F.size("found") == F.col("cells")
    up_to = lists.select(*_LEVEL, F.when(whole, F.transform("found", lambda x: x["draw"])).otherwise(by_cell).alias("up_to"))
    return levels.select(*_LEVEL, "source_size", "target", "each").join(up_to, _LEVEL, "left")


def _copies() -> Column:
    up_to = F.get("up_to", F.pmod("draw", F.size("up_to")).cast("int"))
    return F.col("each") + F.when(F.col("up_to").isNotNull() & (F.col("draw") <= up_to), 1).otherwise(0)


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(id, size, source_size, target, copies, taken) per row of ``docs``; size counts words.

    A null text has size 0; a null source is a source of its own, the last one. Rows of one id and text are
    decided alike. The copies of a document are ``cap`` at most. No rows give no rows.
    """
    slim = materialize(docs.select(F.col(id_col).alias("id"), *_keyed(id_col, text_col, source_col)), "mix-sized")
    found = joined_small(slim, materialize(_plan(slim, weights, share, cap), "mix-plan"), _LEVEL)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (not at all, once or more). Otherwise as ``rates``.

    While the plan is small, the texts themselves aren't shuffled.
    """
    key = free_name(docs, "_key")
    inner = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(key)
    keyed = _keyed(id_col, text_col, source_col)
    sized = materialize(docs.select(*keyed), "mix-sized")
    plan = materialize(_plan(sized, weights, share, cap), "mix-plan")
    taken = joined_small(docs.select(inner, *keyed), plan, _LEVEL).withColumn("copies", _copies()).where("copies > 0")
    return taken.select(F.explode(F.array_repeat(F.col(key), F.col("copies"))).alias(key)).select(f"{key}.*")

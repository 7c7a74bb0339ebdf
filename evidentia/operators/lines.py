"""Lines of text as read: (scan_id, pass_no, line_no, text, confidence, bbox, words, height) and what is derived from them.

Every order has a tie-break by ordinals, so that results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.noise import refused
from evidentia.functions.text import clean_text, dedupe_key, has_author_prefix, let, letter_count, letter_ratio, normalise, wordiness, wordiness_of

PASS = ["scan_id", "pass_no"]
#: Boxes that share more than this of the smaller one are one place.
CLASH = 0.6
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def tallest_heights(lines: DataFrame) -> DataFrame:
    """Per pass the height of the tallest line that reads like words (``page_max``, 0 if none does)."""
    reads = (F.col("confidence") >= 20) & (letter_count(F.col("text")) >= 3) & (wordiness(F.col("text")) >= 0.5)
    return lines.groupBy(*PASS).agg(F.coalesce(F.max(F.when(reads, F.col("height"))), F.lit(0.0)).alias("page_max"))


def measured(lines: DataFrame) -> DataFrame:
    """``lines`` with what is judged of a text, each step a column of its own, and the text cleaned (``_clean``).

    Cleaning changes neither letters nor what is left of a text in its normal form, so these are worked out once for both.
    """
    text, clean = F.col("text"), F.col("_clean")
    rows = lines.withColumns({"_normal": normalise(text), "_clean": clean_text(text), "_letters": letter_count(text)})
    rows = rows.withColumns({"_wordy": wordiness_of(F.col("_normal")), "_lower": F.lower(clean), "_ratio": letter_ratio(clean)})
    rows = rows.withColumn("_noise", refused(clean, F.col("_normal"), F.col("_lower"), F.col("_ratio")))
    return rows.drop("_normal", "_lower", "_ratio")


def usable_lines(lines: DataFrame) -> DataFrame:
    """The lines that can be a title or an author, cleaned, with their pass's ``page_max``.

    What texts measure is dealt out by scan before it is filtered by: a filter would work each measure out again wherever it is named, and no window
    or group of a scan or a pass that follows is dealt out again.
    """
    rows = measured(lines).drop("text").repartition("scan_id")
    reads = (F.col("confidence") >= 20) & (F.col("_letters") >= 3) & (F.col("_wordy") >= 0.5)
    tallest = F.coalesce(F.max(F.when(reads, F.col("height"))).over(Window.partitionBy(*PASS)), F.lit(0.0))
    display = (F.col("page_max") > 0) & (F.col("height") >= F.col("page_max") * 0.5)
    keep = F.when(display, (F.col("confidence") >= 20) & (F.col("_letters") >= 4) & (F.col("_wordy") >= 0.5)).otherwise((F.col("confidence") >= 30) & (F.col("_letters") >= 3))
    kept = rows.withColumn("page_max", tallest).where(~F.col("_noise") & keep)
    return kept.select(*[F.col("_clean").alias("text") if c == "text" else F.col(c) for c in lines.columns], "page_max")


def pass_quality(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per pass the share of its text that reads like words, weighted by letters and confidence."""
    weight = F.greatest(F.lit(1), letter_count(F.col("text")))
    good = weight * wordiness(F.col("text")) * (F.col("confidence") / 100)
    return lines.groupBy(*(by or PASS)).agg(F.least(F.lit(1.0), F.sum(good) / F.sum(weight)).alias("quality"))


def pass_measures(lines: DataFrame) -> DataFrame:
    """Per pass its page's height (``page``), ``page_max`` as of ``tallest_heights`` and ``quality`` as of ``pass_quality``, in one go over its lines."""
    text, letters, wordy = F.col("text"), F.col("_letters"), F.col("_wordy")
    rows = lines.select(*PASS, "height", "page_height", "confidence", letter_count(text).alias("_letters"), wordiness(text).alias("_wordy"))
    reads = (F.col("confidence") >= 20) & (letters >= 3) & (wordy >= 0.5)
    weight = F.greatest(F.lit(1), letters)
    quality = F.least(F.lit(1.0), F.sum(weight * wordy * (F.col("confidence") / 100)) / F.sum(weight))
    return rows.groupBy(*PASS).agg(F.greatest(F.lit(1.0), F.max("page_height")).alias("page"), F.coalesce(F.max(F.when(reads, F.col("height"))), F.lit(0.0)).alias("page_max"), quality.alias("quality"))


def strong_evidence(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per pass whether its lines already look like a cleanly read cover (``strong``)."""
    text = F.col("text")
    solid = (F.col("confidence") >= 80) & (letter_count(text) >= 4) & (wordiness(text) >= 0.6)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: letter_count(w) >= 2))
    sums = lines.groupBy(*(by or PASS)).agg(
        F.count_if(solid).alias("solid"), F.coalesce(F.sum(F.when(solid, words)), F.lit(0)).alias("words"), F.coalesce(F.bool_or(solid & (letter_count(text) >= 8)), F.lit(False)).alias("long")
    )
    return sums.withColumn("strong", (F.col("solid") >= 2) & (F.col("words") >= 3) & F.col("long"))


def mean_confidence(lines: DataFrame) -> DataFrame:
    """Per scan the mean confidence of all words, 0 without words."""
    return lines.select("scan_id", F.explode_outer("words").alias("w")).groupBy("scan_id").agg(F.coalesce(F.avg("w.confidence"), F.lit(0.0)).alias("mean_confidence"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Of lines of a scan that read alike, letters and digits only, the most confident; the first one of equals."""
    best = Window.partitionBy("scan_id", "dedupe").orderBy(F.col("confidence").desc(), "pass_no", "line_no")
    keyed = lines.withColumn("dedupe", dedupe_key(F.col("text"))).where(F.col("dedupe") != "")
    return keyed.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place", "dedupe")


def _overlapping(a: Column, b: Column) -> Column:
    """Whether two boxes share more than ``CLASH`` of the smaller one, which counts as one square at least."""
    width = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    height = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])

    def area(x: Column) -> Column:
        return F.greatest(F.lit(1.0), (x["x1"] - x["x0"]) * (x["y1"] - x["y0"]))

    return (width > 0) & (height > 0) & (width * height / F.least(area(a), area(b)) > CLASH)


def _kept_apart(rows: Column) -> Column:
    """Of lines (bbox, dedupe, ...) in order of confidence: a line that shares its place with one kept before is left out, unless it says all that one says."""

    def step(kept: Column, row: Column) -> Column:
        at = F.get(F.filter(F.sequence(F.lit(1), F.size(kept)), lambda i: _overlapping(row["bbox"], F.element_at(kept, i)["bbox"])), F.lit(0))
        none = (F.size(kept) == 0) | ~F.exists(kept, lambda k: _overlapping(row["bbox"], k["bbox"]))
        before = F.element_at(kept, at)
        fuller = (F.length(row["dedupe"]) > F.length(before["dedupe"])) & F.contains(row["dedupe"], before["dedupe"])
        return F.when(none, F.array_append(kept, row)).when(fuller, F.transform(kept, lambda k, i: F.when(i + 1 == at, row).otherwise(k))).otherwise(kept)

    return F.aggregate(rows, F.slice(rows, 1, 0), step)


def merge_lines(lines: DataFrame) -> DataFrame:
    """One line per place and wording of a scan, from the top (``place``). A scan's lines are few; each scan is folded by itself, in one array."""
    distinct = distinct_lines(lines)
    line = F.struct((-F.col("confidence")).alias("down"), *PASS[1:], "line_no", F.col("bbox"), dedupe_key(F.col("text")).alias("dedupe"))
    folded = distinct.groupBy("scan_id").agg(F.array_sort(F.collect_list(line)).alias("l")).select("scan_id", _kept_apart(F.col("l")).alias("kept"))
    # kept lines stay in the order in which they came to stand where they are; from the top, the first of equals comes first
    placed = F.array_sort(F.transform("kept", lambda k, i: F.struct(k["bbox"]["y0"].alias("y0"), i.alias("i"), k["pass_no"].alias("pass_no"), k["line_no"].alias("line_no"))))
    places = folded.select("scan_id", F.posexplode(placed).alias("place", "k")).select("scan_id", "k.pass_no", "k.line_no", "place")
    return distinct.join(places, [*PASS, "line_no"])


def _joined(block: Column, line: Column) -> Column:
    """A block with one line more. Its height is the upper median of its lines', its confidence the mean of what it was and the line's."""
    heights = F.array_append(block["heights"], line["height"])
    edges = [f(block[e], line[e]).alias(e) for e, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))]
    return F.struct(
        F.concat(block["text"], F.lit(" "), line["text"]).alias("text"), F.element_at(F.array_sort(heights), F.floor(F.size(heights) / 2).cast("int") + 1).alias("height"), ((block["confidence"] + line["confidence"]) / 2).alias("confidence"),
        *edges, block["page_height"].alias("page_height"), block["page_max"].alias("page_max"), block["by_prefix"].alias("by_prefix"), heights.alias("heights"),
    )


def _continues(block: Column, line: Column) -> Column:
    """Whether a line belongs to the block above it: of like size, or display type stepping down in size on one centre line."""
    h, tail = line["height"], F.element_at(block["heights"], -1)
    small, large, gap = F.least(h, tail), F.greatest(h, tail), line["y0"] - block["y1"]
    ratio = F.when(large == 0, 0.0).otherwise(small / large)
    beside = F.least(line["x1"], block["x1"]) - F.greatest(line["x0"], block["x0"]) > 0
    widest = F.greatest(block["x1"] - block["x0"], line["x1"] - line["x0"])
    centred = F.abs((line["x0"] + line["x1"]) / 2 - (block["x0"] + block["x1"]) / 2) < widest * 0.25
    alike = (ratio > 0.45) & (gap < large * 0.6)
    stepped = (ratio > 0.2) & (line["page_max"] > 0) & (large >= line["page_max"] * 0.45) & (h >= block["height"] * 0.25) & (gap < small * 0.6) & centred
    return beside & (gap > -large) & (alike | stepped)


def _blocks(rows: Column) -> Column:
    """Lines from the top -> blocks of lines that continue each other."""
    names = ["text", "height", "confidence", "x0", "y0", "x1", "y1", "page_height", "page_max", "by_prefix"]

    def alone(line: Column) -> Column:
        return F.struct(*[line[n].alias(n) for n in names], F.array(line["height"]).alias("heights"))

    def step(blocks: Column, line: Column) -> Column:
        last = F.element_at(blocks, -1)
        goes_on = F.when(F.size(blocks) == 0, False).otherwise(_continues(last, line))
        return F.when(goes_on, F.array_append(F.slice(blocks, F.lit(1), F.size(blocks) - 1), _joined(last, line))).otherwise(F.array_append(blocks, alone(line)))

    return F.aggregate(rows, F.slice(F.transform(rows, alone), 1, 0), step)


def _flat(lines: DataFrame) -> DataFrame:
    """Usable lines with the box in columns."""
    usable = usable_lines(lines)
    return usable.select(
        *PASS, "line_no", "text", "height", "confidence", *[F.col(f"bbox.{e}").alias(e) for e in ("x0", "y0", "x1", "y1")], F.col("page_height").cast("double").alias("page_height"), "page_max", has_author_prefix(F.col("text")).alias("by_prefix")
    )


def group_lines(lines: DataFrame) -> DataFrame:
    """Candidates: blocks of usable lines, numbered from the top. The fold needs the order of lines and looks at one pass at a time, in one array."""
    names = ["y0", "line_no", "text", "height", "confidence", "x0", "x1", "y1", "page_height", "page_max", "by_prefix"]
    passes = _flat(lines).groupBy(*PASS).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("l"))
    b = passes.select(*PASS, F.posexplode(_blocks(F.col("l"))).alias("cand_no", "b"))
    page = F.when(F.coalesce("b.page_height", F.lit(0.0)) == 0, 1.0).otherwise(F.col("b.page_height"))
    kept = [F.col(f"b.{n}").alias(n) for n in ("text", "height", "confidence", "x0", "y0", "x1", "y1")]
    return b.select(*PASS, "cand_no", *kept, ((F.col("b.y0") + F.col("b.y1")) / 2 / page).alias("centre_y"), "b.by_prefix", F.size("b.heights").alias("n_lines"), "b.page_max")


def single_line_candidates(lines: DataFrame) -> DataFrame:
    """Candidates without grouping: every usable line by itself."""
    number = F.row_number().over(Window.partitionBy(*PASS).orderBy("y0", "line_no")) - 1
    page = F.when(F.col("page_height") == 0, 1.0).otherwise(F.col("page_height"))
    return _flat(lines).select(
        *PASS, number.alias("cand_no"), "text", "height", "confidence", "x0", "y0", "x1", "y1", ((F.col("y0") + F.col("y1")) / 2 / page).alias("centre_y"), "by_prefix", F.lit(1).alias("n_lines"), "page_max"
    )


def _is_strong(solid: Column, words: Column, longest: Column) -> Column:
    return (solid >= 2) & (words >= 3) & (longest >= 8)


def passes_until_strong(lines: DataFrame, least: int = 3) -> DataFrame:
    """The lines of the passes that an adaptive reader would run: up to the first, from ``least`` on, by which the evidence is strong.

    What is judged are the merged lines of the passes so far, so a line that several passes read counts once. Lines are dealt out by scan once,
    whatever passes they count for, and only those of scans whose lines could be strong, were all of them kept. A scan's passes are folded in turn until
    one is strong.
    """
    text, letters = F.col("text"), F.col("_letters")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: letter_count(w) >= 2))
    # what ``when`` guards is worked out for the lines that can be solid only
    sure = lines.select(*PASS, "line_no", "confidence", "bbox", "text", F.when(F.col("confidence") >= 80, letter_count(text)).alias("_letters"))
    solid = F.when(letters >= 4, wordiness(text) >= 0.6).otherwise(False)
    sure = sure.withColumn("solid", solid).withColumns({"n_letters": F.when(F.col("solid"), letters), "n_words": F.when(F.col("solid"), words)})
    hopeful = _is_strong(F.count_if("solid"), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.max("n_letters"), F.lit(0)))
    slim = sure.select(*PASS, "line_no", "confidence", "bbox", dedupe_key(text).alias("dedupe"), "solid", "n_letters", "n_words")
    line = F.struct((-F.col("confidence")).alias("down"), "pass_no", "line_no", "bbox", "dedupe", "n_letters", "n_words", "solid", "hider")
    # of lines that read the same the first in order counts, from a pass on that has one before it on it doesn't
    before = Window.partitionBy("scan_id", "dedupe").orderBy(F.col("confidence").desc(), "pass_no", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.repartition("scan_id").withColumn("hider", F.min("pass_no").over(before))
    scans = rows.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.when(F.col("dedupe") != "", line))).alias("l"), F.array_sort(F.collect_set("pass_no")).alias("p"), hopeful.alias("hopeful"))
    scans = scans.where("hopeful").select("scan_id", "l", F.slice("p", least, F.greatest(F.size("p"), F.lit(1))).alias("p"))

    def strong(upto: Column) -> Column:
        seen = F.filter("l", lambda x: (x["pass_no"] <= upto) & (x["hider"].isNull() | (x["hider"] > upto)))
        solid = F.filter(let(seen, _kept_apart), lambda k: k["solid"])
        return let(solid, lambda k: _is_strong(F.size(k), F.aggregate(k, F.lit(0), lambda n, x: n + x["n_words"]), F.coalesce(F.array_max(F.transform(k, lambda x: x["n_letters"])), F.lit(0))))

    none = F.lit(None).cast(lines.schema["pass_no"].dataType)
    first = F.aggregate("p", none, lambda found, upto: F.when(found.isNotNull(), found).when(strong(upto), upto))
    last = scans.select("scan_id", first.alias("last_pass")).where("last_pass is not null")
    return lines.join(last, "scan_id", "left").where(F.col("last_pass").isNull() | (F.col("pass_no") <= F.col("last_pass"))).drop("last_pass")

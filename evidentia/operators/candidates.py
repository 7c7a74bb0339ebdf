"""Which lines are the title and the author: scores, ranks, interpretations pooled over passes, and the detection.

Candidates are rows (scan_id, pass_no, cand_no, text, height, confidence, x0, y0, x1, y1, centre_y, by_prefix, page_max). All steps
are windows and joins on the scan and pass; a pass has at most five candidates a role, so the pairing is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from evidentia.functions.labels import rounded
from evidentia.functions.text import let, letter_count, letter_ratio, name_shape_of, normalise, strip_author_prefix, tidy_title, wordiness
from evidentia.operators.lines import PASS, pass_measures

# Fixed values.
PER_ROLE = 5
PER_SCAN = 6
NOTHING = "No text large enough to be a title was found"
TWO_LINES = "two lines of the cover read as one title"
NAME_ONLY = "only a name was legible"


def _pass() -> WindowSpec:
    return Window.partitionBy(*PASS)


def _words(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def shaped(candidates: DataFrame) -> DataFrame:
    """Candidates with the measures that the scores share."""
    text = F.col("text")
    bare = candidates.withColumn("reads_as", strip_author_prefix(text)).withColumn("_bare", F.trim("reads_as"))
    return bare.withColumns({"name": name_shape_of(F.col("_bare")), "wordy": wordiness(text), "letters": letter_ratio(text)}).drop("_bare")


def title_scores(candidates: DataFrame, cover_max: str | None = None) -> DataFrame:
    """``shaped`` candidates with ``title_score``: size above all, then place, length and shape."""
    page = F.greatest("page_max", cover_max) if cover_max else F.col("page_max")
    tallest = F.greatest(page, F.max("height").over(_pass()), F.lit(1.0))
    rel = F.col("height") / tallest
    words = _words(F.col("text"))
    score = F.lit(0.0) + rel * 0.5
    score = score - F.when(rel < 0.55, (F.lit(0.55) - rel) * 1.2).otherwise(0.0)
    score = score + F.when(F.col("centre_y") <= 0.6, F.lit(0.15) * (F.lit(1.0) - F.col("centre_y") / 0.6) + 0.05).otherwise(0.0)
    score = score + F.when(words.between(1, 10), 0.12).otherwise(0.0)
    score = score + F.col("letters") * 0.1
    score = score + (F.col("wordy") - 0.5) * 0.4
    score = score + F.col("confidence") / 100 * 0.10
    score = score - F.when(F.col("by_prefix"), 0.5).otherwise(0.0)
    score = score - F.when(F.col("name") > 0.75, 0.25).otherwise(0.0)
    return candidates.withColumn("title_score", score)


def author_scores(candidates: DataFrame) -> DataFrame:
    """``shaped`` candidates with ``author_score``: introduced by a prefix, shaped like a name, at an edge of the page."""
    edge = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.col("centre_y"), F.lit(1.0) - F.col("centre_y")) / 0.35)
    score = F.when(F.col("by_prefix"), 0.45).otherwise(0.0)
    score = score + F.col("name") * 0.3
    score = score + edge * 0.12
    score = score + F.col("confidence") / 100 * 0.13
    score = score + (F.col("wordy") - 0.5) * 0.3
    score = score - F.when(_words(F.col("reads_as")) > 5, 0.25).otherwise(0.0)
    return candidates.withColumn("author_score", score)


def ranked(scored: DataFrame) -> DataFrame:
    """With ``<role>_rank`` (score scaled to the pass's range) and ``<role>_place`` (1 for the best)."""
    for role in ("title", "author"):
        score = F.col(f"{role}_score")
        best, worst = F.greatest(F.max(score).over(_pass()), F.lit(1e-4)), F.least(F.min(score).over(_pass()), F.lit(0.0))
        place = F.row_number().over(_pass().orderBy(score.desc(), "cand_no"))
        scored = scored.withColumns({f"{role}_rank": (score - worst) / F.greatest(F.lit(1e-4), best - worst), f"{role}_place": place})
    return scored


def describe(height: Column, tallest: Column, centre_y: Column, confidence: Column) -> Column:
    """Why a line was taken for the title."""
    size = F.when(height >= tallest * 0.95, "largest text").otherwise("one of the largest lines")
    place = F.when(centre_y < 0.34, "upper third").when(centre_y < 0.6, "upper half").otherwise("lower half")
    return F.concat_ws(", ", size, place, F.concat(rounded(confidence).cast("string"), F.lit("% OCR confidence")))


def _sides(candidates: DataFrame, cover_max: str | None = None) -> DataFrame:
    """Per pass its best candidates a role in order of place: ``titles`` and ``authors``, and ``extra``, what columns of ``candidates`` tell of the pass."""
    page = F.greatest("page_max", cover_max) if cover_max else F.col("page_max")
    base = ranked(author_scores(title_scores(shaped(candidates), cover_max)))
    reach = F.when(page <= 0, 1.0).otherwise(F.lit(0.35) + F.lit(0.65) * F.least(F.lit(1.0), F.col("height") / (page * 0.6)))
    weight = reach * F.when(F.col("name") > 0.75, 0.65).otherwise(1.0)
    base = base.withColumns({"weight": weight, "tallest": F.greatest(F.max("height").over(_pass()), F.lit(1.0))})
    base = base.where(f"title_place <= {PER_ROLE} or author_place <= {PER_ROLE}")
    reason = describe(F.col("height"), F.col("tallest"), F.col("centre_y"), F.col("confidence"))
    title = F.struct("title_place", "cand_no", "text", tidy_title(F.col("text")).alias("as_title"), "height", "y0", "name", "by_prefix", "title_rank", "weight", reason.alias("reason"))
    author = F.struct("author_place", "cand_no", tidy_title(F.col("reads_as")).alias("as_author"), "height", "confidence", "name", "by_prefix", "author_rank")
    extra = [F.first(c).alias(c) for c in ("quality", "reach") if c in candidates.columns]
    titles, authors = (F.array_sort(F.collect_list(F.when(F.col(f"{role}_place") <= PER_ROLE, x))).alias(f"{role}s") for role, x in (("title", title), ("author", author)))
    return base.groupBy(*PASS).agg(titles, authors, *extra)


def _readings(titles: Column, authors: Column) -> Column:
    """All readings of a pass, told by places: (title, author, score, ord), 0 being none; a title of -1 is the first two as one."""

    def reading(title: Column, author: Column, score: Column, order: Column) -> Column:
        return F.struct(title.cast("int").alias("title"), author.cast("int").alias("author"), score.cast("double").alias("score"), order.cast("int").alias("ord"))

    def paired(t: Column, a: Column) -> Column:
        score = t["title_rank"] * 0.55 * t["weight"] + a["author_rank"] * 0.45
        score = score + F.when(t["height"] > a["height"], 0.1).otherwise(0.0)
        score = score + F.when(a["by_prefix"], 0.12).otherwise(0.0)
        score = score + a["name"] * 0.12
        score = score - t["name"] * 0.1
        score = score - F.when(t["by_prefix"], 0.3).otherwise(0.0)
        return reading(t["title_place"], a["author_place"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), t["title_place"] * 10 + a["author_place"])

    none = F.lit(0)
    alone = F.transform(titles, lambda t: reading(t["title_place"], none, t["title_rank"] * 0.6 * t["weight"], t["title_place"] * 10))
    pairs = F.flatten(F.transform(titles, lambda t: F.transform(F.filter(authors, lambda a: a["cand_no"] != t["cand_no"]), lambda a: paired(t, a))))
    least = F.least(F.get(titles, F.lit(0))["title_rank"], F.get(titles, F.lit(1))["title_rank"])
    joined = F.transform(F.slice(titles, 2, 1), lambda t: reading(F.lit(-1), none, least * 0.5, F.lit(100)))
    named = F.transform(F.slice(authors, 1, 2), lambda a: reading(none, a["author_place"], a["author_rank"] * 0.35, a["author_place"] + 100))
    return F.concat(alone, pairs, joined, named)


def _two_lines(titles: Column) -> Column:
    """The two best titles as one, from the top."""
    parts = F.array_sort(F.transform(F.slice(titles, 1, 2), lambda t: F.struct(t["y0"].alias("y0"), t["title_place"].alias("title_place"), t["text"].alias("text"))))
    return tidy_title(F.array_join(F.transform(parts, lambda p: p["text"]), " "))


def _texts(title: Column, author: Column, titles: Column, authors: Column, two: Column) -> list[Column]:
    """What a reading's places say: title, author, reason, author_confidence."""
    t, a = F.get(titles, title - 1), F.get(authors, author - 1)
    said = F.when(title == -1, two).when(title == 0, "").otherwise(t["as_title"])
    reason = F.when(title == -1, TWO_LINES).when(title == 0, NAME_ONLY).otherwise(t["reason"])
    return [said.alias("title"), F.when(author == 0, "").otherwise(a["as_author"]).alias("author"), reason.alias("reason"), F.when(author > 0, a["confidence"]).alias("author_confidence")]


def interpretations(candidates: DataFrame, cover_max: str | None = None) -> DataFrame:
    """Every reading of a pass as (title, author, score, reason, author_confidence, ord), ``ord`` being the order of enumeration."""
    sides = _sides(candidates, cover_max).select(*PASS, "titles", "authors", _two_lines(F.col("titles")).alias("two"))
    rows = sides.select("*", F.explode(_readings(F.col("titles"), F.col("authors"))).alias("r"))
    title, author, reason, confidence = _texts(F.col("r.title"), F.col("r.author"), F.col("titles"), F.col("authors"), F.col("two"))
    return rows.select(*PASS, title, author, F.col("r.score").alias("score"), reason, confidence, F.col("r.ord").alias("ord"))


def _title_keys(passes: Column) -> Column:
    """Every normalised title of a scan's passes once."""
    texts = F.flatten(F.transform(passes, lambda p: F.concat(p["title_keys"], F.array(p["two_key"]))))
    return F.filter(F.array_distinct(texts), lambda k: k != "")


def _fuller(keys: Column) -> Column:
    """Those of a scan's titles that contain a shorter one."""
    return F.filter(keys, lambda k: F.exists(keys, lambda o: (F.length(k) > F.length(o)) & F.contains(k, o)))


def _by_scan(sides: DataFrame) -> DataFrame:
    """One row per scan with its passes in order, each with its texts, their normal forms, and its readings by places."""
    rows = sides.withColumn("two", F.when(F.size("titles") > 1, _two_lines(F.col("titles"))).otherwise(""))
    keys = {"title_keys": F.transform("titles", lambda t: normalise(t["as_title"])), "author_keys": F.transform("authors", lambda a: normalise(a["as_author"])), "two_key": normalise(F.col("two"))}
    slim = {
        "titles": F.transform("titles", lambda t: F.struct(t["as_title"].alias("as_title"), t["reason"].alias("reason"))), "authors": F.transform("authors", lambda a: F.struct(a["as_author"].alias("as_author"), a["confidence"].alias("confidence"))),
    }
    rows = rows.withColumns({"readings": _readings(F.col("titles"), F.col("authors")), **keys}).withColumns(slim)
    kept = [c for c in rows.columns if c != "scan_id"]
    return rows.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("passes"))


def complete_titles(candidates: DataFrame) -> DataFrame:
    """(scan_id, title_key): the normalised titles of a scan's readings that contain a shorter one."""
    return _by_scan(_sides(candidates)).select("scan_id", F.explode(let(_title_keys(F.col("passes")), _fuller)).alias("title_key"))


def _weighed(passes: Column, titles: Column, authors: Column) -> Column:
    """All readings of a scan in order of pass, score and enumeration: (down, ord, key, nth, title, author), ``key`` telling title and author by their numbers among the scan's keys."""

    def of_pass(p: Column, nth: Column) -> Column:
        def reading(r: Column) -> Column:
            said = F.when(r["title"] == -1, p["two_key"]).when(r["title"] == 0, "").otherwise(F.get(p["title_keys"], r["title"] - 1))
            name = F.when(r["author"] == 0, "").otherwise(F.get(p["author_keys"], r["author"] - 1))
            score = r["score"] * (F.lit(0.55) + F.lit(0.45) * p["quality"]) * (F.lit(0.72) + F.lit(0.28) * p["reach"])
            key = F.array_position(titles, said) * F.lit(1 << 20) + F.array_position(authors, name)
            return F.struct((-score).alias("down"), r["ord"].alias("ord"), key.alias("key"), nth.alias("nth"), r["title"].alias("title"), r["author"].alias("author"))

        def shown(r: Column) -> Column:
            said = F.when(r["title"] == -1, p["two"]).when(r["title"] == 0, "").otherwise(F.get(p["titles"], r["title"] - 1)["as_title"])
            name = F.when(r["author"] == 0, "").otherwise(F.get(p["authors"], r["author"] - 1)["as_author"])
            return (said != "") | (name != "")

        return F.array_sort(F.transform(F.filter(p["readings"], shown), reading))

    return F.flatten(F.transform(passes, of_pass))


def _pooled(readings: Column, fuller: Column) -> Column:
    """Readings of one key as one, best first, ``PER_SCAN`` at most: votes counted, whole titles (numbers ``fuller``) put before their parts."""

    def one(key: Column, seen: Column) -> Column:
        def scored(own: Column) -> Column:
            votes, first = F.size(own).cast("long"), F.get(own, F.lit(0))
            score = F.least(F.lit(1.0), -F.array_min(F.transform(own, lambda r: r["down"])) * (F.lit(1.0) + F.least(F.lit(0.3), (votes - 1) * 0.1)))
            score = F.least(F.lit(1.0), score + F.when(F.array_contains(fuller, F.shiftright(key, 20)), 0.08).otherwise(0.0))
            return F.struct((-F.round(score, 12)).alias("down"), seen.alias("seen"), score.alias("score"), votes.alias("votes"), first["nth"].alias("nth"), first["title"].alias("title"), first["author"].alias("author"))

        return let(F.filter(readings, lambda r: r["key"] == key), scored)

    return F.slice(F.array_sort(F.transform(F.array_distinct(F.transform(readings, lambda r: r["key"])), one)), 1, PER_SCAN)


def pool(candidates: DataFrame, cover_max: str = "cover_max") -> DataFrame:
    """Readings of all passes of a scan, by normalised title and author: votes counted, the best six with ``rank``.

    ``candidates`` have ``quality`` and ``reach`` of their pass: how well it read and how tall its tallest line is by the scan's. A scan's readings
    are told by the places of their lines, some numbers each; texts are looked up for the six that are left. What a lambda names is bound by
    ``let``: a column would be worked out again for each element.
    """
    scans = _by_scan(_sides(candidates, cover_max))

    def best(passes: Column) -> Column:
        def of(titles: Column) -> Column:
            authors = F.array_distinct(F.flatten(F.transform(passes, lambda p: p["author_keys"])))
            numbers = F.transform(_fuller(titles), lambda k: F.array_position(titles, k))
            readings = let(authors, lambda a: _weighed(passes, titles, F.filter(a, lambda k: k != "")))
            return let(readings, lambda r: let(numbers, lambda n: _pooled(r, n)))

        return let(_title_keys(passes), of)

    rows = scans.select("scan_id", "passes", F.posexplode(let(F.col("passes"), best)).alias("at", "b")).withColumn("p", F.get("passes", F.col("b.nth")))
    texts = _texts(F.col("b.title"), F.col("b.author"), F.col("p.titles"), F.col("p.authors"), F.col("p.two"))
    return rows.select("scan_id", (F.col("at") + 1).alias("rank"), *texts[:2], F.col("b.score").alias("score"), F.col("b.votes").alias("votes"), *texts[2:])


def detect(hypotheses: DataFrame, scans: DataFrame) -> DataFrame:
    """One detection per row of ``scans`` (scan_id, mean_confidence) from pooled hypotheses; without any, an empty one of confidence 0."""
    per = hypotheses.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "author", "score", "reason"))).alias("ranked"))
    return detect_ranked(per, scans)


def detect_ranked(ranked: DataFrame, scans: DataFrame) -> DataFrame:
    """``detect`` of hypotheses that lie by scan already: (scan_id, ranked), ``ranked`` in order of rank; null is none."""
    second = F.get(F.filter("ranked", lambda h: h["rank"] == 2), F.lit(0))["score"]
    per = ranked.where("ranked is not null").select("scan_id", F.get("ranked", F.lit(0)).alias("best"), second.alias("second"), F.col("ranked").alias("all"))

    def others(field: str) -> Column:
        distinct = F.array_distinct(F.filter(F.col(f"all.{field}"), lambda x: x != ""))
        return F.slice(F.filter(distinct, lambda x: x != F.col(f"best.{field}")), 1, 4)

    title = F.col("best.title")
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("best.score") - F.coalesce("second", F.lit(0.0))) / 0.25))
    read = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean_confidence") / 100))
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.3), letter_count(title) / 12)) * F.greatest(F.lit(0.4), wordiness(title))
    raw = F.least(F.lit(96.0), (F.col("best.score") * 0.5 + margin * 0.25 + read * 0.25) * 100) * (F.lit(0.5) + F.lit(0.5) * quality)
    empty = F.array().cast("array<string>")
    return scans.join(per, "scan_id", "left").select(
        "scan_id", F.coalesce("best.title", F.lit("")).alias("title"), F.coalesce("best.author", F.lit("")).alias("author"),
        F.when(F.col("best").isNull(), 0).otherwise(rounded(F.round(raw, 9)).cast("int")).alias("confidence"), F.coalesce("best.reason", F.lit(NOTHING)).alias("reason"),
        F.coalesce(others("title"), empty).alias("title_alternates"), F.coalesce(others("author"), empty).alias("author_alternates"), F.lit("ocr").alias("source"),
    )


def read_scans(lines: DataFrame, candidates: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Pooled hypotheses of scans from their candidates: the size reference is the tallest line of any pass, as a share of the page.

    Passes without a candidate count for that size too. ``quality`` (scan_id, pass_no, quality) is that of ``lines`` where it isn't given.
    """
    pages = pass_measures(lines).drop(*["quality"] if quality is not None else [])
    if quality is not None:
        pages = pages.join(quality, PASS)
    passes = pages.groupBy("scan_id").agg(F.collect_list(F.struct("pass_no", "page", "page_max", "quality")).alias("_passes"), F.greatest(F.lit(1e-4), F.max(F.col("page_max") / F.col("page"))).alias("_cover"))
    # joined by scan alone, as candidates lie by scan already
    own = F.get(F.filter("_passes", lambda p: p["pass_no"] == F.col("pass_no")), F.lit(0))
    joined = candidates.join(passes, "scan_id").withColumn("_own", own).where(F.col("_own").isNotNull())
    reach = F.least(F.lit(1.0), F.col("_own.page_max") / F.col("_own.page") / F.col("_cover"))
    return pool(joined.withColumns({"cover_max": F.col("_cover") * F.col("_own.page"), "reach": reach, "quality": F.col("_own.quality")}).drop("_passes", "_own", "_cover"))

"""Known inputs and what must come of them: folds, detection, identification, cards, the library, and functions that no query reaches."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from evidentia.functions import geometry, labels, noise
from evidentia.functions import text as T
from evidentia.operators import cache, candidates, group, identify, library
from evidentia.operators import lines as L

LINE = "scan_id long, pass_no int, line_no int, text string, confidence double, height double, page_height double, bbox struct<x0: double, y0: double, x1: double, y1: double>"


def row(spark, *columns):
    """The values of constant expressions."""
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def line(text, y, height, confidence=90.0, x=100.0, scan=1, pass_no=0, no=None):
    return (scan, pass_no, int(y) if no is None else no, text, float(confidence), float(height), 1600.0, (float(x), float(y), x + len(text) * height * 0.55, float(y + height)))


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), LINE)


def grouped(spark, *rows):
    return [r.text for r in L.group_lines(lines(spark, *rows)).orderBy("cand_no").collect()]


def detected(spark, *rows):
    found = lines(spark, *rows)
    hypotheses = candidates.read_scans(found, L.group_lines(found), L.pass_quality(found))
    scans = found.groupBy("scan_id").agg(F.avg("confidence").alias("mean_confidence"))
    return {r.scan_id: r for r in candidates.detect(hypotheses, scans).collect()}


# ------------------------------------------------------------------ text and labels


def test_text(spark):
    lit = F.lit
    got = row(
        spark, T.normalise(lit("The Handmaid's Tale!")), T.normalise(lit("Émile Zola")), T.normalise(lit("Мојот Роман")), T.normalise_all(lit("ﬁne Ⅳ Ǆ")), T.tokens(lit("   ")),
        T.similarity(lit("The Road"), lit("THE ROAD")), T.similarity(lit(""), lit("")), T.similarity(lit("Dune"), lit("")), T.letter_ratio(lit("9780141187761")), T.tidy_title(lit("THE WEIGHT OF WATER")),
        T.tidy_title(lit("The Weight of water")), T.sanitise_query(lit('"harper Lee')), T.sanitise_query(lit("F. Scott Fitzgerald")), T.sanitise_query(lit("— , . |")), T.dominant_script(lit("Мој")), T.dominant_script(lit("aб")),
        T.dominant_script(lit("12")), T.wordiness(lit("рј")), T.is_mostly_upper(lit("АБв")),
    )
    assert got == ["the handmaid s tale", "emile zola", "мојот роман", "fine iv dz", [], 1.0, 1.0, 0.0, 0.0, "The Weight of Water", "The Weight of water", "harper Lee", "Scott Fitzgerald", "", "cyrillic", "cyrillic", "other", 1.0, False]
    close = row(spark, *[T.similarity(lit(a), lit(b)) for a, b in (("Neuromancer", "Neuromahcer"), ("The Weight of Water", "Weight of Water"), ("Iron Harvest", "Winter Letters"))])
    assert close[0] > 0.85 and close[1] > 0.75 and close[2] < 0.4


def test_words_that_match(spark):
    pairs = {("neuromahcer", "neuromancer"): True, ("ockingbird", "mockingbird"): True, ("gatsry", "gatsby"): True, ("road", "read"): False, ("harvest", "handmaid"): False}
    assert row(spark, *[T.token_matches(F.lit(a), F.lit(b)) for a, b in pairs]) == list(pairs.values())

    def cover(title, *read):
        return T.coverage(T.tokens(F.lit(title)), F.array(*map(F.lit, read)))

    full, hobbit, oz, on, none = row(spark, cover("The Road", "the", "road"), cover("The Hobbit", "hobbit"), cover("The Road to Oz", "the", "road"), cover("On the Road", "the", "road"), cover("Dune", "sand"))
    assert full == 1 and hobbit > 0.8 and full > oz and full > on and none == 0


def test_functions_that_no_query_reaches(spark):
    lit = F.lit
    spaced = row(spark, T.join_spaced_letters(lit("D U N E x")), T.join_spaced_letters(lit("D U N E"), repair=True), T.join_spaced_letters(lit("A B"), repair=True))
    assert spaced == ["D U N E x", "DUNE", "A B"]
    queries = row(spark, T.search_query(lit("Dune"), lit("Herbert"), lit("x")), T.search_query(lit("It"), lit(""), lit("one two three")), T.search_query(lit(""), lit(""), lit(" ".join(f"w{i}" for i in range(15)))))
    assert queries == ["Dune Herbert", "one two three", " ".join(f"w{i}" for i in range(12))]
    assert row(spark, T.contains_reading(lit("Dune, Messiah"), lit("dune")), T.contains_reading(lit("dune"), lit("DUNE")), T.contains_reading(lit("Emma"), lit("dune"))) == [True, False, False]
    names = row(spark, labels.backup_name(lit("2024-03-09").cast("date")), labels.format_bytes(lit(900)), labels.format_bytes(lit(2048)), labels.format_bytes(lit(3 * 1024 * 1024 + 400000)), labels.describe_backup(lit(3), lit(2048), lit("f.json"), lit(False)))
    assert names == ["library-2024-03-09.json", "900 B", "2 KB", "3.4 MB", "3 books (2 KB) saved as f.json."]


def test_geometry(spark):
    def box(*edges):
        return F.struct(*[F.lit(float(e)).alias(n) for n, e in zip(("x0", "y0", "x1", "y1"), edges, strict=True)])

    def words(*parts):
        return F.array(*[F.struct(F.lit(t).alias("text"), F.lit(90.0).alias("confidence"), box(0, 0, 10, h).alias("bbox")) for t, h in parts])

    got = row(spark, geometry.line_height(words(("a", 10), ("b", 30), ("c", 20), ("d", 40), (" ", 500)), box(0, 0, 9, 99)), geometry.line_height(words((" ", 1)), box(0, 5, 9, 99)), geometry.upper_median(F.array(F.lit(3), F.lit(1))))
    assert got == [30.0, 94.0, 3]
    got = row(spark, geometry.merge_boxes(box(0, 5, 10, 20), box(-3, 7, 4, 40)), geometry.overlap_fraction(box(0, 0, 10, 10), box(5, 0, 25, 10)), geometry.overlap_fraction(box(0, 0, 1, 1), box(2, 2, 3, 3)), geometry.overlap_fraction(box(0, 0, 0.5, 0.5), box(0, 0, 9, 9)))
    assert [tuple(got[0]), *got[1:]] == [(-3.0, 5.0, 10.0, 40.0), 0.5, 0.0, 0.25]
    assert row(spark, geometry.scale_for(F.lit(400), F.lit(1000), F.lit(1500)), geometry.scale_for(F.lit(100), F.lit(10), F.lit(1500)), geometry.scale_for(F.lit(0), F.lit(0), F.lit(5))) == [1.5, 2.0, 1.0]


def test_labels(spark):
    lit = F.lit
    assert row(spark, *[labels.confidence_class(lit(x)) for x in (70, 69, 55, 54)]) == ["high", "medium", "medium", "low"]
    assert row(spark, *[labels.confidence_label(lit(x)) for x in (81, 60, 10)]) == ["81% confident", "60% — worth checking", "Not sure — please check"]
    assert row(spark, *[labels.should_look_up(lit(m), lit(o)) for m in ("auto", "forced-off", "forced-on") for o in (True, False)]) == [True, False, False, False, True, True]
    assert row(spark, *[labels.lookup_label(lit(m), lit(o)) for m in ("auto", "forced-off", "forced-on") for o in (True, False)]) == [
        "Lookup: On · connected", "Lookup: Off · offline", "Lookup: Off", "Lookup: Off", "Lookup: On · connected", "Lookup: On · no signal",
    ]
    kinds = {(401, ""): "auth", (403, ""): "auth", (429, ""): "rate-limit", (500, ""): "server", (503, ""): "server", (400, "API key not valid"): "auth", (400, "bad image"): "server", (404, "x"): "server"}
    assert row(spark, *[labels.classify_failure(lit(s), lit(b)) for s, b in kinds]) == list(kinds.values())
    assert row(spark, labels.is_model_retired(lit(404), lit("model is no longer available")), labels.is_model_retired(lit(404), lit("page")), labels.is_model_retired(lit(500), lit("model"))) == [True, False, False]
    assert row(spark, labels.describe_failure(lit("timeout")), labels.next_state(lit("auto"), labels.LOOKUP_CYCLE), labels.next_state(lit("forced-on"), labels.LOOKUP_CYCLE), labels.next_state(lit("off"), labels.READER_CYCLE)) == [labels.FAILURES["timeout"], "forced-off", "auto", "auto"]
    toggled = row(spark, labels.toggle_language(F.array(lit("mkd"), lit("eng")), lit("eng")), labels.toggle_language(F.array(lit("mkd")), lit("eng")), labels.toggle_language(F.array(lit("eng")), lit("eng")))
    assert toggled == [["mkd"], ["mkd", "eng"], ["mkd"]]
    sure = {"0.85": 85, "1": 100, "500": 100, "-20": 0, "lots": 0, "NaN": 0, "Infinity": 0, "54.5": 55, None: 0}
    assert row(spark, *[labels.as_confidence(lit(x).cast("string")) for x in sure]) == list(sure.values())
    assert row(spark, labels.reader_reason(lit("off"), lit(True), lit(True)), labels.reader_control_visible(lit(False))) == ["switched off", False]


def test_noise(spark):
    refused = [
        "A Novel", "A New York Times Bestseller", "Winner of the Booker Prize", "International Bestseller", "Shortlisted for a prize", "Award-winning author", "Penguin Books", "— Village Voice", "The Guardian", "ISBN 9780141187761",
        "$14.99", "Translated by Ana Stone", "Now a major motion picture", "www.example.com", '"Simply the best there is"', "©", "all copyright reserved", "ВТОРО ИЗДАНИЕ", "Превод: Ана", "BOOK TWO", "Volume III", "12345", "x",
    ]
    kept = ["The Prizefighter", "Iron Harvest", "Copyright 1999 Something", "COPYRIGHT", "Dune", "The Weight of Water", "The Guardians of Time", "Мојот роман"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(refused + kept)], "i int, text string")
    both = noise.with_noise(rows).select("i", "noise", noise.is_noise(F.col("text")).alias("again")).orderBy("i").collect()
    assert [r.noise for r in both] == [True] * len(refused) + [False] * len(kept) == [r.again for r in both]


# ------------------------------------------------------------------ lines and detection


def test_blocks_of_lines(spark):
    assert grouped(spark, line("THE SILENT", 103, 165), line("ORCHARD", 300, 85)) == ["THE SILENT ORCHARD"]
    assert grouped(spark, line("BURNING SEASON", 120, 160), line("CLARA NOWAK", 640, 40)) == ["BURNING SEASON", "CLARA NOWAK"]
    assert len(grouped(spark, line("SOMETHING", 100, 60, x=10.0), line("ANOTHER", 110, 60, x=900.0))) == 2
    assert grouped(spark, line("A NOVEL", 40, 30), line("IRON HARVEST", 300, 120)) == ["IRON HARVEST"]
    assert grouped(spark, line("sm0dged", 300, 60, confidence=12)) == []


def test_confidence_of_a_block_runs_pairwise(spark):
    found = L.group_lines(lines(spark, line("First words", 100, 50, 80), line("second words", 155, 50, 60), line("third words", 210, 50, 40))).collect()
    assert [(r.confidence, r.n_lines, r.height) for r in found] == [(55.0, 3, 50.0)]


def test_merged_lines(spark):
    rows = [
        line("Iron Harvest", 100, 50, 90, pass_no=0, no=0), line("IRON  harvest!", 102, 50, 95, pass_no=1, no=0),  # one wording, the surer stays
        line("Harvest", 101, 50, 97, pass_no=2, no=0, x=100.0), line("Whitlock", 400, 40, 80, pass_no=0, no=1), line("D. K. Whitlock", 398, 42, 70, pass_no=1, no=1),
        line("...", 700, 10, 99, pass_no=0, no=2), line("Iron Harvest", 900, 50, 20, pass_no=2, no=5),
    ]
    found = [(r.text, r.place) for r in L.merge_lines(lines(spark, *rows)).orderBy("place").collect()]
    # "Harvest" is the surest; the longer reading at its place says all it says and more, and takes the place
    assert found == [("IRON  harvest!", 0), ("D. K. Whitlock", 1)]


def test_an_adaptive_reader_judges_merged_lines(spark):
    strong = [line("The Weight of Water", 100, 80, 95, no=0), line("Anita Shreve Author", 300, 50, 92, no=1)]
    weak = [line("Watr", 100, 20, 30, no=0)]

    def at(rows, pass_no, scan):
        return [(scan, pass_no, *r[2:]) for r in rows]

    rows = at(weak, 0, 1) + at(strong, 1, 1) + at(weak, 2, 1) + at(weak, 3, 1) + at(weak, 0, 2) + at(weak, 1, 2)
    found = L.passes_until_strong(lines(spark, *rows)).groupBy("scan_id").agg(F.max("pass_no").alias("last")).collect()
    assert {r.scan_id: r["last"] for r in found} == {1: 2, 2: 1}
    # one line that two passes read a little differently at one place isn't two strong lines
    twice = at([line("The Weight of Water", 100, 80, 95, no=0)], 0, 3) + at([line("The Weight of Watery", 101, 80, 94, no=0)], 1, 3) + at(strong, 2, 3)
    found = L.passes_until_strong(lines(spark, *twice), least=1).select("pass_no").distinct().collect()
    assert {r.pass_no for r in found} == {0, 1, 2}


def test_detections(spark):
    rows = [
        line("IRON HARVEST", 300, 120), line("D. K. WHITLOCK", 1400, 50), line("A NOVEL", 900, 30),
        line("SALT AND ASH", 300, 120, scan=2), line("by Peter Vance", 1400, 50, scan=2), line("sm0dged", 300, 60, 12, scan=3),
    ]
    found = detected(spark, *rows)
    assert (found[1].title, found[1].author) == ("Iron Harvest", "D. K. Whitlock")
    assert (found[2].title, found[2].author) == ("Salt and Ash", "Peter Vance")
    assert (found[3].title, found[3].author, found[3].confidence, found[3].reason) == ("", "", 0, candidates.NOTHING)
    unclear = detected(spark, line("IRON HARVEST", 300, 120), line("WINTER LETTERS", 700, 118))
    assert found[1].confidence > unclear[1].confidence


def test_the_tallest_line_of_any_pass_is_the_measure(spark):
    """A pass whose only tall line is noise still says how large print is on the cover."""
    small = [line("Iron Harvest", 300, 40, pass_no=0)]
    alone, beside = detected(spark, *small), detected(spark, *small, line("Penguin Books", 800, 400, pass_no=1))
    assert beside[1].confidence < alone[1].confidence


def test_mean_confidence_of_words(spark):
    shape = "scan_id long, words array<struct<text: string, confidence: double>>"
    rows = spark.createDataFrame([(1, [("a", 80.0), ("b", 60.0)]), (1, [("c", 40.0)]), (2, []), (3, None)], shape)
    assert {r.scan_id: r.mean_confidence for r in L.mean_confidence(rows).collect()} == {1: 60.0, 2: 0.0, 3: 0.0}


# ------------------------------------------------------------------ identification

CATALOGUE = "doc_id long, title string, author_name array<string>, edition_count int"


def judged(spark, read, doc, author_words=(), title_words=()):
    title, authors, editions = (*doc, None)[:3]
    evidence = spark.createDataFrame([(1, read.split(), list(author_words), list(title_words), title, authors, editions)], "scan_id long, words array<string>, author_words array<string>, title_words array<string>, title string, author_name array<string>, edition_count int")
    return identify.score_documents(evidence).first()


def test_judgements(spark):
    iron = ("Iron Harvest", ["D. K. Whitlock"])
    both = judged(spark, "iron harvest whitlock", iron)
    assert both.accepted and both.reason == identify.ACCEPTED
    whole = judged(spark, "thirteen doors", ("Thirteen Doors", ["Mira Stein"]))
    assert whole.accepted and whole.reason == identify.WHOLE
    assert not judged(spark, "ird itt", ("Ird", ["Itt"])).accepted
    assert judged(spark, "sand", iron).reason == identify.NOTHING
    assert judged(spark, "iron", ("Iron Harvest Season Book", ["Anna Bell"])).reason == identify.TOO_LITTLE
    part = judged(spark, "harvest whitlock", ("Harvest Moon", ["Whitlock"]))
    assert part.accepted and part.reason == identify.AUTHOR_PART
    exact = judged(spark, "harvest whitlock", ("Harvest Moonlight", ["Whitlock"]))
    assert exact.accepted and exact.reason == identify.AUTHOR_EXACT
    other = judged(spark, "iron harvest nowak", iron, author_words=["nowak"])
    assert not other.accepted and other.reason == identify.OTHER_AUTHOR
    # a damaged reading of the same author is no other author, nor is a title word taken for one
    assert judged(spark, "iron harvest whitlcck", iron, author_words=["whitlcck"]).accepted
    assert judged(spark, "iron harvest", iron, author_words=["harvest"]).accepted
    about = judged(spark, "tolstoy leo", ("Leo Tolstoy", ["G. K. Chesterton"]), title_words=[])
    assert not about.accepted and about.reason == identify.ABOUT_NAME
    assert judged(spark, "jane eyre", ("Jane Eyre", ["Charlotte Bronte"])).accepted
    foreign = judged(spark, "шерлок холмс arthur doyle авантурите", ("Adventures Arthur Doyle", ["Arthur Doyle"]))
    assert not foreign.accepted and foreign.reason == identify.OTHER_SCRIPT
    unexplained = judged(spark, "thirteen doors", ("Thirteen", ["Mira Stein"]), title_words=["thirteen", "doors"])
    assert not unexplained.accepted and unexplained.reason == identify.UNEXPLAINED
    only = judged(spark, "fitzgerald scott", ("Tender Is the Night", ["F. Scott Fitzgerald"]))
    assert not only.accepted and only.author_only
    assert judged(spark, "iron harvest", (*iron, 900)).score > judged(spark, "iron harvest", (*iron, 1)).score == judged(spark, "iron harvest", iron).score


def test_evidence_and_queries(spark):
    found = lines(spark, line("IRON HARVEST", 300, 120, no=0), line("A Novel", 500, 30, no=1), line("Iron D. K. Whitlock", 900, 40, no=2))
    shape = "scan_id long, rank int, title string, author string, author_confidence double"
    guessed = spark.createDataFrame([(1, 1, "", "Low Name", 20.0), (1, 2, "Iron Harvest", "D. K. Whitlock", 90.0), (1, 3, "Harvest", "", None)], shape)
    evidence = identify.build_evidence(found, guessed)
    r = evidence.first()
    assert r.words == ["iron", "harvest", "d", "k", "whitlock", "low", "name"]
    assert r.author_words == ["whitlock"] and r.title_words == ["iron", "harvest"]
    texts = spark.createDataFrame([(1, "IRON HARVEST\nA Novel\nWhitlock")], "scan_id long, text string")
    assert [q.query for q in identify.build_queries(evidence, texts).orderBy("query_no").collect()] == ["Low Name", "Whitlock", "Iron Harvest Whitlock", "Iron Harvest", "Harvest"]


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([(1, "Iron Harvest", ["D. K. Whitlock"], 3), (2, "Iron Harvest", ["D. K. Whitlock"], 50), (3, "Harvest of Iron", ["Clara Nowak"], 9), (4, "The Great Gatsby", ["F. Scott Fitzgerald"], 100), (5, "Tender Night", ["F. Scott Fitzgerald"], 20), (6, None, ["Nobody"], 1)], CATALOGUE)


def test_search_and_distinct_documents(spark, catalogue):
    queries = spark.createDataFrame([(1, 1, "Iron Harvest Whitlock"), (1, 2, "Gatsby")], "scan_id long, query_no int, query string")
    found = identify.search_catalogue(queries, catalogue)
    assert [(r.query_no, r.place, r.doc_id) for r in found.orderBy("query_no", "place").collect()] == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 4)]
    assert sorted(r.doc_id for r in identify.distinct_documents(found.join(catalogue, "doc_id")).collect()) == [1, 3, 4]


def test_no_query_after_an_accepted_document(spark):
    rows = [(1, 1, 1, False, 0.4), (1, 2, 1, True, 0.8), (1, 2, 2, True, 0.9), (1, 3, 1, True, 1.0), (2, 1, 1, False, 0.2), (2, 2, 1, False, 0.3)]
    scored = spark.createDataFrame(rows, "scan_id long, query_no int, place int, accepted boolean, score double")
    kept = identify.stop_early(scored).orderBy("scan_id", "doc_rank").collect()
    assert [(r.scan_id, r.query_no, r.place) for r in kept] == [(1, 2, 2), (1, 2, 1), (1, 1, 1), (2, 2, 1), (2, 1, 1)]


def test_identification(spark, catalogue):
    scans = [(1, "Iron Harvst", "D. K. Whitlock", "iron harvest whitlock"), (2, "Grt Gtsb", "F. Scott Fitzgerald", "grt gtsb scott fitzgerald"), (3, "Nothing Here", "", "nothing here")]
    detections = spark.createDataFrame([(i, t, a, 40 + 10 * i, "largest text", ["Other"], [], "ocr") for i, t, a, _ in scans], "scan_id long, title string, author string, confidence int, reason string, title_alternates array<string>, author_alternates array<string>, source string")
    evidence = spark.createDataFrame([(i, w.split(), [], []) for i, _, _, w in scans], "scan_id long, words array<string>, author_words array<string>, title_words array<string>")
    queries = spark.createDataFrame([(i, 1, w) for i, _, _, w in scans], "scan_id long, query_no int, query string")
    found = {r.scan_id: r for r in identify.identify(detections, evidence, queries, catalogue).collect()}
    assert (found[1].title, found[1].author, found[1].matched, found[1].source) == ("Iron Harvest", "D. K. Whitlock", True, "catalogue")
    # eight of the ten weights of the author's words were read
    assert found[1].confidence == int(55 + 45 * (0.6 + 0.36 * 0.8 + 0.04 * math.log10(4) / 3) + 0.5) and found[1].title_alternates[0] == "Iron Harvst"
    assert (found[2].title, found[2].author, found[2].matched, found[2].identified_author) == ("Grt Gtsb", "F. Scott Fitzgerald", False, True)
    assert found[2].confidence == 45 and set(found[2].title_alternates) == {"The Great Gatsby", "Tender Night", "Other"}
    assert (found[3].title, found[3].confidence, found[3].matched, found[3].identified_author, found[3].source) == ("Nothing Here", 70, False, False, "ocr")


def test_covered_finds_every_pair_above_the_threshold(spark):
    scans = spark.createDataFrame([(1, "the iron harvest came early again".split()), (2, "iron winter".split()), (3, "letters from the harvst".split())], "scan_id long, words array<string>")
    docs = spark.createDataFrame([(1, "iron harvest".split()), (2, "winter letters winter".split()), (3, ["the"])], "doc_id long, words array<string>")
    found = {(r.scan_id, r.doc_id): round(r.significant, 3) for r in identify.covered(scans, docs, 0.5).collect()}
    assert found == {(1, 1): 1.0, (2, 1): 0.5, (3, 1): 0.5, (2, 2): 0.667}


# ------------------------------------------------------------------ cards, library, cache


def cards(spark, *rows):
    shape = "batch_id long, item_no long, title string, author string, confidence int, reason string, source string, reader string, title_alternates array<string>, cover binary"
    found = group.group_detections(spark.createDataFrame([(1, i, t, a, c, f"r{i}", "ocr", f"by{i}", [f"alt{i}"], bytes([i])) for i, (t, a, c) in enumerate(rows)], shape))
    return found.orderBy("card_no")


def test_cards(spark):
    found = cards(spark, ("Iron Harvest", "D. K. Whitlock", 60), ("Iron Harvst", "", 90), ("Winter Letters", "", 50), ("", "", 0), ("", "", 0), ("IRON HARVEST", "Clara Nowak", 95), ("Ėmile ﬁne", "", 10), ("emile fine", "", 5)).collect()
    assert [(r.title, r.author, r.confidence, r.items) for r in found] == [
        ("Iron Harvst", "D. K. Whitlock", 90, [0, 1]), ("Winter Letters", "", 50, [2]), ("", "", 0, [3]), ("", "", 0, [4]), ("IRON HARVEST", "Clara Nowak", 95, [5]), ("Ėmile ﬁne", "", 10, [6, 7]),
    ]
    # the surer detection brings its reader and its cover, alternates stay
    assert (found[0].reason, found[0].reader, bytes(found[0].cover), found[0].title_alternates) == ("r1", "by1", bytes([1]), ["alt0"])


def test_the_likeness_of_detections(spark):
    lit = F.lit
    same, apart, blank = row(spark, group.detection_similarity(lit("dune"), lit("frank herbert"), lit("dune"), lit("frank herbert")), group.detection_similarity(lit("dune"), lit("frank herbert"), lit("dune"), lit("")), group.detection_similarity(lit("dune"), lit("ann lee"), lit("dune"), lit("frank herbert")))
    assert same == 1 and apart == 1 and blank < 0.85


def test_card_edits(spark):
    found = cards(spark, ("Iron Harvest", "A", 60), ("Winter Letters", "B", 90), ("Dune", "C", 50))
    assert [(r.place, r.item_no) for r in group.split_cards(found.where("card_no = 0")).collect()] == [(0, 0)]
    merged = group.merge_cards(found.withColumn("merged_no", F.least("card_no", F.lit(1)))).orderBy("merged_no").collect()
    assert [(r.title, r["items"]) for r in merged] == [("Iron Harvest", [0]), ("Winter Letters", [1, 2])]
    one = spark.createDataFrame([(1, 1, None, "New Author")], "batch_id long, card_no int, title string, author string")
    assert [r.title for r in group.discard_cards(found, one).orderBy("card_no").collect()] == ["Iron Harvest", "Dune"]
    assert [(r.title, r.author) for r in group.edit_cards(found, one).orderBy("card_no").collect()] == [("Iron Harvest", "A"), ("Winter Letters", "New Author"), ("Dune", "C")]
    added = spark.createDataFrame([(1, 0, "Rescan", "D")], "batch_id long, card_no int, title string, author string")
    assert [(r.card_no, r.title) for r in group.insert_after(found, added).orderBy("card_no").collect()] == [(0, "Iron Harvest"), (1, "Rescan"), (2, "Winter Letters"), (3, "Dune")]
    assert row(spark, group.shown_warnings(F.lit(54), F.array(F.lit("dark"))), group.shown_warnings(F.lit(55), F.array(F.lit("dark")))) == [["dark"], []]


def now():
    return F.lit("2024-05-06 07:08:09").cast("timestamp")


@pytest.fixture(scope="module")
def books(spark):
    when = datetime.datetime(2024, 1, 1)
    rows = [("a", "The Road", "Cormac McCarthy", "read", when, when, "manual", 1, None, None, None, None), ("b", "Roadside Picnic", "Strugatsky", None, when, when, "manual", 2, 80, "ocr", b"\x01\x02", "image/png"), ("c", "Dune", "Frank Herbert", "unread", when, when, "manual", 1, None, None, None, None)]
    return spark.createDataFrame(rows, library.BOOK)


def test_library(spark, books):
    def titles(query, status="all"):
        return sorted(r.title for r in library.view(books, query, status).collect())

    assert titles("") == ["Dune", "Roadside Picnic", "The Road"] and titles("road") == ["Roadside Picnic", "The Road"]
    assert titles("mcc road") == ["The Road"] and titles("HERB") == ["Dune"] and titles("erbert") == [] and titles("road", "unread") == ["Roadside Picnic"]
    new = spark.createDataFrame([("  Emma ", " Jane ")], "title string, author string")
    added = library.add(books, new, now()).where("title = 'Emma'").first()
    assert (added.author, added.status, added.source, added.photo_count) == ("Jane", "unread", "manual", 1) and len(added.id) == 36
    patch = spark.createDataFrame([("a", "read", None)], "id string, status string, title string")
    assert {r.id: r.title for r in library.update(books, patch, now()).collect()} == {"a": "The Road", "b": "Roadside Picnic", "c": "Dune"}
    with pytest.raises(Exception, match="no book zz"):
        library.update(books, spark.createDataFrame([("zz", "x")], "id string, title string"), now()).collect()
    saved = library.save_cards(books, cards(spark, ("", "A", 60), ("Winter Letters", "B", 90))).where("source = 'ocr'").orderBy("title").collect()
    assert [(r.title, r.author, r.photo_count, r.reader, r.confidence) for r in saved] == [("Untitled", "A", 1, "by0", 60), ("Winter Letters", "B", 1, "by1", 90)]
    assert library.settings({"theme": "dark"}, {"languages": ["eng"]}) == {**library.DEFAULTS, "theme": "dark", "languages": ["eng"]}


def test_export_and_import(spark, books, tmp_path):
    library.export_file(books, f"{tmp_path}/backup", "2024-05-06")
    text = spark.read.text(f"{tmp_path}/backup").first().value
    document = json.loads(text)
    assert (document["format"], document["version"], document["exported"], len(document["books"])) == (library.FORMAT, library.VERSION, "2024-05-06", 3)
    added, summary = library.import_file(books.where("id = 'a'"), f"{tmp_path}/backup", now())
    assert tuple(summary.first()) == (2, 1)
    back = {r.id: r for r in added.collect()}
    assert bytes(back["b"].cover) == b"\x01\x02" and back["b"].cover_type == "image/png" and back["b"].status == "unread" and back["b"].photo_count == 2
    assert back["c"].date_added == books.where("id = 'c'").first().date_added
    with pytest.raises(Exception, match="not a library export"):
        library.read_export(spark.createDataFrame([('{"format": "other", "books": []}',)], "value string")).collect()


def test_entries_that_are_skipped(spark, books):
    entries = ['{"id":"n1","title":"New"}', '{"x":{"id":"a"},"id":5,"title":"q"}', '{"id":"n2","title":7}', "null", '{"title":"no id"}', "[1]", '"text"', '{"id":"n1","title":"Again"}', '{"id":"a","title":"Here"}', '{"id":"n3","title":"","author":null,"status":"READ"}', "not json"]
    rows = spark.createDataFrame(list(enumerate(entries)), "place int, entry string")
    added, summary = library.import_entries(books, rows, now())
    assert {(r.id, r.title, r.author, r.status, r.source, r.photo_count) for r in added.collect()} == {("n1", "New", "", "unread", "manual", 1), ("n3", "", "", "unread", "manual", 1)}
    assert tuple(summary.first()) == (2, 9)
    empty, none = library.import_entries(books, rows.limit(0), now())
    assert empty.collect() == [] and tuple(none.first()) == (0, 0)


def test_offline_files(spark):
    assets = spark.createDataFrame([("eng", "e1", 100), ("eng", "e2", 50), ("mkd", "m1", 7)], "language string, url string, bytes long")
    assert tuple(library.offline_plan(assets, ["eng"]).first()) == (2, 4_000_150)
    here = spark.createDataFrame([("e1",), ("m1",), ("e1",)], "url string")
    ready = [library.offline_ready(assets, here, x).first().ready for x in (["eng"], ["mkd"], ["mkd", "deu"], ["eng", "mkd"])]
    assert ready == [False, True, False, False]


def test_lookup_cache(spark):
    cached = spark.createDataFrame([("dune", ["d"], datetime.datetime(2024, 1, 1)), ("old", ["o"], datetime.datetime(2023, 1, 1))], "query string, docs array<string>, cached_at timestamp")
    asked = spark.createDataFrame([(" DUNE ",), ("old",), ("new",)], "query string")
    assert {r.query: r.docs for r in cache.probe(asked, cached, "2024-01-20 00:00:00").collect()} == {" DUNE ": ["d"], "old": None, "new": None}
    stored = cache.store(cached, spark.createDataFrame([("Old ", ["o2"])], "query string, docs array<string>"), "2024-02-01 00:00:00")
    assert {r.query: r.docs for r in stored.collect()} == {"dune": ["d"], "old": ["o2"]}


def test_a_hit_does_not_make_an_entry_younger(spark):
    hour = 3600
    times = {"k": [0, 10, 20, 31, 40, 62, 200], " K": [5], "z": [0]}
    rows = [(i * 100 + j, k, datetime.datetime.fromtimestamp(t * hour, datetime.UTC)) for i, (k, ts) in enumerate(times.items()) for j, t in enumerate(ts)]
    found = cache.hits(spark.createDataFrame(rows, "event_id long, key string, ts timestamp"), ttl_ms=30 * hour * 1000)
    assert {r.event_id: r.hit for r in found.collect()} == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 100: True, 200: False}

"""The stored catalogue index, grouping at scale, work until settled, and reading with fallbacks."""

import json
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import cache, catalogue, evaluate, frontier, identify, library, similar
from evidentia.operators import lines as L
from evidentia.plans import queries as queries_plan
from evidentia.plans import registry, views
from evidentia.sources import fallback

FOLDER = "/root/testdata/sf0.001"

# ------------------------------------------------------------------ catalogue index


def _titles(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(40)]
    return [(i, " ".join(["everywhere", *rng.choice(words, int(rng.integers(1, 9)), p=np.arange(40, 0, -1) / 820)]), ["Ana Stone"] if i % 3 else None, 1) for i in range(n)]


def _best(queries, titles, limit):
    docs = [(i, t.split() + (["ana", "stone"] if a else [])) for i, t, a, _ in titles]
    out = []
    for scan, number, query in queries:
        wanted = set(query.split()) - set(T.STOPWORDS)
        scored = sorted((-len(wanted & set(ws)), len(ws), i) for i, ws in docs if wanted & set(ws))
        out += [(scan, number, p, i, -s) for p, (s, _, i) in enumerate(scored[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_search_skips_blocks_and_loses_nothing(spark, tmp_path, block):
    titles = _titles(700, 1)
    frame = spark.createDataFrame(titles, "doc_id long, title string, author_name array<string>, edition_count int")
    index = catalogue.write_index(frame, f"{tmp_path}/index", block)
    assert index.blocks.agg(F.max("n")).first()[0] <= block
    rng = np.random.default_rng(2)
    asked = [(s, 1, " ".join(rng.choice(["everywhere", "ana", "nothing", "the", *[f"word{i}" for i in range(40)]], int(rng.integers(1, 14))))) for s in range(80)]
    asked += [(90, 1, "everywhere"), (91, 1, "everywhere stone"), (92, 1, ""), (93, 1, "the of"), (94, 2, "nothing known")]
    found = catalogue.search(spark.createDataFrame(asked, "scan_id long, query_no int, query string"), index)
    assert sorted(map(tuple, found.collect())) == _best(asked, titles, 5)
    assert [tuple(map(str, x)) for x in (catalogue.read_index(spark, f"{tmp_path}/index").words.dtypes,)] == [tuple(map(str, x)) for x in (index.words.dtypes,)]


def test_search_is_the_join(spark, tmp_path):
    """The same rows as counting words in common over the whole catalogue."""
    docs = views.documents(spark, FOLDER)
    queries = docs.select(F.col("doc_id").alias("scan_id"), F.lit(1).alias("query_no"), F.array_join(T.significant_tokens(F.col("text")), " ").alias("query"))
    items = views.catalogue(spark, FOLDER)
    found = catalogue.search(queries, catalogue.write_index(items, f"{tmp_path}/index"))
    assert sorted(map(tuple, found.drop("shared").collect())) == sorted(map(tuple, identify.search_catalogue(queries, items).collect()))


def test_word_in_every_title_is_dealt_to_many_tasks(spark, tmp_path):
    forward = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 2).cast("int").alias("size"), F.array(F.lit("everywhere"), F.concat(F.lit("w"), F.col("id") % 90)).alias("words"))
    sizes = [r["count"] for r in catalogue.sorted_postings(forward).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 3 * np.median(sizes)


# ------------------------------------------------------------------ groups


def _alike(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row, last = [i], row
            for j, q in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != q)))
        return row[-1]

    char = 1 - distance(a, b) / max(len(a), len(b))
    x, y = set(a.split()), set(b.split())
    token = 2 * len(x & y) / (len(x) + len(y))
    return 1.0 if a == b else max(char, (char + token) / 2, token * 0.95)


@pytest.mark.parametrize("least", [0.7, 0.8, 0.85, 0.95])
def test_no_similar_pair_is_lost(spark, least):
    rng = np.random.default_rng(3)
    words = ["river", "the", "house", "of", "leaves", "a", "moon", "ii"]
    texts = {" ".join(rng.choice(words, int(rng.integers(1, 6)))) for _ in range(60)} | {"ab", "abc", "abcd", "abcdef", "abcdeg", "aaaaaaaa", "aaaaaaab", "x"}
    for t in list(texts)[:40]:  # damage some letters
        at = int(rng.integers(0, len(t)))
        texts |= {t[:at] + "q" + t[at + 1 :], t[:at] + t[at + 1 :], t + " the"}
    texts = sorted({" ".join(t.split()) for t in texts} - {""})
    wanted = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if _alike(a, b) >= least}
    found = similar.similar_texts(spark.createDataFrame([(t,) for t in texts], "n string"), least)
    assert {(r.a, r.b) for r in found.collect()} == wanted


def test_components_of_a_chain_a_hub_and_copies(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (None, 3), (400, 399), (399, 400), (399, 400)]
    found = dict(map(tuple, similar.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), 399: 399, 400: 399}
    assert similar.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_groups_of_copies_and_blanks(spark):
    rows = [(i, "The Long River", "Ana Stone") for i in range(500)] + [(600, "The Long Rivers", "Ana Stone"), (601, "the long river", None), (602, "The Long River", "Zebulon Quirke-Oxley"), (603, "", "Ana Stone"), (604, None, None), (605, "Elsewhere", "")]
    found = dict(map(tuple, similar.similar_groups(spark.createDataFrame(rows, "item_no long, title string, author string")).collect()))
    assert {found[i] for i in (*range(500), 600, 601, 602)} == {0}  # 602 is alike to 601, which has no author
    assert [found[i] for i in (603, 604, 605)] == [603, 604, 605]


# ------------------------------------------------------------------ until settled


def test_settled_scans_are_not_read_again(spark):
    rows = views.lines(spark, FOLDER).withColumn("pass_no", (F.col("line_no") % 5).cast("int"))
    rows = rows.withColumn("words", F.array().cast("array<struct<text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>>>")).persist()
    asked = []

    def read(scans, number):
        asked.append({r.scan_id for r in scans.select("scan_id").collect()})
        return rows.where(F.col("pass_no") == number).join(scans.select("scan_id"), "scan_id", "left_semi")

    found = frontier.read_until_strong(rows.select("scan_id").distinct(), read, [0, 1, 2, 3, 4], least=2)
    keys = ["scan_id", "pass_no", "line_no"]
    wanted = sorted(map(tuple, L.passes_until_strong(rows, least=2).select(*keys).collect()))
    assert sorted(map(tuple, found.select(*keys).collect())) == wanted
    needed = Counter(s for s, p in {(s, p) for s, p, _ in wanted})
    read_of = Counter(s for x in asked for s in x)
    assert all(later <= earlier for earlier, later in zip(asked, asked[1:], strict=False)) and len(asked[-1]) < len(asked[0])
    assert all(read_of[s] == max(p for t, p, _ in wanted if t == s) + 1 for s in needed if read_of[s] < 5)


def test_accepted_scans_are_not_asked_again(spark):
    titles = ["The Silent Harbour", "Winter Letters Home", "A Garden of Glass"]
    catalogue_rows = spark.createDataFrame([(i, t, ["Ana Stone"], 3) for i, t in enumerate(titles)], "doc_id long, title string, author_name array<string>, edition_count int")
    evidence = spark.createDataFrame([(1, ["silent", "harbour", "the", "ana", "stone"], ["ana", "stone"], []), (2, ["winter", "letters"], [], []), (3, ["nothing"], [], [])], "scan_id long, words array<string>, author_words array<string>, title_words array<string>")
    queries = spark.createDataFrame([(1, 1, "garden glass"), (1, 2, "silent harbour ana stone"), (1, 3, "winter letters"), (2, 1, "winter letters home"), (2, 2, "silent"), (3, 1, "glass"), (3, 2, "harbour")], "scan_id long, query_no int, query string")
    asked = []

    def ask(some):
        asked.extend((r.scan_id, r.query_no) for r in some.collect())
        return identify.search_catalogue(some, catalogue_rows).join(catalogue_rows, "doc_id")

    found = frontier.ask_until_accepted(queries, evidence, ask)
    everything = identify.score_documents(identify.distinct_documents(identify.search_catalogue(queries, catalogue_rows).join(catalogue_rows, "doc_id")).join(evidence, "scan_id"))
    keys = ["scan_id", "doc_id", "query_no", "accepted", "reason", "doc_rank"]
    assert sorted(map(tuple, identify.stop_early(found).select(*keys).collect())) == sorted(map(tuple, identify.stop_early(everything).select(*keys).collect()))
    assert (1, 3) not in asked and (3, 2) in asked and len(asked) == len(set(asked))


# ------------------------------------------------------------------ fallbacks

GOOD = json.dumps({"candidates": [{"content": {"parts": [{"text": json.dumps({"title": "Dune", "author": "Frank Herbert", "confidence": 90})}]}}]})


class Scripted:
    """A client that answers by the image's kind and notes each request in a file."""

    def __init__(self, name, log, gone=False):
        self.name, self.log, self.gone = name, str(log), gone

    def __call__(self, batch):
        kinds = batch["kind"].tolist()
        if len(kinds) > 1 and any(k in ("slow", "dropped") for k in kinds):
            raise RuntimeError("one of the batch can't be sent")
        with Path(self.log).open("a") as f:
            f.writelines(f"{self.name} {i}\n" for i in batch["image_id"])
        if "slow" in kinds:
            raise TimeoutError("timed out")
        if "dropped" in kinds:
            raise ConnectionError("failed to fetch")
        answers = {"good": (200, GOOD), "denied": (401, "nope"), "forbidden": (403, "nope"), "quota": (429, "nope"), "down": (500, "nope"), "key": (400, '{"error": {"message": "API key not valid"}}'), "bad": (400, "bad image"), "prose": (200, "not json at all"), "hollow": (200, '{"candidates": []}'), "lost": (404, "not here")}
        rows = [(404, "models/x is not found for API version") if self.gone else answers[k] for k in kinds]
        return pd.DataFrame({"image_id": batch["image_id"].to_numpy(), "status": [s for s, _ in rows], "body": [b for _, b in rows]})


KINDS = {"good": None, "denied": "auth", "forbidden": "auth", "quota": "rate-limit", "down": "server", "key": "auth", "bad": "server", "prose": "malformed", "hollow": "malformed", "lost": "server", "slow": "timeout", "dropped": "network"}


def _requests(log):
    return Counter(tuple(x.split()) for x in Path(log).read_text().splitlines()) if Path(log).exists() else Counter()


def _images(spark):
    return spark.createDataFrame(list(enumerate(KINDS)), "image_id long, kind string").repartition(3)


def test_kinds_of_failure_and_one_request_each(spark, tmp_path):
    log = tmp_path / "log"
    found = {r.image_id: r for r in fallback.read_by_models(_images(spark), [fallback.Model("a", Scripted("a", log)), fallback.Model("b", Scripted("b", log))]).collect()}
    assert {kind: found[i].error for i, kind in enumerate(KINDS)} == KINDS
    assert (found[0].title, found[0].author, found[0].confidence, found[0].model, found[0].tried) == ("Dune", "Frank Herbert", 90, "a", 1)
    # no failure but a model that is gone costs a second request
    assert _requests(log) == Counter({("a", str(i)): 1 for i in range(len(KINDS))})


def test_next_model_only_where_one_is_gone(spark, tmp_path):
    log = tmp_path / "log"
    models = [fallback.Model("old", Scripted("old", log, gone=True)), fallback.Model("new", Scripted("new", log)), fallback.Model("old", Scripted("old", log, gone=True))]
    images = _images(spark).where("kind in ('good', 'quota')")
    found = {r.kind: r for r in fallback.read_by_models(images, models).collect()}
    assert (found["good"].title, found["good"].model, found["good"].tried, found["quota"].error) == ("Dune", "new", 2, "rate-limit")
    assert sorted(n for n, _ in _requests(log).elements()) == ["new", "new", "old", "old"]
    (none,) = fallback.read_by_models(images.where("kind = 'good'"), models[:1]).collect()
    assert (none.error, none.title) == ("server", None)
    with pytest.raises(ValueError, match="no model"):
        fallback.read_by_models(images, [])


def test_failed_images_go_to_the_device(spark, tmp_path):
    log, seen = tmp_path / "log", []

    def device(images):
        seen.extend(r.image_id for r in images.collect())
        none = F.array().cast("array<string>")
        return images.select(F.col("image_id").alias("scan_id"), F.lit("by device").alias("title"), F.lit("").alias("author"), F.lit(40).alias("confidence"), F.lit("r").alias("reason"), none.alias("title_alternates"), none.alias("author_alternates"), F.lit("ocr").alias("source"), F.lit("").alias("raw_text"))

    found = {r.scan_id: r for r in fallback.read_with_fallback(_images(spark), [fallback.Model("a", Scripted("a", log))], device, F.col("kind") != "bad").collect()}
    assert len(found) == len(KINDS) and sorted(seen) == list(range(1, len(KINDS)))
    by_kind = {k: found[i] for i, k in enumerate(KINDS)}
    assert (by_kind["good"].source, by_kind["good"].fell_back) == ("ai", None)
    assert (by_kind["bad"].source, by_kind["bad"].failure) == ("ocr", None) and ("a", "6") not in _requests(log)
    assert all(by_kind[k].failure == v and by_kind[k].fell_back for k, v in KINDS.items() if v and k != "bad")


# ------------------------------------------------------------------ medians and prefixes


@pytest.mark.parametrize("around", [(0.499, 0.501), (0.1, 0.2)])
def test_upper_median_sorts_no_group(spark, monkeypatch, around):
    """Small, large, tied and null groups; bounds that miss the rank are made good."""
    monkeypatch.setattr(evaluate, "AROUND", around)
    rng = np.random.default_rng(6)
    groups = {"one": [5.0], "two": [2.0, 1.0], "tied": [3.0] * 999 + [1.0, 2.0], "hot": rng.normal(size=20_000).tolist(), None: [-1.0, -3.0, -2.0], "even": list(map(float, range(1000)))}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("two", None), ("none", None)]
    found = {r.k: r.v for r in evaluate.upper_median_of(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert found == {k: sorted(xs)[len(xs) // 2] for k, xs in groups.items()}
    whole = evaluate.upper_median_of(spark.createDataFrame(rows, "k string, v double"), [], "v").collect()
    every = sorted(x for xs in groups.values() for x in xs)
    assert [r.v for r in whole] == [every[len(every) // 2]]


def test_many_searches_are_each_search(spark):
    rng = np.random.default_rng(8)
    words = ["river", "Rivers", "ri", "the", "Ėmile", "of", "r", "night", "nightfall"]
    books = spark.createDataFrame([(str(i), " ".join(rng.choice(words, int(rng.integers(1, 5)))), "Ana Stone" if i % 2 else None) for i in range(80)], "id string, title string, author string")
    queries = ["ri", "riv an", "r", "night", "emil", "x", "nightf sto", "the the", " - ", "Rivers of"]
    found = library.search_many(books, spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")).collect()
    wanted = {(i, r.id) for i, q in enumerate(queries) if q != " - " for r in library.search(books, q).collect()}
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


def test_no_filter_works_out_what_lines_measure(spark):
    """The text chain stands in projections only: a filter names what was written."""
    plan = L.usable_lines(views.lines(spark, FOLDER, noisy=True))._jdf.queryExecution().optimizedPlan().toString()
    assert all(line.count("translate") <= 2 for line in plan.splitlines() if "Filter" in line)


def test_readings_are_pooled_by_numbers(spark):
    """Long lines make 33 readings a pass: only the lines themselves are dealt out, once, and nothing is written."""
    found = registry.QUERIES["hypothesis_pool"](spark, FOLDER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "passes-" not in plan and "readings-" not in plan and "candidates-" not in plan
    assert all("title" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_characters_are_counted_as_by_matches(spark):
    """Counting by what is left gives what counting matches gave, odd spaces, marks and empty texts included."""
    texts = ["", " ", "a", "Ab  c D　e", "\tрј x ѝ﻿", "i", "ai b ca", "12 34", "Łódź — №5", "\U0001d400 b", "one two three four five", "a b c d e f", "A B C d e", "x\x1fy z", "a\x0bb\x0cc"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", T.normalise(F.col("t")))
    like = f" (?=[^ ]{{2}})[^ ]*?{T.VOWELS[:-1]}{T.SYLLABIC[1:]}"
    t, n, solid = F.col("t"), F.col("n"), F.length("t") - F.regexp_count("t", F.lit(T.SPACE))
    words = F.regexp_count(t, F.lit(f"[^{T.SPACE[1:-1]}]+"))
    odd = "[" + T.SPACE[1:-1].replace(r"\s", r"\t\n\f\r") + "]"
    for r in rows.select(
        "t", T.letter_count(t).alias("a"), F.regexp_count(t, F.lit(r"\p{L}")).alias("a2"), T.letter_ratio(t).alias("b"), F.when(solid == 0, 0.0).otherwise(F.regexp_count(t, F.lit(r"\p{L}")) / solid).alias("b2"),
        T.wordiness_of(n).alias("c"), F.coalesce(F.try_divide(F.regexp_count(F.concat(F.lit(" "), n), F.lit(like)), F.regexp_count(n, F.lit("[^ ]+"))), F.lit(0.0)).alias("c2"),
        T.collapse(t).alias("d"), F.trim(F.regexp_replace(t, f" ?{odd}{T.SPACE}*| {{2,}}{T.SPACE}*", " ")).alias("d2"), (T.name_shape_of(t) == 0).alias("e"), ((words < 1) | (words > 5)).alias("e2"),
    ).collect():
        assert (r.a, r.b, r.c, r.d) == (r.a2, r.b2, r.c2, r.d2), r
        assert r.e or not r.e2, r


def test_equal_searches_and_books_meet_once(spark, monkeypatch):
    met = []
    monkeypatch.setattr(library, "stored", lambda df, name: met.append(df.count()) or df)
    books = spark.createDataFrame([(str(i), "River of Night", "Ana Stone") for i in range(40)], "id string, title string, author string")
    found = library.search_many(books, spark.createDataFrame([(i, "an riv") for i in range(30)], "query_id int, query string"))
    assert found.count() == 1200 == found.distinct().count() and met == [1]


def test_the_cache_is_one_stream_over_sorted_keys(spark):
    """Batches cut keys anywhere; against a fold of plain Python."""
    rng = np.random.default_rng(3)
    hours = {k: sorted(rng.integers(0, 300, n).tolist()) for k, n in (("a", 1), ("b", 40), ("c", 7), ("d", 100))}
    rows = [(i * 1000 + j, k, pd.Timestamp(h * 3600, unit="s").to_pydatetime()) for i, (k, hs) in enumerate(hours.items()) for j, h in enumerate(hs)]
    wanted = {}
    for i, hs in enumerate(hours.values()):
        missed = None
        for j, h in enumerate(hs):
            wanted[i * 1000 + j] = missed is not None and h - missed <= 30
            missed = missed if wanted[i * 1000 + j] else h
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            hits = cache.hits(spark.createDataFrame(rows, "event_id long, key string, ts timestamp"), 30 * 3600 * 1000)
            assert {r.event_id: r.hit for r in hits.collect()} == wanted
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in hits._jdf.queryExecution().executedPlan().toString()


def test_words_of_scans_are_not_dealt_out_by_document(spark, monkeypatch):
    """A search by a small catalogue counts where the queries lie, and pairs whose words are matched already aren't written."""
    items = spark.createDataFrame([(i, f"iron harvest {i}", ["Ana Stone"], 1) for i in range(20)], "doc_id long, title string, author_name array<string>, edition_count int")
    queries = spark.createDataFrame([(s, 1, "iron harvest stone") for s in range(5)], "scan_id long, query_no int, query string")
    found = identify.search_catalogue(queries, items)
    assert found.count() == 25
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("doc_id" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    monkeypatch.setattr(identify, "stored", lambda *_: pytest.fail("written"))
    none = F.array().cast("array<string>")
    pairs = found.join(items, "doc_id").withColumns({"hit": F.array(F.lit("iron"), F.lit("harvest")), "words": F.array(F.lit("iron"), F.lit("harvest")), "author_words": none, "title_words": none})
    assert {round(r.title_support, 3) for r in identify.score_documents(pairs).collect()} <= {0.917, 0.846}


def test_a_small_index_is_counted_in_one_go(spark, tmp_path, monkeypatch):
    """Nothing is written for a search that every task can do by itself; of a larger index blocks are read, with the same rows."""
    titles = _titles(300, 4)
    index = catalogue.write_index(spark.createDataFrame(titles, "doc_id long, title string, author_name array<string>, edition_count int"), f"{tmp_path}/index", 16)
    rng = np.random.default_rng(5)
    asked = [(s, 1 + s % 2, " ".join(rng.choice(["everywhere", "ana", "nothing", "the", *[f"word{i}" for i in range(40)]], int(rng.integers(0, 14))))) for s in range(60)]
    queries = spark.createDataFrame(asked, "scan_id long, query_no int, query string")
    with monkeypatch.context() as m:
        m.setattr(catalogue, "stored", lambda *_: pytest.fail("written"))
        small = catalogue.search(queries, index)
        assert sorted(map(tuple, small.collect())) == _best(asked, titles, 5)
    monkeypatch.setattr(catalogue, "INDEX_ROWS", 0)
    large = catalogue.search(queries, index)
    assert sorted(map(tuple, large.collect())) == _best(asked, titles, 5) and large.dtypes == small.dtypes


@pytest.mark.parametrize("hits", [1, 40, 1 << 20])
def test_no_row_is_made_for_a_word_or_a_pair_of_a_small_index(spark, tmp_path, monkeypatch, hits):
    """Only the numbers of known words are dealt out; rows of one id count together, as in the query's SQL, and rows without an id are none."""
    monkeypatch.setattr(catalogue, "HITS", hits)
    titles = _titles(40, 6)
    items = [*titles, (7, "everywhere word1 word2 word3", None, 1), (7, "everywhere", None, 1), (None, "everywhere word0", None, 1), (50, None, None, 1)]
    index = catalogue.write_index(spark.createDataFrame(items, "doc_id long, title string, author_name array<string>, edition_count int"), f"{tmp_path}/index")
    rng = np.random.default_rng(7)
    asked = [(s // 2, 1 + s % 3, " ".join(rng.choice(["everywhere", "nothing", "the", *[f"word{i}" for i in range(40)]], int(rng.integers(0, 14))))) for s in range(60)]
    asked += [(0, 1, "everywhere everywhere word1"), (0, 1, "word1 word2"), (91, 1, None), (92, 1, ""), (93, 1, "nothing")]
    found = catalogue.search(spark.createDataFrame(asked, "scan_id long, query_no int, query string").repartition(3), index)

    docs = [(i, [*t.split(), *(["ana", "stone"] if a else [])] if t else []) for i, t, a, _ in items if i is not None]
    shared: Counter = Counter()
    for scan, number, query in asked:
        for word in set((query or "").split()) - set(T.STOPWORDS):
            shared.update((scan, number, i) for i, ws in docs if word in ws)
    wanted = []
    for scan, number in {k[:2] for k in shared}:
        best = sorted((-shared[scan, number, i], len(ws), i) for i, ws in docs if (scan, number, i) in shared)
        wanted += [(scan, number, place, i, -n) for place, (n, _, i) in enumerate(best[:5], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Generate", "Window", "Join"))


def test_an_empty_index_has_nothing(spark, tmp_path):
    index = catalogue.write_index(spark.createDataFrame([], "doc_id long, title string, author_name array<string>, edition_count int"), f"{tmp_path}/index")
    assert catalogue.search(spark.createDataFrame([(1, 1, "iron harvest")], "scan_id long, query_no int, query string"), index).collect() == []


@pytest.mark.parametrize("block", [4, 64])
def test_blocks_of_a_large_index_are_skipped(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(catalogue, "INDEX_ROWS", 0)
    test_search_skips_blocks_and_loses_nothing(spark, tmp_path, block)


def test_words_are_matched_once_until_accepted(spark, monkeypatch):
    """Each round looks only for the words that no answer had before, and no pair carries a scan's words."""
    met, matched = [], identify.fuzzy_words
    monkeypatch.setattr(identify, "fuzzy_words", lambda read, known: met.append([r.known for r in known.collect()]) or matched(read, known))
    items = spark.createDataFrame([(1, "Silent Harbour", ["Ana Stone"], 3), (2, "Silent Letters", ["Ana Stone"], 3)], "doc_id long, title string, author_name array<string>, edition_count int")
    evidence = spark.createDataFrame([(1, ["silent", "lettars", "stone", "ana"], [], []), (2, ["nothing"], [], [])], "scan_id long, words array<string>, author_words array<string>, title_words array<string>")
    queries = spark.createDataFrame([(s, n, q) for s in (1, 2) for n, q in enumerate(["harbour", "silent", "letters", "harbour stone"], 1)], "scan_id long, query_no int, query string")
    found = frontier.ask_until_accepted(queries, evidence, lambda some: identify.search_catalogue(some, items).join(items, "doc_id"))
    assert sorted(map(sorted, met)) == [["ana", "harbour", "silent", "stone"], ["letters"]]
    assert {(r.scan_id, r.doc_id, r.query_no, r.accepted) for r in found.collect()} == {(1, 1, 1, False), (2, 1, 1, False), (1, 2, 2, True), (2, 2, 2, False)}
    assert "words" not in found.columns


def test_scans_are_read_once_to_be_identified(spark, monkeypatch):
    """Evidence and detections start from one pooling of the readings."""
    met, pooled = [], queries_plan._hypotheses
    monkeypatch.setattr(queries_plan, "_hypotheses", lambda *x, **k: met.append(x) or pooled(*x, **k))
    found = registry.QUERIES["identify_scans"](spark, FOLDER)
    detected = {r.scan_id: r for r in registry.QUERIES["detect"](spark, FOLDER).collect()}
    rows = found.collect()
    assert len(met) == 2 and len(rows) == len(detected)  # one of them is the detection's own
    for r in rows:
        d = detected[r.scan_id]
        if not r.matched and not r.identified_author:
            assert (r.title, r.author, r.confidence, r.reason, "|".join(r.title_alternates), "|".join(r.author_alternates)) == (d.title, d.author, d.confidence, d.reason, d.title_alternates, d.author_alternates)


def test_a_whole_title_is_shown_where_it_was_read(spark):
    """What is shown of a document follows from the words matched already; titles are cut only where something can be cut."""
    items = spark.createDataFrame([(1, "Iron Harvest: A History of Fields", ["Ana Stone"], 3)], "doc_id long, title string, author_name array<string>, edition_count int")
    read = [(1, ["iron", "harvest", "ana", "stone"]), (2, ["iron", "harvest", "histary", "of", "fields", "ana", "stone"])]
    none = F.array().cast("array<string>")
    evidence = spark.createDataFrame(read, "scan_id long, words array<string>").withColumns({"author_words": none, "title_words": none})
    queries = evidence.select("scan_id", F.lit(1).alias("query_no"), F.lit("iron harvest").alias("query"))
    scans = evidence.select("scan_id", F.lit("x").alias("title"), F.lit("").alias("author"), F.lit(20).alias("confidence"), F.lit("r").alias("reason"), none.alias("title_alternates"), none.alias("author_alternates"), F.lit("ocr").alias("source"))
    assert {r.scan_id: r.title for r in identify.identify(scans, evidence, queries, items).collect()} == {1: "Iron Harvest", 2: "Iron Harvest: A History of Fields"}
    cuts = spark.createDataFrame([("  Dune  ",), ("A: B",), ("Dune; x",), ("Dune — x",), ("Dune—x",), ("x",), ("",), (None,)], "t string").select(T.main_title(F.col("t")).alias("m"))
    assert [r.m for r in cuts.collect()] == ["Dune", "A: B", "Dune", "Dune", "Dune—x", "x", "", None]


@pytest.mark.parametrize("least", [1, 2])
def test_passes_are_folded_a_scan_at_a_time(spark, least):
    """Against merging and judging the lines of every first so many passes; lines repeat across passes at other places and confidences."""
    rng = np.random.default_rng(9)
    texts = ["The Weight of Water", "the weight of water!", "Anita Shreve", "Iron Harvest Moon", "x", "--", "Silent Harbour Home"]
    rows = []
    for scan in range(60):
        for n in range(int(rng.integers(1, 10))):
            y = float(rng.integers(0, 4) * 40)
            rows.append((scan, int(rng.integers(0, 4)), n, texts[int(rng.integers(0, len(texts)))], float(rng.integers(60, 100)), (0.0, y, 300.0, y + float(rng.integers(20, 60)))))
    frame = spark.createDataFrame(rows, f"scan_id long, pass_no int, line_no int, text string, confidence double, bbox {L.BOX}").persist()
    last = {}
    for upto in range(4):
        for r in L.strong_evidence(L.merge_lines(frame.where(F.col("pass_no") <= upto)), ["scan_id"]).where("strong").collect():
            passes = sorted({p for s, p, *_ in rows if s == r.scan_id})
            if upto in passes[least - 1 :]:
                last.setdefault(r.scan_id, upto)
    found = L.passes_until_strong(frame, least)
    assert sorted((r.scan_id, r.pass_no, r.line_no) for r in found.collect()) == sorted((s, p, n) for s, p, n, *_ in rows if p <= last.get(s, 3))
    assert 10 < len(last) < 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "pass-lines" not in plan
    assert not any("dedupe" in x for x in plan.splitlines() if "Exchange hashpartitioning" in x)

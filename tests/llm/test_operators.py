"""The training-data operators against brute force, and on nulls, empty texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import components, htmltext, langid, minhash, mixing, neighbours, packing, queries, secrets, simhash, spans

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quiet harbour woke before the bell. Nine boats left with the tide and four came back by noon. Nobody on the quay asked where the others had gone. "


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and wordless texts, repeated rows, a long text and columns with clashing names."""
    rows = [
        (1, PROSE, "en", "a", 10), (1, PROSE, "en", "a", 10), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t", "en", None, 3), (None, PROSE + "x", "en", "a", 1),
        (5, "slovo 1 \U0001f600 password=abcdef12", None, "b", 5), (6, PROSE * 3000, "en", "c", 9), (7, "12345 67890", "de", "a", 11), (8, "null\x00byte and <|endoftext|>", "de", "\U0001f600", 8),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({c: F.lit(7) for c in ("id", "node", "size", "copies", "_key", "_keep", "_base", "_guess", "root", "fp", "h", "n", "kind")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, odd, FOLDER)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 4, 7})
    for name in ("near_duplicates", "secret_scan", "source_mix"):
        kept = stages[name](spark, kept, FOLDER)
        assert kept.columns == odd.columns
    assert "abcdef12" not in "".join(r.text for r in kept.collect())
    assert stages["packed"](spark, kept, FOLDER).count() > 0


def test_pipeline_stages_in_order(spark, docs):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secret_scan", "source_mix", "packed"]
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_simhash_against_brute_force(spark, docs, odd):
    def wanted(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    for frame in (docs, odd.where("doc_id is not null")):
        rows = frame.select("doc_id", "text").collect()
        prints = [(r.doc_id, wanted(r.text)) for r in rows]
        least = list(range(len(prints)))

        def find(i):
            while least[i] != i:
                i = least[i]
            return i

        for i, (_, a) in enumerate(prints):
            for j in range(i):
                if (a ^ prints[j][1]).bit_count() <= 2:
                    least[find(i)] = find(j)
        group = defaultdict(list)
        for i, (doc, _) in enumerate(prints):
            group[find(i)].append(doc)
        expected = sorted((doc, f"{fp:016x}", min(group[find(i)])) for i, (doc, fp) in enumerate(prints))
        found = simhash.near_duplicates(frame).select("doc_id", simhash.hexadecimal(F.col("fp")), "component_id")
        assert sorted(map(tuple, found.collect())) == expected


def test_simhash_links_are_exact(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    prints = set(base)
    for x in base:
        for n in (1, 2, 3):
            y = x
            for b in rng.choice(63, n, replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    prints = sorted(prints)
    expected = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    found = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()
    assert {tuple(r) for r in found} == expected


def test_one_document_of_each_group_stays_whatever_its_id(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(80)) for _ in range(6)]
    ids = [(None, 0), (None, 0), (None, 1), (None, 2), (9, 2), (5, 3), (7, 3), (5, 4), (8, 4), (5, 4), (3, 5)]
    docs = spark.createDataFrame([(i, texts[t], "en", "a", t) for i, t in ids], DOCS)
    found = [(r.doc_id, r.text) for r in simhash.deduplicate(docs).collect()]
    expected = [(None, 0), (None, 1), (9, 2), (5, 3), (5, 4), (3, 5)]
    assert sorted(found, key=repr) == sorted(((i, texts[t]) for i, t in expected), key=repr)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (None, 3), (100, 101), (101, 100)], "u long, v long")
    assert {r.node: r.root for r in components.connected_components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_packing_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.VOCABULARY)
    for frame in (docs, odd.where("doc_id not in (1, 6)")):
        texts = {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}
        pieces = defaultdict(list)
        for r in packing.pack(frame).collect():
            pieces[r.doc_id].append(r)
            assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert pieces.keys() == texts.keys()
        for doc, own in pieces.items():
            own.sort(key=lambda r: r.start)
            ids = [i for r in own for i in r.ids]
            assert ids == [*slow.encode(texts[doc], add_special_tokens=False).ids, 1]
            assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
            assert {r.doc_tokens for r in own} == {len(ids)}


def test_packing_refuses_other_lengths(docs):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, length=1000)


def test_mixing_meets_targets(spark, docs, odd):
    for frame in (docs, odd):
        rows = mixing.rates(frame).collect()
        again = mixing.rates(frame).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
        assert len(rows) == frame.count()
        taken, target, size = defaultdict(int), {}, {}
        names = {r.doc_id: r.source for r in frame.collect()}
        largest = defaultdict(int)
        for r in rows:
            source = names[r.doc_id]
            assert 0 <= r.taken <= 2 * r["size"]
            taken[source] += r.taken
            target[source], size[source] = r.target, r.source_size
            largest[source] = max(largest[source], r["size"])
        order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        left, free, expected = 1.5 * sum(size.values()), set(order), {}
        while free:
            level = left / sum(weights[s] for s in free)
            full = {s for s in free if level * weights[s] > 2 * size[s]}
            for s in full or free:
                expected[s] = 2 * size[s] if full else level * weights[s]
            left -= sum(expected[s] for s in full)
            free = free - full if full else set()
        for s in order:
            assert math.isclose(target[s], expected[s], rel_tol=1e-9, abs_tol=1e-6)
            assert abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s])


def test_secrets_against_patterns(spark, docs, odd):
    rules = [(0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), (1, "AKIA[A-Z0-9]+"), (2, "[0-9a-f]+")]
    found = secrets.scan(docs.unionByName(odd.select(docs.columns))).collect()
    texts = docs.unionByName(odd.select(docs.columns)).select("doc_id", "text").collect()
    expected = []
    for doc, text in texts:
        own = []
        for kind, rule in rules:
            for m in re.finditer(rule, text or "", re.I | re.A if kind == 0 else 0):
                if len(m[2]) >= 6 if kind == 0 else m.end() - m.start() >= (20, 24)[kind - 1]:
                    own.append((m.start(), kind, m.end()))
        expected.append((doc, sorted(own)))
    got = [(r.doc_id, [tuple(s) for s in r.base]) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in found)


def test_the_battery_finds_keys_and_leaves_words(spark):
    import base64
    import random

    rnd = random.Random(5)
    rows = [(i, f"see {base64.b64encode(rnd.randbytes(48)).decode()} there" if i % 4 == 0 else "the antidisestablishmentarianism of some_long_identifier_name_here stays", "en", "a", 1) for i in range(400)]
    found = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(bool(found[i]) for i in range(0, 400, 4)) >= 90
    assert not any(found[i] for i in range(400) if i % 4)


def test_minhash_against_brute_force(spark, docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    found = {r.doc_id: r for r in minhash.fingerprints_with_neighbours(docs).collect()}
    assert len(found) == len(rows)
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)].text or ""
        changed = minhash.edited(text, after)
        assert changed == text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert found[doc].n_chars == len(text)
        assert found[doc].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = set(minhash.shingles(text).tolist()), set(minhash.shingles(changed).tolist()), set(minhash.shingles(after).tolist())
        if a and b and c:
            assert abs(found[doc].near_edited - len(a & b) / len(a | b)) < 0.25
            assert abs(found[doc].near_next - len(a & c) / len(a | c)) < 0.25


def test_minhash_classes(spark, odd):
    found = sorted(map(repr, minhash.near_duplicates(odd.where("doc_id is not null")).collect()))
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(odd.where("doc_id is not null")).collect()}
    assert len(found) == 9
    assert classes[2] == classes[3] == classes[4] == 2
    assert classes[5] == 5


def test_minhash_pairs_of_chains_and_full_buckets_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)

    def words(n):
        return ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]

    texts = []
    for _ in range(5):  # each like the next, not like the one after it
        long = words(420)
        texts += [" ".join(long[i * 20 : i * 20 + 220]) for i in range(10)]
    shared = words(160)
    for _ in range(30):  # unlike each other, but of many common shingles; each has a near copy
        own = words(40)
        texts += [" ".join(shared + own), " ".join(words(12) + shared[12:] + own)]
    marks = [minhash.signature(t)[:4] for t in texts]
    # a single band of four bytes: no other bucket makes good for what one leaves out
    monkeypatch.setattr(minhash, "PERMUTATIONS", 4)
    monkeypatch.setattr(minhash, "BANDS", 1)
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    least = list(range(len(texts)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    width, buckets = minhash.PERMUTATIONS // minhash.BANDS, defaultdict(set)
    for i, mark in enumerate(marks):
        for b in range(minhash.BANDS):
            buckets[b, mark[b * width : (b + 1) * width].tobytes()].add(i)
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (mark.reshape(-1, width) == marks[j].reshape(-1, width)).all(axis=1).any():
                x, y = sorted((find(i), find(j)))
                least[y] = x
    assert max(map(len, buckets.values())) > 4
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    for more in ({}, {"leaders": 3}):
        found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, **more).collect()}
        assert found == {i: find(i) for i in range(len(texts))}


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 16))
    vectors[100] = vectors[2]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=256).collect()
    hits = defaultdict(dict)
    for r in found:
        hits[r.query_id][r.rank] = r
    assert sorted(hits) == list(range(0, 3000, 100))
    right = 0
    for q, own in hits.items():
        distance = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        best = set(np.lexsort((np.arange(3000), distance))[:10].tolist())
        right += len(best & {r.vec_id for r in own.values()})
        assert sorted(own) == list(range(1, 11))
        assert [r.score for _, r in sorted(own.items())] == sorted(r.score for r in own.values())
        assert all(math.isclose(r.score, distance[r.vec_id], rel_tol=1e-12, abs_tol=1e-12) for r in own.values())
    assert right / (10 * len(hits)) >= 0.9
    assert hits[100][1].vec_id == 2


def test_hilbert_curve_steps_by_one_cell():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert_index(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_main_text():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav><article><h1>A  tide &amp; a bell</h1>"
        f"<p>{PROSE}</p><script>var x = '<p>no</p>';</script><p>{PROSE}&copy;</p></article><div class='comments'><p>{PROSE}</p></div><footer><p>All rights reserved.</p></footer></body></html>"
    )
    assert htmltext.main_text(page) == f"A tide & a bell\n{PROSE.strip()}\n{PROSE}©"
    for broken in (None, "", "   ", "<", "<p", "<!--", "<div" * 1000, "</p></p>", "<script>x"):
        assert isinstance(htmltext.main_text(broken), str)


def test_minimum_cut_against_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = 6
        gain = rng.normal(size=n).tolist()
        edges = [(i, i + 1, float(rng.random())) for i in range(n - 1)]

        def cost(keep, gain=gain, edges=edges):
            return sum(-g if k and g < 0 else g if not k and g > 0 else 0 for g, k in zip(gain, keep, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(htmltext.minimum_cut(gain, edges)), best, abs_tol=1e-9)


def test_spans_remove_repeats_only(spark, odd):
    passage = "First the lamp was lit by the keeper at the usual hour of night. Then the long stair was climbed twice by the same two patient people. After that nothing at all moved until the morning bell rang out again."
    rows = [(1, f"One begins alone. {passage} One ends.", "en", "a", 1), (2, f"Two begins otherwise. {passage} Two ends.", "en", "a", 1), (3, "A clean text stands here. It repeats nothing that any other text has said before.", "en", "a", 1)]
    found = {r.doc_id: r for r in spans.remove_repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[1].text == rows[0][1] and found[3].text == rows[2][1]
    assert found[2].text == "Two begins otherwise. Two ends." and found[2].n_removed == 3
    cleaned = spans.remove_repeated_spans(odd)
    assert cleaned.count() == odd.count()
    assert {r.text for r in cleaned.where("doc_id = 2").collect()} == {None}


def test_spans_of_passages_that_begin_and_end_inside_sentences(spark):
    rng = np.random.default_rng(6)

    def words(n):
        return ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]

    rows, passages = [], []
    for i in range(40):
        passage = words(51)
        if i % 2:  # a break inside, but no whole sentence
            passage[20 + i % 10] += "."
        passages.append(passage)
        for k in (0, 100):
            # mid-word at both ends, other sentences around
            rows.append((i + k, f"{' '.join(words(9))}. {' '.join(words(3 + i % 7))} x{k}{' '.join(passage)}{k}y {' '.join(words(4))}. {' '.join(words(30))}", "en", "a", 1))
    whole = words(70)
    rows += [(300, f"Ein Anfang. \u0130 {' '.join(whole)} \U0001f600", "de", "a", 1), (301, f"Anders. \U0001f600 {' '.join(whole).upper()}", "de", "a", 1)]
    found = {r.doc_id: r for r in spans.remove_repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}
    texts = {r[0]: r[1] for r in rows}
    for i, passage in enumerate(passages):
        assert found[i].text == texts[i] and found[i].n_removed == 0
        left = found[i + 100].text
        own = set(left.split())
        assert not any(w in own for w in passage[13:-13]) and found[i + 100].n_removed > 0
        before, after = texts[i + 100].split(" x100")[0], texts[i + 100].split("100y ")[1]
        assert left.startswith(before) and left.endswith(after)
    assert found[300].text == texts[300]
    assert found[301].text.startswith("Anders. ") and len(found[301].text.split()) <= 2 + 22


def test_language_of_held_out_documents(spark, docs, odd):
    found = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    judged = [r for r in found if r.held_out and r.lang and any(c.isalpha() for c in r.text or "")]
    assert sum(r.lang == r.lang_pred for r in judged) / len(judged) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    rows = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 4, 7))

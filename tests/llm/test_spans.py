"""Removed spans against a literal form: every span spelled out, and texts cut character by character."""

import re

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import spans
from evidentia.llm.minhash import _mixed

MASK = 2**64 - 1


def mixed(x):
    return int(_mixed(np.array([x & MASK], np.uint64))[0])


def word_hash(word):
    total = 0
    for i, c in enumerate(word):
        total += (ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 2**64)
    return mixed(total)


def repeats(words):
    return any(all(words[i] == words[i - p] for i in range(p, len(words))) for p in range(1, min(spans.REPEATING, len(words) // 2) + 1))


def literal_spans(text):
    """(what is told, begin, end) of every span."""
    found = []
    cuts = [0, *(m.end() for m in re.finditer(r"[.!?]+\s+|\s*\n\s*", text)), len(text)]
    pieces = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    for i in range(len(pieces)):
        for j in range(i + 2, len(pieces) + 1):
            words = [text[a:b].lower().split() for a, b in pieces[i:j]]
            if sum(map(len, words)) >= spans.SENTENCE_WORDS:
                if not repeats([w for x in words for w in x]):
                    found.append((("sentences", *(" ".join(w) for w in words)), pieces[i][0], pieces[j - 1][1]))
                break
    words = [(m.group(), m.start()) for m in re.finditer(r"\S+", text.lower())]
    hashes = []
    for i in range(len(words) - spans.WORDS + 1):
        total = 0
        for w, _ in words[i : i + spans.WORDS]:
            total = (total * 0xD6E8FEB86659FD93 + word_hash(w)) & MASK
        hashes.append(mixed(total))
    chosen = set()
    for i in range(len(hashes) - spans.WINDOW + 1):
        window = hashes[i : i + spans.WINDOW]
        chosen |= {i + k for k, h in enumerate(window) if h == min(window)}
    ends = [b for _, b in words] + [len(text)]
    for i in sorted(chosen):
        run = [w for w, _ in words[i : i + spans.WORDS]]
        if not repeats(run):
            found.append((("run", *run), words[i][1], ends[i + spans.WORDS]))
    return found


def test_against_the_literal_form(spark):
    rng = np.random.default_rng(12)

    def prose(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 6))) + rng.choice(["", "", "", "", ".", "!\n"]) for _ in range(n))

    passages = [prose(60) for _ in range(4)]
    texts = []
    for i in range(40):
        text = prose(int(rng.integers(0, 90)))
        for p in rng.choice(4, int(rng.integers(0, 3))):
            text += f" x{passages[p]}y " + prose(int(rng.integers(0, 30)))
        texts.append(text if i % 9 else text + " la" * 60)
    texts += [texts[3], "", " \n "]
    first, expected = {}, {}
    for i, text in enumerate(texts):
        for told, _, _ in literal_spans(text):
            first.setdefault(told, i)
    for i, text in enumerate(texts):
        gone, seen = [False] * len(text), set()
        for told, a, b in literal_spans(text):
            if first[told] != i or told in seen:
                gone[a:b] = [True] * (b - a)
            seen.add(told)
        expected[i] = "".join(c for c, x in zip(text, gone, strict=True) if not x)
    found = spans.remove_repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in found.collect()} == expected
    assert sum(expected[i] != t for i, t in enumerate(texts)) > 10


def test_one_word_over_and_over_is_no_passage(spark):
    rows = [(i, f"Text number {i} begins at {i}{i}. {'la ' * 300}{i} ends at {i}.") for i in range(3)]
    found = spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.text, r.n_removed) for r in found.collect()} == {i: (t, 0) for i, t in rows}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumns({c: F.lit(3) for c in ("h", "n", "first", "known", "n_removed", "_spans", "sentences")})
    found = spans.remove_repeated_spans(docs)
    assert found.columns == [*[c for c in docs.columns if c != "n_removed"], "n_sentences", "n_removed"]
    assert found.first().n_removed == 0


def test_two_short_sentences_go_and_stock_phrases_stay(spark):
    rng = np.random.default_rng(5)

    def prose(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))

    passage = f"{prose(8)}. {prose(9)}. "
    rows = [(i, f"{prose(30)}. {passage if i < 3 else ''}{prose(30)}. Thank you very much. See you again soon. {prose(20)}.") for i in range(6)]
    found = {r.doc_id: r.text for r in spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: t.replace(passage, "") if i else t for i, t in rows}


def test_a_very_long_text(spark):
    rng = np.random.default_rng(6)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(400_000)]
    long = " ".join(w + "." * (k % 11 == 10) for k, w in enumerate(words))
    middle = long[1_000_000:1_001_000]
    found = {r.doc_id: r.text for r in spans.remove_repeated_spans(spark.createDataFrame([(1, long), (2, f"Begin. {middle} end."), (3, long)], "doc_id long, text string")).collect()}
    assert found[1] == long
    assert len(found[2]) < 120
    assert len(found[3]) < 120

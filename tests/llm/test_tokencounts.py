"""Token counts of flat files: against the tokenizer, across ends of blocks and files, and for files that aren't ours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import packing, tokencounts

FOLDER = "/root/testdata/sf0.001"


def naive(stream, end):
    """(start, length, closed) by walking through a stream."""
    found, start = [], 0
    for i, x in enumerate(stream):
        if x == end:
            found.append((start, i - start, True))
            start = i + 1
    return found + ([(start, len(stream) - start, False)] if start < len(stream) else [])


@pytest.mark.parametrize("width", [2, 4])
def test_files_against_a_walk(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    end, dtype = 9, f"<u{width}"
    streams = [[9, 1, 2, 3, 4, 5, 9, 9, 6], [1], [9], [1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 9], rng.integers(0, 12, 1000).tolist(), rng.integers(8, 10, 333).tolist(), rng.integers(10, 60000 if width == 2 else 1 << 31, 500).tolist()]
    for i, stream in enumerate(streams):
        np.array(stream, dtype).tofile(tmp_path / f"{i}.bin")
    files = tokencounts.list_token_files(spark, str(tmp_path))
    assert files.count() == len(streams)
    for block in (1, 4, 7, 1 << 20):
        found = tokencounts.count_tokens(tokencounts.find_separators(files, end, width, block)).collect()
        got: dict = {}
        for r in sorted(found, key=lambda r: (r.file, r.place)):
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.place, r.start, r.n_tokens, r.closed))
        assert got == {f"{i}.bin": [(k, *x) for k, x in enumerate(naive(s, end))] for i, s in enumerate(streams)}


def test_half_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole ids"):
        tokencounts.find_separators(tokencounts.list_token_files(spark, str(tmp_path))).collect()


def test_documents_against_the_tokenizer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencounts, "NAMES", 16)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(900001, None), (900002, ""), (900003, " \n"), (900004, "a <|endoftext|> b"), (900005, "word " * 30000), (None, "x"), (900004, "again")], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumns({c: F.lit(1) for c in ("file", "block", "size", "place", "bytes")})
    written = tokencounts.write_token_files(docs.repartition(3), f"file:{tmp_path}/tokens").cache()
    files = written.groupBy("file").agg(F.max("bytes").alias("bytes"))
    assert files.count() == 3
    counts = tokencounts.count_tokens(tokencounts.find_separators(files, block=100))
    found = sorted((repr(r.doc_id), r.n_tokens) for r in tokencounts.named(counts, written).collect())
    assert found == sorted((repr(r.doc_id), len(packing.ordinary(r.text or ""))) for r in docs.collect())
    written.unpersist()

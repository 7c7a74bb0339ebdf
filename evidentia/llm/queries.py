"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import htmltext, importance, langid, minhash, mixing, neighbours, packing, secrets, simhash, spans, suffixes, tokencounts, trie
from evidentia.llm.shared import materialize, scratch_dir, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``: the main text, empty for a null or blank page or one without content.

    Repeated rows stay. Pages of any size and depth are parsed whole, in time in proportion to their length. No rows give no rows.
    """
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", htmltext.length(F.col("text")).alias("n_chars"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 10 nearest other rows found of every row of ``embeddings`` whose vec_id is divisible by 100.

    Rows with a null id, and null, zero, or not wholly finite vectors, and those of another length than the most frequent, take no part. Ties go to the
    smaller id, equal vectors and repeated ids are candidates each. No rows give no rows.
    """
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op3_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents`` with its fingerprint, that of its edited text, and its likeness to it and to the next document.

    A null text is empty; texts without words have one fingerprint; null ids come first, rows of one id in order of their texts. Texts are
    hashed whole, a block at a time. No rows give no rows.
    """
    return minhash.fingerprints_with_neighbours(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``documents``.

    A null text has size 0, the null source comes last, rows of one id and text are decided alike, ties in size go by a digest of id and
    text. No rows give no rows.
    """
    return mixing.rates(table(spark, sf_dir, "documents")).drop("copies")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``documents``.

    A null or wordless text has fingerprint 0 and links like any other. Repeated rows stay. Null ids are the least only where a component has
    no other. Texts are hashed whole, in chunks of shingles. No rows give no rows.
    """
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) per row of ``documents``: the text without what an earlier text, or it itself before, says.

    Null texts stay null. Rows of one id are one document, rows without an id come last and are told apart by their texts. No rows give no
    rows.
    """
    cleaned = spans.remove_repeated_spans(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_sentences", "n_removed")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of a document of ``documents``: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset.

    A null or empty text gives the end id alone. Repeated rows are packed each. Long texts are as many pieces as they need. No rows give no rows.
    """
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, file, start) per document of ``documents``: its tokens are written to flat files in the shared folder and counted there.

    A null or empty text has 0 tokens. Rows of one id are counted each. No rows give no rows.
    """
    folder = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    written = materialize(tokencounts.write_token_files(table(spark, sf_dir, "documents"), folder), "token-files")
    files = written.groupBy("file").agg(F.max("bytes").alias("bytes"))
    counts = tokencounts.count_tokens(tokencounts.find_separators(files))
    return tokencounts.named(counts, written).select("doc_id", "n_tokens", "file", "start")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``documents``.

    A null text is empty: no spans and the digest of an empty text. Repeated rows stay; whole texts are scanned. No rows give no rows.
    """
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``documents``.

    Null texts and texts without a letter are ``und`` with score 0. Equal cosines go to the first language by name. Repeated rows stay; long
    texts are bundled piece by piece. No rows give no rows.
    """
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``documents``: what is left without strings of 50 bytes that a smaller doc_id has.

    A null text is empty. Rows without an id come last; rows of one id take nothing from each other. Whole texts are sorted, of any length. No
    rows give no rows.
    """
    found = suffixes.remove_repeated_strings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``documents``, drawn towards the texts of ``benchmark``.

    Null and wordless texts have no features, weight 0 and no rank. Equal scores go to the smaller id, null ids last; repeated rows are ranked
    each. Texts are counted whole. No rows give no rows.
    """
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per node of the trie of all rebuilt ``conversations``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, null turns come first, rows without a conv_id are left out. No rows give no rows.
    """
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_minhash_fingerprints": op3_minhash_fingerprints,
    "op4_mixing": op4_mixing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_trie": op13_conversation_trie,
}

#: The sources' targets, the bisection of their multipliers and the rounding by level and cell, in one statement.
_MIX = r"""WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(chr(1), coalesce(doc_id::VARCHAR, '-'), coalesce(text, ''))), 1, 15))::BIGINT AS draw FROM documents
), s AS (
  SELECT *, greatest(0, length(bin(size)) - 9) AS power FROM d
), sized AS (
  SELECT doc_id, source, size, draw, power * 512 + (size >> power) AS level FROM s
), levels AS (
  SELECT source, level, count(*) AS n, sum(size)::BIGINT AS words, sum(size)::DOUBLE / count(*) AS mean FROM sized GROUP BY ALL
), totals AS (
  SELECT source, sum(words)::BIGINT AS source_size, coalesce(sum(words * mean) / nullif(sum(words), 0), 1.0::DOUBLE) AS scale FROM levels GROUP BY 1
), ranked AS (
  SELECT *, 2 * source_size AS most, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM totals
), filled AS (
  SELECT *, row_number() OVER w AS place, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water
  FROM ranked WINDOW w AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)
), sources AS (
  SELECT source, source_size, scale, CASE WHEN water * weight >= most THEN most::DOUBLE ELSE coalesce((SELECT arg_min(water, place) FROM filled WHERE water * weight < most), 0) * weight END AS target FROM filled
), tilts AS (
  SELECT s.source, list(mean / scale) AS x, list(words) AS words FROM levels l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source GROUP BY 1
), steps AS (
  SELECT s.source, 0 AS round, -1000.0::DOUBLE AS low, 1000.0::DOUBLE AS high, target, x, words FROM sources s JOIN tilts t ON s.source IS NOT DISTINCT FROM t.source WHERE target > 0 AND target < 2 * source_size
  UNION ALL
  SELECT source, round + 1, CASE WHEN got < target THEN (low + high) / 2 ELSE low END, CASE WHEN got < target THEN high ELSE (low + high) / 2 END, target, x, words
  FROM (SELECT *, list_sum(list_transform(list_zip(x, words), lambda p: p[2] * least(2.0::DOUBLE, exp(least(700.0::DOUBLE, (low + high) / 2 * p[1]))))) AS got FROM steps WHERE round < 80)
), solved AS (
  SELECT source, (low + high) / 2 AS multiplier FROM steps WHERE round = 80
), rated AS (
  SELECT l.source, level, n, mean, source_size, target, round(1000000 * CASE WHEN target <= 0 THEN 0.0::DOUBLE WHEN target >= 2 * source_size THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, exp(least(700.0::DOUBLE, multiplier * (mean / scale)))) END)::BIGINT AS parts
  FROM levels l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN solved m ON l.source IS NOT DISTINCT FROM m.source
), run AS (
  SELECT *, (sum(n * parts) OVER (PARTITION BY source ORDER BY level))::BIGINT AS upto FROM rated
), tried AS (
  SELECT source, k * 1000000 // 32 AS start, round(abs(sum(((upto + k * 1000000 // 32) // 1000000 - (upto - n * parts + k * 1000000 // 32) // 1000000) * mean) - any_value(target)), 3) AS off FROM run, range(32) t(k) GROUP BY ALL
), starts AS (
  SELECT source, arg_min(start, (off, start)) AS start FROM tried GROUP BY 1
), placed AS (
  SELECT r.source, level, n, source_size, target, parts // 1000000 AS each, greatest(0, least(n, (upto + start) // 1000000 - (upto - n * parts + start) // 1000000 - n * (parts // 1000000))) AS extra, ceil(sqrt(n) / 4)::BIGINT AS cells
  FROM run r JOIN starts s ON r.source IS NOT DISTINCT FROM s.source
), dealt AS (
  SELECT doc_id, size, draw, p.*, draw % cells AS cell FROM sized d JOIN placed p ON d.source IS NOT DISTINCT FROM p.source AND d.level = p.level
), counts AS (
  SELECT source, level, cell, any_value(n) AS n, any_value(extra) AS extra, count(*) AS m FROM dealt GROUP BY ALL
), shares AS (
  SELECT source, level, cell, floor(extra::HUGEINT * upto // n)::BIGINT - floor(extra::HUGEINT * (upto - m) // n)::BIGINT AS wanted FROM (SELECT *, (sum(m) OVER (PARTITION BY source, level ORDER BY cell))::BIGINT AS upto FROM counts)
), limits AS (
  SELECT d.source, d.level, d.cell, list_extract(list(draw ORDER BY draw), any_value(wanted)) AS up_to FROM dealt d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source AND d.level = s.level AND d.cell = s.cell WHERE wanted > 0 GROUP BY 1, 2, 3, wanted
)
SELECT doc_id, size, source_size, target, ((each + CASE WHEN draw <= up_to THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM dealt d LEFT JOIN limits l ON d.source IS NOT DISTINCT FROM l.source AND d.level = l.level AND d.cell = l.cell"""

#: The exact search. Tables of at most a window's 512 vectors are searched whole; beyond that recall is what tests measure.
_NEAREST = """WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 10"""

#: The CRC-32 of each ``w`` of a relation ``strings``, byte by byte through a table that bits give.
_CRC = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))
), crcs AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda j: ('0x' || substr(hex(encode(w)), 2 * j + 1, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS crc
  FROM (SELECT DISTINCT w FROM strings), crc_table
)"""

_RESAMPLE = (
    r"""WITH words AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
), wanted AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), strings AS (
  SELECT w FROM words UNION SELECT w FROM wanted
), """
    + _CRC
    + """, buckets AS MATERIALIZED (
  SELECT w, crc % 10000 AS bucket FROM crcs
), has AS (
  SELECT bucket, count(*)::DOUBLE AS s FROM words JOIN buckets USING (w) GROUP BY 1
), wants AS (
  SELECT bucket, count(*)::DOUBLE AS t FROM wanted JOIN buckets USING (w) GROUP BY 1
), gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM has) + 10000) / ((s + 1) * ((SELECT sum(t) FROM wants) + 10000))))::BIGINT AS gain FROM has LEFT JOIN wants USING (bucket)
), weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY 1
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM placed) // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
)

_TRIE = (
    """WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), strings AS (
  SELECT DISTINCT conv_id::VARCHAR AS w FROM own
), """
    + _CRC
    + """, convs AS (
  SELECT w::BIGINT AS conv_id, w::BIGINT - w::BIGINT % 100 AS base, crc % 6 AS h FROM crcs
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, i, role, text FROM convs c JOIN own b ON b.conv_id = c.base AND b.i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > h
), paths AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(length(role) || ':' || role || text), ',') OVER w AS node, length(text) AS size FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest FROM (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY 1) GROUP BY 1
), nodes AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM paths GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT DISTINCT a.node AS parent, b.node AS child FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1
), below AS (
  SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), summed AS (
  SELECT top AS node, count(*) FILTER (node NOT IN (SELECT parent FROM links)) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM below JOIN nodes USING (node) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM links l WHERE l.parent = n.node) AS n_children, n_leaves, saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM nodes n JOIN summed USING (node) LEFT JOIN links k ON k.child = n.node LEFT JOIN nodes p ON p.node = k.parent LEFT JOIN ends e ON e.node = n.node"""
)

#: Queries that DuckDB can express over whole tables.
ORACLE_SQL: dict[str, str] = {"op2_nearest_neighbours": _NEAREST, "op4_mixing": _MIX, "op12_importance_resampling": _RESAMPLE, "op13_conversation_trie": _TRIE}

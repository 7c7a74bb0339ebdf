"""More of the registered queries: judgements on documents, readings as they come in, labels, boxes and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import geometry, labels
from evidentia.functions import text as T
from evidentia.operators import cache, group, identify, library
from evidentia.plans import sql as S
from evidentia.plans import views
from evidentia.plans.queries import _BOOKS, ORACLE, query
from evidentia.sources import readings
from evidentia.sources.scratch import stored

# ------------------------------------------------------------------ judgements

_STOP = S.array(T.STOPWORDS)
_WEIGHT = f"CASE WHEN list_contains({_STOP}, w) THEN 1 ELSE greatest(1, length(w)) END"


def _cov(x: str) -> str:
    total = f"list_sum(list_transform({x}, lambda w: {_WEIGHT}))"
    got = f"coalesce(list_sum(list_transform(list_filter({x}, lambda w: list_contains(hit, w)), lambda w: {_WEIGHT})), 0)"
    return f"CASE WHEN len({x}) = 0 THEN 0.0::DOUBLE ELSE {got}::DOUBLE / {total} END"


def _share(x: str) -> str:
    return f"CASE WHEN len({S.significant_of(x)}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({S.significant_of(x)}, lambda w: list_contains(hit, w)))::DOUBLE / len({S.significant_of(x)}) END"


def _longest(x: str) -> str:
    return f"coalesce(list_max(list_transform(list_filter({S.significant_of(x)}, lambda w: list_contains(hit, w)), lambda w: length(w))), 0)"


def _unmatched(wanted: str, known: str) -> str:
    return f"len(list_filter({wanted}, lambda x: len(list_filter({known}, lambda d: {S.token_matches('x', 'd')})) = 0))"


_JUDGED = f"""WITH docs AS (SELECT doc_id AS scan_id, {S.words('text')} AS ws, {S.significant_of(S.words("string_split(text, chr(10))[1]"))} AS fw FROM documents WHERE text IS NOT NULL),
e AS (SELECT scan_id, list_distinct(ws) AS ws, CASE WHEN scan_id % 3 = 0 THEN fw[1:2] ELSE [] END AS aw, CASE WHEN scan_id % 2 = 0 THEN fw[1:4] ELSE [] END AS tw FROM docs),
b AS (SELECT item_id, text AS title, {S.words('text')} AS f, {S.words(S.main_title('text'))} AS s, item_id % 50 + 1 AS editions FROM benchmark),
c AS (SELECT *, CASE item_id % 3 WHEN 0 THEN [f[1], f[3]] WHEN 1 THEN ['ana', 'stone'] ELSE [] END AS al FROM b),
k AS (SELECT DISTINCT unnest(list_concat(f, al)) AS known FROM c), r AS (SELECT DISTINCT unnest(ws) AS read FROM e),
m AS (SELECT read, known FROM r JOIN k ON {S.token_matches('read', 'known')}),
hits AS (SELECT DISTINCT scan_id, known FROM (SELECT scan_id, unnest(ws) AS read FROM e) JOIN m USING (read)), hl AS (SELECT scan_id, list(known) AS hit FROM hits GROUP BY 1),
sig AS (SELECT item_id, unnest({S.significant_of('f')}) AS known FROM c), n AS (SELECT item_id, count(*) AS n FROM sig GROUP BY 1),
near AS (SELECT scan_id, item_id FROM hits JOIN sig USING (known) JOIN n USING (item_id) GROUP BY scan_id, item_id, n HAVING count(*)::DOUBLE / n >= 0.34),
p AS (SELECT * FROM near JOIN c USING (item_id) JOIN e USING (scan_id) JOIN hl USING (scan_id)),
q AS (SELECT *, greatest({_cov('f')}, {_cov('s')} * 0.98::DOUBLE) AS t, {_cov('al')} AS a, greatest({_share('f')}, {_share('s')}) >= 1 AS whole, {_longest('f')} AS lt, {_longest('al')} AS la FROM p),
v AS (SELECT *, CASE WHEN t >= 0.75 AND lt >= 5 AND a >= 0.5 THEN {S.text(identify.ACCEPTED)} WHEN whole AND t >= 0.85 AND lt >= 4 THEN {S.text(identify.WHOLE)}
    WHEN t >= 0.5 AND a >= 0.99 AND la >= 5 THEN {S.text(identify.AUTHOR_PART)} WHEN a >= 0.99 AND la >= 6 AND t >= 0.34 THEN {S.text(identify.AUTHOR_EXACT)} END AS branch,
  {_unmatched('aw', S.significant_of('f'))} > 0 AND len({S.significant_of('al')}) > 0 AND a = 0 AS contradicted,
  a = 0 AND {S.name_shape('title')} > 0.7 AND len(list_filter({S.significant_of('f')}, lambda w: list_contains(hit, w))) < 2 AS about,
  {S.script("array_to_string(ws, ' ')")} <> 'other' AND {S.script('title')} <> {S.script("array_to_string(ws, ' ')")} AS strange,
  len(tw) >= 2 AND (len(tw) - {_unmatched('tw', 'list_concat(f, al)')})::DOUBLE / len(tw) < 0.75 AS unexplained FROM q),
w AS (SELECT *, CASE WHEN contradicted THEN {S.text(identify.OTHER_AUTHOR)} WHEN about THEN {S.text(identify.ABOUT_NAME)} WHEN strange THEN {S.text(identify.OTHER_SCRIPT)} WHEN unexplained THEN {S.text(identify.UNEXPLAINED)} END AS veto FROM v)
SELECT scan_id, item_id, round(t, 6) AS title_support, round(a, 6) AS author_support, lt AS longest_title, round(t * 0.6::DOUBLE + a * 0.36::DOUBLE + least(1.0::DOUBLE, log10(editions + 1.0::DOUBLE) / 3) * 0.04::DOUBLE, 6) AS score,
  branch IS NOT NULL AND veto IS NULL AS accepted, CASE WHEN branch IS NOT NULL THEN coalesce(veto, branch) WHEN t + a = 0 THEN {S.text(identify.NOTHING)} ELSE {S.text(identify.TOO_LITTLE)} END AS reason,
  NOT (branch IS NOT NULL AND veto IS NULL) AND NOT contradicted AND a >= 0.6 AND la >= 6 AND t < 0.99 AS author_only FROM w"""


@query(_JUDGED)
def document_support(spark: SparkSession, folder: str) -> DataFrame:
    docs = views.documents(spark, folder).select(F.col("doc_id").alias("scan_id"), T.tokens(F.col("text")).alias("words"), T.significant_tokens(F.split("text", "\n")[0]).alias("first"))
    none = F.array().cast("array<string>")
    evidence = docs.select("scan_id", F.array_distinct("words").alias("words"), F.when(F.col("scan_id") % 3 == 0, F.slice("first", 1, 2)).otherwise(none).alias("author_words"), F.when(F.col("scan_id") % 2 == 0, F.slice("first", 1, 4)).otherwise(none).alias("title_words"))
    items = views.table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("title"), T.tokens(F.col("text")).alias("words"), (F.col("item_id") % 50 + 1).cast("int").alias("edition_count"))
    own = F.concat_ws(" ", F.get("words", F.lit(0)), F.get("words", F.lit(2)))
    items = items.withColumn("author_name", F.when(F.col("doc_id") % 3 == 0, F.array(own)).when(F.col("doc_id") % 3 == 1, F.array(F.lit("Ana Stone"))).otherwise(none))
    named = items.select("doc_id", F.concat("words", F.flatten(F.transform("author_name", T.tokens))).alias("words"))
    hits = identify.scan_hits(evidence, named.select(F.explode("words").alias("known")).distinct())
    # no pair carries a scan's words
    scans = evidence.select("scan_id", "author_words", "title_words", T.dominant_script(F.array_join("words", " ")).alias("script"))
    near = identify.covered(evidence, items.select("doc_id", "words"), 0.34, hits).select("scan_id", "doc_id")
    found = identify.score_documents(identify.with_hits(near, named, hits).join(stored(identify.described(items.drop("words")), "described"), "doc_id").join(scans, "scan_id"))
    return found.select(
        "scan_id", F.col("doc_id").alias("item_id"), F.round("title_support", 6).alias("title_support"), F.round("author_support", 6).alias("author_support"), F.col("longest_title").cast("long").alias("longest_title"),
        F.round("score", 6).alias("score"), "accepted", "reason", "author_only",
    )


@query(
    f"""WITH c AS (SELECT item_id AS doc_id, list_distinct({S.words('text')}) AS ws, len({S.words('text')}) AS size FROM benchmark), i AS (SELECT doc_id, unnest(ws) AS word FROM c),
q AS (SELECT doc_id AS scan_id, unnest(list_distinct({S.significant_of(S.words('text'))})) AS word FROM documents WHERE text IS NOT NULL),
h AS (SELECT scan_id, doc_id, count(*) AS shared FROM q JOIN i USING (word) GROUP BY ALL)
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY shared DESC, size, doc_id) AS place, doc_id FROM h JOIN c USING (doc_id) QUALIFY place <= 5"""
)
def catalogue_search(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array_join(T.significant_tokens(F.col("text")), " ")
    queries = views.documents(spark, folder).select(F.col("doc_id").alias("scan_id"), F.lit(1).alias("query_no"), words.alias("query"))
    items = views.catalogue(spark, folder).withColumn("author_name", F.array().cast("array<string>"))
    return identify.search_catalogue(queries, items).select("scan_id", F.col("place").cast("long").alias("place"), "doc_id")


def _identified() -> str:
    """CTE ``judged``: each scan's queries asked of the passages, the first of equal documents judged by the scan's evidence."""
    asked, last = ORACLE["build_queries"].rsplit("SELECT scan_id, row_number()", 1)
    rules = _JUDGED[_JUDGED.index("q AS (SELECT *, greatest(") : _JUDGED.index("SELECT scan_id, item_id, round(t, 6)")].replace("w AS (SELECT *, CASE WHEN contradicted", "judged AS (SELECT *, CASE WHEN contradicted")
    mine = f"{S.significant_of(S.words('author'))}"
    return f"""{asked}, qs AS (SELECT scan_id, row_number(){last}),
read_words AS (SELECT scan_id, unnest({S.words('text')}) AS word FROM cleaned UNION SELECT scan_id, unnest(list_concat({S.words('title')}, {S.words('author')})) FROM hypotheses),
trusted AS (SELECT scan_id, list(DISTINCT word) AS aw FROM (SELECT scan_id, unnest({mine}) AS word FROM hypotheses WHERE coalesce(author_confidence, 0) >= 60) GROUP BY 1),
firsts AS (SELECT scan_id, {S.significant_of(S.words('arg_min(title, rank)'))} AS tw FROM hypotheses WHERE title <> '' GROUP BY 1),
evidence AS (SELECT * REPLACE (coalesce(aw, []) AS aw, coalesce(tw, []) AS tw) FROM (SELECT scan_id, list(word) AS ws FROM read_words GROUP BY 1) LEFT JOIN trusted USING (scan_id) LEFT JOIN firsts USING (scan_id)),
items AS (SELECT item_id, text AS title, {S.words('text')} AS f, {S.words(S.main_title('text'))} AS s, ['ana', 'stone'] AS al, item_id % 50 + 1 AS editions FROM benchmark),
entries AS (SELECT item_id, len(f) + 2 AS size, unnest(list_distinct(list_concat(f, al))) AS word FROM items),
sought AS (SELECT scan_id, query_no, unnest(list_distinct({S.words('query')})) AS word FROM qs),
shared AS (SELECT scan_id, query_no, item_id, size, count(*) AS n FROM sought JOIN entries USING (word) WHERE NOT list_contains({_STOP}, word) GROUP BY ALL),
places AS (SELECT scan_id, query_no, item_id, row_number() OVER (PARTITION BY scan_id, query_no ORDER BY n DESC, size, item_id) AS place FROM shared QUALIFY place <= 5),
once AS (SELECT p.*, i.* EXCLUDE (item_id) FROM places p JOIN items i USING (item_id) WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY scan_id, {S.normal('title')} ORDER BY query_no, place) = 1),
known AS (SELECT DISTINCT unnest(list_concat(f, al)) AS known FROM items),
same AS (SELECT read, known FROM (SELECT DISTINCT word AS read FROM read_words) JOIN known ON {S.token_matches('read', 'known')}),
matched AS (SELECT scan_id, list(DISTINCT known) AS hit FROM read_words JOIN same ON read = word GROUP BY 1),
p AS (SELECT o.*, e.* EXCLUDE (scan_id), coalesce(hit, []) AS hit FROM once o JOIN evidence e USING (scan_id) LEFT JOIN matched USING (scan_id)),
{rules}"""


_SCORE = "round(t * 0.6::DOUBLE + a * 0.36::DOUBLE + least(1.0::DOUBLE, log10(editions + 1.0::DOUBLE) / 3) * 0.04::DOUBLE, {})"
_FOUND = f"branch IS NOT NULL AND veto IS NULL AS accepted, CASE WHEN branch IS NOT NULL THEN coalesce(veto, branch) WHEN t + a = 0 THEN {S.text(identify.NOTHING)} ELSE {S.text(identify.TOO_LITTLE)} END AS reason, NOT (branch IS NOT NULL AND veto IS NULL) AND NOT contradicted AND a >= 0.6 AND la >= 6 AND t < 0.99 AS author_only"
ORACLE["score_docs"] = f"{_identified()} SELECT scan_id, item_id AS doc_id, query_no, round(t, 6) AS title_support, round(a, 6) AS author_support, {_SCORE.format(6)} AS score, {_FOUND} FROM judged"
ORACLE["identify_early_stop"] = f"""{_identified()}, told AS (SELECT scan_id, item_id AS doc_id, query_no, place, {_SCORE.format(12)} AS fine, {_SCORE.format(6)} AS score, {_FOUND} FROM judged),
stops AS (SELECT *, min(CASE WHEN accepted THEN query_no END) OVER (PARTITION BY scan_id) AS stop FROM told)
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY accepted DESC, fine DESC, query_no, place) AS doc_rank, doc_id, query_no, accepted, score FROM stops WHERE stop IS NULL OR query_no <= stop"""

# ------------------------------------------------------------------ readings as they come in


@query(
    r"""SELECT p_partkey AS scan_id, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_brand END AS author,
(CASE WHEN p_partkey % 5 = 4 THEN 0 WHEN p_partkey % 5 = 1 THEN p_size * 2 WHEN p_size = 1 THEN 100 ELSE p_size END)::INTEGER AS confidence,
CASE p_partkey % 5 WHEN 4 THEN '' WHEN 0 THEN p_type || '|' || p_name ELSE p_type END AS title_alternates, CASE p_partkey % 5 WHEN 4 THEN '' ELSE p_type || ' of ' || p_name END AS raw_text, CASE WHEN p_partkey % 5 = 4 THEN 'malformed' END AS error FROM part"""
)
def parse_reading(spark: SparkSession, folder: str) -> DataFrame:
    """Replies in five forms: a null word for the title, a share for the confidence, a fence, a preamble and an array, and no object at all."""
    kind = F.col("p_partkey") % 5
    title = F.when(kind == 0, " Unknown ").otherwise(F.col("p_name"))
    sure = F.when(kind == 1, (F.col("p_size") * 2 / 100).cast("string")).otherwise(F.col("p_size").cast("string"))
    quoted = F.when(kind == 2, F.concat(F.lit('"'), sure, F.lit('"'))).otherwise(sure)
    alternates = F.to_json(F.array("p_type", "p_name", F.upper("p_type"), F.lit("n/a")))
    body = F.format_string('{"title":"%s","author":"%s ","confidence":%s,"titleAlternates":%s,"authorAlternates":"none","rawText":"%s of %s","reason":7}', title, F.col("p_brand"), quoted, alternates, F.col("p_type"), F.col("p_name"))
    raw = F.when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is:\n["), body, F.lit("] and that is all."))).when(kind == 4, F.concat(F.lit("I see "), F.col("p_name"), F.lit(" {")))
    replies = views.parts(spark, folder).select(F.col("p_partkey").alias("scan_id"), F.coalesce(raw, body).alias("raw"))
    found = readings.parse_readings(replies)
    return found.select("scan_id", "title", "author", "confidence", F.array_join("title_alternates", "|").alias("title_alternates"), "raw_text", "error")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1 HAVING trim(string_agg(text, '')) <> ''")
def reply_text(spark: SparkSession, folder: str) -> DataFrame:
    part = F.struct("turn", F.to_json(F.struct("text")).alias("json"))
    parts = views.table(spark, folder, "conversations").where("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    payload = F.concat(F.lit('{"candidates":[{"content":{"parts":['), F.array_join(F.transform("parts", lambda p: p["json"]), ","), F.lit(',{"text":5},{"other":"x"}]}},{"content":null}]}'))
    return parts.select("conv_id", readings.reply_text(payload).alias("text")).where("text is not null")


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as recognised pages: a turn is a line, its words have confidences by their places."""
    box = F.struct(*[F.lit(x).cast("double").alias(n) for n, x in (("x0", 0), ("y0", 0), ("x1", 50), ("y1", 20))])

    def word(w, i):
        return F.struct(w.alias("text"), ((i * 7 + F.col("turn")) % 100).cast("double").alias("confidence"), box.alias("bbox"))

    line = F.struct("turn", F.struct("text", F.lit(50.0).alias("confidence"), box.alias("bbox"), F.transform(F.split("text", " "), word).alias("words")).alias("line"))
    per = views.table(spark, folder, "conversations").where("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("turns"))
    lines = F.transform("turns", lambda x: x["line"])
    blocks = F.array(F.struct(F.array(F.struct(lines.alias("lines"))).alias("paragraphs")))
    return per.select(F.col("conv_id").alias("scan_id"), F.lit(0).alias("pass_no"), F.struct(F.lit(None).cast("string").alias("text"), blocks.alias("blocks")).alias("tree"))


@query(
    rf"""WITH t AS (SELECT conv_id, turn, text, {S.collapse('text')} AS line FROM conversations WHERE text IS NOT NULL), w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM t WHERE line <> ''),
c AS (SELECT conv_id, avg(((i * 7 + turn) % 100)::DOUBLE) AS mean FROM w WHERE trim(word) <> '' GROUP BY 1)
SELECT conv_id AS scan_id, string_agg(line, chr(10) ORDER BY turn) FILTER (line <> '') AS text, round(coalesce(any_value(mean), 0), 6) AS mean_confidence FROM t LEFT JOIN c USING (conv_id) GROUP BY 1"""
)
def ocr_texts(spark: SparkSession, folder: str) -> DataFrame:
    return readings.texts_of(_trees(spark, folder)).select("scan_id", "text", F.round("mean_confidence", 6).alias("mean_confidence"))


@query(
    r"""SELECT doc_id AS scan_id, unnest(range(len(l))) AS line_no, unnest(l) AS text, (doc_id % 101)::DOUBLE AS confidence FROM
(SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)"""
)
def evidence_from_reading(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.documents(spark, folder)
    none = F.array().cast("array<string>")
    detections = rows.select(F.col("doc_id").alias("scan_id"), F.lit("t").alias("title"), F.lit("a").alias("author"), (F.col("doc_id") % 101).cast("int").alias("confidence"), F.lit("r").alias("reason"), none.alias("title_alternates"), none.alias("author_alternates"), F.col("text").alias("raw_text"))
    return readings.evidence_of(detections)[0].select("scan_id", F.col("line_no").cast("long").alias("line_no"), "text", "confidence")


# ------------------------------------------------------------------ labels, boxes, texts

@query(
    """WITH c AS (SELECT o_orderkey, (['auto', 'forced-off', 'forced-on'])[(o_orderkey % 3 + 1)::INTEGER] AS mode, o_custkey % 2 = 0 AS online FROM orders)
SELECT o_orderkey, mode, online, CASE mode WHEN 'forced-off' THEN false WHEN 'forced-on' THEN true ELSE online END AS look_up, CASE mode WHEN 'auto' THEN 'forced-off' WHEN 'forced-off' THEN 'forced-on' ELSE 'auto' END AS pressed,
CASE WHEN mode = 'forced-off' THEN 'Lookup: Off' WHEN online THEN 'Lookup: On · connected' WHEN mode = 'forced-on' THEN 'Lookup: On · no signal' ELSE 'Lookup: Off · offline' END AS label FROM c"""
)
def lookup_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as presses of the control: the key gives the state it was in, the customer whether there was a network."""
    mode = F.element_at(F.array(*map(F.lit, labels.LOOKUP_CYCLE)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = views.table(spark, folder, "orders").select("o_orderkey", mode.alias("mode"), (F.col("o_custkey") % 2 == 0).alias("online"))
    mode, online = F.col("mode"), F.col("online")
    return rows.select("o_orderkey", "mode", "online", labels.should_look_up(mode, online).alias("look_up"), labels.next_state(mode, labels.LOOKUP_CYCLE).alias("pressed"), labels.lookup_label(mode, online).alias("label"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 101 AS c, 390 + o_orderkey % 130 AS status, CASE o_orderkey % 4 WHEN 0 THEN 'API key not valid' WHEN 1 THEN 'the model is gone' ELSE o_orderpriority END AS body, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 7) / 8.0::DOUBLE ELSE (o_orderkey % 300 - 50)::DOUBLE END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN c >= 70 THEN 'high' WHEN c >= 55 THEN 'medium' ELSE 'low' END AS class, CASE WHEN c >= 70 THEN c || '% confident' WHEN c >= 55 THEN c || '% — worth checking' ELSE 'Not sure — please check' END AS label,
CASE WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 THEN 'rate-limit' WHEN status = 400 AND body = 'API key not valid' THEN 'auth' ELSE 'server' END AS failure, status = 404 AND body = 'the model is gone' AS retired,
greatest(0, least(100, floor(CASE WHEN raw > 0 AND raw <= 1 THEN raw * 100 ELSE raw END + 0.5)))::INTEGER AS confidence FROM o"""
)
def confidence_and_failures(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    body = F.when(key % 4 == 0, "API key not valid").when(key % 4 == 1, "the model is gone").otherwise(F.col("o_orderpriority"))
    raw = F.when(key % 3 == 0, (key % 7) / 8).otherwise((key % 300 - 50).cast("double"))
    status = F.lit(390) + key % 130
    return views.table(spark, folder, "orders").select(
        "o_orderkey", labels.confidence_class(key % 101).alias("class"), labels.confidence_label(key % 101).alias("label"), labels.classify_failure(status, body).alias("failure"), labels.is_model_retired(status, body).alias("retired"), labels.as_confidence(raw.cast("string")).alias("confidence")
    )


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 * 1.0::DOUBLE AS ax, l_suppkey % 50 * 1.0::DOUBLE AS ay, l_suppkey % 100 * 1.0::DOUBLE AS bx, l_partkey % 50 * 1.0::DOUBLE AS bight, l_quantity AS w FROM lineitem),
c AS (SELECT *, least(ax + w, bx + 30) - greatest(ax, bx) AS cw, least(ay + 20, bight + w) - greatest(ay, bight) AS ch FROM b)
SELECT l_orderkey, l_linenumber, least(ax, bx) AS x0, greatest(ay + 20, bight + w) AS y1, CASE WHEN cw <= 0 OR ch <= 0 THEN 0.0::DOUBLE ELSE round(cw * ch / least(greatest(1.0::DOUBLE, w * 20), greatest(1.0::DOUBLE, 30 * w)), 6) END AS overlap,
CASE WHEN greatest(ax, w) = 0 THEN 1.0::DOUBLE ELSE round(least(60 / greatest(ax, w), 2.0::DOUBLE), 6) END AS scale FROM c"""
)
def boxes(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "lineitem")
    ax, ay, bx, by, w = (F.col("l_partkey") % 100 * 1.0, F.col("l_suppkey") % 50 * 1.0, F.col("l_suppkey") % 100 * 1.0, F.col("l_partkey") % 50 * 1.0, F.col("l_quantity"))

    def box(x0, y0, x1, y1):
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    a, b = box(ax, ay, ax + w, ay + 20), box(bx, by, bx + 30, by + w)
    both = geometry.merge_boxes(a, b)
    return rows.select("l_orderkey", "l_linenumber", both["x0"].alias("x0"), both["y1"].alias("y1"), F.round(geometry.overlap_fraction(a, b), 6).alias("overlap"), F.round(geometry.scale_for(ax, w, F.lit(60.0)), 6).alias("scale"))


@query(
    f"""SELECT p_partkey, CASE WHEN length(trim(t || ' ' || a)) >= 4 THEN trim(t || ' ' || a) ELSE array_to_string(({S.words('p_type')})[1:12], ' ') END AS query,
length({S.dedupe("p_name || ' ' || p_type")}) > length({S.dedupe('p_name')}) AS contains_name, length({S.dedupe('p_type')}) > length({S.dedupe('t')}) AND contains({S.dedupe('p_type')}, {S.dedupe('t')}) AS contains_short, p_name AS spaced
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE left(p_type, p_partkey % 3) END AS t, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x' END AS a FROM part)"""
)
def queries_and_readings(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    t = F.when(key % 3 == 0, F.col("p_name")).otherwise(F.left(F.col("p_type"), key % 3))
    a = F.when(key % 2 == 0, "").otherwise("x")
    both = F.concat_ws(" ", "p_name", "p_type")
    return views.parts(spark, folder).select(
        "p_partkey", T.search_query(t, a, F.col("p_type")).alias("query"), T.contains_reading(both, F.col("p_name")).alias("contains_name"), T.contains_reading(F.col("p_type"), t).alias("contains_short"), T.join_spaced_letters(F.col("p_name")).alias("spaced")
    )


@query(
    """SELECT o_orderkey, 'library-' || strftime(o_orderdate, '%Y-%m-%d') || '.json' AS name, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN floor(n / 1024.0 + 0.5)::BIGINT || ' KB' ELSE printf('%.1f', n / 1048576.0::DOUBLE) || ' MB' END AS size
FROM (SELECT *, (o_orderkey * 7919 % 9000000)::BIGINT // CASE WHEN o_orderkey % 3 = 0 THEN 9000 ELSE 1 END AS n FROM orders)"""
)
def names_and_sizes(spark: SparkSession, folder: str) -> DataFrame:
    n = F.expr("(o_orderkey * 7919 % 9000000) div CASE WHEN o_orderkey % 3 = 0 THEN 9000 ELSE 1 END")
    return views.table(spark, folder, "orders").select("o_orderkey", labels.backup_name(F.col("o_orderdate").cast("date")).alias("name"), labels.format_bytes(n).alias("size"))


# ------------------------------------------------------------------ cards, library, cache


@query(f"SELECT p_partkey, round(CASE WHEN b = '' OR d = '' THEN {S.similarity('a', 'c')} ELSE {S.similarity('a', 'c')} * 0.75::DOUBLE + {S.similarity('b', 'd')} * 0.25::DOUBLE END, 6) AS alike FROM (SELECT p_partkey, {S.normal('p_name')} AS a, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE {S.normal('p_brand')} END AS b, {S.normal('p_type')} AS c, {S.normal('p_type')} AS d FROM part)")
def detection_similarity(spark: SparkSession, folder: str) -> DataFrame:
    author = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(T.normalise(F.col("p_brand")))
    other = T.normalise(F.col("p_type"))
    return views.parts(spark, folder).select("p_partkey", F.round(group.detection_similarity(T.normalise(F.col("p_name")), author, other, other), 6).alias("alike"))


@query("""SELECT p_partkey // 10 AS merged_no, arg_min(p_name, p_partkey) AS title, string_agg((p_partkey * 2) || ',' || (p_partkey * 2 + 1), ',' ORDER BY p_partkey) AS items FROM part GROUP BY 1""")
def merged_cards(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    cards = views.parts(spark, folder).select(
        F.lit(1).cast("long").alias("batch_id"), key.alias("card_no"), F.array(key * 2, key * 2 + 1).alias("items"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.lit(1).alias("confidence"), F.lit("").alias("reason"), F.lit("ocr").alias("source"), F.floor(key / 10).alias("merged_no")
    )
    return group.merge_cards(cards).select("merged_no", "title", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("SELECT p_partkey AS card_no, unnest([p_partkey * 2, p_partkey * 2 + 1]) AS item_no, unnest([0, 1])::INTEGER AS place FROM part")
def split_cards(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    cards = views.parts(spark, folder).select(F.lit(1).alias("batch_id"), key.alias("card_no"), F.array(key * 2, key * 2 + 1).alias("items"))
    return group.split_cards(cards).select("card_no", "item_no", "place")


@query(f"WITH {_BOOKS} SELECT id, title, coalesce(status, 'unread') AS status FROM books WHERE coalesce(status, 'unread') = 'unread' AND len(list_filter({S.words('title')}, lambda w: starts_with(w, 're'))) > 0")
def view_books(spark: SparkSession, folder: str) -> DataFrame:
    books = views.books(spark, folder).withColumn("author", F.lit(""))
    return library.view(books, "re", "unread").select("id", "title", "status")


@query("""WITH c AS (SELECT lower(trim(p_name)) AS query, max(p_retailprice)::VARCHAR AS docs, max(TIMESTAMP '2024-03-01' - to_days(p_size::INTEGER)) AS cached_at FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN cached_at >= TIMESTAMP '2024-03-01' - INTERVAL 30 DAY THEN docs END AS docs FROM part LEFT JOIN c ON c.query = lower(trim(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_type END))""")
def cache_probe(spark: SparkSession, folder: str) -> DataFrame:
    parts = views.table(spark, folder, "part")
    at = F.lit("2024-03-01").cast("timestamp") - F.make_dt_interval(F.col("p_size"))
    cached = parts.groupBy(F.lower(F.trim("p_name")).alias("query")).agg(F.max("p_retailprice").cast("string").alias("docs"), F.max(at).alias("cached_at"))
    asked = parts.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_type")).alias("query"))
    return cache.probe(asked, cached, "2024-03-01 00:00:00").select("p_partkey", "docs")


@query("""WITH a AS (SELECT p_brand AS language, p_size AS bytes FROM part) SELECT count(*) AS files, (sum(bytes) + 4000000)::BIGINT AS bytes FROM a WHERE language IN ('Brand#1', 'Brand#2')""")
def offline_plan(spark: SparkSession, folder: str) -> DataFrame:
    assets = views.parts(spark, folder).select(F.col("p_brand").alias("language"), F.col("p_size").cast("long").alias("bytes"))
    return library.offline_plan(assets, ["Brand#1", "Brand#2"])

"""The registered queries over a folder of tables, and what they mean in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import labels, noise
from evidentia.functions import text as T
from evidentia.operators import cache, candidates, evaluate, group, identify, imaging, library
from evidentia.operators import lines as L
from evidentia.plans import sql as S
from evidentia.plans import views
from evidentia.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return register


def _per_line(spark: SparkSession, folder: str, **values: Column) -> DataFrame:
    return views.lines(spark, folder).select(F.col("scan_id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), *[v.alias(k) for k, v in values.items()])


def _line_sql(**values: str) -> str:
    return f"WITH {S.LINES} SELECT scan_id AS doc_id, line_no, {', '.join(f'{v} AS {k}' for k, v in values.items())} FROM lines"


# ------------------------------------------------------------------ text


@query(_line_sql(normal=S.normal("text")))
def normalise_docs(spark: SparkSession, folder: str) -> DataFrame:
    return _per_line(spark, folder, normal=T.normalise(F.col("text")))


@query(_line_sql(n_tokens=f"len({S.words('text')})", first_token=f"({S.words('text')})[1]"))
def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _per_line(spark, folder, n_tokens=F.size(T.tokens(F.col("text"))).cast("long"), first_token=F.get(T.tokens(F.col("text")), F.lit(0)))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def edit_distance_parts(spark: SparkSession, folder: str) -> DataFrame:
    return views.parts(spark, folder).select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query(f"WITH n AS (SELECT p_partkey, {S.normal('p_name')} AS a, {S.normal('p_type')} AS b FROM part) SELECT p_partkey, round({S.similarity('a', 'b')}, 6) AS similarity FROM n")
def similarity_parts(spark: SparkSession, folder: str) -> DataFrame:
    return views.parts(spark, folder).select("p_partkey", F.round(T.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query(_line_sql(ratio=f"round({S.letter_ratio('text')}, 6)"))
def letter_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return _per_line(spark, folder, ratio=F.round(T.letter_ratio(F.col("text")), 6))


@query(_line_sql(share=f"round({S.upper_share('text')}, 6)", mostly=f"({S.upper_share('text')}) > 0.7", letters=S.letters("text")))
def upper_share(spark: SparkSession, folder: str) -> DataFrame:
    return _per_line(spark, folder, share=F.round(T.upper_share(F.col("text")), 6), mostly=T.is_mostly_upper(F.col("text")), letters=T.letter_count(F.col("text")).cast("long"))


@query(f"SELECT p_partkey, {S.tidy('upper(p_name)')} AS tidy, {S.tidy('p_type')} AS kept FROM part")
def tidy_title(spark: SparkSession, folder: str) -> DataFrame:
    return views.parts(spark, folder).select("p_partkey", T.tidy_title(F.upper("p_name")).alias("tidy"), T.tidy_title(F.col("p_type")).alias("kept"))


@query(_line_sql(wordiness=f"round({S.wordiness('text')}, 6)"))
def wordiness(spark: SparkSession, folder: str) -> DataFrame:
    return _per_line(spark, folder, wordiness=F.round(T.wordiness(F.col("text")), 6))


@query(_line_sql(clean=S.clean("text")))
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return _per_line(spark, folder, clean=T.clean_text(F.col("text")))


@query(f"WITH {S.NOISY} SELECT scan_id AS doc_id, line_no, round({S.name_shape('text')}, 6) AS name_shape, {S.has_prefix('text')} AS by_prefix, {S.without_prefix('text')} AS reads_as FROM lines")
def name_shape(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.lines(spark, folder, noisy=True)
    return rows.select(F.col("scan_id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.round(T.name_shape(F.col("text")), 6).alias("name_shape"), T.has_author_prefix(F.col("text")).alias("by_prefix"), T.strip_author_prefix(F.col("text")).alias("reads_as"))


@query(_line_sql(tokens=f"array_to_string({S.significant_of(S.words('text'))}, ' ')"))
def significant_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _per_line(spark, folder, tokens=F.array_join(T.significant_tokens(F.col("text")), " "))


@query(_line_sql(script=S.script("text"), main=S.main_title("text")))
def main_title_and_script(spark: SparkSession, folder: str) -> DataFrame:
    return _per_line(spark, folder, script=T.dominant_script(F.col("text")), main=T.main_title(F.col("text")))


@query(_line_sql(query=S.sanitise("text"), dedupe=S.dedupe("text")))
def sanitise_query(spark: SparkSession, folder: str) -> DataFrame:
    return _per_line(spark, folder, query=T.sanitise_query(F.col("text")), dedupe=T.dedupe_key(F.col("text")))


_DOC_WORDS = f"""scans AS (SELECT doc_id AS scan_id, unnest(list_distinct({S.words('text')})) AS read FROM documents),
items AS (SELECT item_id, {S.words('text')} AS ws FROM benchmark),
wanted AS (SELECT item_id, unnest(range(len(ws))) AS nth, unnest(ws) AS known FROM items),
r AS (SELECT DISTINCT read FROM scans), k AS (SELECT DISTINCT known FROM wanted),
m AS (SELECT read, known FROM r JOIN k ON {S.token_matches('read', 'known')})"""


def _fuzzy_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    scans = views.documents(spark, folder).select(F.col("doc_id").alias("scan_id"), T.tokens(F.col("text")).alias("words"))
    items = views.table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), T.tokens(F.col("text")).alias("words"))
    return scans, items


@query(f"WITH {_DOC_WORDS} SELECT read, known FROM m")
def token_match_pairs(spark: SparkSession, folder: str) -> DataFrame:
    scans, items = _fuzzy_inputs(spark, folder)
    return identify.fuzzy_words(scans.select(F.explode("words").alias("read")).distinct(), items.select(F.explode("words").alias("known")).distinct())


@query(
    f"""WITH {_DOC_WORDS}, hits AS (SELECT DISTINCT scan_id, known FROM scans JOIN m USING (read)),
weights AS (SELECT *, CASE WHEN list_contains({S.array(T.STOPWORDS)}, known) THEN 1 ELSE greatest(1, length(known)) END AS weight,
  length(known) >= 4 AND NOT list_contains({S.array(T.STOPWORDS)}, known) AS sig FROM wanted),
totals AS (SELECT item_id, sum(weight) AS weight, count(*) FILTER (sig) AS n FROM weights GROUP BY 1),
got AS (SELECT scan_id, item_id, sum(weight) AS weight, count(*) FILTER (sig) AS n FROM hits JOIN weights USING (known) GROUP BY 1, 2)
SELECT scan_id, item_id, round(got.weight::DOUBLE / totals.weight, 6) AS coverage, round(got.n::DOUBLE / totals.n, 6) AS significant FROM got JOIN totals USING (item_id) WHERE got.n > 0 AND got.n::DOUBLE / totals.n >= 0.5"""
)
def coverage_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    found = identify.covered(*_fuzzy_inputs(spark, folder))
    return found.select("scan_id", F.col("doc_id").alias("item_id"), F.round("coverage", 6).alias("coverage"), F.round("significant", 6).alias("significant"))


# ------------------------------------------------------------------ lines


@query(f"WITH {S.NOISY} SELECT scan_id, line_no, {S.is_noise('text')} AS noise FROM lines")
def noise_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = noise.with_noise(views.lines(spark, folder, noisy=True))
    return rows.select("scan_id", F.col("line_no").cast("long").alias("line_no"), "noise")


@query(f"WITH {S.USABLE} SELECT DISTINCT scan_id, pass_no, page_max FROM paged")
def tallest_line(spark: SparkSession, folder: str) -> DataFrame:
    return L.tallest_heights(views.lines(spark, folder, noisy=True))


@query(f"WITH {S.USABLE} SELECT scan_id, pass_no, line_no, text, page_max FROM usable")
def usable_lines(spark: SparkSession, folder: str) -> DataFrame:
    return L.usable_lines(views.lines(spark, folder, noisy=True)).select("scan_id", "pass_no", F.col("line_no").cast("long").alias("line_no"), "text", "page_max")


@query(
    rf"""WITH {S.LINES}, solid AS (SELECT scan_id, pass_no, text, confidence >= 80 AND {S.letters('text')} >= 4 AND ({S.wordiness('text')}) >= 0.6 AS solid, {S.letters('text')} AS n,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: {S.letters('w')} >= 2)) AS ws FROM lines),
s AS (SELECT scan_id, pass_no, count(*) FILTER (solid) AS solid, coalesce(sum(ws) FILTER (solid), 0)::BIGINT AS words, coalesce(bool_or(solid AND n >= 8), false) AS long FROM solid GROUP BY ALL)
SELECT *, solid >= 2 AND words >= 3 AND long AS strong FROM s"""
)
def strong_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return L.strong_evidence(views.lines(spark, folder))


@query(
    f"WITH {S.LINES} SELECT scan_id AS doc_id, round(least(1.0, sum(greatest(1, {S.letters('text')}) * ({S.wordiness('text')}) * (confidence / 100)) / sum(greatest(1, {S.letters('text')}))), 6) AS quality FROM lines GROUP BY 1"
)
def pass_quality(spark: SparkSession, folder: str) -> DataFrame:
    return L.pass_quality(views.lines(spark, folder), ["scan_id"]).select(F.col("scan_id").alias("doc_id"), F.round("quality", 6).alias("quality"))


@query(
    f"""WITH {S.NOISY} SELECT scan_id, pass_no, line_no, confidence FROM lines WHERE {S.dedupe('text')} <> ''
QUALIFY row_number() OVER (PARTITION BY scan_id, {S.dedupe('text')} ORDER BY confidence DESC, pass_no, line_no) = 1"""
)
def line_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return L.distinct_lines(views.lines(spark, folder, noisy=True)).select("scan_id", "pass_no", F.col("line_no").cast("long").alias("line_no"), "confidence")


@query(
    f"""WITH {S.boxed(S.NOISY)}, best AS (SELECT * FROM boxed QUALIFY row_number() OVER (PARTITION BY scan_id, dedupe ORDER BY confidence DESC, pass_no, line_no) = 1),
f AS (SELECT scan_id, list({S.line_struct()} ORDER BY confidence DESC, pass_no, line_no) AS l FROM best GROUP BY 1), k AS (SELECT scan_id, {S.kept_apart('l')} AS k FROM f),
u AS (SELECT scan_id, unnest(range(len(k))) AS i, unnest(k) AS r FROM k), p AS (SELECT scan_id, r.pass_no AS pass_no, r.line_no AS line_no, (row_number() OVER (PARTITION BY scan_id ORDER BY r.y0, i) - 1)::INTEGER AS place FROM u)
SELECT scan_id, place, pass_no, line_no, text, confidence FROM p JOIN boxed USING (scan_id, pass_no, line_no)"""
)
def merge_lines(spark: SparkSession, folder: str) -> DataFrame:
    return L.merge_lines(views.lines(spark, folder, noisy=True)).select("scan_id", "place", "pass_no", "line_no", "text", "confidence")


@query(f"WITH {S.BLOCKS} SELECT scan_id, pass_no, cand_no, text, height, confidence, x0, y0, x1, y1, centre_y, by_prefix, n_lines, page_max FROM grouped_lines")
def group_lines(spark: SparkSession, folder: str) -> DataFrame:
    return L.group_lines(views.lines(spark, folder, noisy=True))


_PASS_LINE = rf""", {S.letters('text')} AS n_letters, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: {S.letters('w')} >= 2)) AS n_words, confidence >= 80 AND {S.letters('text')} >= 4 AND ({S.wordiness('text')}) >= 0.6 AS solid"""
_ADAPTIVE = f"""WITH {S.boxed(S.LINES, _PASS_LINE)}, upto AS (SELECT DISTINCT scan_id, pass_no AS upto FROM lines),
best AS (SELECT u.upto, b.* FROM upto u JOIN boxed b ON b.scan_id = u.scan_id AND b.pass_no <= u.upto QUALIFY row_number() OVER (PARTITION BY b.scan_id, u.upto, dedupe ORDER BY confidence DESC, pass_no, line_no) = 1),
f AS (SELECT scan_id, upto, list({S.line_struct(['n_letters', 'n_words', 'solid'])} ORDER BY confidence DESC, pass_no, line_no) AS l FROM best GROUP BY ALL),
k AS (SELECT scan_id, upto, list_filter({S.kept_apart('l')}, lambda r: r.solid) AS k FROM f),
s AS (SELECT scan_id, min(upto) AS last FROM k WHERE len(k) >= 2 AND list_sum(list_transform(k, lambda r: r.n_words)) >= 3 AND len(list_filter(k, lambda r: r.n_letters >= 8)) > 0 GROUP BY 1)
SELECT scan_id, pass_no, line_no FROM lines LEFT JOIN s USING (scan_id) WHERE last IS NULL OR pass_no <= last"""


@query(_ADAPTIVE)
def adaptive_passes(spark: SparkSession, folder: str) -> DataFrame:
    return L.passes_until_strong(views.lines(spark, folder), least=1).select("scan_id", "pass_no", "line_no")


# ------------------------------------------------------------------ detection


def _candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = views.lines(spark, folder, noisy=True)
    return rows, L.single_line_candidates(rows)


@query(f"WITH {S.scored('page_max')} SELECT scan_id, pass_no, cand_no, text, round(title_score, 6) AS title_score FROM scores")
def title_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates.title_scores(candidates.shaped(_candidates(spark, folder)[1]))
    return found.select("scan_id", "pass_no", F.col("cand_no").cast("long").alias("cand_no"), "text", F.round("title_score", 6).alias("title_score"))


@query(f"WITH {S.scored('page_max')} SELECT scan_id, pass_no, cand_no, text, round(author_score, 6) AS author_score FROM scores")
def author_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates.author_scores(candidates.shaped(_candidates(spark, folder)[1]))
    return found.select("scan_id", "pass_no", F.col("cand_no").cast("long").alias("cand_no"), "text", F.round("author_score", 6).alias("author_score"))


@query(f"WITH {S.scored('page_max')} SELECT scan_id, pass_no, cand_no, round(title_rank, 6) AS title_rank, title_place, round(author_rank, 6) AS author_rank, author_place FROM ranked WHERE title_place <= 5 OR author_place <= 5")
def role_rank(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates.ranked(candidates.author_scores(candidates.title_scores(candidates.shaped(_candidates(spark, folder)[1])))).where("title_place <= 5 or author_place <= 5")
    return found.select("scan_id", "pass_no", F.col("cand_no").cast("long").alias("cand_no"), F.round("title_rank", 6).alias("title_rank"), "title_place", F.round("author_rank", 6).alias("author_rank"), "author_place")


@query(f"WITH {S.readings('page_max')} SELECT scan_id, pass_no, ord, title, author, round(score, 6) AS score, reason, author_confidence FROM readings")
def hypothesis_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates.interpretations(_candidates(spark, folder)[1])
    return found.select("scan_id", "pass_no", F.col("ord").cast("long").alias("ord"), "title", "author", F.round("score", 6).alias("score"), "reason", "author_confidence")


def _hypotheses(spark: SparkSession, folder: str, grouped: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = views.lines(spark, folder, noisy=True)
    found = L.group_lines(rows) if grouped else L.single_line_candidates(rows)
    return rows, candidates.read_scans(rows, found)


@query(f"WITH {S.POOLED} SELECT scan_id, rank, title, author, round(score, 6) AS score, votes, reason, author_confidence FROM hypotheses")
def hypothesis_pool(spark: SparkSession, folder: str) -> DataFrame:
    found = _hypotheses(spark, folder)[1]
    return found.select("scan_id", F.col("rank").cast("long").alias("rank"), "title", "author", F.round("score", 6).alias("score"), "votes", "reason", "author_confidence")


@query(
    f"""WITH {S.readings('page_max')}, k AS (SELECT DISTINCT scan_id, {S.normal('title')} AS title_key FROM readings WHERE title <> '' OR author <> '')
SELECT DISTINCT a.scan_id, a.title_key FROM k a JOIN k b ON a.scan_id = b.scan_id AND b.title_key <> '' AND length(a.title_key) > length(b.title_key) AND contains(a.title_key, b.title_key)"""
)
def completeness(spark: SparkSession, folder: str) -> DataFrame:
    return candidates.complete_titles(_candidates(spark, folder)[1])


def _shown(found: DataFrame) -> DataFrame:
    return found.select("scan_id", "title", "author", "confidence", "reason", F.array_join("title_alternates", "|").alias("title_alternates"), F.array_join("author_alternates", "|").alias("author_alternates"))


def _scans(lines: DataFrame) -> DataFrame:
    return lines.groupBy("scan_id").agg(F.avg("confidence").alias("mean_confidence"))


def _detections(spark: SparkSession, folder: str, grouped: bool = False) -> DataFrame:
    rows, found = _hypotheses(spark, folder, grouped)
    return candidates.detect(found, _scans(rows))


@query(
    f"""WITH {S.POOLED}, scans AS (SELECT scan_id, avg(confidence) AS read FROM lines GROUP BY 1), best AS (SELECT * FROM hypotheses WHERE rank = 1),
seconds AS (SELECT scan_id, score AS second FROM hypotheses WHERE rank = 2),
ts AS (SELECT scan_id, title, min(rank) AS r FROM hypotheses WHERE title <> '' GROUP BY 1, 2), aus AS (SELECT scan_id, author, min(rank) AS r FROM hypotheses WHERE author <> '' GROUP BY 1, 2),
ta AS (SELECT t.scan_id, list(t.title ORDER BY r)[1:4] AS l FROM ts t JOIN best b ON b.scan_id = t.scan_id AND b.title <> t.title GROUP BY 1), aa AS (SELECT a.scan_id, list(a.author ORDER BY r)[1:4] AS l FROM aus a JOIN best b ON b.scan_id = a.scan_id AND b.author <> a.author GROUP BY 1)
SELECT s.scan_id, coalesce(b.title, '') AS title, coalesce(b.author, '') AS author,
  CASE WHEN b.scan_id IS NULL THEN 0 ELSE (floor(round(least(96.0::DOUBLE, (b.score * 0.5::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (b.score - coalesce(second, 0)) / 0.25::DOUBLE)) * 0.25::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, read / 100)) * 0.25::DOUBLE) * 100)
    * (0.5::DOUBLE + 0.5::DOUBLE * (least(1.0::DOUBLE, greatest(0.3::DOUBLE, {S.letters('b.title')}::DOUBLE / 12)) * greatest(0.4::DOUBLE, {S.wordiness('b.title')}))), 9) + 0.5))::INTEGER END AS confidence,
  coalesce(b.reason, {S.text(candidates.NOTHING)}) AS reason, coalesce(array_to_string(ta.l, '|'), '') AS title_alternates, coalesce(array_to_string(aa.l, '|'), '') AS author_alternates
FROM scans s LEFT JOIN best b USING (scan_id) LEFT JOIN seconds USING (scan_id) LEFT JOIN ta USING (scan_id) LEFT JOIN aa USING (scan_id)"""
)
def detect(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_detections(spark, folder))


@query(ORACLE["detect"].replace(S.CANDIDATES, S.GROUPED_CANDIDATES))
def detect_grouped(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_detections(spark, folder, grouped=True))


# ------------------------------------------------------------------ identification


def _evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows, found = _hypotheses(spark, folder)
    texts = views.documents(spark, folder).select(F.col("doc_id").alias("scan_id"), "text")
    evidence = stored(identify.build_evidence(rows, found), "evidence")
    return evidence, identify.build_queries(evidence, texts)


_WANTED = ["both(0)", "author(0)", "title(0)"] + [x for i in (1, 2, 3) for x in (f"author({i})", f"both({i})", f"title({i})")]


def _wanted(spec: str) -> str:
    kind, i = spec[:-1].split("(")
    t, a = (f"coalesce(h[{int(i) + 1}].{f}, '')" for f in ("title", "author"))
    return {"title": t, "author": a, "both": f"CASE WHEN {t} <> '' AND {a} <> '' THEN {t} || ' ' || {a} ELSE '' END"}[kind]


@query(
    f"""WITH {S.POOLED}, h AS (SELECT scan_id, list({{'title': title, 'author': author}} ORDER BY rank) AS h FROM hypotheses GROUP BY 1),
w AS (SELECT d.doc_id AS scan_id, [{', '.join(map(_wanted, _WANTED))}, array_to_string(({S.significant_of(S.words('text'))})[1:8], ' ')] AS q FROM documents d LEFT JOIN h ON h.scan_id = d.doc_id WHERE text IS NOT NULL),
u AS (SELECT scan_id, unnest(range(len(q))) AS ord, unnest(q) AS raw FROM w), c AS (SELECT scan_id, ord, {S.sanitise('raw')} AS query FROM u),
f AS (SELECT scan_id, {S.normal('query')} AS key, min(ord) AS ord, arg_min(query, ord) AS query FROM c WHERE length(query) >= 4 GROUP BY ALL)
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY ord) AS query_no, query FROM f QUALIFY query_no <= 5"""
)
def build_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _evidence(spark, folder)[1].select("scan_id", F.col("query_no").cast("long").alias("query_no"), "query")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    evidence, queries = _evidence(spark, folder)
    catalogue = views.catalogue(spark, folder)
    found = identify.distinct_documents(identify.search_catalogue(queries, catalogue).join(catalogue, "doc_id"))
    return identify.judged(found, evidence)


@query()
def score_docs(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("scan_id", "doc_id", "query_no", F.round("title_support", 6).alias("title_support"), F.round("author_support", 6).alias("author_support"), F.round("score", 6).alias("score"), "accepted", "author_only", "reason")


@query()
def identify_early_stop(spark: SparkSession, folder: str) -> DataFrame:
    return identify.stop_early(_scored(spark, folder)).select("scan_id", "doc_rank", "doc_id", "query_no", "accepted", F.round("score", 6).alias("score"))


@query()
def identify_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence and detections come from one reading of the scans."""
    evidence, queries = _evidence(spark, folder)
    found = candidates.detect_ranked(evidence.select("scan_id", "ranked"), _scans(views.lines(spark, folder, noisy=True)))
    return identify.identify(found, evidence, queries, views.catalogue(spark, folder))


@query()
def group_detections(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.parts(spark, folder).select(F.floor(F.col("p_partkey") / 40).alias("batch_id"), F.col("p_partkey").alias("item_no"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), (F.col("p_partkey") * 31 % 101).cast("int").alias("confidence"), F.lit("read").alias("reason"), F.lit("ocr").alias("source"))
    return group.group_detections(rows)


# ------------------------------------------------------------------ library

_BOOKS = "books AS (SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand AS author, CASE p_partkey % 3 WHEN 0 THEN 'read' WHEN 2 THEN 'unread' END AS status, o_orderdate AS date_added FROM part JOIN orders ON p_partkey = o_orderkey)"


@query(f"WITH {_BOOKS} SELECT id, title, author FROM books WHERE len(list_filter({S.words(S.text('re bra'))}, lambda n: len(list_filter({S.words(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || author')}, lambda w: starts_with(w, n))) = 0)) = 0")
def search_books(spark: SparkSession, folder: str) -> DataFrame:
    return library.search(views.books(spark, folder), "re bra").select("id", "title", "author")


@query(f"WITH {_BOOKS} SELECT count(*) AS total, count(*) FILTER (status = 'read') AS read, count(*) FILTER (coalesce(status, 'unread') = 'unread') AS unread FROM books")
def library_counts(spark: SparkSession, folder: str) -> DataFrame:
    return library.counts(views.books(spark, folder))


@query(f"WITH {_BOOKS} SELECT id, title, date_added FROM books ORDER BY date_added DESC, id DESC LIMIT 4")
def recent_books(spark: SparkSession, folder: str) -> DataFrame:
    return library.newest(views.books(spark, folder), 4).select("id", "title", "date_added")


@query(f"WITH {_BOOKS} SELECT id, title, author, coalesce(status, 'unread') AS status FROM books WHERE id::BIGINT % 5 <> 0")
def delete_books(spark: SparkSession, folder: str) -> DataFrame:
    rows = library.with_status(views.books(spark, folder))
    return library.delete(rows, rows.where("cast(id as long) % 5 = 0")).select("id", "title", "author", "status")


@query(f"WITH {_BOOKS} SELECT id, CASE WHEN id::BIGINT % 7 = 0 THEN upper(title) ELSE title END AS title, author FROM books")
def update_books(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.books(spark, folder)
    changes = rows.where("cast(id as long) % 7 = 0").select("id", F.upper("title").alias("title"))
    return library.update(rows, changes).select("id", "title", "author")


@query(f"WITH {_BOOKS} SELECT id, title, author, status FROM books WHERE id::BIGINT % 2 = 1 UNION ALL SELECT id, title, author, CASE WHEN status = 'read' THEN 'read' ELSE 'unread' END FROM books WHERE id::BIGINT % 2 = 0")
def import_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.books(spark, folder)
    stored = rows.where("cast(id as long) % 2 = 1")
    entries = library.export_rows(rows).select(F.col("id").cast("long").alias("place"), F.col("json").alias("entry"))
    added, _ = library.import_entries(stored, entries)
    return stored.select("id", "title", "author", "status").unionAll(added.select("id", "title", "author", "status"))


@query(f"""WITH {_BOOKS} SELECT id, '{{"id":"' || id || '","title":"' || title || '","author":"' || author || '"' || CASE WHEN status IS NULL THEN '' ELSE ',"status":"' || status || '"' END || ',"date_added":' || epoch_ms(date_added) || '}}' AS json FROM books""")
def export_json(spark: SparkSession, folder: str) -> DataFrame:
    return library.export_rows(views.books(spark, folder)).select("id", "json")


@query()
def lookup_cache(spark: SparkSession, folder: str) -> DataFrame:
    return cache.hits(views.lookups(spark, folder), ttl_ms=48 * 3600 * 1000)


# ------------------------------------------------------------------ readings, routes, accuracy


@query(
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'off' ELSE 'auto' END AS mode, o_custkey % 3 > 0 AS has_key, o_custkey % 2 = 0 AS online FROM orders)
SELECT o_orderkey, mode, has_key, online, CASE WHEN mode = 'off' OR NOT has_key OR NOT online THEN 'ocr' ELSE 'ai' END AS reader, CASE WHEN mode = 'off' THEN 'auto' ELSE 'off' END AS pressed,
CASE WHEN mode = 'off' THEN 'AI: Off' WHEN NOT has_key THEN 'AI: No key' WHEN online THEN 'AI: On · connected' ELSE 'AI: On · no signal' END AS label FROM c"""
)
def reader_route(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as scans to be routed: the key gives the mode, the customer whether there was a key and a network."""
    mode, key, online = F.when(F.col("o_orderkey") % 2 == 0, "off").otherwise("auto"), F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 2 == 0
    rows = views.table(spark, folder, "orders").select("o_orderkey", mode.alias("mode"), key.alias("has_key"), online.alias("online"))
    given = [F.col(c) for c in ("mode", "has_key", "online")]
    return rows.select("*", labels.choose_reader(*given).alias("reader"), labels.next_state(given[0], labels.READER_CYCLE).alias("pressed"), labels.reader_label(*given).alias("label"))


@query(
    f"""WITH g AS (SELECT p_partkey AS id, p_name AS et, p_brand AS ea, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name || 's' ELSE p_name END AS gt, CASE WHEN p_partkey % 5 = 0 THEN 'Nobody Else' ELSE p_brand END AS ga, p_partkey * 31 % 101 AS conf, p_size FROM part),
n AS (SELECT *, {S.normal('et')} AS a, {S.normal('gt')} AS b, {S.normal('ea')} AS c, {S.normal('ga')} AS d FROM g),
r AS (SELECT *, a = b AS exact, ({S.edit_similarity('a', 'b')}) >= 0.7 AS fuzzy, ({S.edit_similarity('c', 'd')}) >= 0.7 OR (length(string_split(c, ' ')[-1]) > 2 AND list_contains(string_split(d, ' '), string_split(c, ' ')[-1])) AS hit FROM n)
SELECT p_size, count(*) AS covers, count(*) FILTER (exact) AS title_exact, count(*) FILTER (fuzzy) AS title_fuzzy, count(*) FILTER (hit) AS author_hit, count(*) FILTER (NOT fuzzy AND conf >= 60) AS confidently_wrong FROM r GROUP BY 1"""
)
def accuracy_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.summary(_eval_rows(spark, folder), ["p_size"])


def _eval_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.parts(spark, folder)
    key = F.col("p_partkey")
    truth = rows.select(key.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), "p_size", F.element_at(F.array(*map(F.lit, ("book", "author", "uncertain"))), (key % 3 + 1).cast("int")).alias("expect"))
    title = F.when(key % 4 == 0, F.col("p_type")).when(key % 4 == 1, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    got = rows.select(key.alias("id"), title.alias("title"), F.when(key % 5 == 0, "Nobody Else").otherwise(F.col("p_brand")).alias("author"), (key * 31 % 101).cast("int").alias("confidence"))
    return evaluate.score_rows(truth, got)


@query(ORACLE["accuracy_summary"].split("SELECT p_size")[0] + """SELECT id, CASE id % 3 WHEN 0 THEN fuzzy AND hit WHEN 1 THEN hit ELSE conf < 55 AND NOT fuzzy END AS as_expected FROM r""")
def expected_behaviour(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.expected_behaviour(_eval_rows(spark, folder)).select("id", "as_expected")


@query("SELECT p_brand, list(p_retailprice ORDER BY p_retailprice)[count(*) // 2 + 1] AS p_retailprice FROM part GROUP BY 1")
def upper_median(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.upper_median_of(views.table(spark, folder, "part"), ["p_brand"], "p_retailprice")


@query(
    """WITH c AS (SELECT l_returnflag AS image_id, l_suppkey * 7 % 256 AS v, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT *, sum(n) OVER o AS below, sum(n * v) OVER o AS weight, sum(n) OVER p AS total, sum(n * v) OVER p AS mass FROM c WINDOW o AS (PARTITION BY image_id ORDER BY v), p AS (PARTITION BY image_id)),
x AS (SELECT *, CASE WHEN total > below THEN below::DOUBLE * (total - below) * (weight::DOUBLE / below - (mass - weight)::DOUBLE / (total - below)) ** 2 ELSE 0 END AS variance FROM w)
SELECT image_id, CASE WHEN max(variance) > 0 THEN first(v ORDER BY variance DESC, v) ELSE 127 END AS threshold, min(v) FILTER (below >= total * 0.005) AS low, min(v) FILTER (below >= total * (1 - 0.005)) AS high FROM x GROUP BY 1"""
)
def otsu_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("image_id"), (F.col("l_suppkey") * 7 % 256).alias("v"))
    return imaging.histogram_threshold(rows, "image_id")

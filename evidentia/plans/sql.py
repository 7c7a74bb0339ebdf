"""The operators' meaning as SQL expressions and tables, for the engine that checks results."""

from __future__ import annotations

from evidentia.functions.noise import CASED, IMPRINTS, PATTERNS, PUBLICATIONS
from evidentia.functions.text import FUNCTION_WORDS, PARTICLES, SMALL_WORDS, STOPWORDS, SYLLABIC, VOWELS
from evidentia.plans.views import NOISE

_SPACE = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text('(?i)' + pattern)})"


def normal(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def words_of(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda t: t <> '')"


def words(x: str) -> str:
    return words_of(normal(x))


def letters(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))"


def capitals(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\p{{Lu}}]', '', 'g'))"


def letter_ratio(x: str) -> str:
    solid = f"length(regexp_replace({x}, '{_SPACE}', '', 'g'))"
    return f"CASE WHEN {solid} = 0 THEN 0.0 ELSE {letters(x)}::DOUBLE / {solid} END"


def upper_share(x: str) -> str:
    return f"CASE WHEN {letters(x)} = 0 THEN 0.0 ELSE {capitals(x)}::DOUBLE / {letters(x)} END"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse(f"translate(regexp_replace({x}, '[|_~^`]+', ' ', 'g'), '“”„‘’', '\"\"\"''''')")


def tidy(x: str) -> str:
    line = collapse(x)
    word = f"CASE WHEN i > 1 AND list_contains({array(SMALL_WORDS)}, w) THEN w ELSE upper(left(w, 1)) || substr(w, 2) END"
    return f"CASE WHEN ({upper_share(line)}) > 0.7 AND length({line}) >= 4 THEN array_to_string(list_transform(string_split(lower({line}), ' '), lambda w, i: {word}), ' ') ELSE {line} END"


def wordiness(x: str) -> str:
    like = rf"length(t) >= 2 AND (regexp_matches(t, '{VOWELS}') OR (regexp_matches(t, '\p{{Cyrillic}}') AND regexp_matches(t, '{SYLLABIC}')))"
    return f"CASE WHEN len({words(x)}) = 0 THEN 0.0 ELSE len(list_filter({words(x)}, lambda t: {like}))::DOUBLE / len({words(x)}) END"


def without_prefix(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)^(by|written by|av|од)\s+', '')"


def has_prefix(x: str) -> str:
    return rf"regexp_matches({x}, '(?i)^(by|written by|av|од)\s+')"


def name_shape(x: str) -> str:
    bare = f"trim({without_prefix(x)})"
    parts = rf"list_filter(regexp_split_to_array({bare}, '\s+'), lambda w: w <> '')"
    capital = rf"len(list_filter({parts}, lambda w: regexp_matches(w, '^\p{{Lu}}') OR ({upper_share('w')}) > 0.7))"
    score = (
        f"{capital}::DOUBLE / len({parts}) * 0.5::DOUBLE + CASE WHEN len({parts}) BETWEEN 2 AND 4 THEN 0.3::DOUBLE ELSE 0 END"
        rf" + CASE WHEN regexp_matches({bare}, '\p{{Lu}}\.') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {matches(bare, PARTICLES)} THEN 0.05::DOUBLE ELSE 0 END"
        f" - CASE WHEN {matches(bare, FUNCTION_WORDS)} THEN 0.25::DOUBLE ELSE 0 END"
    )
    return f"CASE WHEN len({parts}) < 1 OR len({parts}) > 5 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {score})) END"


def significant_of(ws: str) -> str:
    return f"list_filter({ws}, lambda t: length(t) >= 4 AND NOT list_contains({array(STOPWORDS)}, t))"


def edits(a: str, b: str) -> str:
    """Edit distance in characters; the engine's own counts bytes, so letters that take two are written as capitals, which normal texts lack."""
    x, y = (f"translate({t}, 'ßæøœðþđłı', 'ABCDEFGHI')" for t in (a, b))
    return f"levenshtein({x}, {y})"


def token_matches(read: str, known: str) -> str:
    return f"({read} = {known} OR (length({known}) >= 5 AND abs(length({read}) - length({known})) <= 2 AND {edits(read, known)} <= CASE WHEN length({known}) >= 8 THEN 2 ELSE 1 END))"


def similarity(a: str, b: str) -> str:
    """Of two normalised texts."""
    shared = f"len(list_intersect(list_distinct({words_of(a)}), list_distinct({words_of(b)})))"
    token = f"(2.0::DOUBLE * {shared} / (len(list_distinct({words_of(a)})) + len(list_distinct({words_of(b)}))))"
    char = f"(1.0::DOUBLE - {edits(a, b)}::DOUBLE / greatest(length({a}), length({b})))"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE greatest({char}, ({char} + {token}) / 2, {token} * 0.95::DOUBLE) END"


def edit_similarity(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE 1.0::DOUBLE - {edits(a, b)}::DOUBLE / greatest(length({a}), length({b})) END"


def main_title(x: str) -> str:
    short = rf"trim(regexp_split_to_array({x}, '[:;]|\s—\s')[1])"
    return f"CASE WHEN length({short}) >= 3 THEN {short} ELSE {x} END"


def script(x: str) -> str:
    cyrillic, latin = (rf"length(regexp_replace({x}, '[^\p{{{s}}}]', '', 'g'))" for s in ("Cyrillic", "Latin"))
    return f"CASE WHEN {cyrillic} = 0 AND {latin} = 0 THEN 'other' WHEN {cyrillic} >= {latin} THEN 'cyrillic' ELSE 'latin' END"


def sanitise(x: str) -> str:
    plain = rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"array_to_string(list_filter(string_split({plain}, ' '), lambda w: length(w) > 1)[1:12], ' ')"


def dedupe(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def is_noise(x: str) -> str:
    line = clean(x)
    norm = normal(line)
    publication = " OR ".join(f"{norm} = {text(p)} OR suffix({norm}, {text(' ' + p)})" for p in PUBLICATIONS)
    quoted = f"""(regexp_matches({line}, '^["''].*["'']$') AND length({line}) > 12)"""
    return f"(length({line}) < 2 OR length({norm}) < 2 OR list_contains({array(IMPRINTS)}, {norm}) OR {publication} OR {quoted} OR ({letter_ratio(line)}) < 0.5 OR regexp_matches({line}, {text(CASED)}) OR {matches(line, '|'.join(f'(?:{p})' for p in PATTERNS))})"


_LINES = """raw AS (
  SELECT doc_id, {parts} AS parts FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), split AS (
  SELECT doc_id AS scan_id, len(parts) * 60.0::DOUBLE AS page_height, unnest(range(len(parts))) AS line_no, unnest(parts) AS text FROM raw
), lines AS (
  SELECT scan_id, (line_no % 2)::INTEGER AS pass_no, line_no, text, ((scan_id * 31 + line_no * 17) % 101)::DOUBLE AS confidence,
    (20 + (scan_id * 7 + line_no * 13) % 80)::DOUBLE AS height, page_height, line_no * 60.0::DOUBLE AS y0 FROM split
)"""
LINES = _LINES.format(parts="string_split(text, chr(10))")
NOISY = _LINES.format(parts=f"list_append(string_split(text, chr(10)), ({array(NOISE)})[doc_id % {len(NOISE)} + 1])")
#: Usable lines of noisy pages, with what their pass's tallest line measures.
USABLE = f"""{NOISY}, tall AS (
  SELECT *, {letters('text')} AS n_letters, {wordiness('text')} AS wordy FROM lines
), paged AS (
  SELECT *, coalesce(max(CASE WHEN confidence >= 20 AND n_letters >= 3 AND wordy >= 0.5 THEN height END) OVER (PARTITION BY scan_id, pass_no), 0) AS page_max FROM tall
), cleaned AS (
  SELECT * REPLACE ({clean('text')} AS text) FROM paged WHERE NOT {is_noise('text')}
), measured AS (
  SELECT * REPLACE ({letters('text')} AS n_letters, {wordiness('text')} AS wordy) FROM cleaned
), usable AS (
  SELECT * FROM measured WHERE CASE WHEN page_max > 0 AND height >= page_max * 0.5 THEN confidence >= 20 AND n_letters >= 4 AND wordy >= 0.5 ELSE confidence >= 30 AND n_letters >= 3 END
)"""
CANDIDATES = f"""{USABLE}, cand AS (
  SELECT scan_id, pass_no, row_number() OVER (PARTITION BY scan_id, pass_no ORDER BY y0, line_no) - 1 AS cand_no, text, height, confidence, y0,
    (y0 + y0 + height) / 2 / CASE WHEN page_height = 0 THEN 1 ELSE page_height END AS centre_y, page_height, page_max, {has_prefix('text')} AS by_prefix,
    {name_shape('text')} AS name, wordy, {letter_ratio('text')} AS ratio, {without_prefix('text')} AS reads_as FROM usable
)"""


_AREA = "greatest(1.0::DOUBLE, ({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"


def clash(a: str, b: str) -> str:
    """Whether two boxes (structs) share more than 0.6 of the smaller one."""
    w, h = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))", f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    return f"({w} > 0 AND {h} > 0 AND {w} * {h} / least({_AREA.format(a)}, {_AREA.format(b)}) > 0.6::DOUBLE)"


def kept_apart(rows: str) -> str:
    """A list of lines (structs, most confident first) folded to those that keep their places."""
    at = f"list_position(list_transform(acc, lambda k: {clash('k', '(x[1])')}), true)"
    fuller = f"length((x[1]).dedupe) > length((acc[{at}]).dedupe) AND contains((x[1]).dedupe, (acc[{at}]).dedupe)"
    swapped = f"list_transform(acc, lambda k, i: CASE WHEN i = {at} THEN x[1] ELSE k END)"
    return f"list_reduce(list_transform({rows}, lambda r: [r]), lambda acc, x: CASE WHEN coalesce({at}, 0) = 0 THEN list_concat(acc, x) WHEN {fuller} THEN {swapped} ELSE acc END)"


def _box_of(line: str) -> str:
    return f"100.0::DOUBLE AS x0, {line}.y0 AS y0, length({line}.text) * {line}.height + 100.0::DOUBLE AS x1, {line}.y0 + {line}.height AS y1"


_LINE = ["pass_no", "line_no", "confidence", "x0", "y0", "x1", "y1", "dedupe"]


def boxed(lines: str, extra: str = "") -> str:
    """CTE ``boxed``: lines with boxes and dedupe keys, those without a key left out."""
    return f"""{lines}, boxed AS (
  SELECT scan_id, pass_no, line_no, text, confidence, {_box_of('lines')}, {dedupe('text')} AS dedupe{extra} FROM lines WHERE {dedupe('text')} <> ''
)"""


def line_struct(extra: list[str] = ()) -> str:
    return "{" + ", ".join(f"'{c}': {c}" for c in [*_LINE, *extra]) + "}"


_BLOCK = ["text", "height", "confidence", "x0", "y0", "x1", "y1", "page_height", "page_max", "by_prefix"]


def _joins() -> str:
    """Whether the line ``x[1]`` continues the last block of ``acc``."""
    p, q = "(acc[-1])", "(x[1])"
    tail, gap = f"(({p}.heights)[-1])", f"({q}.y0 - {p}.y1)"
    small, large = f"least({q}.height, {tail})", f"greatest({q}.height, {tail})"
    ratio = f"(CASE WHEN {large} = 0 THEN 0.0::DOUBLE ELSE {small} / {large} END)"
    beside = f"least({q}.x1, {p}.x1) - greatest({q}.x0, {p}.x0) > 0"
    widest = f"greatest({p}.x1 - {p}.x0, {q}.x1 - {q}.x0)"
    centred = f"abs(({q}.x0 + {q}.x1) / 2 - ({p}.x0 + {p}.x1) / 2) < {widest} * 0.25::DOUBLE"
    alike = f"({ratio} > 0.45::DOUBLE AND {gap} < {large} * 0.6::DOUBLE)"
    stepped = f"({ratio} > 0.2::DOUBLE AND {q}.page_max > 0 AND {large} >= {q}.page_max * 0.45::DOUBLE AND {q}.height >= {p}.height * 0.25::DOUBLE AND {gap} < {small} * 0.6::DOUBLE AND {centred})"
    return f"{beside} AND {gap} > -{large} AND ({alike} OR {stepped})"


def _joined() -> str:
    p, q = "(acc[-1])", "(x[1])"
    heights = f"list_append({p}.heights, {q}.height)"
    new = {
        "text": f"{p}.text || ' ' || {q}.text", "height": f"list_sort({heights})[len({heights}) // 2 + 1]", "confidence": f"({p}.confidence + {q}.confidence) / 2", "x0": f"least({p}.x0, {q}.x0)", "y0": f"least({p}.y0, {q}.y0)",
        "x1": f"greatest({p}.x1, {q}.x1)", "y1": f"greatest({p}.y1, {q}.y1)", "page_height": f"{p}.page_height", "page_max": f"{p}.page_max", "by_prefix": f"{p}.by_prefix", "heights": heights,
    }
    return "{" + ", ".join(f"'{k}': {v}" for k, v in new.items()) + "}"


#: Blocks of usable lines, numbered from the top.
BLOCKS = f"""{USABLE}, flat AS (
  SELECT u.scan_id, u.pass_no, u.line_no, u.text, u.height, u.confidence, {_box_of('r').replace('r.height', 'u.height')}, u.page_height, u.page_max, {has_prefix('u.text')} AS by_prefix
  FROM usable u JOIN lines r ON u.scan_id = r.scan_id AND u.pass_no = r.pass_no AND u.line_no = r.line_no
), stacks AS (
  SELECT scan_id, pass_no, list([{{{', '.join(f"'{c}': {c}" for c in _BLOCK)}, 'heights': [height]}}] ORDER BY y0, line_no) AS l FROM flat GROUP BY ALL
), folded AS (
  SELECT scan_id, pass_no, list_reduce(l, lambda acc, x: CASE WHEN {_joins()} THEN list_concat(acc[1:len(acc) - 1], [{_joined()}]) ELSE list_concat(acc, x) END) AS blocks FROM stacks
), blocks AS (
  SELECT scan_id, pass_no, unnest(range(len(blocks))) AS cand_no, unnest(blocks) AS b FROM folded
), grouped_lines AS (
  SELECT scan_id, pass_no, cand_no, {', '.join(f'b.{c} AS {c}' for c in _BLOCK)}, (b.y0 + b.y1) / 2 / CASE WHEN b.page_height = 0 THEN 1 ELSE b.page_height END AS centre_y, len(b.heights) AS n_lines FROM blocks
)"""
GROUPED_CANDIDATES = f"""{BLOCKS}, cand AS (
  SELECT scan_id, pass_no, cand_no, text, height, confidence, y0, centre_y, page_height, page_max, by_prefix, {name_shape('text')} AS name, {wordiness('text')} AS wordy, {letter_ratio('text')} AS ratio, {without_prefix('text')} AS reads_as FROM grouped_lines
)"""


def scored(page: str) -> str:
    """Candidates with scores, ranks and places, sizes measured against ``page``."""
    return rf"""{CANDIDATES}, covered AS (
  SELECT scan_id, pass_no, max(page_height) AS page, max(page_max) AS tall_max FROM paged GROUP BY ALL
), measures AS (
  SELECT *, greatest(0.0001::DOUBLE, max(tall_max / greatest(1.0::DOUBLE, page)) OVER (PARTITION BY scan_id)) * greatest(1.0::DOUBLE, page) AS cover_max FROM covered
), covers AS (
  SELECT c.*, page, tall_max, cover_max FROM cand c JOIN measures USING (scan_id, pass_no)
), sized AS (
  SELECT *, {page} AS ref, greatest({page}, max(height) OVER (PARTITION BY scan_id, pass_no), 1.0::DOUBLE) AS top, greatest(max(height) OVER (PARTITION BY scan_id, pass_no), 1.0::DOUBLE) AS tallest,
    len(regexp_split_to_array(text, '\s+')) AS n_words, len(regexp_split_to_array(reads_as, '\s+')) AS n_name FROM covers
), scores AS (
  SELECT *, 0.0::DOUBLE + height / top * 0.5::DOUBLE - CASE WHEN height / top < 0.55 THEN (0.55::DOUBLE - height / top) * 1.2::DOUBLE ELSE 0 END
    + CASE WHEN centre_y <= 0.6 THEN 0.15::DOUBLE * (1.0::DOUBLE - centre_y / 0.6::DOUBLE) + 0.05::DOUBLE ELSE 0 END + CASE WHEN n_words BETWEEN 1 AND 10 THEN 0.12::DOUBLE ELSE 0 END
    + ratio * 0.1::DOUBLE + (wordy - 0.5::DOUBLE) * 0.4::DOUBLE + confidence / 100 * 0.10::DOUBLE - CASE WHEN by_prefix THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN name > 0.75 THEN 0.25::DOUBLE ELSE 0 END AS title_score,
    CASE WHEN by_prefix THEN 0.45::DOUBLE ELSE 0 END + name * 0.3::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - least(centre_y, 1.0::DOUBLE - centre_y) / 0.35::DOUBLE) * 0.12::DOUBLE
    + confidence / 100 * 0.13::DOUBLE + (wordy - 0.5::DOUBLE) * 0.3::DOUBLE - CASE WHEN n_name > 5 THEN 0.25::DOUBLE ELSE 0 END AS author_score FROM sized
), ranked AS (
  SELECT *, (title_score - least(min(title_score) OVER w, 0)) / greatest(0.0001::DOUBLE, greatest(max(title_score) OVER w, 0.0001::DOUBLE) - least(min(title_score) OVER w, 0)) AS title_rank,
    (author_score - least(min(author_score) OVER w, 0)) / greatest(0.0001::DOUBLE, greatest(max(author_score) OVER w, 0.0001::DOUBLE) - least(min(author_score) OVER w, 0)) AS author_rank,
    row_number() OVER (PARTITION BY scan_id, pass_no ORDER BY title_score DESC, cand_no) AS title_place, row_number() OVER (PARTITION BY scan_id, pass_no ORDER BY author_score DESC, cand_no) AS author_place,
    CASE WHEN ref <= 0 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE + 0.65::DOUBLE * least(1.0::DOUBLE, height / (ref * 0.6::DOUBLE)) END * CASE WHEN name > 0.75 THEN 0.65::DOUBLE ELSE 1 END AS weight
  FROM scores WINDOW w AS (PARTITION BY scan_id, pass_no)
)"""


def readings(page: str) -> str:
    """All interpretations of the candidates."""
    reason = """concat_ws(', ', CASE WHEN height >= tallest * 0.95 THEN 'largest text' ELSE 'one of the largest lines' END, CASE WHEN centre_y < 0.34 THEN 'upper third' WHEN centre_y < 0.6 THEN 'upper half' ELSE 'lower half' END, floor(confidence + 0.5)::INTEGER || '% OCR confidence')"""
    return f"""{scored(page)}, titles AS (
  SELECT *, {reason} AS reason FROM ranked WHERE title_place <= 5
), authors AS (
  SELECT * FROM ranked WHERE author_place <= 5
), parts AS (
  SELECT scan_id, pass_no, count(*) AS n, array_to_string(list(text ORDER BY y0, title_place), ' ') AS text, min(title_rank) AS least_rank FROM titles WHERE title_place <= 2 GROUP BY ALL
), readings AS (
  SELECT scan_id, pass_no, {tidy('text')} AS title, '' AS author, title_rank * 0.6::DOUBLE * weight AS score, reason, NULL::DOUBLE AS author_confidence, title_place * 10 AS ord FROM titles
  UNION ALL
  SELECT t.scan_id, t.pass_no, {tidy('t.text')}, {tidy('a.reads_as')}, greatest(0.0::DOUBLE, least(1.0::DOUBLE, t.title_rank * 0.55::DOUBLE * t.weight + a.author_rank * 0.45::DOUBLE + CASE WHEN t.height > a.height THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN a.by_prefix THEN 0.12::DOUBLE ELSE 0 END + a.name * 0.12::DOUBLE - t.name * 0.1::DOUBLE - CASE WHEN t.by_prefix THEN 0.3::DOUBLE ELSE 0 END)), t.reason, a.confidence, t.title_place * 10 + a.author_place
  FROM titles t JOIN authors a ON t.scan_id = a.scan_id AND t.pass_no = a.pass_no AND t.cand_no <> a.cand_no
  UNION ALL
  SELECT scan_id, pass_no, {tidy('text')}, '', least_rank * 0.5::DOUBLE, 'two lines of the cover read as one title', NULL, 100 FROM parts WHERE n = 2
  UNION ALL
  SELECT scan_id, pass_no, '', {tidy('reads_as')}, author_rank * 0.35::DOUBLE, 'only a name was legible', confidence, author_place + 100 FROM authors WHERE author_place <= 2
)"""


#: Readings of both passes pooled by wording.
POOLED = f"""{readings('greatest(page_max, cover_max)')}, quality AS (
  SELECT scan_id, pass_no, least(1.0::DOUBLE, sum(greatest(1, n_letters) * wordy * (confidence / 100)) / sum(greatest(1, n_letters))) AS quality FROM tall GROUP BY ALL
), passes AS (
  SELECT DISTINCT scan_id, pass_no, least(1.0::DOUBLE, tall_max / greatest(1.0::DOUBLE, page) / (cover_max / greatest(1.0::DOUBLE, page))) AS reach, quality FROM covers JOIN quality USING (scan_id, pass_no)
), weighed AS (
  SELECT r.* REPLACE (score * (0.55::DOUBLE + 0.45::DOUBLE * quality) * (0.72::DOUBLE + 0.28::DOUBLE * reach) AS score), {normal('title')} AS title_key, {normal('author')} AS author_key,
    row_number() OVER (PARTITION BY scan_id, pass_no ORDER BY score * (0.55::DOUBLE + 0.45::DOUBLE * quality) * (0.72::DOUBLE + 0.28::DOUBLE * reach) DESC, ord) AS arrival
  FROM readings r JOIN passes USING (scan_id, pass_no) WHERE title <> '' OR author <> ''
), grouped AS (
  SELECT scan_id, title_key, author_key, count(*) AS votes, max(score) AS score, min(pass_no * 1000 + arrival) AS seen, arg_min({{'title': title, 'author': author, 'reason': reason, 'author_confidence': author_confidence}}, pass_no * 1000 + arrival) AS f
  FROM weighed GROUP BY ALL
), boosted AS (
  SELECT *, least(1.0::DOUBLE, score * (1.0::DOUBLE + least(0.3::DOUBLE, (votes - 1) * 0.1::DOUBLE))) AS s,
    EXISTS (SELECT 1 FROM grouped o WHERE o.scan_id = g.scan_id AND o.title_key <> '' AND length(g.title_key) > length(o.title_key) AND contains(g.title_key, o.title_key)) AS fuller FROM grouped g
), final AS (
  SELECT *, least(1.0::DOUBLE, s + CASE WHEN fuller THEN 0.08::DOUBLE ELSE 0 END) AS pooled FROM boosted
), hypotheses AS (
  SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY round(pooled, 12) DESC, seen) AS rank, f.title AS title, f.author AS author, pooled AS score, votes, f.reason AS reason, f.author_confidence AS author_confidence FROM final
  QUALIFY rank <= 6
)"""

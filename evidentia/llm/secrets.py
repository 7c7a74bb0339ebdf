"""Secret scans: three patterns, and a battery of randomness tests with false-discovery control.

All of it is column expressions. The battery looks at every long run of letters, digits and ``+/_-`` outside the
patterns' spans. Its alphabet is inferred (hexadecimal, base 32, alphanumeric or base 64). Against the hypothesis that the run is a random
string of that alphabet stand a chi-squared test of uniformity, a test of the number of runs of character classes and one of serial
correlation; Fisher's method makes one p-value of theirs. Against the hypothesis that it is written language or a name stand the same
statistics of uniformity and runs: fewer equal pairs of characters, and more changes of class, than writing has (Poisson and binomial tails by
Chernoff's bound), combined likewise. All p-values fall with length, and within each band of lengths the Benjamini-Hochberg rule over the
whole table's candidates picks both thresholds: a secret is a run that isn't refused as random and is refused as writing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.shared import free_name, materialize

#: The patterns' kinds in order. Of the first, the second group has 6 characters at least.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: What writing has: the chance that two of its characters are equal is this at least, and that neighbours are of unlike classes this at most.
COINCIDENCE, CHANGE = 0.055, 0.2
#: Of the runs taken for secrets this share may be writing, and of those dismissed as not random this share may be random.
FALSE_DISCOVERIES, FALSE_DISMISSALS = 0.001, 0.01
_BINS, _BIN = 400, 10
_PLACEHOLDER = "[secret]"
_BLOCK = 128
_SYMBOLS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Shares of the classes lower, upper, digit, other in a random string.
_SHARES = {name: [sum(map(f, s)) / len(s) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())] for name, s in _SYMBOLS.items()}


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start: int, end: int, found: string>>)")

    def place(x: Column, at: Column) -> Column:
        return F.struct((at - F.length(x["match"])).cast("int").alias("start"), at.cast("int").alias("end"), x["match"].alias("found"))

    pairs = F.zip_with(matches, F.slice(between, F.lit(1), F.size(matches)), lambda m, b: F.struct(m.alias("match"), b.alias("before")))

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda x: (F.length(x["before"]) + F.length(x["match"])).cast("long")), lambda a, b: a + b)
        return F.zip_with(pairs, F.slice(ends, F.lit(2), F.size(pairs)), place)

    spans = let(pairs, placed)
    return F.when(F.regexp_instr(text, F.lit(pattern)) > 0, spans).otherwise(empty)


def _base(text: Column) -> Column:
    """array<struct<start, kind, end>> of the three patterns."""

    def kind(number: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    assigned = F.filter(_found(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= LEAST_VALUE)
    return F.array_sort(F.concat(kind(0, assigned), kind(1, _found(text, ACCESS)), kind(2, _found(text, HEX))))


def _pick(by: Column, values: dict[str, object]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(by == name, F.lit(value)).otherwise(out)
    return out


def _encoding(token: Column) -> Column:
    digit, letter = token.rlike("[0-9]"), token.rlike("[A-Za-z]")
    return (
        F.when(~(digit & letter) & ~(token.rlike("[a-z]") & token.rlike("[A-Z]")), "none")
        .when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def _judged(token: Column) -> Column:
    """struct<band, bin, off>: the band of lengths, and tenths of -log10 of the p-values, against writing and against randomness."""
    encoding = _encoding(token)
    plain = F.translate(F.when(encoding == "hex", F.lower(token)).otherwise(token), "-_", "+/")
    alphabet = _pick(encoding, _SYMBOLS)
    size = F.length(token).cast("double")
    symbols = F.length(alphabet).cast("double")

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    squares = total(F.transform(F.split(alphabet, ""), lambda c: F.pow(size - F.length(F.replace(plain, c, F.lit(""))), F.lit(2.0))))
    free = symbols - 1
    chi = F.greatest(F.lit(0.0), squares * symbols / size - size) / free
    uniform = (F.pow(chi, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))

    classes = F.translate(F.translate(F.translate(F.translate(plain, "abcdefghijklmnopqrstuvwxyz", "l" * 26), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "u" * 26), "0123456789", "d" * 10), "+/", "oo")
    changes = F.length(F.regexp_replace(classes, r"(.)\1*", "x")).cast("double") - 1
    expected = _pick(encoding, {name: 1 - sum(p * p for p in shares) for name, shares in _SHARES.items()})
    runs = (changes - (size - 1) * expected) / F.sqrt((size - 1) * expected * (1 - expected))

    values = F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c).cast("double"))

    def correlation(values: Column, mean: Column) -> Column:
        spread = total(F.transform(values, lambda v: (v - mean) * (v - mean)))
        lagged = total(F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda a, b: (a - mean) * (b - mean)))
        return lagged / F.greatest(spread, F.lit(1e-9)) * F.sqrt(size)

    serial = let(values, lambda values: let(total(values) / size, lambda mean: correlation(values, mean)))

    random = let(surprise(uniform) + surprise(F.abs(runs), sides=2) + surprise(F.abs(serial), sides=2), lambda y: y - F.log(1 + y + y * y / 2))
    share = changes / (size - 1)
    changed = F.when(share > CHANGE, (size - 1) * (share * F.log(share / CHANGE) + (1 - share) * F.log(F.greatest(1 - share, F.lit(1e-12)) / (1 - CHANGE)))).otherwise(0.0)
    pairs, usual = (squares - size) / 2, size * (size - 1) / 2 * COINCIDENCE
    apart = F.when(pairs < usual, usual - pairs + F.when(pairs > 0, pairs * F.log(F.greatest(pairs, F.lit(1.0)) / usual)).otherwise(0.0)).otherwise(0.0)
    written_ = let(changed + apart, lambda y: y - F.log(1 + y))

    def tenths(negative_log: Column) -> Column:
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(_BINS)), negative_log / math.log(10) * _BIN))).cast("int")

    known = encoding != "none"
    return F.struct(F.floor(F.log2(size)).cast("int").alias("band"), F.when(known, tenths(written_)).otherwise(0).alias("bin"), F.when(known, tenths(random)).otherwise(_BINS).alias("off"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(xs: Column, size: int | Column) -> Column:
    """An array that isn't empty, dealt to arrays of ``size``, the last one shorter."""
    size = F.lit(size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda i: F.slice(xs, i * size + 1, size))


def running(xs: Column, together: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """array<bigint> of n values from 0 up -> the n + 1 totals of its first 0 to n values, by a sum or a maximum.

    A total is added to an array by copying it, so long arrays are worked on in blocks: the blocks' own totals, and the totals of
    what stands before each. The work grows with n up to ``_BLOCK`` to the power of ``levels``.
    """

    def plain(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(together(F.element_at(s, -1), x))))

    if levels == 1:
        return plain(xs)

    def blocked(blocks: Column) -> Column:
        before = running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), together)), together, levels - 1)
        own = F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, s: F.transform(F.slice(plain(b), F.lit(2), F.size(b)), lambda v: together(s, v)))
        return F.concat(F.array(F.lit(0).cast("long")), F.flatten(own))

    return let(xs, lambda xs: F.when(F.size(xs) > _BLOCK, let(_blocks(xs, _BLOCK), blocked)).otherwise(plain(xs)))


def surprise(z: Column, sides: int = 1) -> Column:
    """-ln of the chance that a standard normal value is above ``z``, or, on two ``sides``, farther out (Abramowitz and Stegun 26.2.17)."""

    def tail(z: Column) -> Column:
        t = 1 / (1 + 0.2316419 * F.abs(z))
        series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        far = z * z / 2 + math.log(2 * math.pi) / 2 - F.log(series)
        return F.when(z >= 0, far).otherwise(-F.log(1 - F.exp(-far)))

    return F.greatest(F.lit(0.0), let(z, tail) - math.log(sides))


def _untouched(found: Column, base: Column) -> Column:
    """The matches, by start, that share no character with any span of ``base``.

    A span that begins before a match's end either ends before its start or touches it: both kinds are counted along the sorted ends.
    """

    def counted(spans: Column, matches: Column, spans_first: bool) -> Column:
        """By match how many places of spans lie before its own place, or at it where ``spans_first``."""
        def placed(xs: Column, kind: int) -> Column:
            return F.transform(xs, lambda x: F.struct(x.cast("long").alias("at"), F.lit(kind).alias("kind")))

        events = F.array_sort(F.concat(placed(spans, 0), placed(matches, 1 if spans_first else -1)))

        def count(events: Column) -> Column:
            before = running(F.transform(events, lambda e: (e["kind"] == 0).cast("long")), lambda a, b: a + b)
            seen = F.zip_with(events, F.slice(before, F.lit(2), F.size(events)), lambda e, n: F.struct(e["kind"].alias("kind"), n.alias("n")))
            return F.transform(F.filter(seen, lambda e: e["kind"] != 0), lambda e: e["n"])

        return let(events, count)

    begun = counted(base["start"], found["end"], False)
    ended = counted(base["end"], found["start"], True)
    marked = F.zip_with(found, F.zip_with(begun, ended, lambda a, b: a == b), lambda f, free: F.struct(f.alias("found"), free.alias("free")))
    return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["found"])


def _candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, band, bin, off>> of the long runs that no pattern's span touches."""
    runs = let(_found(text, CANDIDATE), lambda found: F.when(F.size(found) * F.size(base) > 0, _untouched(found, base)).otherwise(found))

    def judge(c: Column) -> Column:
        judged = _judged(c["found"])
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), judged["band"].alias("band"), judged["bin"].alias("bin"), judged["off"].alias("off"))

    return F.transform(runs, lambda c: let(c, judge))


def _scan(docs: DataFrame, text_col: str, base: str, candidates: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(base, _base(text)).withColumn(candidates, _candidates(text, F.col(base)))


def thresholds(candidates: DataFrame, rate: float, column: str = "bin") -> dict[int, int]:
    """Candidates (band, ``column``: tenths of -log10 p) -> by band the least tenths that refuse the hypothesis; bands without any are left out.

    The Benjamini-Hochberg rule on binned p-values, a bin's p-value being its upper end. What reaches the driver is one number per
    band, and a band is a power of two of lengths.
    """
    counts = candidates.groupBy("band", F.col(column).alias("tenths")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("band").orderBy(F.col("tenths").desc())
    ranked = counts.withColumn("found", F.sum("n").over(above)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    ranked = ranked.where((F.col("tenths") > 0) & (F.pow(F.lit(10.0), -F.col("tenths") / _BIN) <= rate * F.col("found") / F.col("all")))
    return {r["band"]: r["least"] for r in ranked.groupBy("band").agg(F.min("tenths").alias("least")).collect()}


Limits = tuple[dict[int, int], dict[int, int]]


def limits_of(candidates: DataFrame, rate: float) -> Limits:
    """By band: the tenths from which a run isn't writing, and those from which it isn't random."""
    return thresholds(candidates, rate), thresholds(candidates, FALSE_DISMISSALS, "off")


def _passing(candidates: Column, limits: Limits) -> Column:
    """The candidates that count as secrets, as array<struct<start, kind, end>>."""
    written_from, odd_from = limits
    if not written_from:
        return F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")

    def limit(values: dict[int, int], band: Column) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[band], F.lit(_BINS + 1)) if values else F.lit(_BINS + 1)

    kept = F.filter(candidates, lambda c: (c["bin"] >= limit(written_from, c["band"])) & (c["off"] < limit(odd_from, c["band"])))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(id, base, spans) per row: arrays of struct<start, kind, end>, kind a place in ``KINDS``, by start, then kind.

    ``base`` has the patterns' spans, ``spans`` those and the battery's. Offsets are code points, ends exclusive. A null text is
    empty and has no spans. Repeated rows stay, no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialize(_scan(rows, "text", "base", "candidates").select("id", "base", "candidates"), "secrets")
    limits = limits_of(found.select(F.inline("candidates")), rate)
    return found.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", _passing(F.col("candidates"), limits))).alias("spans"))


def _cut(text: Column, spans: Column) -> Column:
    """The text with its spans (by start, at least one) replaced, overlapping ones by one placeholder.

    Finding a place in a text reads it from its start, so the pieces between spans are taken from parts of the text, as many as a part has pieces.
    """

    def pieces(reach: Column) -> Column:
        all_ = F.zip_with(spans, F.slice(reach, F.lit(1), F.size(spans)), lambda s, at: F.struct(at.cast("int").alias("at"), (s["start"] - at).cast("int").alias("length")))
        return F.filter(all_, lambda p: p["length"] >= 0)

    def joined(block: Column) -> Column:
        first, last = block[0]["at"], F.element_at(block, -1)
        part = F.substring(text, first + 1, last["at"] + last["length"] - first)
        return let(part, lambda part: F.array_join(F.transform(block, lambda p: F.concat(F.substring(part, p["at"] - first + 1, p["length"]), F.lit(_PLACEHOLDER))), ""))

    def whole(reach: Column) -> Column:
        cut = let(pieces(reach), lambda ps: F.array_join(F.transform(_blocks(ps, F.ceil(F.sqrt(F.size(ps)))), joined), ""))
        return F.concat(cut, F.substring(text, F.element_at(reach, -1).cast("int") + 1, F.length(text)))

    return let(running(F.transform(spans, lambda s: s["end"].cast("long")), lambda a, b: F.greatest(a, b)), whole)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with every secret in the text replaced by a placeholder, and the length column, if there is one, brought up to date.

    Overlapping spans share one placeholder. Texts without secrets stay as they are, null texts null.
    """
    base, candidates, spans = free_name(docs, "_base"), free_name(docs, "_candidates"), free_name(docs, "_spans")
    scanned = materialize(_scan(docs, text_col, base, candidates), "secrets-scanned")
    limits = limits_of(scanned.select(F.inline(candidates)), rate)
    marked = scanned.withColumn(spans, F.array_sort(F.concat(base, _passing(F.col(candidates), limits))))
    text = F.col(text_col)

    clean = _cut(text, F.col(spans))
    changed = F.size(spans) > 0
    cleaned = marked.withColumn(text_col, F.when(changed, clean).otherwise(text))
    if length_col in docs.columns:
        cleaned = cleaned.withColumn(length_col, F.when(changed, F.length(text).cast("long")).otherwise(F.col(length_col)))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Text functions over columns: normal forms, word shape, fuzzy similarity.

Lengths count code points. Letters are Unicode letters; white space is the set below, which is wider than the regular expression
class of the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
SPACE = r"[\s\x0B   -     　﻿]"
WORD_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
AUTHOR_PREFIX = r"^(by|written by|av|од)\s+"
PARTICLES = r"\b(de|van|von|del|della|di|mc|mac)\b"
FUNCTION_WORDS = r"\b(the|of|and|a|an|in|on|to|for)\b"
SMALL_WORDS = "a an the of and or in on to for at на и во од за со ги го се до по кон".split()
STOPWORDS = (
    "the a an and or of in on to for at by from with novel book story tales edition vol part new his her their "
    "на во од за со и се го ги роман книга издание"
).split()
VOWELS = "[aeiouyаеиоуѐѝ]"
SYLLABIC = "[рј]"
SIGNIFICANT = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def jvm(pattern: str) -> str:
    r"""A pattern whose ``\b`` and ``\s`` mean ASCII word edges and any white space, case being ignored in all scripts."""
    return "(?iu)" + pattern.replace(r"\b", WORD_EDGE).replace(r"\s", SPACE)


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """Characters up to U+1FFF whose compatibility decomposition is one base character and accents."""
    odd, plain = [], []
    for code in range(0x80, 0x2000):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F]
        if len(base) == 1 and base[0] != chr(code):
            odd.append(chr(code))
            plain.append(base[0])
    return "".join(odd), "".join(plain)


def normalise(text: Column) -> Column:
    """Without accents, in lower case, anything but letters and digits one space; see ``normalise_all`` for ligatures."""
    accented = F.translate(F.regexp_replace(text, r"[\u0300-\u036F]", ""), *_plain_letters())
    bare = F.when(F.octet_length(text) != F.length(text), accented).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


@F.arrow_udf(StringType())
def _decomposed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([None if x is None else unicodedata.normalize("NFKD", x) for x in batch.to_pylist()], pa.string())


def normalise_all(text: Column) -> Column:
    """As ``normalise``, with characters that decompose into several (ligatures, Roman numerals) taken apart too."""
    return normalise(_decomposed(text))


def tokens_of(normal: Column) -> Column:
    """Words of a text that is normalised already; none for an empty text."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def tokens(text: Column) -> Column:
    return tokens_of(normalise(text))


def similarity_of(a: Column, b: Column) -> Column:
    """0 to 1 for two normalised texts: the best of edit distance, word overlap and their mean."""
    longest = F.greatest(F.length(a), F.length(b))
    char = F.lit(1.0) - F.levenshtein(a, b) / longest
    x, y = F.array_distinct(tokens_of(a)), F.array_distinct(tokens_of(b))
    token = 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return (
        F.when((a == "") & (b == ""), 1.0)
        .when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .otherwise(F.greatest(char, (char + token) / 2, token * 0.95))
    )


def similarity(a: Column, b: Column) -> Column:
    return let(normalise(a), lambda x: let(normalise(b), lambda y: similarity_of(x, y)))


def edit_similarity(a: Column, b: Column) -> Column:
    """The evaluation's plainer measure: edit distance only, and 0 if either text is empty."""

    def alike(x: Column, y: Column) -> Column:
        return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))

    return let(normalise(a), lambda x: let(normalise(b), lambda y: alike(x, y)))


def count_of(text: Column, kind: str) -> Column:
    """How many characters of a class (``\\p{L}``, ``a-z``) a text has: what is left without the others, as counting matches would build an array of them."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def letter_count(text: Column) -> Column:
    return count_of(text, r"\p{L}")


#: White space besides the space itself.
_ODD = r"\t\n\f\r" + SPACE[3:-1]


def _unusual(text: Column) -> Column:
    """What a text has besides letters and printable ASCII; mostly nothing, so that rarer classes are looked for in what is short."""
    return F.regexp_replace(text, r"[ -~\p{L}]+", "")


def _solid(text: Column) -> Column:
    """How many characters are no white space."""
    return F.length(F.replace(text, F.lit(" "), F.lit(""))) - count_of(_unusual(text), _ODD)


def letter_ratio(text: Column) -> Column:
    """Letters among the characters that are no white space; 0 if there are none."""
    return F.when(text.isNotNull(), F.coalesce(F.try_divide(letter_count(text), _solid(text)), F.lit(0.0)))


def upper_share(text: Column) -> Column:
    """Capitals among the letters; 0 if there are none."""
    return F.when(text.isNotNull(), F.coalesce(F.try_divide(count_of(text, r"\p{Lu}"), letter_count(text)), F.lit(0.0)))


def is_mostly_upper(text: Column) -> Column:
    return upper_share(text) > 0.7


def collapse(text: Column) -> Column:
    full = F.regexp_replace(text, f" ?[{_ODD}]{SPACE}*| {{2,}}{SPACE}*", " ")
    return F.trim(F.when(F.contains(text, F.lit("  ")) | _unusual(text).rlike(f"[{_ODD}]"), full).otherwise(text))


def tidy_title(text: Column) -> Column:
    """Title case for what was read in capitals; other text keeps its case."""
    small = F.array(*map(F.lit, SMALL_WORDS))

    def tidy(line: Column) -> Column:
        words = F.transform(
            F.split(F.lower(line), " "),
            lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
        )
        return F.when(is_mostly_upper(line) & (F.length(line) >= 4), F.array_join(words, " ")).otherwise(line)

    return let(collapse(text), tidy)


def wordiness_of(normal: Column) -> Column:
    """Share of the words of a normalised text that read like words rather than scraps: two letters or more, and a vowel or a letter that carries a syllable."""
    gaps = F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit("")))
    words = F.when(normal == "", 0).otherwise(gaps + 1)
    # each such word's begin becomes a mark that no normalised text holds, and the marks are counted
    marked = F.regexp_replace(F.concat(F.lit(" "), normal), f" (?=[^ ]{{2}})[^ ]*?{VOWELS[:-1]}{SYLLABIC[1:]}", "|")
    like = F.length(marked) - F.length(F.replace(marked, F.lit("|"), F.lit("")))
    return F.coalesce(F.try_divide(like, words), F.lit(0.0))


def wordiness(text: Column) -> Column:
    """Share of the words that read like words rather than scraps; 0 without words."""
    return wordiness_of(normalise(text))


def join_spaced_letters(text: Column, repair: bool = False) -> Column:
    """Type set with a space after each letter. It is left as it is unless ``repair`` joins runs of three letters or more."""
    if not repair:
        return text
    first, last, letter = f"(?:^|{SPACE})", f"(?:{SPACE}|$)", r"\p{L}"
    return F.regexp_replace(text, f"(?<={first}{letter}){SPACE}(?={letter}{SPACE}{letter}{last})|(?<={first}{letter}{SPACE}{letter}){SPACE}(?={letter}{last})", "")


def clean_text(text: Column) -> Column:
    """Without scanning debris, quotes made plain, white space collapsed."""
    bare = F.regexp_replace(text, r"[|_~^`]+", " ")
    plain = F.when(F.octet_length(bare) != F.length(bare), F.translate(bare, "“”„‘’", "\"\"\"''")).otherwise(bare)
    return collapse(plain)


def strip_author_prefix(text: Column) -> Column:
    return F.regexp_replace(text, jvm(AUTHOR_PREFIX), "")


def has_author_prefix(text: Column) -> Column:
    return text.rlike(jvm(AUTHOR_PREFIX))


def _capital_words(bare: Column) -> Column:
    """How many words begin with a capital or are mostly capitals. Only a text with a capital inside a word is taken apart for it."""
    begin = F.regexp_count(F.concat(F.lit(" "), bare), F.lit(f"{SPACE}\\p{{Lu}}"))
    words = F.filter(F.split(bare, SPACE + "+"), lambda w: w.rlike(r"^\p{Lu}") | is_mostly_upper(w))
    inside = F.concat(F.lit(" "), bare).rlike(f"{SPACE}[^\\p{{Lu}}{SPACE[1:-1]}]+\\p{{Lu}}")
    return F.when(inside, F.size(words)).otherwise(begin)


def name_shape_of(bare: Column) -> Column:
    """``name_shape`` of a text that is trimmed and has no author prefix."""
    spaced = F.when(_unusual(bare).rlike(f"[{_ODD}]"), F.regexp_replace(bare, f"[{_ODD}]", " ")).otherwise(bare)
    many = spaced.rlike("[^ ]++(?: ++[^ ]++){5}")
    n = F.regexp_count(spaced, F.lit("[^ ]+"))
    score = F.coalesce(F.try_divide(_capital_words(bare), n), F.lit(0.0)) * 0.5
    score = score + F.when(n.between(2, 4), 0.3).otherwise(0.0)
    score = score + F.when(bare.rlike(r"\p{Lu}\."), 0.2).otherwise(0.0)
    score = score + F.when(bare.rlike(jvm(PARTICLES)), 0.05).otherwise(0.0)
    score = score - F.when(bare.rlike(jvm(FUNCTION_WORDS)), 0.25).otherwise(0.0)
    return F.when(many | (n < 1), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def name_shape(text: Column) -> Column:
    """How much a line looks like a personal name, 0 to 1."""
    return name_shape_of(F.trim(strip_author_prefix(text)))


def significant(words: Column) -> Column:
    """The words that identify: four letters or more and not common in titles."""
    common = F.array(*map(F.lit, STOPWORDS))
    return F.filter(words, lambda t: (F.length(t) >= SIGNIFICANT) & ~F.array_contains(common, t))


def significant_tokens(text: Column) -> Column:
    return significant(tokens(text))


def allowed_edits(word: Column) -> Column:
    return F.when(F.length(word) >= 8, 2).when(F.length(word) >= 5, 1).otherwise(0)


def token_matches(read: Column, known: Column) -> Column:
    """Whether a word that was read is a known word, allowing for one or two damaged letters in long words."""
    close = F.when(F.length(known) >= 8, F.levenshtein(read, known, 2) >= 0).otherwise(F.levenshtein(read, known, 1) >= 0)
    return (read == known) | ((F.length(known) >= 5) & close)


def word_weight(word: Column) -> Column:
    return F.when(F.array_contains(F.array(*map(F.lit, STOPWORDS)), word), 1).otherwise(F.greatest(F.lit(1), F.length(word)))


def matched_words(known: Column, read: Column) -> Column:
    """The words of ``known`` (an array) that a word of ``read`` (an array) matches."""
    return F.filter(known, lambda w: F.array_contains(read, w) | F.exists(read, lambda r: token_matches(r, w)))


def coverage_of(known: Column, matched: Column) -> Column:
    """Weight of the words that are among ``matched``, of the weight of all; 0 without words."""

    def total(words: Column) -> Column:
        return F.aggregate(F.transform(words, word_weight), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(known) == 0, 0.0).otherwise(total(F.filter(known, lambda w: F.array_contains(matched, w))) / total(known))


def coverage(known: Column, read: Column) -> Column:
    return coverage_of(known, matched_words(known, read))


def significant_coverage_of(known: Column, matched: Column) -> Column:
    """Share of the identifying words that are among ``matched``; 0 without any."""

    def share(words: Column) -> Column:
        return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.array_contains(matched, w))) / F.size(words))

    return let(significant(known), share)


def significant_coverage(known: Column, read: Column) -> Column:
    return significant_coverage_of(known, matched_words(known, read))


def longest_matched_of(known: Column, matched: Column) -> Column:
    """Length of the longest identifying word among ``matched``, or 0."""
    found = F.filter(significant(known), lambda w: F.array_contains(matched, w))
    return F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0))


def longest_matched(known: Column, read: Column) -> Column:
    return longest_matched_of(known, matched_words(known, read))


def main_title(title: Column) -> Column:
    """A title without its subtitle, if three characters or more are left."""
    # most titles have nothing to split at, and looking for that is much cheaper
    marked = F.contains(title, F.lit(":")) | F.contains(title, F.lit(";")) | F.contains(title, F.lit("—"))
    short = F.trim(F.when(marked, F.split(title, rf"[:;]|{SPACE}—{SPACE}", 2)[0]).otherwise(title))
    return let(short, lambda s: F.when(F.length(s) >= 3, s).otherwise(title))


def dominant_script(text: Column) -> Column:
    cyrillic, latin = count_of(text, r"\p{IsCyrillic}"), count_of(text, r"\p{IsLatin}")
    return F.when((cyrillic == 0) & (latin == 0), "other").when(cyrillic >= latin, "cyrillic").otherwise("latin")


def sanitise_query(text: Column) -> Column:
    """Up to twelve words of two letters or more, nothing that a search engine could take for syntax."""
    words = F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.slice(F.filter(words, lambda w: F.length(w) > 1), 1, 12), " ")


def search_query(title: Column, author: Column, text: Column) -> Column:
    """Title and author if they come to four characters, else the first twelve words of the whole text."""
    both = F.trim(F.concat_ws(" ", title, author))
    return F.when(F.length(both) >= 4, both).otherwise(F.array_join(F.slice(tokens(text), 1, 12), " "))


def dedupe_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def contains_reading(a: Column, b: Column) -> Column:
    """Whether ``a`` says all that ``b`` says, and more."""
    x, y = dedupe_key(a), dedupe_key(b)
    return (F.length(x) > F.length(y)) & F.contains(x, y)

"""What is printed on covers but is never a title or an author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import SPACE, WORD_EDGE, clean_text, jvm, let, letter_ratio, normalise

# Fixed values: \b is an edge of ASCII words. In the first pattern case counts, in the others it doesn't.
CASED = r"\bcopyright\b|©"
PATTERNS = [
    r"^(a|an)\s+(novel|memoir|story|novella|tale|thriller|romance|mystery)\b",
    r"\b(inter)?national\s+bestseller\b",
    r"\bbestsell(er|ing)\b",
    r"\bnew york times\b",
    r"\bsunday times\b",
    r"\bwinner of\b",
    r"\bshort ?listed\b",
    r"\blong ?listed\b",
    r"\bprize\b",
    r"\baward[- ]winning\b",
    r"\bpulitzer\b",
    r"\bbooker\b",
    r"\bnobel\b",
    r"\bauthor of\b",
    r"\bfrom the (author|creator)\b",
    r"\bnow a major (motion picture|film|series)\b",
    r"\bsoon to be a\b",
    r"\b(un)?abridged\b",
    r"\bwith a new (introduction|foreword|afterword|preface)\b",
    r"\b(translated|illustrated|edited|introduced|foreword|afterword)\s+by\b",
    r"\bedition\b",
    r"\bvolume\s+(one|two|three|[ivx\d]+)\b",
    r"\bisbn\b",
    r"^\s*\d{5,}\s*$",
    r"^[\s\d.,$£€]+$",
    r"^[$£€]\s?\d",
    r"\bwww\.|https?:|\.com\b",
    r"\bclassics?\b",
    r"\b(paperback|hardcover|hardback)\b",
    r"\bbook (one|two|three|1|2|3)\b",
    r"\bprelude to\b",
    r"^\s*[—–-]{1,2}\s*\p{L}",
    r"(превод|препев)",
    r"илустрации",
    r"(предговор|поговор)",
    r"(прво|второ|трето)\s+издание",
    r"издава(ч|штво)",
    r"библиотека",
]
PUBLICATIONS = [
    "village voice", "the guardian", "guardian", "observer", "the times", "telegraph", "washington post", "wall street journal",
    "entertainment weekly", "publishers weekly", "kirkus", "booklist", "esquire", "vogue", "the atlantic", "the new yorker", "new yorker",
    "boston globe", "chicago tribune", "los angeles times", "daily mail", "independent", "financial times", "time magazine", "newsweek",
    "salon", "slate", "npr", "bbc",
]
IMPRINTS = [
    "penguin", "penguin books", "penguin classics", "vintage", "vintage books", "vintage international", "harper", "harpercollins",
    "harper perennial", "anchor", "anchor books", "bantam", "bantam books", "del rey", "tor", "tor books", "faber", "faber and faber",
    "viking", "knopf", "random house", "simon schuster", "simon and schuster", "macmillan", "orbit", "gollancz", "pan", "pan books", "corgi",
    "mariner", "mariner books", "picador", "doubleday", "scribner", "norton", "w w norton", "oxford", "modern library", "everyman", "signet",
    "ace", "ace books", "dell", "avon", "ballantine", "ballantine books", "grove press", "granta", "bloomsbury", "hodder", "headline",
    "orion", "sceptre", "canongate", "houghton mifflin", "little brown", "антолог", "табернакул", "култура", "просветно дело", "или или",
    "матица", "магор", "детска радост", "арс ламина", "полица", "слово", "феникс",
]


#: A line that matches a pattern with letters holds one of these in lower case; what has none of them isn't searched.
MARKS = [
    "novel", "memoir", "story", "tale", "thriller", "romance", "mystery", "bestsell", "new york times", "sunday times", "winner of", "listed", "prize", "winning",
    "pulitzer", "booker", "nobel", "author of", "from the author", "from the creator", "now a major", "soon to be", "abridged", "with a new", "translated", "illustrated", "edited", "introduced",
    "foreword", "afterword", "edition", "volume", "isbn", "www.", "http", ".com", "classic", "paperback", "hardcover", "hardback", "book one", "book two", "book three", "book 1", "book 2",
    "book 3", "prelude to", "прев", "преп", "илустр", "говор", "издание", "издава", "библиотека",
]


def _alternation() -> str:
    """All patterns in one, those that begin at a word's edge behind a single test for it; for lines in lower case."""
    edged = [p[2:] for p in PATTERNS if p.startswith(r"\b") and r"|\b" not in p and "|http" not in p]
    rest = [p for p in PATTERNS if p.startswith("^") or p[2:] not in edged]
    joined = "|".join([rf"\b(?:{'|'.join(f'(?:{p})' for p in edged)})", *[f"(?:{p})" for p in rest]])
    return jvm(joined).removeprefix("(?iu)")


def _printed(line: Column, lower: Column) -> Column:
    """Whether a cleaned line matches a pattern, ``lower`` being the same in lower case."""
    marked = F.exists(F.array(*map(F.lit, MARKS)), lambda mark: F.contains(lower, mark))
    cased = (F.contains(line, F.lit("copyright")) | F.contains(line, F.lit("©"))) & line.rlike(CASED.replace(r"\b", WORD_EDGE))
    priced = line.rlike(f"^[$£€]{SPACE}?\\d")
    dashed = line.rlike(r"^[—–-]{1,2}\s*\p{L}")
    return cased | priced | dashed | (marked & lower.rlike(_alternation()))


def refused(line: Column, normal: Column, lower: Column, ratio: Column) -> Column:
    """Whether a line is noise, from its cleaned, normalised and lower-case forms and its share of letters."""
    publication = normal.isin(PUBLICATIONS) | normal.rlike(f" (?:{'|'.join(PUBLICATIONS)})$")
    quoted = (F.length(line) > 12) & line.rlike("""^["'].*["']$""")
    return (F.length(line) < 2) | (F.length(normal) < 2) | (ratio < 0.5) | normal.isin(IMPRINTS) | publication | quoted | _printed(line, lower)


def is_noise(text: Column) -> Column:
    """Whether a line is too short, an imprint, a publication, a quotation, mostly no letters, or matches a pattern."""
    return let(clean_text(text), lambda line: let(normalise(line), lambda normal: refused(line, normal, F.lower(line), letter_ratio(line))))


def with_noise(lines: DataFrame, text: str = "text", noise: str = "noise", clean: str = "clean") -> DataFrame:
    """``lines`` with ``clean``, the text cleaned, and ``noise``: as ``is_noise``, its steps being columns that are worked out once."""
    steps = lines.withColumn(clean, clean_text(F.col(text)))
    steps = steps.withColumns({"_normal": normalise(F.col(clean)), "_lower": F.lower(clean), "_ratio": letter_ratio(F.col(clean))})
    return steps.withColumn(noise, refused(F.col(clean), F.col("_normal"), F.col("_lower"), F.col("_ratio"))).drop("_normal", "_lower", "_ratio")

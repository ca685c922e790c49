"""Text normalisation and token functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankspark.functions.features import let

# Character and word tables.
TRADITIONAL_TO_SIMPLIFIED = {"萬": "万"}
ACCENTS = {"á": "a"}
SPECIAL_SYMBOLS = ["_", "-"]
NUMBER_WORDS = {"ii": "2", "iii": "3", "iv": "4", "cinco": "5", "tres": "3"}
PORTUGUESE_NUMBERS = {"vinte e um": "21", "vinte e dois": "22"}
STOP_WORDS = ["de", "do", "da", "dos", "das"]

FULL_WIDTH = "".join(chr(c) for c in range(0xFF00, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF00, 0xFF5F)) + " "


def fold_width(c: Column) -> Column:
    """Full-width forms and the ideographic space to their ASCII counterparts."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def map_chars(c: Column, table: dict[str, str]) -> Column:
    """Replace single characters through a table."""
    return F.translate(c, "".join(table), "".join(table.values()))


def fold_accents(c: Column) -> Column:
    return map_chars(c, ACCENTS)


def collapse_symbols(c: Column, symbols: list[str] = SPECIAL_SYMBOLS) -> Column:
    """Each run of special symbols becomes one space; white space is squeezed, ends trimmed."""
    runs = F.regexp_replace(c, "[" + "".join(f"\\{s}" for s in symbols) + "]+", " ")
    return F.trim(F.regexp_replace(runs, r"\s{2,}", " "))


def normalise(c: Column) -> Column:
    """Width folding, character map, lower case, symbol runs, spaces."""
    return collapse_symbols(F.lower(map_chars(fold_width(c), TRADITIONAL_TO_SIMPLIFIED)))


def split_words(c: Column) -> Column:
    """Letter runs, digit runs, and every other character on its own."""
    return F.regexp_extract_all(c, F.lit("([A-Za-z]+|[0-9]+|(?s:.))"), F.lit(1))


def words_of(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def is_digits(c: Column) -> Column:
    """True for text of digits only, the empty text included."""
    return c.rlike("^[0-9]*\\z")


def is_letter(c: Column) -> Column:
    return c.rlike("^[A-Za-z]\\z")


def char_class(c: Column) -> Column:
    """Class of a single character: chinese, number, letter or other."""
    return (
        F.when(c.rlike("^[\\u4e00-\\u9fa5]"), "chinese")
        .when(c.rlike("^[0-9]"), "number")
        .when(c.rlike("^[A-Za-z]"), "letter")
        .otherwise("other")
    )


def remove_stop_words(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop))


def number_words(words: Column) -> Column:
    """Whole-token number words to digits."""
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def number_phrases(c: Column) -> Column:
    """Portuguese number phrases to digits, longest phrase first."""
    for phrase in sorted(PORTUGUESE_NUMBERS, key=len, reverse=True):
        c = F.regexp_replace(c, rf"\b{phrase}\b", PORTUGUESE_NUMBERS[phrase])
    return c


def has_control_chars(c: Column) -> Column:
    """Control characters other than tab and line feed."""
    return c.rlike("[\\x00-\\x08\\x0b-\\x1f]")


def char_trigrams(c: Column) -> Column:
    """Overlapping three-character substrings of the lower-cased text; shorter text yields itself."""
    # A character after each look ahead at three, so that they overlap; one pass over the text.
    grams = lambda low: F.when(F.length(low) >= 3, F.regexp_extract_all(low, F.lit("(?s)(?=(...))."), F.lit(1)))
    return let(F.lower(c), lambda low: F.coalesce(grams(low), F.filter(F.array(low), lambda x: x != "")))


def word_bigrams(words: Column) -> Column:
    def joined(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    return let(words, joined)


def token_overlap(query: Column, name_address: Column) -> tuple[Column, Column]:
    """Distinct query tokens also in the item text: count capped at 20, and share."""
    q = F.array_distinct(F.split(query, " "))
    d = F.split(F.replace(name_address, F.lit("|"), F.lit(" ")), " ")
    n = F.size(F.array_intersect(q, d))
    return F.least(n, F.lit(20)), n / F.size(q)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def compose_key(*parts: Column | str) -> Column:
    return F.concat_ws("||", *parts)


def location(lat: Column, lng: Column) -> Column:
    return F.concat_ws(",", lat.cast("string"), lng.cast("string"))


def list_text(values: Column, digits: int = 6) -> Column:
    """Numbers with up to ``digits`` decimals, joined by semicolons."""
    return F.array_join(F.transform(values, lambda x: F.round(x, digits).cast("string")), ";")


def parse_list(c: Column, separator: str = ";") -> Column:
    return F.split(c, separator).cast("array<double>")

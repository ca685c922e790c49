"""Street-address clean-up rules over word arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankspark.functions.text import is_digits, is_letter

# Words that announce a house number.
NUMBER_MARKS = ["n", "no", "numero"]


def _with_neighbours(words: Column, f) -> Column:
    """Map ``f(word, previous, next)``; a missing neighbour is null."""
    n = F.size(words)
    none = F.array(F.lit(None).cast("string"))
    previous = F.concat(none, F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))))
    following = F.concat(F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), none)
    around = F.arrays_zip(words.alias("w"), previous.alias("p"), following.alias("f"))
    return F.transform(around, lambda e: f(e["w"], e["p"], e["f"]))


def drop_repeated_symbols(words: Column) -> Column:
    """Drop a ``-`` or ``#`` that follows the same symbol."""
    kept = _with_neighbours(
        words, lambda w, p, _: F.when(w.isin("-", "#") & F.equal_null(w, p), F.lit(None)).otherwise(w)
    )
    return F.filter(kept, lambda w: w.isNotNull())


def number_symbol(words: Column) -> Column:
    """``n``, ``no`` or ``numero`` in front of a number becomes ``#``."""
    return _with_neighbours(
        words,
        lambda w, _, f: F.when(w.isin(NUMBER_MARKS) & F.coalesce(is_digits(f), F.lit(False)), "#").otherwise(w),
    )


def drop_affixes(words: Column) -> Column:
    """Drop a closing ``sur`` after a number, and an opening ``av`` when ``calle`` occurs."""
    n = F.size(words)
    long = n >= 2
    sur = long & (F.get(words, n - 1) == "sur") & F.coalesce(is_digits(F.get(words, n - 2)), F.lit(False))
    av = long & (F.get(words, F.lit(0)) == "av") & F.array_contains(words, "calle")
    sur, av = F.coalesce(sur, F.lit(False)), F.coalesce(av, F.lit(False))
    start = F.when(av, 2).otherwise(1)
    return F.slice(words, start, F.greatest(n - sur.cast("int") - av.cast("int"), F.lit(0)))


def _glues(word: Column, before: Column) -> Column:
    number, letter = is_digits(word), is_letter(word)
    return (
        (letter & is_digits(before))
        | (number & before.isin("#", "-"))
        | ((word == "-") & (is_digits(before) | is_letter(before)))
    )


def glue_tokens(words: Column) -> Column:
    """Join number+letter, #+number, -+number, number+- and letter+-.

    Each word is tested against the original word before it, so the text can be built
    by choosing, for every word, whether a space goes in front of it.
    """
    pieces = _with_neighbours(
        words, lambda w, p, _: F.when(p.isNull() | _glues(w, p), w).otherwise(F.concat(F.lit(" "), w))
    )
    return F.array_join(pieces, "")


def clean(words: Column) -> Column:
    """All four rules in order."""
    return glue_tokens(drop_affixes(number_symbol(drop_repeated_symbols(words))))

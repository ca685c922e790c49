"""Fixed-length token, segment and mask arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankspark.functions.features import LEAF_TOKEN_BASE, TREE_LIMIT

# Sequence lengths and special ids.
TOKEN_LENGTH = 60
SHORT_TOKEN_LENGTH = 32
CATEGORY_LENGTH = 4
PAD, UNK, CLS, SEP = 0, 1, 4, 5


def pad_to(ids: Column, n: int, fill=PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(ids), F.lit(0))))


def fit(ids: Column, n: int, fill=PAD) -> Column:
    """Cut or pad to exactly ``n``."""
    return F.slice(pad_to(ids, n, fill), 1, n)


def _ones(n_ones: Column, n: int, one=1) -> Column:
    return fit(F.array_repeat(F.lit(one), n_ones), n)


def enclose(ids: Column, n: int, sep: int = SEP) -> Column:
    """CLS + ids + SEP, ids cut to leave room for both."""
    return F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, n - 2), F.array(F.lit(sep)))


def encode(ids: Column, n: int, sep: int = SEP) -> Column:
    """Struct of token, segment and mask ids of one text."""
    inner = enclose(ids, n, sep)
    return F.struct(
        pad_to(inner, n).alias("token_ids"),
        F.array_repeat(F.lit(0), n).alias("segment_ids"),
        _ones(F.size(inner), n).alias("mask_ids"),
    )


def pair_segments(ids: Column, n: int, sep: int = SEP) -> Column:
    """Struct for a stored id list: segment 0 through the first SEP after the start, then 1."""
    size = F.size(ids)
    at = F.array_position(F.slice(ids, 2, F.greatest(size - 1, F.lit(0))), F.lit(sep))
    first = F.when(at > 0, at.cast("int") + 1).otherwise(size)
    segments = F.concat(F.array_repeat(F.lit(0), first), F.array_repeat(F.lit(1), size - first))
    return F.struct(
        pad_to(ids, n).alias("token_ids"),
        pad_to(segments, n).alias("segment_ids"),
        pad_to(F.array_repeat(F.lit(1), size), n).alias("mask_ids"),
    )


def encode_pair(first: Column, second: Column, n: int, sep: int = SEP) -> Column:
    """CLS first SEP second SEP; the longer list gives way, then segments by pair."""
    a, b = truncate_pair(first, second, n - 3)
    ids = F.concat(F.array(F.lit(CLS)), a, F.array(F.lit(sep)), b, F.array(F.lit(sep)))
    return pair_segments(ids, n, sep)


def encode_triple(query: Column, name: Column, addr: Column, n: int, sep: int = SEP) -> Column:
    """CLS query SEP name SEP addr SEP; the address is cut first, then name, then query."""
    room = n - 4
    q = F.least(F.size(query), F.lit(room))
    m = F.least(F.size(name), room - q)
    r = F.least(F.size(addr), room - q - m)
    ids = F.concat(
        F.array(F.lit(CLS)), F.slice(query, F.lit(1), q), F.array(F.lit(sep)),
        F.slice(name, F.lit(1), m), F.array(F.lit(sep)),
        F.slice(addr, F.lit(1), r), F.array(F.lit(sep)),
    )
    used = F.size(ids)
    return F.struct(
        pad_to(ids, n).alias("token_ids"),
        pad_to(F.concat(F.array_repeat(F.lit(0), q + 2), F.array_repeat(F.lit(1), used - q - 2)), n).alias("segment_ids"),
        _ones(used, n).alias("mask_ids"),
    )


def truncate_pair(a: Column, b: Column, n: int) -> tuple[Column, Column]:
    """Shorten the longer list (the second on ties) until both fit in ``n``.

    Removing one token at a time from the longer side ends with both lists at most
    half of ``n``, unless the shorter one already leaves more room than that.
    """
    sa, sb = F.size(a), F.size(b)
    half_a, half_b = (n + 1) // 2, n // 2
    keep_a = F.when(sa + sb <= n, sa).when(sa <= half_a, sa).when(sb <= half_b, n - sb).otherwise(half_a)
    keep_b = F.when(sa + sb <= n, sb).otherwise(n - keep_a)
    return F.slice(a, F.lit(1), keep_a), F.slice(b, F.lit(1), keep_b)


def append_features(encoded: Column, ids: Column, segments: Column, masks: Column, n: int) -> Column:
    """Add feature ids with their own segment and mask ids, padded to ``n``."""
    return F.struct(
        pad_to(F.concat(encoded.token_ids, ids), n).alias("token_ids"),
        pad_to(F.concat(encoded.segment_ids, segments), n).alias("segment_ids"),
        pad_to(F.concat(encoded.mask_ids, masks), n).alias("mask_ids"),
    )


# Fixed value: segment of leaf ids in a token sequence.
LEAF_SEGMENT = 9


def append_leaves(encoded: Column, leaf_ids: Column, n: int, limit: int = TREE_LIMIT) -> Column:
    """Add the leaf ids of at most ``limit`` trees as tokens of the leaf segment, padded to ``n``."""
    ids = F.transform(F.slice(leaf_ids, 1, limit), lambda i: (i + LEAF_TOKEN_BASE).cast("int"))
    same = lambda v: F.transform(ids, lambda _: F.lit(v))
    return append_features(encoded, ids, same(LEAF_SEGMENT), same(1), n)


def append_alias(name: Column, addr: Column, alias: Column, budget: int = SHORT_TOKEN_LENGTH) -> Column:
    """``name|addr alias`` with as many alias words as the budget leaves."""
    words = lambda c: F.size(F.split(c, " "))
    room = F.greatest(F.lit(budget) - words(name) - words(addr), F.lit(0))
    extra = F.array_join(F.slice(F.split(alias, " "), F.lit(1), room), " ")
    return F.concat(name, F.lit("|"), addr, F.lit(" "), extra)


def pad_categories(ids: Column, n: int = CATEGORY_LENGTH) -> tuple[Column, Column]:
    """Category ids cut or padded to ``n``, and their 0/1 mask."""
    return fit(ids, n), _ones(F.least(F.size(ids), F.lit(n)), n)

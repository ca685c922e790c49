"""Ranking features: parsing, densifying, grouping, statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Highest feature index, tree limit, and the pass-through of re-indexed features.
FEATURE_CAP = 529
TREE_LIMIT = 300
SKIPPED_INDEXES = (16, 25, 27, 29, 30, 33, 34, 35, 36)
REINDEXED_WIDTH = 215
IGNORED_COLUMNS = (25, 62)
STATISTIC_WIDTH = 41
NULL_FEATURES = ("null", "nullLtrFeatures")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def reindex_table() -> dict[int, int]:
    """Old index -> new index: 1-36 without the skipped ones, then 36, then 64-68."""
    kept = [i for i in range(1, 37) if i not in SKIPPED_INDEXES] + [36] + list(range(64, 69))
    return {old: new for new, old in enumerate(kept, start=1)}


def parse_features(c: Column, cap: int = FEATURE_CAP) -> Column:
    """``v;v;...`` or ``i:v;i:v;...`` to map(index -> value rounded to 7 places).

    Null markers give null. Indexes beyond the cap are dropped, and a repeated index
    keeps its last value.
    """
    tokens = F.slice(F.split(F.regexp_replace(c, "^;+|;+$", ""), ";"), 1, cap)
    value = lambda text: F.round(text.cast("double"), 7)
    indexed = F.filter(
        F.transform(
            F.transform(tokens, lambda t: F.split(t, ":")),
            lambda kv: F.struct(F.get(kv, 0).cast("int").alias("i"), value(F.get(kv, 1)).alias("v")),
        ),
        lambda e: e.i <= cap,
    )

    def last_wins(entries: Column) -> Column:
        names = F.array_distinct(entries["i"])
        repaired = F.transform(
            names, lambda i: F.struct(i.alias("i"), F.element_at(F.filter(entries, lambda e: e.i == i), -1).v.alias("v"))
        )
        return F.map_from_entries(F.when(F.size(names) == F.size(entries), entries).otherwise(repaired))

    plain = F.transform(tokens, lambda t, at: F.struct((at + 1).alias("i"), value(t).alias("v")))
    return F.when(c.isNotNull() & ~c.isin(*NULL_FEATURES), F.when(
        c.contains(":"), let(indexed, last_wins)
    ).otherwise(F.map_from_entries(plain)))


def malformed_tokens(c: Column) -> Column:
    """Tokens that are not exactly ``key:value``."""
    return F.filter(F.split(c, ";"), lambda t: F.size(F.split(t, ":")) != 2)


def densify(features: Column, show_pos: Column, cap: int = FEATURE_CAP) -> Column:
    """Fixed-width array with 0.0 for missing features; slot 0 holds the show position.

    Each present feature, in index order, contributes the zeros of the gap before it and
    its value, so the work is linear in the width.
    """
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def fill(entries: Column) -> Column:
        n = F.size(entries)
        before = F.concat(F.array(F.lit(0)), F.slice(entries["key"], F.lit(1), F.greatest(n - 1, F.lit(0))))
        pieces = F.zip_with(
            entries, F.slice(before, F.lit(1), n), lambda e, last: F.concat(zeros(e.key - last - 1), F.array(e.value))
        )
        last = F.coalesce(F.array_max(entries["key"]), F.lit(0))
        return F.concat(F.flatten(pieces), zeros(F.lit(cap) - last))

    kept = F.filter(F.map_entries(features), lambda e: e.key.between(1, cap))
    return F.concat(F.array(show_pos.cast("double")), let(F.sort_array(kept), fill))


def pick(dense: Column, indexes: Sequence[int]) -> Column:
    """The listed slots of a dense row, in the listed order."""
    return F.array(*[F.get(dense, F.lit(i)) for i in indexes])


def slot_of(features: Column, show_pos: Column, i: int) -> Column:
    """A slot as :func:`densify` would give it, read from the map alone."""
    return show_pos.cast("double") if i == 0 else F.coalesce(F.try_element_at(features, F.lit(i)), F.lit(0.0))


def pick_from(features: Column, show_pos: Column, indexes: Sequence[int]) -> Column:
    """The listed slots as :func:`pick` gives them of a dense row, in the listed order."""
    return F.array(*[slot_of(features, show_pos, i) for i in indexes])


def ignore(features: Column, indexes: Sequence[int] = IGNORED_COLUMNS) -> Column:
    return F.map_filter(features, lambda i, v: ~i.isin(list(indexes)))


def _reindexed(m: Column, match_ratio: Column) -> list[Column | None]:
    """The new slots by place, None for those that hold no feature."""
    slots = {new: old for old, new in reindex_table().items()}

    def slot(i: int) -> Column | None:
        if i == REINDEXED_WIDTH:
            return match_ratio.cast("double")
        if i not in slots:
            return None
        v = F.try_element_at(m, F.lit(slots[i]))
        return F.coalesce(v / 1000 if slots[i] == 28 else v, F.lit(0.0))

    return [slot(i) for i in range(1, REINDEXED_WIDTH + 1)]


def reindex(features: Column, match_ratio: Column) -> Column:
    """Selected features moved to their new slots; feature 28 in thousands, match ratio last."""
    return let(features, lambda m: F.array(*[F.lit(0.0) if v is None else v for v in _reindexed(m, match_ratio)]))


def reindex_text(features: Column, match_ratio: Column, form: Callable[[Column], Column]) -> Column:
    """What joining ``form`` of each value of ``dense_log2(reindex(...))`` by commas gives.

    Runs of slots that hold no feature are one constant of the plan. Pass features of a column that isn't computed here.
    """
    zero, parts = form(F.lit(0.0)), []
    slots = enumerate(_reindexed(features, match_ratio))
    for empty, run in groupby(slots, lambda x: x[1] is None):
        parts += [F.concat_ws(",", *[zero for _ in run])] if empty else [form(v if i < UNSCALED else _log2(v)) for i, v in run]
    return F.concat_ws(",", *parts)


def median_ratio_log(x: Column, median: Column, low: Column) -> Column:
    """log((1 + x) / (1 + median)) after shifting both by the minimum; 0 where undefined."""
    v, m = x - low, median - low
    return F.when((v <= 0) | (m <= 0), 0.0).otherwise(F.round(F.log((1 + v) / (1 + m)), 4))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; 0 for a constant feature, x itself without statistics."""
    return F.when(std.isNull(), x).when(std <= 1e-6, 0.0).otherwise((x - mean) / std)


# Fixed value: so many values at the front of a dense list stay as they are.
UNSCALED = 4


def _log2(v: Column) -> Column:
    return F.log2(v + 2) - 1


def dense_log2(values: Column, form: Callable[[Column], Column] = lambda v: v) -> Column:
    """First four values unchanged, the rest log2(v + 2) - 1; of each, what ``form`` makes of it."""
    return F.transform(values, lambda v, i: form(F.when(i < UNSCALED, v).otherwise(_log2(v))))


def statistics_or_zeros(values: Column) -> Column:
    return F.coalesce(values, F.array_repeat(F.lit(0.0), STATISTIC_WIDTH))


def masked_statistics(
    query_type: Column,
    distance: Column,
    click_score: Column,
    source_tag: Column,
    counts: dict[str, Column],
    groups: dict[str, Column],
    match_ratio: Column,
) -> Column:
    """Statistic features of one item, with the parts of the other query side zeroed.

    ``counts``: common_end, common_start, person_end, person_start, common_total.
    ``groups``: dest_query_city, dest_pid_query_city, dest_query_geohash,
    start_query_geohash, dest_pid_city; each defaults to 41 zeros.
    """
    start_side = query_type.cast("int") == 0
    zero = F.lit(0.0)
    zeros = F.array_repeat(zero, STATISTIC_WIDTH)
    n = {k: F.coalesce(v.cast("double"), zero) for k, v in counts.items()}
    g = {k: statistics_or_zeros(v) for k, v in groups.items()}
    score = F.coalesce(click_score.cast("double"), zero)
    head = F.array(
        distance.cast("double"),
        (score > 0).cast("double"),
        score,
        F.coalesce(source_tag, F.lit("")).contains("google_textsearch").cast("double"),
        F.when(start_side, zero).otherwise(n["common_end"]),
        F.when(start_side, n["common_start"]).otherwise(zero),
        F.when(start_side, zero).otherwise(n["person_end"]),
        F.when(start_side, n["person_start"]).otherwise(zero),
        n["common_total"],
    )
    return F.concat(
        head,
        g["dest_query_city"],
        g["dest_pid_query_city"],
        F.when(start_side, zeros).otherwise(g["dest_query_geohash"]),
        F.when(start_side, g["start_query_geohash"]).otherwise(zeros),
        g["dest_pid_city"],
        F.array(match_ratio.cast("double")),
    )


# Fixed value: number of hash buckets for user ids outside the dictionary.
USER_BUCKETS = 14138257


def user_bucket(uid: Column) -> Column:
    """Bucket of a long user id from its last eight digits; null when they are not digits."""
    return F.pmod(F.right(uid, F.lit(8)).try_cast("bigint"), F.lit(USER_BUCKETS))


# Reward weight per clicked rank; ranks from 9 on and misses use the last.
RANK_WEIGHTS = (-0.43, -0.234, -0.144, -0.117, -0.057, -0.042, 0.032, 0.022, 0.015, 0.01)


def position_weight(rank: Column) -> Column:
    """Weight of a 0-based rank relative to rank 3; a null rank is a miss."""
    last = len(RANK_WEIGHTS) - 1
    weights = F.array(*[F.lit(w) for w in RANK_WEIGHTS])
    at = F.least(F.coalesce(rank, F.lit(last)), F.lit(last)).cast("int")
    return F.get(weights, at) - F.lit(RANK_WEIGHTS[3])


# Fixed value: where leaf ids start in the shared token id space.
LEAF_TOKEN_BASE = 66453


def leaf_offsets(leaves_per_tree: Sequence[int]) -> list[int]:
    """First one-hot id of each tree: 1, then cumulative, so that trees never overlap."""
    out, at = [], 1
    for n in leaves_per_tree:
        out.append(at)
        at += n
    return out


def leaf_ids(leaves: Column, offsets: Sequence[int]) -> Column:
    return F.zip_with(leaves, F.array(*[F.lit(o) for o in offsets]), lambda a, b: (a + b).cast("int"))


def append(rows: DataFrame, extra: DataFrame, key: str, features: str, new: str) -> DataFrame:
    """Left-join new feature maps by row key; indexes already present win."""
    joined = rows.join(extra, key, "left")
    fresh = F.map_filter(
        F.col(new), lambda i, v: ~F.array_contains(F.map_keys(F.col(features)), i)
    )
    return joined.withColumn(
        features, F.when(F.col(new).isNull(), F.col(features)).otherwise(F.map_concat(features, fresh))
    ).drop(new)

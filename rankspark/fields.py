"""Field specifications: one list drives parsing, defaults, dictionaries and schemas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions import geo, text


@dataclass(frozen=True)
class FieldSpec:
    """One field of a query or an item.

    ``source``   name in the JSON log            ``default``  used when it is missing
    ``parser``   registered field operator       ``dict_key`` dictionary it is numbered in
    ``min_count`` values must exceed this count  ``width``    padded length of a list
    """

    source: str
    type: T.DataType = T.StringType()
    default: str | int | None = ""
    parser: str = "plain"
    dict_key: str | None = None
    min_count: int | None = None
    width: int | None = None

    @property
    def output_type(self) -> T.DataType:
        return T.ArrayType(T.IntegerType()) if self.width else self.type


def _plain(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def _words(value: Column, default) -> Column:
    return text.normalise(_plain(value, default))


def _name_address(value: Column, default) -> Column:
    """Normalise name and address apart, keeping the bar between them."""
    parts = F.split(_plain(value, default), r"\|")
    return F.array_join(F.transform(parts, text.normalise), "|")


def _pair_geohash(value: Column, default) -> Column:
    """``lat,lng`` text to a geohash."""
    parts = F.split(_plain(value, default), ",")
    return geo.geohash(
        F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    )


# Field operators by configured name; unknown names fail when the plan is built.
FIELD_OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "plain": _plain,
    "words": _words,
    "name_address": _name_address,
    "geohash": _pair_geohash,
}


def field_column(spec: FieldSpec, value: Column) -> Column:
    if spec.parser not in FIELD_OPERATORS:
        raise KeyError(f"no field operator named {spec.parser!r}")
    return FIELD_OPERATORS[spec.parser](value, spec.default).cast(spec.type).alias(spec.source)


def project_fields(specs: list[FieldSpec], parent: str) -> list[Column]:
    """Columns for the configured fields of a parsed struct; repeated names count once."""
    seen: dict[str, Column] = {}
    for spec in specs:
        if spec.source not in seen:
            seen[spec.source] = field_column(spec, F.col(f"{parent}.{spec.source}"))
    return list(seen.values())


def raw_schema(specs: list[FieldSpec]) -> T.StructType:
    """Schema of the stored JSON object: every field is text there."""
    names = dict.fromkeys(s.source for s in specs)
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def output_schema(specs: list[FieldSpec], prefix: str = "") -> T.StructType:
    """Typed output schema, with ``pos_`` or ``neg_`` in front for pair formats."""
    names = {f"{prefix}{s.source}": s.output_type for s in specs}
    return T.StructType([T.StructField(n, t) for n, t in names.items()])


# Log field names, defaults, dictionary names, thresholds and widths.
QUERY_FIELDS = [
    FieldSpec("g_disp_query", parser="words", dict_key="trigram", width=100),
    FieldSpec("g_disp_area", dict_key="cityid"),
    FieldSpec("g_uid", dict_key="uid", min_count=0),
    FieldSpec("g_plng", T.DoubleType(), default=None),
    FieldSpec("g_plat", T.DoubleType(), default=None),
    FieldSpec("g_timestamp"),
    FieldSpec("g_query_type"),
    FieldSpec("q_geohash", parser="geohash"),
    FieldSpec("component_terms"),
    FieldSpec("component_ids", dict_key="comp_label_id", width=10),
]
ITEM_FIELDS = [
    FieldSpec("p_poi_id", dict_key="poiid", min_count=0),
    FieldSpec("p_name_address", parser="name_address", dict_key="trigram", width=150),
    FieldSpec("p_poi_lat", T.DoubleType(), default=None),
    FieldSpec("p_poi_lng", T.DoubleType(), default=None),
    FieldSpec("p_category", dict_key="category", width=10),
    FieldSpec("p_geometry"),
    FieldSpec("p_brand"),
    FieldSpec("p_show_pos", T.IntegerType(), default=None),
    FieldSpec("p_layer", default="0", dict_key="layer"),
    FieldSpec("p_geohash", parser="geohash", dict_key="geohash"),
]
# Read with the items but not projected by configuration.
ITEM_EXTRAS = ["p_label", "p_ltrfeatures", "p_impression_id"]

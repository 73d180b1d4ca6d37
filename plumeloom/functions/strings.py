"""Text forms of parameters, durations, colours, names and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_mmss(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), F.floor(F.pmod(seconds, F.lit(60))).cast("long"))


def parse_params(text: Column) -> Column:
    """"k=v:k=v" as a map from k to struct(kind, value); an item without one "=" is an error.

    A value's kind is the first that fits of bool, none, int, float and str.
    """
    items = F.transform(F.split(text, ":"), lambda item: F.split(item, "="))
    bad = F.exists(items, lambda kv: F.size(kv) != 2)

    def typed(v: Column) -> Column:
        low = F.lower(v)
        kind = F.when(low.isin("true", "false"), "bool").when(low == "none", "none").when(v.rlike(r"^\s*[+-]?[0-9]+\s*$"), "int").when(v.try_cast("double").isNotNull(), "float").otherwise("str")
        return F.struct(kind.alias("kind"), v.alias("value"))

    pairs = F.transform(items, lambda kv: F.struct(F.element_at(kv, 1), typed(F.element_at(kv, 2))))
    return F.when(bad, F.raise_error(F.concat(F.lit("not k=v: "), text))).otherwise(F.map_from_entries(pairs))


def plume_color(*key: Column) -> Column:
    """RRGGBB, the same for the same plume in every run."""
    return F.upper(F.substring(F.sha2(F.concat_ws(":", *key), 256), 1, 6))


def granule_of(path: Column) -> Column:
    """The file's name without folders and last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def obs_path(path: Column) -> Column:
    """The observation file beside a radiance file; other names are an error."""
    swapped = F.replace(path, F.lit("_L1B_RAD"), F.lit("_L1B_OBS"))
    return F.when(F.contains(path, F.lit("_L1B_RAD")), swapped).otherwise(F.raise_error(F.concat(F.lit("not a radiance file: "), path)))


def point_wkt(x: Column, y: Column) -> Column:
    """A point, or the empty text where there is none."""
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.format_string("POINT (%.16f %.16f)", x, y)), F.lit(""))

"""Attributes of features: picking, cleaning, and telling layers by name and geometry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(props: Column, names: Sequence[str]) -> Column:
    """The first value that is not empty among the named keys of a map, whatever their case and surrounding blanks; null if there is none."""
    entries = F.map_entries(props)

    def of(name: str) -> Column:
        return F.nullif(F.try_element_at(F.filter(entries, lambda e: F.upper(F.trim(e.key)) == name.upper()), F.lit(-1)).value, F.lit(""))

    return F.coalesce(*[of(n) for n in names])


def clean(props: Column) -> Column:
    """A map without the keys that begin with an underscore; null as empty."""
    return F.map_filter(F.coalesce(props, F.create_map().cast("map<string,string>")), lambda key, _: ~key.startswith("_"))


def layer_type(name: Column, geometry: Column, hints: Sequence[tuple[Sequence[str], str]], kinds: Mapping[str, str]) -> Column:
    """The type of the first hint with a keyword in the name, else that of the geometry, else other."""
    upper, found = F.upper(F.coalesce(name, F.lit(""))), []
    for words, kind in hints:
        found.append(F.when(F.exists(F.array(*[F.lit(w.upper()) for w in words]), lambda w: F.contains(upper, w)), kind))
    by_geometry = [F.when(geometry == g, kind) for g, kind in kinds.items()]
    return F.coalesce(*found, *by_geometry, F.lit("other"))


def same_geometry(expected: Column, actual: Column) -> Column:
    """Whether the kinds are equal or one is the multiple of the other."""
    return (expected == actual) | (expected == F.concat(F.lit("Multi"), actual)) | (actual == F.concat(F.lit("Multi"), expected))

"""Scalar and array expressions of the concept graph. All are built-in functions, none a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What Java's \\s stands for, and the no-break space.
_SPACES = " \t\n\x0b\x0c\r\u00a0"


def normalized_space(c: Column | str) -> Column:
    """Trimmed, runs of white space (no-break spaces too) as one space."""
    some = reduce(Column.__or__, (F.contains(col(c), F.lit(x)) for x in _SPACES))  # most words have none and need no pattern
    return F.when(some, F.btrim(F.regexp_replace(col(c), "[\\s\u00a0]+", " "))).otherwise(col(c))


def normalized_variant(c: Column | str) -> Column:
    """The form under which term variants are equal."""
    return F.lower(normalized_space(c))


def is_blank(c: Column | str) -> Column:
    return col(c).isNull() | (F.btrim(F.regexp_replace(col(c), "\\s+", " ")) == "")


def blank_to_null(c: Column | str) -> Column:
    return F.when(~is_blank(c), col(c))


def ordered_union(existing: Column | str, incoming: Column | str) -> Column:
    """Existing values, then incoming ones that are new; each once. A null side counts as empty, two nulls stay null."""
    a, b = col(existing), col(incoming)
    return F.when(a.isNull(), F.array_distinct(b)).when(b.isNull(), F.array_distinct(a)).otherwise(F.array_union(a, b))


def appended(values: Column | str, value: Column, allow_duplicates: bool = False, allow_nulls: bool = False) -> Column:
    """values with value at the end, unless it is there already or null."""
    some = F.coalesce(col(values), F.array().cast("array<string>"))
    more = F.array_append(some, value) if allow_duplicates else F.array_union(some, F.array(value))
    return more if allow_nulls else F.when(value.isNull(), col(values)).otherwise(more)


def keep_first(existing: Column | str, incoming: Column | str, default: Column | None = None) -> Column:
    """A scalar keeps its first value."""
    return F.coalesce(*(col(c) for c in (existing, incoming, default) if c is not None))


def overridden(existing: Column | str, incoming: Column | str, override: bool) -> Column:
    """The incoming value where it isn't blank and override is set; else the first."""
    return F.coalesce(blank_to_null(incoming), col(existing)) if override else keep_first(existing, incoming)


def without(values: Column | str, value: Column | str) -> Column:
    """values but value; unchanged where value is null."""
    return F.when(col(value).isNull(), col(values)).otherwise(F.array_remove(col(values), col(value)))


def as_value(text: Column | str) -> Column:
    """A text as the JSON text of a property's value."""
    return F.when(col(text).isNotNull(), F.substring(F.to_json(F.array(col(text))), F.lit(2), F.length(F.to_json(F.array(col(text)))) - 2))


def as_text(value: Column | str) -> Column:
    """What a property's value (JSON text) shows: a text without its quotes, anything else as it is."""
    v = col(value)
    return F.when(v.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0))).otherwise(v)


def is_list(value: Column) -> Column:
    """Whether a property's value is a list. A text that looks like one is not: its JSON text starts with a quote."""
    return F.coalesce(value.startswith("["), F.lit(False))


def list_values(value: Column) -> Column:
    """The elements of a list value as JSON texts."""
    return F.transform(F.from_json(value, "array<variant>"), lambda x: F.to_json(x))


def list_of(values: Column) -> Column:
    """A list value of elements given as JSON texts."""
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def value_clash(old: Column, new: Column, key: Column) -> Column:
    """Whether two values of an edge property make different edges: single values that differ do. Lists never do, as they
    are united; a list that meets a single value is an error."""
    mixed = F.raise_error(F.concat(F.lit("a list meets a single value in edge property "), key)).cast("boolean")
    return F.when(old.isNull() | new.isNull() | (old == new) | is_list(old) & is_list(new), False).when(is_list(old) | is_list(new), mixed).otherwise(True)


def merged_entries(old: Column, new: Column) -> Column:
    """Entries (key, value) of edge properties: the old ones, lists united with the new, then keys that only new has."""
    value_in = lambda entries, key: F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]

    def grown(e: Column) -> Column:
        other = value_in(new, e["key"])
        united = list_of(F.array_union(list_values(e["value"]), list_values(other)))
        return F.struct(e["key"].alias("key"), F.when(is_list(e["value"]) & is_list(other), united).otherwise(e["value"]).alias("value"))

    return F.concat(F.transform(old, grown), F.filter(new, lambda e: ~F.exists(old, lambda o: o["key"] == e["key"])))


def merged_map(existing: Column | str, incoming: Column | str) -> Column:
    """A map whose existing keys keep their values."""
    a, b = (F.coalesce(col(c), F.create_map().cast("map<string,string>")) for c in (existing, incoming))
    return F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))


def null_if_empty(values: Column | str) -> Column:
    return F.when(F.size(col(values)) > 0, col(values))


def distinct_ignoring_case(values: Column | str) -> Column:
    """Values whose lower-case form is new, in order."""
    v = col(values)
    return F.filter(v, lambda x, i: F.array_position(F.transform(v, F.lower), F.lower(x)) == i + 1)


def first_position(values: Column | str, value: Column) -> Column:
    """Index of the first equal value, from 0; -1 if there is none, null for a null array."""
    return (F.array_position(col(values), value) - 1).cast("int")


def same_value(a: Column | str, b: Column | str) -> Column:
    return col(a).eqNullSafe(col(b))


def contradicts(a: Column | str, b: Column | str) -> Column:
    """Both are there and differ."""
    return col(a).isNotNull() & col(b).isNotNull() & (col(a) != col(b))


def as_string_array(df: DataFrame, name: str) -> Column:
    """A string as an array of one, a string array as it is, anything else as null."""
    kind = dict(df.dtypes)[name]
    if kind == "array<string>":
        return F.col(name)
    return F.when(F.col(name).isNotNull(), F.array(F.col(name))) if kind == "string" else F.lit(None).cast("array<string>")


def listed(values: Column | str, by: str = "|") -> Column:
    """Values sorted and joined."""
    return F.array_join(F.array_sort(col(values)), by)


def same_set(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_distinct(col(a))) == F.array_sort(F.array_distinct(col(b)))


def without_empty_json(value: Column) -> Column:
    """JSON of a struct without null fields."""
    return F.to_json(value, {"ignoreNullFields": "true"})

"""Label sets: arrays of (name, value) as rows bring them, maps once normalised.

A normalised set holds the metric under METRIC. Its text form, sorted by name, is the identity of its
series (``labels_key``): maps can't be keys of joins or sets in Spark, and a hash could collide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC = "__name__"
LABELS = "array<struct<name:string,value:string>>"


def filter_labels(labels: Column) -> Column:
    """Labels with a name and a value, the first of each name; one that is dropped for want of a value
    still counts as its name's first."""

    def kept(label: Column, i: Column) -> Column:
        earlier = F.exists(F.slice(labels, F.lit(1), i), lambda x: x["name"].eqNullSafe(label["name"]))
        return (label["name"] != "") & (label["value"] != "") & ~earlier

    def whole(label: Column) -> Column:
        return F.coalesce((label["name"] != "") & (label["value"] != ""), F.lit(False))

    # Names mostly differ, which is quickly seen; then no label needs a look at those before it.
    names = F.transform(labels, lambda x: x["name"])
    alike = F.size(F.array_distinct(names)) == F.size(labels)
    checked = F.when(alike, F.filter(labels, whole)).otherwise(F.filter(labels, lambda x, i: F.coalesce(kept(x, i), F.lit(False))))
    return F.coalesce(checked, F.array().cast(LABELS))


def label_map(labels: Column) -> Column:
    """A map of filtered labels."""
    return F.map_from_entries(filter_labels(labels))


def with_metric(labels: Column, metric: Column) -> Column:
    """Filtered labels and the metric, by name; a label of the metric's name gives way to it."""
    others = F.filter(filter_labels(labels), lambda x: x["name"] != METRIC)
    return F.sort_array(F.concat(others, F.array(F.struct(F.lit(METRIC).alias("name"), metric.alias("value")))))


def sorted_labels(labels: Column) -> Column:
    """A map's entries in the byte order of their names."""
    return F.transform(F.sort_array(F.map_entries(labels)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))


def quoted(value: Column) -> Column:
    escaped = value
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def rendered(entries: Column) -> Column:
    """{name="value", …} of labels in their order; {} for none or null."""
    parts = F.transform(entries, lambda e: F.concat(e["name"], F.lit("="), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.coalesce(parts, F.array().cast("array<string>")), ", "), F.lit("}"))


def labels_string(labels: Column) -> Column:
    """The text form of a label map, by name."""
    return rendered(sorted_labels(labels))


def has_label(labels: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(labels, name), F.lit(False))


def labels_hash(labels: Column) -> Column:
    """For distribution only; series are told apart by labels_string."""
    return F.xxhash64(labels_string(labels))

"""Label sets as columns. The canonical form of a label set is ``k1=v1,k2=v2`` with keys in ascending order."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_labels(labels: Column) -> Column:
    """Canonical string of a ``MAP<STRING,STRING>``; an empty map gives the empty string, null gives null."""
    pairs = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def label_map(labels: Column) -> Column:
    """Map of a canonical string. Labels have no escape, so a comma inside a value starts a new token."""
    return F.map_from_entries(
        F.transform(
            F.array_distinct(label_tokens(labels)),
            lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.substring(t, F.instr(t, "=") + 1, F.length(t)).alias("value")),
        )
    )


def label_tokens(labels: Column) -> Column:
    """The ``key=value`` tokens of a label string, empty ones left out; null gives no tokens."""
    return F.filter(F.coalesce(F.split(labels, ","), F.array().cast("array<string>")), lambda t: t != "")

"""In-row array helpers.

Counting inside the row that holds the tokens needs no shuffle, where exploding and grouping would move every token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body`` without evaluating it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(rows: DataFrame, keep: tuple[str, ...], entries: Column | str, name: str = "e") -> DataFrame:
    """``keep`` and one row per entry (none is null) of an array that is worked out in the row.

    An inner explode of a named array filters on its size first, which works the whole array out once more.
    """
    return rows.select(*keep, F.explode_outer(entries).alias(name)).where(F.col(name).isNotNull())


def run_starts(ordered: Column, key: Callable[[Column], Column]) -> Column:
    """Positions in an ordered array where a new key begins; empty for an empty array."""
    n = F.size(ordered)
    return F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: (i < n) & ((i == 0) | (key(F.get(ordered, i)) != key(F.get(ordered, i - 1)))),
    )


def counted(tokens: Column) -> Column:
    """``array<string>`` -> ``array<struct<token, tf>>``, one entry per different token."""
    return let(
        F.sort_array(tokens),
        lambda s: let(
            run_starts(s, lambda t: t),
            lambda p: F.transform(
                p,
                lambda start, k: F.struct(
                    F.get(s, start).alias("token"),
                    (F.coalesce(F.get(p, k + 1), F.size(s)) - start).alias("tf"),
                ),
            ),
        ),
    )


def summed(entries: Column) -> Column:
    """``array<struct<feature, value>>`` with repeated features -> the same with values added up per feature."""
    return let(
        F.sort_array(entries),
        lambda s: let(
            run_starts(s, lambda e: e["feature"]),
            lambda p: F.transform(
                p,
                lambda start, k: F.struct(
                    F.get(s, start)["feature"].alias("feature"),
                    F.aggregate(
                        F.slice(s, start + 1, F.coalesce(F.get(p, k + 1), F.size(s)) - start),
                        F.lit(0.0),
                        lambda acc, e: acc + e["value"],
                    ).alias("value"),
                ),
            ),
        ),
    )


def unit_length(entries: Column, shape: Callable[[Column, Column], Column] | None = None) -> Column:
    """Divide the values of ``array<struct<feature, value>>`` by their L2 norm; a zero row stays as it is.

    ``shape`` builds the output entry from feature and value, to spare a second pass over the array.
    """
    shape = shape or (lambda feature, value: F.struct(feature.alias("feature"), value.alias("value")))
    return let(
        entries,
        lambda e: let(
            F.sqrt(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x["value"] * x["value"])),
            lambda norm: F.transform(
                e, lambda x: shape(x["feature"], F.when(norm > 0, x["value"] / norm).otherwise(x["value"]))),
        ),
    )

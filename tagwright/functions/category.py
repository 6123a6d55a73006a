"""Category paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_strict(path: Column) -> dict[str, Column]:
    """Three parts and ``first/second``; paths of fewer than three parts become ``other``, extra parts are dropped."""
    parts = F.split(path, "/")
    full = F.size(parts) >= 3
    part = [F.when(full, F.get(parts, F.lit(i))).otherwise("other") for i in range(3)]
    pair = F.when(full, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise("other/other")
    return {"general_cat": part[0], "subcat_1": part[1], "subcat_2": part[2], "gen_subcat1": pair}


def split_padded(path: Column, missing: str = "missing") -> dict[str, Column]:
    """Three parts by position; a part that is not there becomes ``missing``."""
    parts = F.split(path, "/")
    return {f"cat_{i + 1}": F.coalesce(F.get(parts, F.lit(i)), F.lit(missing)) for i in range(3)}


def path_tokens(path: Column) -> Column:
    """The four outputs of ``split_strict`` as tokens."""
    return F.array(*split_strict(path).values())


def with_condition(part: Column, condition: Column) -> Column:
    return F.concat_ws("_", part, condition.cast("string"))

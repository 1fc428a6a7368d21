"""Rows by a list of keys of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.session import fits_broadcast, stage


def _select(table: DataFrame, listed: DataFrame, keys: Sequence[str], wanted: bool) -> DataFrame:
    """Rows whose key is listed (or is not), moving as few of the table's rows as possible.

    A short list is broadcast. For a long one the keys alone are compared first: often few of the
    table's rows are hit, or few are left, and then those keys are broadcast instead. Only
    when neither holds are whole rows shuffled.
    """
    keys = list(keys)
    keep, drop = ("left_semi", "left_anti") if wanted else ("left_anti", "left_semi")
    listed = listed.select(*keys)
    if fits_broadcast(listed):
        return table.join(listed, keys, keep)
    own = table.select(*keys)
    small_table = fits_broadcast(own)
    found = listed.join(own, keys, "left_semi") if small_table else own.join(listed.distinct(), keys, "left_semi")
    hit = stage(found.distinct(), "keys-hit")
    if not fits_broadcast(hit):
        left = stage(own.join(hit, keys, "left_anti"), "keys-left")
        if fits_broadcast(left):
            left = left.toDF(*[f"_{key}" for key in keys])
            # NULL-safe, as rows without a key are among those left.
            return table.join(left, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys], drop)
    return table.join(hit, keys, keep)


def rows_with_keys(table: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _select(table, listed, keys, wanted=True)


def rows_without_keys(table: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _select(table, listed, keys, wanted=False)

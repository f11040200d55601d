"""Joins that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.session import cut

#: A key is hot when it holds more than 1/HOT_SHARE of all rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 200


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row that ``groups`` has for their key.

    ``groups`` has the key columns, ``weight`` (the number of rows of the key) and what is to be
    attached. Keys that hold more than one row in ``HOT_SHARE`` are joined by broadcast: their
    number is below ``HOT_SHARE`` whatever the data, so that side is bounded. All others meet in a
    shuffle join whose largest key has at most that share. Null keys match nothing.
    """
    groups = cut(groups)
    total = groups.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = groups.filter(is_hot).limit(HOT_SHARE)  # the limit never bites; it states the bound to the planner
    if not hot.head(1):
        return rows.join(groups, keys, how)
    hot_rows = rows.join(F.broadcast(hot), keys, "inner")
    cold_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return hot_rows.unionByName(cold_rows.join(groups.filter(~is_hot), keys, how))

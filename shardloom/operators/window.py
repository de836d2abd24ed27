"""Window frames that Spark has no syntax for: GROUPS, and EXCLUDE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRECEDING, FOLLOWING = Window.unboundedPreceding, Window.unboundedFollowing


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], low: int, high: int, **aggregates: Column) -> DataFrame:
    """Aggregates over a GROUPS frame: the peers of ``low`` to ``high`` peer groups around a
    row's own. A peer group's number is its dense rank, over which the frame is a RANGE."""
    own = Window.partitionBy(*partition)
    numbered = df.withColumn("_peer", F.dense_rank().over(own.orderBy(*order)))
    frame = own.orderBy("_peer").rangeBetween(low, high)
    return numbered.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items())).drop("_peer")


def exclude_current(df: DataFrame, partition: list[str], order: list[Column], low: int, high: int, value: str, exclude: str = "current row") -> DataFrame:
    """sum_, count_, avg_, min_ and max_ of ``value`` over ROWS ``low`` to ``high`` without
    the current row, its peer group (``group``), or its peers but not itself (``ties``).

    Sums and counts take the excluded rows off the frame; minima and maxima combine the two
    sides of what is excluded. Where peers are excluded, a side without a bound is the peer
    groups before or after, and a side of k rows is looked through for other groups.
    """
    own = Window.partitionBy(*partition).orderBy(*order)
    frame = own.rowsBetween(low, high)
    v = F.col(value)
    total, n = F.coalesce(F.sum(v).over(frame), F.lit(0)), F.count(v).over(frame)
    own_n, own_v = v.isNotNull().cast("long"), F.coalesce(v, F.lit(0))
    if exclude == "current row":
        inside = F.lit(low <= 0 <= high)
        off, off_n = F.when(inside, own_v).otherwise(F.lit(0)), F.when(inside, own_n).otherwise(F.lit(0))
        before, after = own.rowsBetween(low, min(high, -1)), own.rowsBetween(max(low, 1), high)
        sides = [w for w, ok in ((before, low <= -1), (after, high >= 1)) if ok]
        least = F.least(*(F.min(v).over(w) for w in sides)) if len(sides) > 1 else F.min(v).over(sides[0])
        most = F.greatest(*(F.max(v).over(w) for w in sides)) if len(sides) > 1 else F.max(v).over(sides[0])
    elif exclude in ("group", "ties"):
        # peers inside the frame: those whose row number is in it
        df = df.withColumns({"_peer": F.dense_rank().over(own), "_row": F.row_number().over(own)})
        peers = Window.partitionBy(*partition, "_peer").orderBy("_row").rangeBetween(low, high)
        off, off_n = F.coalesce(F.sum(v).over(peers), F.lit(0)), F.count(v).over(peers)
        if exclude == "ties" and low <= 0 <= high:  # the row itself is in the frame, and stays
            off, off_n = off - own_v, off_n - own_n
        sides = [(low < 0, low == PRECEDING, own.rowsBetween(low, min(high, -1)), (PRECEDING, -1), high >= 0), (high > 0, high == FOLLOWING, own.rowsBetween(max(low, 1), high), (1, FOLLOWING), low <= 0)]
        by_peer, values = Window.partitionBy(*partition).orderBy("_peer"), []
        for present, endless, rows, range_, reaches in sides:
            if not present:
                continue
            if endless and not reaches:
                raise ValueError("a frame without a bound has to reach the current row")
            if endless:
                values.append((F.min(v).over(by_peer.rangeBetween(*range_)), F.max(v).over(by_peer.rangeBetween(*range_))))
            else:
                near = F.filter(F.collect_list(F.struct(F.col("_peer").alias("p"), v.alias("v"))).over(rows), lambda x: x["p"] != F.col("_peer"))
                near = F.transform(near, lambda x: x["v"])
                values.append((F.array_min(near), F.array_max(near)))
        if exclude == "ties" and low <= 0 <= high:
            values.append((v, v))
        none = F.lit(None).cast(df.schema[value].dataType)
        least = F.least(*(a for a, _ in values), none, none)
        most = F.greatest(*(b for _, b in values), none, none)
    else:
        raise ValueError(f"no exclusion of {exclude!r}")
    count = (n - off_n).alias("count_")
    sum_ = F.when(n - off_n > 0, total - off)
    return df.select("*", count, sum_.alias("sum_"), (sum_ / (n - off_n)).alias("avg_"), least.alias("min_"), most.alias("max_")).drop("_peer", "_row")


def nth_from_last(value: Column, n: int, partition: list[str], order: list[Column]) -> Column:
    """NTH_VALUE(.., n) FROM LAST over the whole partition; ``order`` is the reversed order."""
    return F.nth_value(value, n).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(PRECEDING, FOLLOWING))

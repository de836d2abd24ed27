"""Mixing sources to target weights by cube-method balanced sampling.

Targets: sources in ascending code point order, null last, have weights 5, 2, 1, repeating,
and share ``share`` times all sizes; a target is at most ``most`` times its source's size and
what it leaves is shared again by weight. A source's rate is its target over its size: each
of its documents is taken floor(rate) times, and once more with the rest as its inclusion
probability.

The cube method decides who that is. In its flight phase, probabilities move along vectors
of the null space of the balance equations (the total of sizes and the number of documents
of each source), so both totals stay what they are, until a probability is 0 or 1. Blocks
of documents of one source fly on their own; what a block can't decide (as many documents
as there are equations, at most) meets what other blocks of the source left in the next
round, until each source has one small landing problem, which is settled by trying all
outcomes. Order inside a block is that of a hash, so reruns agree.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

SHARE = 1.5
MOST = 2.0
WEIGHTS = (5, 2, 1)
#: Documents of a block, about.
BLOCK = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> dict:
    """The target of each source from the total size of each; None is a source as well."""
    order = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, found = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            found |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            found[s] = most * sizes[s]
        left -= sum(found[s] for s in over)
        open_ = [s for s in open_ if s not in found]
    return found


def fly(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The flight phase for one block. Keeps sum(prob) and sum(size * prob); at most two
    entries stay strictly between 0 and 1."""
    p, x = prob.tolist(), size.tolist()
    out = prob.copy()
    window: list[int] = []
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        window.append(i)
        while len(window) == 3:
            a, b, c = window
            # orthogonal to (1, 1, 1) and to the sizes
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            step = min((1.0 - p[j]) / d if d > 0 else -p[j] / d for j, d in zip(window, u) if d)
            for j, d in zip(window, u):
                p[j] += step * d
                if p[j] < 1e-9:
                    p[j] = 0.0
                elif p[j] > 1.0 - 1e-9:
                    p[j] = 1.0
            window = [j for j in window if 0.0 < p[j] < 1.0]
    if len(window) == 2 and x[window[0]] == x[window[1]]:
        a, b = window  # one equation is enough for equal sizes
        total = p[a] + p[b]
        p[a], p[b] = (1.0, total - 1.0) if total >= 1.0 else (total, 0.0)
        p[b] = 0.0 if p[b] < 1e-9 else p[b]
    out[:] = p
    return out


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Outcomes of 0 or 1 for the few open entries whose total size, then number, is nearest."""
    out, open_ = prob.copy(), np.flatnonzero((prob > 0) & (prob < 1))
    if len(open_):
        want, count = float(prob[open_] @ size[open_]), float(prob[open_].sum())
        tried = [np.array(o) for o in product((0.0, 1.0), repeat=len(open_))]
        out[open_] = min(tried, key=lambda o: (abs(float(o @ size[open_]) - want), abs(o.sum() - count), tuple(-o)))
    return out


def _round(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_block").sort_values(["_order", "_size", "_row"], kind="stable", ignore_index=True)
        p = fly(rows["_p"].to_numpy(float), rows["_size"].to_numpy(float))
        return rows.assign(_p=land(p, rows["_size"].to_numpy(float)) if last else p)

    return run


def choose(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (_source, _row, _size, _order, _p) with each _p decided to 0 or 1."""
    columns = ["_source", "_row", "_size", "_order", "_p"]
    schema = "_source string, _row long, _size long, _order long, _p double"
    done: list[DataFrame] = []
    left = rows.select(*columns)
    while True:
        counts = left.groupBy("_source").agg(F.count(F.lit(1)).alias("n"))
        blocks = {r["_source"]: max(1, -(-r.n // block)) for r in counts.collect()}  # one for each source
        last = max(blocks.values(), default=1) == 1
        table = left.sparkSession.createDataFrame([(s, b) for s, b in blocks.items()], "_s string, _blocks long")
        parted = left.join(F.broadcast(table), left["_source"].eqNullSafe(table["_s"]))
        parted = parted.withColumn("_block", F.pmod(F.xxhash64(F.lit(len(done)), "_order"), F.col("_blocks")))
        flown = parted.select(*columns, "_block").groupBy("_source", "_block").applyInPandas(_round(last), schema)
        flown = materialise(flown, "mixing")
        if last:
            done.append(flown)
            break
        done.append(flown.where("_p IN (0, 1)"))
        left = flown.where("_p NOT IN (0, 1)")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sizes(docs: DataFrame):
    """``docs`` (doc_id, text, source) as (doc_id, source, size, order), one row each."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    order = F.xxhash64("doc_id", "source", "text")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), order.alias("order"))


def ranked(slim: DataFrame) -> DataFrame:
    """``slim`` (order, row) with ``rank``: a row's number among rows of an equal order. Ranks
    are counted inside each part of the table as it was written (a row's upper bits) and go on
    from part to part, so copies that are a third of all rows meet in no single task."""
    parted = slim.withColumn("_part", F.shiftright("row", 33))
    inside = F.row_number().over(Window.partitionBy("order", "_part").orderBy("row"))
    sizes = parted.groupBy("order", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("order").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("order", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return parted.withColumn("_inside", inside).join(sizes, ["order", "_part"]).withColumn("rank", F.col("_before") + F.col("_inside") - 1).drop("_part", "_inside", "_before")


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, order, size, source_size, target, copies, taken) for each row of
    ``docs`` (doc_id, text, source).

    A null text has size 0. Sources without a word have target 0. Rows of equal doc_id are
    documents of their own; a null doc_id and a null source are allowed. Equal rows are
    interchangeable: how many of them are taken is the same in each run. Other columns are
    ignored; texts count as a whole, however long. An empty table gives an empty result.
    ``order`` is a hash of the row. The driver holds one row for each source.
    """
    spark = docs.sparkSession
    slim = materialise(sizes(docs).withColumn("row", F.monotonically_increasing_id()), "mixing-sizes")
    slim = materialise(ranked(slim), "mixing-ranks")
    total = {r.source: r.n for r in slim.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # one for each source
    target = targets(total, share, most)
    rate = {s: target[s] / total[s] if total[s] else 0.0 for s in total}
    table = [(s, total[s], float(target[s]), int(rate[s]), rate[s] - int(rate[s])) for s in total]
    plan = F.broadcast(spark.createDataFrame(table, "s string, source_size long, target double, base int, p double"))
    planned = slim.join(plan, slim["source"].eqNullSafe(plan["s"])).drop("s")
    # copies of a row fly in different blocks: which of them is taken makes no difference
    place = F.xxhash64("order", "rank").alias("_order")
    open_ = planned.select(*(F.col(a).alias(f"_{a}") for a in ("source", "row", "size")), place, F.col("p").alias("_p"))
    chosen = choose(open_, block).select(F.col("_row").alias("row"), F.col("_p").cast("int").alias("once"))
    copies = F.col("base") + F.col("once")
    return planned.join(chosen, "row").select(
        "doc_id", "source", "order", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )

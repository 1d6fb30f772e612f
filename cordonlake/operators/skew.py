"""Per-key results in key order without letting a heavy key land in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordonlake.session import stacked

_STATE = "k string, part int, rows long, orders long, first_order long, last_order long, max_gap long, total double"


def clean_label(column: Column | str) -> Column:
    """A label without surrounding white space and in lower case; null where nothing is left.

    White space here includes tabs, line breaks and the Unicode space separators.
    """
    column = F.col(column) if isinstance(column, str) else column
    stripped = F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(stripped != "", stripped)


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partial state for each key of a sorted partition; the run that an Arrow batch leaves open goes on in the next."""
    part, held = TaskContext.get().partitionId(), None
    for pdf in batches:
        if pdf.empty:
            continue
        keys, order = pdf["k"], pdf["o"].to_numpy()
        code = pd.factorize(keys, use_na_sentinel=False)[0]
        starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
        ends = np.append(starts[1:], len(code))
        gaps = np.diff(order, prepend=order[0])
        gaps[starts] = 0
        out = pd.DataFrame({
            "k": keys.to_numpy()[starts], "part": part, "rows": ends - starts,
            "orders": np.add.reduceat(gaps > 0, starts) + 1, "first_order": order[starts], "last_order": order[ends - 1],
            "max_gap": np.maximum.reduceat(gaps, starts), "total": np.add.reduceat(pdf["v"].to_numpy(), starts),
        })
        if held is not None:
            first = out.iloc[0]
            if first["k"] == held["k"] or (pd.isna(first["k"]) and pd.isna(held["k"])):
                seam = first["first_order"] - held["last_order"]
                held |= {"rows": held["rows"] + first["rows"], "orders": held["orders"] + first["orders"] - (seam == 0), "last_order": first["last_order"],
                         "max_gap": max(held["max_gap"], first["max_gap"], seam), "total": held["total"] + first["total"]}
                out = out.iloc[1:]
                if out.empty:
                    continue
            yield pd.DataFrame([held])
        yield out.iloc[:-1]
        held = out.iloc[-1].to_dict()
    if held is not None:
        yield pd.DataFrame([held])


def ordered_by_key(df: DataFrame, key: Column, order: Column, value: Column | None = None, partitions: int | None = None) -> DataFrame:
    """Per key: rows, distinct order values, the first and last of them, the largest gap between neighbours, sum of ``value``.

    Method: range partitioning on (key, order, row number) with sampled quantiles, so that a key's share of the
    partitions follows its share of the rows; each partition is scanned once in order and gives one partial state
    per key; the states of a key, a few per partition it spans, are then stitched in partition order,
    counting the gap and the repeated order value across each seam.

    Args:
        df: any columns; only those that the expressions use are read.
        key: string; rows whose key is null form a key of their own, returned as null.
        order: long; rows with a null order are counted in ``n_rows`` and ``total`` only.
        value: double, null counts as 0; without it ``total`` is 0.
        partitions: range partitions, ``spark.sql.shuffle.partitions`` by default.

    Returns:
        ``key, n_rows, n_orders, first_order, last_order, max_gap, total, n_states``. ``max_gap`` is 0 where a key
        has one order value; ``first_order`` to ``max_gap`` are null where it has none. Repeated rows count each time
        in ``n_rows``, once in ``n_orders``. An empty input gives no rows.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(
        key.cast("string").alias("k"), order.cast("long").alias("o"),
        F.coalesce(value.cast("double"), F.lit(0.0)).alias("v") if value is not None else F.lit(0.0).alias("v"),
        F.monotonically_increasing_id().alias("n"),
    )
    placed = rows.where("o is not null").repartitionByRange(partitions, "k", "o", "n").sortWithinPartitions("k", "o")
    states = placed.select("k", "o", "v").mapInPandas(_states, _STATE)
    unordered = rows.where("o is null").groupBy("k").agg(F.count("*").alias("rows"), F.sum("v").alias("total"))
    states = stacked(states, unordered, allow_missing=True)
    # a key has one state per partition it spans: the window sorts states, never rows
    before = F.lag("last_order").over(Window.partitionBy("k").orderBy(F.col("part").asc_nulls_last()))
    seam = F.col("first_order") - before
    stitched = states.select("*", seam.alias("seam"))
    return stitched.groupBy(F.col("k").alias("key")).agg(
        F.sum("rows").alias("n_rows"),
        (F.coalesce(F.sum("orders"), F.lit(0)) - F.count_if(F.col("seam") == 0)).alias("n_orders"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.greatest(F.max("max_gap"), F.max("seam")).alias("max_gap"),
        F.sum("total").alias("total"),
        F.count("*").alias("n_states"),
    )


def heavy_keys(per_key: DataFrame, share: float) -> DataFrame:
    """Keys, null excepted, that hold at least ``share`` of all rows; ``per_key`` is from :func:`ordered_by_key`.

    Adds ``share``. Null keys count in the whole. Without rows there are no heavy keys.
    """
    whole = per_key.agg(F.sum("n_rows").alias("all_rows"))
    with_share = per_key.crossJoin(F.broadcast(whole)).withColumn("share", F.col("n_rows") / F.col("all_rows"))
    return with_share.where(F.col("key").isNotNull() & (F.col("share") >= share)).drop("all_rows")

"""Mixing sources to target shares of the total size."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordonlake.session import bounded_pandas, materialize, stacked

#: The folder of public vocabularies; a parameter of every function that counts tokens.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the rank files, as their publisher gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ROUND = "doc string, source string, size long, copies int, p double, node long"


_ENCODERS: dict[str, object] = {}


def _encoder(name: str, ranks_file: bytes):
    """The tokenizer of a rank file, built once per Python worker."""
    import tiktoken

    if name not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def token_counts(df: DataFrame, text_col: str, keep: list, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The columns ``keep`` and ``size``, the tokens of each whole text; null and empty texts have 0.

    The rank file (about a megabyte) is read here and broadcast, so workers need no such file.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    name = os.path.basename(vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(name, shared.value).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return df.select(*keep, count(F.col(text_col)).alias("size"))


def _pair(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Pivotal rounding: 0 or 1 for every row but one at most, and that row (-1: none) with what is left of its share.

    Two rows with open shares exchange mass, weighted by size so that the sum of size times share stays, until one of
    the shares is 0 or 1. Which of the two ends is reached is drawn so that every share keeps its expectation.
    """
    out = np.zeros(len(p), np.int64)
    held, q = -1, 0.0
    for i in range(len(p)):
        x = p[i]
        if x <= 1e-12 or x >= 1 - 1e-12:
            out[i] = round(x)
            continue
        if held < 0:
            held, q = i, x
            continue
        a, b = size[held], size[i]
        up = min((1 - q) * a, x * b)  # mass that can go from i to the held row
        down = min(q * a, (1 - x) * b)  # and the other way
        move = up if draw[i] * (up + down) < down else -down
        q, x = q + move / a, x - move / b
        done_q = q <= 1e-9 or q >= 1 - 1e-9
        if done_q:
            out[held] = round(q)
            held = -1
        if x <= 1e-9 or x >= 1 - 1e-9:
            out[i] = round(x)
        elif held < 0:
            held, q = i, x
    return out, held, q


def _round_source(pdf: pd.DataFrame, node: int, seed: int) -> pd.DataFrame:
    draw = (pd.util.hash_array((pdf["doc"] + f"/{seed}").to_numpy()) >> np.uint64(11)) / float(1 << 53)
    done, held, q = _pair(pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64), draw)
    out = pd.DataFrame({"doc": pdf["doc"], "source": pdf["source"], "size": pdf["size"], "copies": pdf["copies"].to_numpy() + done, "p": np.nan, "node": np.int64(node)})
    if held >= 0:
        out.iloc[held, out.columns.get_loc("p")] = q
    return out


def _merge(seed: int):
    """Rounds the shares that the partitions of one group left open."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _round_source(pdf.sort_values("doc"), int(pdf["node"].iloc[0]), seed)

    return merge


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", fan_in: int = 64, max_targets: int = 10_000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Copies of each document so that every source has its target share of a mix as large as the whole input.

    Method: a source whose documents must be used f times on average gives each of them the whole part of f and the
    rest as a share. Shares are rounded by pivotal dependent rounding: pairs of documents exchange mass, weighted by their
    size, until one of them is used once more or not. A partition leaves one open document per source at most; these are
    combined by rounds of groups of ``fan_in`` partitions, up to one per source, which is drawn. A source misses its
    target by less than one document.

    Args:
        docs: further columns are ignored. Sizes are tokens of the whole text; null and empty texts have none and are
            used as often as the rest of their source. Documents without a source count in the whole only.
        targets: ``source, weight, max_repeats``, ``max_targets`` rows at most, each source once.

    Returns:
        ``(doc_id, source, size, copies)`` of the documents of the sources of ``targets``;
        ``(source, weight, max_repeats, own_size, target_size, largest, mixed_size, mixed_rows, short_by, reachable, actual_share)`` with
        one row per target. ``short_by`` is what the finished mix lacks to the target. ``reachable`` is false for a source that the capped rounding
        used up, every document ``max_repeats`` times, and left short of its target; one without documents is short of any target above 0.
        ``actual_share`` is null if the mix is empty.
    """
    spark = docs.sparkSession
    sized = token_counts(docs.select(F.col(id_col).cast("string").alias("doc"), F.col(source_col).alias("source"), text_col), text_col, ["doc", "source"], vocabulary)
    sized = materialize(sized, "sizes")
    wanted = targets.select("source", F.col("weight").cast("double"), F.col("max_repeats").cast("int")).where("source is not null")
    wanted = spark.createDataFrame(bounded_pandas(wanted, max_targets, "mix targets"), "source string, weight double, max_repeats int")
    own = sized.groupBy("source").agg(F.sum("size").alias("own_size"))
    whole = own.agg(F.coalesce(F.sum("own_size"), F.lit(0)).alias("whole"))
    plan = wanted.join(own, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "weight", "max_repeats", F.coalesce("own_size", F.lit(0)).alias("own_size"), (F.col("weight") * F.col("whole")).alias("target_size")
    )
    # one row per target, so the plan is as small as the targets are
    plan = spark.createDataFrame(bounded_pandas(plan, max_targets, "mix targets"), "source string, weight double, max_repeats int, own_size long, target_size double")
    times = F.when(F.col("own_size") > 0, F.least(F.col("target_size") / F.col("own_size"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    shares = sized.join(F.broadcast(plan.select("source", times.alias("times"))), "source").select(
        "doc", "source", "size", F.floor("times").cast("int").alias("copies"), F.when(F.col("size") > 0, F.col("times") - F.floor("times")).otherwise(0.0).alias("p")
    )

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rounds the shares of one partition; the open document of a source goes along from batch to batch."""
        node = TaskContext.get().partitionId()
        open_rows: dict[str, pd.DataFrame] = {}
        for pdf in batches:
            for source, part in pdf.groupby("source", sort=False):
                out = _round_source(pd.concat([open_rows.pop(source), part]) if source in open_rows else part, node, seed)
                waits = out["p"].notna()
                if waits.any():
                    open_rows[source] = out[waits]
                yield out[~waits]
        yield from open_rows.values()

    level = materialize(shares.mapInPandas(leaves, _ROUND), "rounded")
    done, waiting = level.where("p is null"), level.where("p is not null")
    nodes = (level.agg(F.max("node")).first()[0] or 0) + 1
    depth = 0
    while nodes > 1:
        nodes, depth = math.ceil(nodes / fan_in), depth + 1
        level = waiting.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("source", "node").applyInPandas(_merge(seed + depth), _ROUND)
        level = materialize(level, "rounded")
        done, waiting = stacked(done, level.where("p is null")), level.where("p is not null")
    last = waiting.withColumn("copies", F.col("copies") + (F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col("p")).cast("int"))
    copies = stacked(done, last).select(F.col("doc").alias("doc_id"), "source", "size", "copies")
    got = copies.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("mixed_size"), F.sum(F.col("copies").cast("long")).alias("mixed_rows"), F.max("size").alias("largest"), F.min(F.when(F.col("size") > 0, F.col("copies"))).alias("least_used")
    )
    report = plan.join(F.broadcast(got), "source", "left").fillna({"mixed_size": 0, "mixed_rows": 0})
    mixed = got.agg(F.sum("mixed_size").alias("mixed_whole"))
    # what the mix itself shows: a source is out of reach if no document with any size can be used once more and the target is not met
    used_up = F.coalesce(F.col("least_used") >= F.col("max_repeats"), F.lit(True))
    short = F.greatest(F.lit(0.0), F.col("target_size") - F.col("mixed_size"))
    report = report.withColumn("short_by", short).withColumn("reachable", ~(used_up & (F.col("short_by") > 1e-6 * F.col("target_size"))))
    report = report.crossJoin(F.broadcast(mixed)).withColumn("actual_share", F.try_divide(F.col("mixed_size").cast("double"), F.col("mixed_whole").cast("double"))).drop("mixed_whole", "least_used")
    return copies, report

"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets target / source size expected copies. The whole part is kept as it is; the fractions are rounded by
the pivotal method: two open fractions meet, mass moves from one to the other until one of them is whole, and the other
stays open for the next meeting. Mass is measured in words, so a source's words are kept to within its last open
document, and each step is a fair game, so every document keeps its expected number of copies. The meetings form a
reduction tree: each (source, bucket) of documents leaves at most one open row, then FAN of those meet, and so on.

Cases: a null text has 0 words and is taken 0 times; an empty table gives an empty result; a source without words gets
target 0; rows that repeat are rows of their own, told apart by a number among equals, so that they are spread over leaves;
reruns agree, as buckets, order and draws depend on values only; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, number_among_equals, numbered, words_of

#: Rows that meet in one leaf, open rows that meet in one inner node of the tree.
LEAF_ROWS, FAN = 1_000, 4_096
#: Equal rows that one task writes out.
EQUALS = 10_000
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds target: `share` of all words by weight, at most `most` times
    the source's size; what is cut off goes to the others by weight, until none is above. Works on the table of sources."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    limit = F.lit(float(most)) * F.col("source_size")
    # The capped sources come first in the order of limit / weight; the level is set by the first that isn't capped.
    order = W.orderBy("ratio", "rank")
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("total") * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    filled = (
        ranked.withColumn("w", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy(F.lit(0))).cast("double"))
        .withColumn("level", level)
        .withColumn("open", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(W.partitionBy(F.lit(0)))["level"])
    )
    target = F.when(F.col("ratio") > F.col("open"), F.col("open") * F.col("w")).otherwise(F.col("limit"))
    return filled.select("source", "source_size", target.cast("double").alias("target"))


def _meet(size: np.ndarray, part: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of the fractions `part` of rows of `size` words, in order. Returns the rounded fractions and the
    index of the row that stays open (-1: none)."""
    out, open_at = part.tolist(), -1
    sizes, coin = size.tolist(), draws.tolist()
    for i, p in enumerate(out):
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[i] = float(round(p))
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b, q = sizes[open_at], sizes[i], out[open_at]
        up = min((1 - q) * a, p * b)  # words that the open row can gain from row i
        down = min(q * a, (1 - p) * b)  # words that it can give to row i
        moved = up if coin[i] * (up + down) < down else -down
        q, p = q + moved / a, p - moved / b
        q_whole, p_whole = q <= 1e-12 or q >= 1 - 1e-12, p <= 1e-12 or p >= 1 - 1e-12
        out[open_at] = float(round(q)) if q_whole else q
        out[i] = float(round(p)) if p_whole else p
        open_at = i if q_whole and not p_whole else -1 if q_whole else open_at
    return np.array(out), open_at


def _round_group(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size", "row"], kind="stable", na_position="last").reset_index(drop=True)
        rng = np.random.Generator(np.random.PCG64([seed, int(pdf["node_seed"].iloc[0]) & (2**63 - 1)]))
        done, open_at = _meet(pdf["size"].to_numpy(), pdf["part"].to_numpy(), rng.random(len(pdf)))
        if last and open_at >= 0:
            done[open_at] = float(rng.random() < done[open_at])
            open_at = -1
        pdf["part"], pdf["open"] = done, np.arange(len(pdf)) == open_at
        return pdf

    return run


def _numbered_equals(sized: DataFrame) -> DataFrame:
    """Adds row: a number among rows that agree in all columns."""
    groups = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("n"))
    few = groups.where(F.col("n") <= EQUALS).withColumn("first", F.lit(0).cast("long"))
    many = groups.where(F.col("n") > EQUALS).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUALS).cast("long")))).repartition("first")
    each = F.explode(F.sequence("first", F.least(F.col("first") + EQUALS, F.col("n")) - 1))
    return few.unionByName(many).withColumn("row", each).select(*sized.columns, "row")


def mix(spark: SparkSession, docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, row: str | None = None, by: str | None = None, size: str | None = None) -> DataFrame:
    """docs: doc_id, text, source. Returns doc_id, source, size, source_size, target, copies, taken for every row; and `row`,
    if it names a column of longs that tells rows apart; draws then depend on `by`, a column of longs made of what the rows hold. size: a column
    of sizes, where they are known, in place of text."""
    scratch = Scratch(spark, "mix")
    sized = docs.select("doc_id", "source", (F.col(size) if size else words_of(F.col("text"))).alias("size"), *([F.col(row).alias("row"), F.col(by or row).alias("by")] if row else []))
    sized = sized if row else _numbered_equals(sized)
    sized = scratch.save(sized.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size", "by" if row else "row")).drop("by"), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    leaves = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("rows") / LEAF_ROWS)))).cast("long")
    targets = source_targets(sizes, weights, share, most).alias("t").join(sizes.select(F.col("source").alias("s"), leaves.alias("leaves")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = scratch.save(targets, "targets")  # one row for each source
    t = targets.withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sized.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("part", F.col("rate") - F.col("whole"))
        .withColumn("bucket", F.pmod(F.xxhash64("order"), F.col("leaves")))
        .withColumn("open", F.col("part") > 0)
        .select("doc_id", "source", "size", "source_size", "target", "whole", "part", "order", "row", "bucket", "leaves", "open")
    )
    most_leaves = targets.agg(F.max("leaves")).first()[0] or 1
    level, done = 0, []
    current = rows.where("open")
    done.append(rows.where("not open"))
    while True:
        last = most_leaves <= 1
        keyed = current.withColumn("node_seed", F.xxhash64(F.lit(level), "source", "bucket"))
        schema = keyed.schema
        met = scratch.save(keyed.groupBy("source", "bucket").applyInPandas(_round_group(seed + level, last), schema), f"level{level}").drop("node_seed")
        done.append(met.where("not open"))
        if last:
            break
        most_leaves = -(-most_leaves // FAN)
        level += 1
        current = met.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.round("part").cast("long")).alias("copies")
    columns = ["doc_id", "source", "size", "source_size", "target", copies, *([F.col("row").alias(row)] if row else [])]
    out = scratch.save(out.select(*columns).withColumn("taken", F.col("copies") * F.col("size")), "out")
    scratch.keep("out")
    return out


def materialise(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as mix() takes it; rows with equal ids are told apart."""
    scratch, row = Scratch(spark, "mix"), "__mix_row"
    hashed = docs.withColumns({"__mix_a": F.xxhash64(*docs.columns), "__mix_b": F.hash(*docs.columns), "__mix_size": words_of(F.col("text"))})
    rows = numbered(scratch, hashed, row)
    told = number_among_equals(rows.select(row, "doc_id", "source", "__mix_size", "__mix_a", "__mix_b"), ["__mix_a", "__mix_b"], "__mix_k").withColumn("__mix_by", F.xxhash64("__mix_a", "__mix_b", "__mix_k"))
    n = mix(spark, told, row=row, by="__mix_by", size="__mix_size", **options).where("copies > 0").select(F.col(row).alias("__mix_at"), F.col("copies").cast("int").alias("__mix_n"))
    kept = rows.join(n, F.col(row) == F.col("__mix_at")).withColumn("__mix_k", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
    return kept.select(*docs.columns)

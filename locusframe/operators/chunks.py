"""Chunk statistics of records and what they allow a predicate to skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import variant as v
from locusframe.plans import predicate as p


def chunk_stats(df: DataFrame, records: int = 8192, info_keys: tuple[str, ...] = ("DP", "AF")) -> DataFrame:
    """(chunk, first_record, record_count, bounds and sets) for every ``records`` records by ord, which counts from 0.

    For every INFO key: bounds over all numeric elements, and whether every element present was a finite number
    (``_complete``); bounds are doubles, so a value such as 12.5 is never outside them.  A column ``place`` of df gives
    the place in its file where a chunk starts.
    """
    qual = v.number(F.when(v.present(F.col("qual")), F.col("qual")))
    columns = [F.floor(F.col("ord") / records).cast("bigint").alias("chunk"), "ord", "chrom", "pos", qual.alias("qual"), "filter"]
    out = [
        F.min("ord").alias("first_record"), F.count(F.lit(1)).alias("record_count"), F.sort_array(F.collect_set("chrom")).alias("chroms"), F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"),
        F.min("qual").alias("qual_min"), F.max("qual").alias("qual_max"), F.sort_array(F.collect_set("filter")).alias("filters"),
    ]
    for k in info_keys:
        raw = v.info_value(F.col("info"), k)
        columns += [v.numbers(raw).alias(f"n_{k}"), F.exists(v.vector(raw), lambda x: v.present(x) & v.number(x).isNull()).alias(f"odd_{k}")]
        out += [F.min(F.array_min(f"n_{k}")).alias(f"{k}_min"), F.max(F.array_max(f"n_{k}")).alias(f"{k}_max"), F.coalesce(~F.bool_or(f"odd_{k}"), F.lit(True)).alias(f"{k}_complete")]
    if "place" in df.columns:
        columns.append("place")
        out.append(F.min("place").alias("place"))
    if "format" in df.columns:
        columns.append(F.split("format", ":").alias("keys"))
        out.append(F.sort_array(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("format_keys"))
    return df.select(*columns).groupBy("chunk").agg(*out)


def _bounds(low: Column, high: Column, op: str, x: float) -> Column:
    """Whether no value between low and high can satisfy ``value op x``; no values at all satisfy nothing."""
    x = F.lit(float(x))
    none = {">": high <= x, ">=": high < x, "<": low >= x, "<=": low > x, "==": (x < low) | (x > high), "!=": (low == x) & (high == x)}[op]
    # a NaN bound means values beyond ordering were seen
    return F.when(low.isNull(), True).when(F.isnan(low) | F.isnan(high), False).otherwise(none)


def _no_text(values: Column, op: str, text: str) -> Column:
    return ~F.array_contains(values, text) if op == "==" else F.forall(values, lambda x: x == text)


def can_skip(tree, columns: list[str]) -> Column:
    """Whether a chunk of chunk_stats holds no record that satisfies the tree. False whenever in doubt."""
    if isinstance(tree, p.Both):
        return can_skip(tree.left, columns) | can_skip(tree.right, columns)
    if isinstance(tree, p.Either):
        return can_skip(tree.left, columns) & can_skip(tree.right, columns)
    test = tree if isinstance(tree, p.Test) else tree.test
    f, text = test.field, isinstance(test.literal, str)
    if f.kind == "format":
        if "format_keys" not in columns:
            return F.lit(False)
        absent = ~F.array_contains("format_keys", f.key)
        # without the key nobody passes: zero passing samples may be what is asked for
        return absent & ~p.compare(F.lit(0.0), tree.op, tree.literal) if isinstance(tree, p.Passing) else absent
    if f.kind in ("chrom", "filter"):
        return _no_text(F.col({"chrom": "chroms", "filter": "filters"}[f.kind]), test.op, test.literal) if text and test.op in ("==", "!=") else F.lit(True)
    if text:
        return F.lit(f.kind != "info")
    if f.kind == "info":
        if f.index is not None or f"{f.key}_min" not in columns:
            return F.lit(False)
        return F.col(f"{f.key}_complete") & _bounds(F.col(f"{f.key}_min"), F.col(f"{f.key}_max"), test.op, test.literal)
    return _bounds(F.col(f"{f.kind}_min").cast("double"), F.col(f"{f.kind}_max").cast("double"), test.op, test.literal)


def plan(stats: DataFrame, where: str) -> DataFrame:
    """(chunk, record_count, skip) of a predicate."""
    return stats.select("chunk", "record_count", can_skip(p.parse(where), stats.columns).alias("skip"))


def skip_report(stats: DataFrame, where: str) -> dict[str, float]:
    """Totals of a plan: chunks, skipped chunks, and their share."""
    row = plan(stats, where).agg(F.count(F.lit(1)).alias("n"), F.count_if("skip").alias("s")).first()
    return {"chunks_total": row["n"], "chunks_skipped": row["s"], "skip_rate": row["s"] / row["n"] if row["n"] else 0.0}


def pruned_filter(df: DataFrame, stats: DataFrame, where: str, records: int = 8192, min_skip_rate: float = 0.8) -> DataFrame:
    """filter_sites over the chunks that a plan leaves, if it skips enough of them; the same rows in any case.

    The chunks to read are a semi join on the chunk number; only their numbers travel.
    """
    whole = df.where(p.compile_text(where))
    if skip_report(stats, where)["skip_rate"] < min_skip_rate:
        return whole
    kept = plan(stats, where).where(~F.col("skip")).select("chunk")
    return df.withColumn("chunk", F.floor(F.col("ord") / records).cast("bigint")).join(kept, "chunk", "left_semi").drop("chunk").where(p.compile_text(where))

"""Chunk index beside a file: JSON with a checksum, valid as long as the file is what it was."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import chunks
from locusframe.plans import predicate as p
from locusframe.sources import ranges, vcf

VERSION, KIND = 1, "locusframe-chunks"


def _identity(path: str) -> dict[str, object]:
    s = os.stat(path)
    return {"path": os.path.abspath(path), "size_bytes": s.st_size, "modified_ns": s.st_mtime_ns, "changed_ns": s.st_ctime_ns}


def _checksum(body: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in body.items() if k != "sha256"}, sort_keys=True).encode()).hexdigest()


def with_ordinals(df: DataFrame, together: int = 100_000) -> DataFrame:
    """df with ord counting 0, 1, 2 … in file order: numbers inside a span of ord plus the count of rows before the span.

    Spans are cut by arithmetic on ord, about ``together`` rows each. Sampled range partitions would not do: their bounds
    and numbers differ between the run that counts them and the one that reads them.
    """
    from pyspark.sql import Window

    low, high, n = df.agg(F.min("ord"), F.max("ord"), F.count(F.lit(1))).first()
    if not n:
        return df
    spans = max(1, -(-n // together))
    width = (high - low) // spans + 1
    span = F.expr(f"cast((ord - {low}L) div {width}L as int)")
    counts, starts = {r["span"]: r["count"] for r in df.select(span.alias("span")).groupBy("span").count().collect()} if spans > 1 else {}, [0]
    for i in range(spans - 1):
        starts.append(starts[-1] + counts.get(i, 0))
    start = F.get(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), F.col("span"))  # a constant, whatever its length
    return df.withColumn("span", span).withColumn("ord", (F.row_number().over(Window.partitionBy("span").orderBy("ord")) - 1 + start).cast("bigint")).drop("span")


def records_by_place(spark: SparkSession, source: str) -> DataFrame | None:
    """The records of a plain or block-gzip file with the place of each; None for a file that cannot be read by places."""
    if source.endswith(".bcf") or not ranges.served(spark, source) or (source.endswith(".gz") and not ranges.is_blocked(spark, source)):
        return None
    return vcf.read_vcf(spark, source, by_place=True).withColumn("place", F.col("ord"))


def build(df: DataFrame, source: str, out: str, records: int = 8192, info_keys: tuple[str, ...] = ("DP", "AF")) -> dict:
    """Index a file's records and write the JSON. From ``records_by_place`` it also says where in the file chunks start."""
    stats = chunks.chunk_stats(with_ordinals(df), records, info_keys).orderBy("chunk")
    rows = [r.asDict(True) for r in stats.toLocalIterator()]
    body = {"version": VERSION, "kind": KIND, "source": _identity(source), "chunk_records": records, "record_count": sum(r["record_count"] for r in rows), "info_keys": list(info_keys), "chunks": rows}
    body["sha256"] = _checksum(body)
    with open(out, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2, sort_keys=True)
    return body


def load(path: str, source: str) -> dict | None:
    """The index if it is sound and belongs to the file as it is now; None otherwise."""
    try:
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
    except (OSError, ValueError):
        return None
    numbers = [c.get("chunk") for c in body.get("chunks", [])]
    sound = body.get("version") == VERSION and body.get("kind") == KIND and body.get("sha256") == _checksum(body) and numbers == list(range(len(numbers)))
    return body if sound and body["source"] == _identity(source) else None


def stats_frame(spark: SparkSession, body: dict) -> DataFrame:
    """The chunk rows of an index as chunk_stats gives them."""
    like = {"chunk": "bigint", "first_record": "bigint", "record_count": "bigint", "chroms": "array<string>", "pos_min": "bigint", "pos_max": "bigint", "qual_min": "double", "qual_max": "double", "filters": "array<string>"}
    for k in body["info_keys"]:
        like |= {f"{k}_min": "double", f"{k}_max": "double", f"{k}_complete": "boolean"}
    if body["chunks"] and "place" in body["chunks"][0]:
        like["place"] = "bigint"
    if body["chunks"] and "format_keys" in body["chunks"][0]:
        like["format_keys"] = "array<string>"
    rows: Iterator[tuple] = [tuple(c.get(k) for k in like) for c in body["chunks"]]
    return spark.createDataFrame(rows, ", ".join(f"`{k}` {t}" for k, t in like.items()))


def _places(rows: list[dict], kept: set[int], together: int = 64) -> list[tuple[int, int | None]]:
    """Ranges of the file that hold the kept chunks; at most ``together`` neighbours are one range."""
    starts = [r["place"] for r in rows] + [None]
    out: list[tuple[int, int | None]] = []
    run = 0
    for i in sorted(kept):
        joined = bool(out) and run < together and out[-1][1] == starts[i]
        run = run + 1 if joined else 1
        out[-1:] = [(out[-1][0], starts[i + 1])] if joined else [*out[-1:], (starts[i], starts[i + 1])]
    return out


def indexed_filter(df: DataFrame, index_path: str, source: str, where: str, *, sample_names: list[str] | None = None, sample: str | None = None, min_skip_rate: float = 0.8, enabled: bool = True) -> tuple[DataFrame, dict]:
    """The filtered records and a report. Without a valid index, or if it would skip too little, a full scan.

    An index with places reads only the kept chunks of the file; the report has the places. One without (BCF, other gzip)
    saves no reading."""
    body = load(index_path, source) if enabled else None
    condition = p.compile_text(where, sample_names, sample)
    if body is None:
        return df.where(condition), {"used": False, "reason": "no valid index"}
    stats = stats_frame(df.sparkSession, body)
    report = chunks.skip_report(stats, where)
    if report["skip_rate"] < min_skip_rate:
        return df.where(condition), report | {"used": False, "reason": "skips too little"}
    kept = chunks.plan(stats, where).where(~F.col("skip")).select("chunk")
    if "place" in stats.columns:
        places = _places(body["chunks"], {r["chunk"] for r in kept.collect()})
        return vcf.read_vcf(df.sparkSession, source, places=places).where(condition), report | {"used": True, "places": places}
    out = with_ordinals(df).withColumn("chunk", F.floor(F.col("ord") / body["chunk_records"]).cast("bigint")).join(F.broadcast(kept) if len(body["chunks"]) <= 100_000 else kept, "chunk", "left_semi").drop("chunk")
    return out.where(condition), report | {"used": True}

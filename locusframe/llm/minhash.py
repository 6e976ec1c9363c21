"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

Plan
1. One pass over the texts (Arrow batches, numpy) gives per row the number of distinct shingles, a 128-bit
   hash of the whole set and the band keys of its SuperMinHash signature.  No text is shuffled.
2. Rows with equal sets form a class; from here on one row stands for a class, so any number of exact copies
   costs one aggregation that is combined before its shuffle.
3. Classes that share a band key are linked to the least class of the key (a star, never all pairs); connected
   components of these unverified links are the candidate clusters.
4. The texts of the clustered classes only are read again; each class's exact shingle set goes to its cluster
   once, together with a few anchors in clusters of several blocks.  A block's task counts all intersections
   exactly by matrix products and returns a spanning forest of the links at or above the threshold.
5. Clusters of several blocks whose blocks and anchors did not join up everything compare the classes outside
   the largest component with all others, block by block, so no link is lost at any cluster size.
6. Components of the verified links, by class, joined back to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm import wordhash as wh
from locusframe.llm.components import connected, with_value
from locusframe.llm.scratch import Scratch

#: Classes and shingles that one block of a cluster holds at most (a single larger set is a block of its own).
BLOCK_CLASSES, BLOCK_SHINGLES, ANCHORS = 512, 400_000, 64
#: Clustered classes up to which their ids are broadcast to pick texts (16 MB); beyond, a shuffle join does it.
BROADCAST_CLASSES = 400_000


def banding(threshold: float, miss: float = 2e-5, max_slots: int = 192) -> tuple[int, int]:
    """(bands, rows): the most selective banding that misses a pair at the threshold with chance ``miss`` at most."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands * rows <= max_slots:
            return bands, rows
    return max_slots, 1


def _binary16(high: np.ndarray, low: np.ndarray) -> pa.Array:
    raw = np.empty((len(high), 2), dtype=">u8")
    raw[:, 0], raw[:, 1] = high, low
    offsets = np.arange(len(high) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _set_hash(doc: np.ndarray, element: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each document's set."""
    size = np.bincount(doc, minlength=n_docs)
    high, low = np.zeros(n_docs, wh.U), np.zeros(n_docs, wh.U)
    if len(element):
        has = np.flatnonzero(size)
        heads = np.searchsorted(doc, has)
        high[has] = np.add.reduceat(wh.mix(element ^ wh.U(0x1234567)), heads)
        low[has] = np.add.reduceat(wh.mix(element ^ wh.U(0x89ABCDEF01)), heads)
    return size, wh.mix(high + size.astype(wh.U)), low


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in wh.text_slices(batch.column(1)):
                _, _, hashes, per_doc = wh.words_of(data, offsets)
                doc, element = wh.shingles_of(hashes, per_doc, k)
                n = end - at
                size, high, low = _set_hash(doc, element, n)
                keys = wh.band_keys(wh.super_minhash(doc, element, n, bands * rows), bands).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], pa.array(size.astype(np.int64)), _binary16(high, low), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, keys.reshape(-1)), batch.column(2)[at:end]], ["id", "n", "cls", "keys", "text_key"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in wh.text_slices(batch.column(0)):
                _, _, hashes, per_doc = wh.words_of(data, offsets)
                doc, element = wh.shingles_of(hashes, per_doc, k)
                n = end - at
                size, high, low = _set_hash(doc, element, n)
                heads = np.zeros(n + 1, np.int32)
                np.cumsum(size, out=heads[1:])
                yield pa.RecordBatch.from_arrays([batch.column(1)[at:end], _binary16(high, low), pa.ListArray.from_arrays(heads, element.view(np.int64))], ["cls", "found", "shingles"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all pairwise intersections of sorted distinct arrays, by products of 0/1 column chunks."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), sizes)
    value = np.concatenate(sets) if n else np.zeros(0, np.int64)
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    out = np.zeros((n, n), np.float64)
    width = max(64, min(8192, 8_000_000 // max(n, 1)))
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    np.fill_diagonal(out, sizes)
    return out.astype(np.int64)


def _forest(linked: np.ndarray) -> np.ndarray:
    """The least reachable position of each node of a symmetric boolean matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            front = np.array([i])
            while len(front):
                reach = linked[front].any(axis=0) & (root < 0)
                front = np.flatnonzero(reach)
                root[front] = i
    return root


def _links(num: int, den: int):
    """A spanning forest of the links among the sets of one task, as pairs (class, least class it reaches here)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cls").sort_values("cls", ignore_index=True)
        sets = [np.asarray(s, dtype=np.int64) for s in pdf["shingles"]]
        inter = intersections(sets)
        sizes = np.diag(inter)
        linked = den * inter >= num * (sizes[:, None] + sizes[None, :] - inter)
        root = _forest(linked)
        other = root != np.arange(len(root))
        name = pdf["cls"].to_numpy()
        return pd.DataFrame({"a": name[other], "b": name[root[other]]})

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100), name: str = "near") -> DataFrame:
    """(id, n_shingles, component_id, kept, text_key): groups of documents whose k-word shingle sets are alike.

    Words are runs of anything but ASCII white space, A-Z lowered.  Two documents are linked if
    ``den * intersection >= num * union``; ``component_id`` is the least id reachable, ``kept`` whether the
    row's id equals it.  A null or wordless text has no shingles, is linked with nothing and is kept.  A text of
    fewer than k words is one shingle.  Every input row gives one row; rows that repeat an id are nodes of their
    own (equal texts then share a component).  A null id is ignored by the minimum; it is kept only if its whole
    group has null ids.  Other columns play no part.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    num, den = threshold
    bands, rows = banding(num / den)
    scratch = Scratch(spark, name)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"))
    id_type = text.schema["id"].dataType.simpleString()
    row = scratch.cut(text.mapInArrow(_sketch(k, bands, rows), f"id {id_type}, n bigint, cls binary, keys array<bigint>, text_key bigint"), "rows")
    classes = row.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.coalesce(F.min_by("text_key", "id"), F.min("text_key")).alias("rep_key"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("n").alias("n"))

    member = classes.select("cls", F.explode("keys").alias("key"))
    centre = member.groupBy("key").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("g")).where("g > 1")
    star = with_value(member, "key", scratch.cut(centre, "centres"), "g").where("b is not null").select(F.col("cls").alias("a"), "b").distinct()
    cluster = connected(star, scratch, "candidates")
    sized = scratch.cut(classes.join(cluster.withColumnRenamed("node", "cls"), "cls").select("cls", "rep", "rep_key", "n", "root"), "clustered")
    blocks = sized.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    blocks = blocks.select("root", "members", F.greatest(F.ceil(F.col("members") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    sized = sized.join(blocks, "root")

    wanted = sized.select(F.col("cls").alias("want"), "rep", "rep_key")
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    found = text.join(wanted, text["id"].eqNullSafe(wanted["rep"]) & (text["text_key"] == wanted["rep_key"])).select("text", "want")
    found = found.mapInArrow(_sets(k), "cls binary, found binary, shingles array<bigint>").where("cls = found").select("cls", "shingles").dropDuplicates(["cls"])
    member = scratch.cut(found.join(sized, "cls").select("cls", "shingles", "n", "root", "nb", "members", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int").alias("block")), "sets")

    # about ANCHORS members of a cluster of several blocks go to each of its blocks, to join the blocks up
    chosen = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("members")) < ANCHORS
    anchors = member.where("nb > 1").where(chosen & (F.col("n") <= 4096)).select("root", "cls", "shingles", F.explode(F.expr("sequence(0, nb - 1)")).alias("block"))
    task = member.select("root", "block", "cls", "shingles").unionByName(anchors.select("root", "block", "cls", "shingles"))
    first = scratch.cut(task.groupBy("root", "block").applyInPandas(_links(num, den), "a binary, b binary"), "links")

    links = first
    if not member.where("nb > 1").limit(1).isEmpty():
        so_far = connected(first, scratch, "joined").withColumnRenamed("node", "cls").withColumnRenamed("root", "comp")
        split = member.where("nb > 1").join(so_far, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        split = scratch.cut(split, "split")
        count = split.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
        main = count.groupBy("root").agg(F.max(F.struct("c", "t", "comp")).alias("top"), F.sum("c").alias("all_c"), F.sum("t").alias("all_t"))
        size = lambda c, t: F.greatest(F.ceil(c / (BLOCK_CLASSES // 2)), F.ceil(t / (BLOCK_SHINGLES // 2))).cast("int")
        main = main.where(F.col("all_c") > F.col("top.c")).select("root", F.col("top.comp").alias("main"), size(F.col("top.c"), F.col("top.t")).alias("n_main"), size(F.col("all_c") - F.col("top.c"), F.col("all_t") - F.col("top.t")).alias("n_rest"))
        split = split.join(main, "root").withColumn("is_main", F.col("comp") == F.col("main"))
        split = split.withColumn("at", F.pmod(F.xxhash64("cls"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
        tasks = F.when(F.col("is_main"), F.expr("transform(sequence(0, n_rest - 1), s -> struct(s as s, at as t, true as m))")).otherwise(
            F.expr("concat(transform(sequence(0, n_main - 1), t -> struct(at as s, t as t, true as m)), transform(sequence(0, n_rest - 1), t -> struct(least(at, t) as s, greatest(at, t) as t, false as m)))")
        )
        split = split.select("root", "cls", "shingles", F.explode(tasks).alias("task"))
        rest = split.groupBy("root", "task").applyInPandas(_links(num, den), "a binary, b binary")
        links = scratch.cut(first.unionByName(rest), "all-links")

    linked = connected(links, scratch, "groups").withColumnRenamed("node", "cls")
    linked = linked.join(classes.select("cls", "rep"), "cls")
    group = linked.groupBy("root").agg(F.min("rep").alias("component"))
    label = linked.join(group, "root").select("cls", "component")
    label = classes.where("copies > 1").select("cls", "rep").join(label, "cls", "full").select("cls", F.coalesce("component", "rep").alias("component"))
    label = scratch.cut(label, "labels")
    out = row.select("id", "n", "cls", "text_key").join(label, "cls", "left")
    component = F.when((F.col("n") > 0) & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_key")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs that stay when one document of each group does: the one with the least id.

    All columns are returned.  Rows with the same id and the same text count as one document and are reduced to
    one; documents without words stay.  A row goes by its id and its text's hash, so an id that repeats with
    another text is judged by itself.  Texts of any length are read whole; what the columns are called plays no part; of a
    group whose least id stands in several rows with different texts all of those stay; an empty table gives none.
    """
    result = near_duplicates(docs, id_col=id_col, text_col=text_col, k=k, threshold=threshold, name="keep")
    result = result.select(F.col(id_col).alias("gone_id"), F.col("text_key").alias("gone_key"), "kept")
    gone = result.where(~F.col("kept")).drop("kept").distinct()
    # the texts are dealt anew only where an id and a text repeat
    repeated = not result.where("kept").groupBy("gone_id", "gone_key").count().where("count > 1").limit(1).isEmpty()
    once = docs.dropDuplicates([id_col, text_col]) if repeated else docs
    once = once.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # a few bytes for each row that goes; the texts stay where they are unless those outgrow a broadcast
    if gone.count() <= BROADCAST_CLASSES:
        gone = F.broadcast(gone)
    same = F.col(f"row.`{id_col}`").eqNullSafe(F.col("gone_id")) & F.xxhash64(F.col(f"row.`{text_col}`").cast("string")).eqNullSafe(F.col("gone_key"))
    return once.join(gone, same, "left_anti").select("row.*")

"""Mixing sources to target weights by index: blocks, quotas, shard draws and index permutations.

The words of each source, its documents one after the other in a fixed pseudorandom order, are packed into blocks
of equal length.  A source's target gives its number of slots; every slot is drawn to an output shard, so the counts of a
shard's sources are a multinomial draw given the quotas.  Slot i maps to a block through a pseudorandom permutation of
the source's block numbers, one permutation for each turn through the source; blocks are joined to documents by
index.  The mix is what the shards hold: a row of ``mix_blocks`` for each part of a document in each slot, and all other
results are sums over it or are laid out by it.  Nothing about a source is gathered in one place: offsets are sums over
hashed chunks, and slots are made in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.scratch import Scratch
from locusframe.llm.wordhash import U, mix

#: Words in a block, slots in an output shard, least documents in a chunk of offsets, slots made by one row.
BLOCK_WORDS, SHARD_SLOTS, CHUNK_DOCS, PIECE = 64, 8192, 256, 1 << 16
#: Sources up to which the table of sources is broadcast (some 60 bytes each); beyond, it is shuffled.
BROADCAST_SOURCES = 100_000
WORD = "[^\\x20\\x09-\\x0D]+"


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at i: a four-round Feistel network, walked until it falls below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = U((1 << half) - 1)
    x = i.astype(U)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> U(half), x[todo] & low
        for r in range(4):
            f = mix(right + U((key * 4 + r) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & low
            left, right = right, left ^ f
        x[todo] = (left << U(half)) | right
        todo = x >= U(n)
    return x.astype(np.int64)


def slots_of(source: int, n: int, lo: int, hi: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, turn, block) of the slots lo..hi of a source of n blocks."""
    i = np.arange(lo, hi, dtype=np.int64)
    turn, block = i // n, np.empty(len(i), np.int64)
    for t in range(int(lo // n), int((hi - 1) // n) + 1):
        block[turn == t] = permute(i[turn == t] % n, n, (seed << 40) + (source << 8) + t)
    draw = mix(i.astype(U) + mix(np.full(1, (seed << 40) + source, dtype=U)))
    return (draw % U(shards)).astype(np.int64), turn, block


def _slots(seed: int, shards: int):
    """Pieces of slot numbers to (source_no, shard, turn, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, n, lo, hi in zip(*(batch.column(c).to_pylist() for c in range(4))):
                shard, turn, block = slots_of(source, n, lo, hi, shards, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), source, np.int64)), pa.array(shard), pa.array(turn.astype(np.int32)), pa.array(block)], ["source_no", "shard", "turn", "block"])

    return run


def sources_of(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], budget: tuple[int, int], cap: int) -> DataFrame:
    """(source, source_no, source_size, docs, target): numbers by code point, null last; targets as in mix."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    parts = max(1, min(64, by.sparkSession.sparkContext.defaultParallelism))
    by = scratch.cut(by.repartitionByRange(parts, F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()), "sources")
    before, starts = 0, {}
    for p, c in sorted((r["part"], r["count"]) for r in by.groupBy("part").count().collect()):  # one row a partition
        starts[p] = before
        before += c
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    offset = F.create_map(*[F.lit(x) for p in starts.items() for x in p])[F.col("part")] if starts else F.lit(0)
    by = by.withColumn("source_no", (local + offset).cast("bigint"))
    by = scratch.cut(by.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights)).cast("int"))).drop("part"), "numbered")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    goal, level, capped = total * budget[0] / budget[1], 0.0, -1
    while True:  # each round caps more sources; a handful of rounds, one aggregation each
        full = F.lit(True) if capped >= 0 and not np.isfinite(level) else F.col("source_size") * cap < F.lit(level) * F.col("w")
        full = F.lit(False) if capped < 0 else full
        n, taken, w = by.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0))).first()
        if n == capped:
            break
        capped, level = n, (goal - taken) / w if w else float("inf")
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.lit(level) * F.col("w")) if np.isfinite(level) else F.col("source_size") * F.lit(float(cap))
    return scratch.cut(by.select("source", "source_no", "source_size", "docs", target.cast("double").alias("target")), "targets")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, budget, cap: int, block_words: int, seed: int, name: str):
    """Rows with offsets, and the mix: (source_no, off, shard, turn, block, first word, words) of each part of a row in a slot."""
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("h"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    rows = scratch.cut(rows, "sizes")
    sources = sources_of(rows, scratch, weights, budget, cap)
    n_sources, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("docs"), F.lit(0))).first()
    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    rows = rows.join(side.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "docs")
    # about as many chunks as documents in one: neither the chunks of a source nor a chunk's documents are many
    chunk = F.pmod(F.xxhash64("id", "h", F.lit(seed)), F.lit(max(1, -(-most // max(CHUNK_DOCS, math.isqrt(most)))))).cast("int")
    rows = rows.withColumn("chunk", chunk)
    sums = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("c"))
    sums = sums.select("source_no", "chunk", (F.sum("c").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("c")).alias("base"))
    order = Window.partitionBy("source_no", "chunk").orderBy("id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("off", F.sum("size").over(order) - F.col("size")).join(sums, ["source_no", "chunk"])
    rows = scratch.cut(rows.withColumn("off", F.col("off") + F.col("base")).drop("base", "chunk", "source"), "offsets")

    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.least(blocks * cap, F.round(F.col("target") * blocks / F.col("source_size"))).cast("bigint")
    made = sources.where("source_size > 0").select("source_no", blocks.alias("n"), quota.alias("q")).where("q > 0")
    slots_n = made.agg(F.sum("q")).first()[0] or 0
    pieces = made.select("source_no", "n", F.explode(F.expr(f"sequence(0L, q - 1, {PIECE}L)")).alias("lo"), "q").select("source_no", "n", "lo", F.least("q", F.col("lo") + PIECE).alias("hi"))
    shards = max(1, -(-slots_n // SHARD_SLOTS))
    slots = pieces.repartition(max(1, min(4096, -(-slots_n // PIECE)))).mapInArrow(_slots(seed, shards), "source_no bigint, shard bigint, turn int, block bigint")

    at = F.explode(F.expr(f"sequence(off div {block_words}, (off + size - 1) div {block_words})")).alias("block")
    own = rows.where("size > 0").select("source_no", "off", "size", at)
    own = own.join(slots.hint("merge"), ["source_no", "block"])  # both sides grow with the corpus
    first = F.greatest(F.col("off"), F.col("block") * block_words)
    words = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block_words) - first
    return rows, own.select("source_no", "off", "shard", "turn", "block", (first - F.col("off")).alias("first"), words.alias("words"))


def mix_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: tuple[int, int] = (3, 2), cap: int = 2, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """(shard, source_no, turn, block, id, first, words): what each output shard holds, a row for each part of a document
    in a block; first counts the words of the document before. See mix_sources for the rest."""
    rows, own = _plan(docs, id_col, text_col, source_col, weights, budget, cap, block_words, seed, "blocks")
    own = own.join(rows.where("size > 0").select("source_no", "off", "id"), ["source_no", "off"])
    return own.select("shard", "source_no", "turn", "block", F.col("id").alias(id_col), "first", "words")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: tuple[int, int] = (3, 2), cap: int = 2, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """(id, size, source_size, target, taken, n_shards) for each row of docs.

    size counts the words of the whole text (a null text has none); sources, ordered by code point with null
    last, take the weights in turn and share budget times all words; a target stops at ``cap`` times its
    source's size and the excess is shared again by weight.  taken counts the words of the document in all shards of the
    mix, repeats included: at most cap times its size, and for a source as near its target as whole blocks allow; n_shards
    the shards that hold part of it.
    Same rows and seed, same result, in whatever order or partitions the rows come: ties among rows of one id and text
    are between equals.  A null source is a source; repeated rows are documents of their own; a text of any length is
    counted as a whole; what other columns are called plays no part; an empty table gives no rows, one without words
    takes nothing.
    """
    rows, own = _plan(docs, id_col, text_col, source_col, weights, budget, cap, block_words, seed, "mix")
    by_shard = own.groupBy("source_no", "off", "shard").agg(F.sum("words").alias("w"))
    taken = by_shard.groupBy("source_no", "off").agg(F.sum("w").alias("taken"), F.count(F.lit(1)).alias("n_shards"))
    # rows without words share an offset with the next document: they must not match
    out = rows.withColumn("key", F.when(F.col("size") > 0, F.col("off"))).join(taken.withColumnRenamed("off", "key").hint("merge"), ["source_no", "key"], "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", none("taken"), none("n_shards"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: tuple[int, int] = (3, 2), cap: int = 2, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs, in the order of its shards: a row for each turn (up to cap) in which
    blocks of a document occur, in the shard of the first of them.

    A row whose blocks are all taken keeps its text as it is; of others the words of the blocks taken stay,
    joined by a space.  n_chars, where there is one, is counted anew.  Documents that the mix leaves out go, those
    without words among them.
    """
    rows, own = _plan(docs, id_col, text_col, source_col, weights, budget, cap, block_words, seed, "mixed")
    parts = own.groupBy("source_no", "off").agg(F.sort_array(F.collect_list(F.struct("first", "words", "turn", "shard"))).alias("parts"))
    # rows of the same id and text are told apart by source and number
    number = F.row_number().over(Window.partitionBy("id", "h").orderBy("source_no", "off"))
    repeated = not rows.where("size > 0").groupBy("id", "h").count().where("count > 1").limit(1).isEmpty()
    named = rows.where("size > 0").withColumn("n", number if repeated else F.lit(1)).join(parts.hint("merge"), ["source_no", "off"])
    return _with_text(docs, named, id_col, text_col, source_col, cap, repeated)


def _with_text(docs: DataFrame, named: DataFrame, id_col: str, text_col: str, source_col: str, cap: int, repeated: bool) -> DataFrame:
    """The rows of docs stay in one column, so that none of their names can clash with one in here."""
    text = F.col(f"row.`{text_col}`").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(text).alias("h"))
    # only where id and text repeat do the texts have to be sorted to number their rows
    keyed = keyed.withColumn("n", F.row_number().over(Window.partitionBy("id", "h").orderBy(F.asc_nulls_last(f"row.`{source_col}`"))) if repeated else F.lit(1))
    named = named.select(F.col("id").alias("i"), F.col("h").alias("k"), F.col("n").alias("m"), "parts", "size")
    out = keyed.join(named.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")) & (F.col("n") == F.col("m"))).select("row", "parts", "size")
    mine = F.filter("parts", lambda p: p["turn"] == F.col("turn"))
    out = out.withColumn("turn", F.explode(F.expr(f"sequence(0, {cap - 1})"))).withColumn("parts", mine).where(F.size("parts") > 0)
    whole: Column = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["words"]) == F.col("size")
    cut = lambda w: F.flatten(F.transform("parts", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int"))))
    # the words are bound once a row: inside the inner lambda they would be found again for every block
    some = F.array_join(F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), cut), F.lit(0)), " ")
    out = out.withColumn("t", F.when(whole, text).otherwise(some))
    out = out.select("row", "t", F.col("parts")[0]["shard"].alias("shard"), F.xxhash64("t").alias("h"))
    out = out.repartitionByRange("shard", "h").sortWithinPartitions("shard", "h")
    pick = {text_col: F.col("t"), "n_chars": F.length("t").cast("bigint")}
    return out.select(*[pick[c].alias(c) if c in pick else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

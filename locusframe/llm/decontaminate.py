"""Benchmark decontamination: Wu-Manber multi-pattern search over normalised text.

Test windows are byte strings ``" w1 w2 ... w8 "`` of a normalised item.  The search reads the block of bytes at
the end of a window of the least pattern length m; a shift table over hashed blocks says how far no pattern can
start, a zero shift opens the bucket of patterns with that suffix block, their first bytes are compared, and a
direct comparison of all bytes confirms.  The scan runs many lanes of a buffer in step, each with its own cursor,
so numpy advances all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.scratch import Scratch

U = np.uint64
#: Bytes of benchmark text that one pass over the documents looks for; more text makes more passes.
PASS_BYTES = 8 << 20
#: Bytes of document text in one scan and start positions of one lane.
SCAN_BYTES, LANE = 1 << 20, 512
_TABLE_BITS = 18

#: A-Z lowered; everything in ASCII but digits and letters becomes a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class _Class:
    """Wu-Manber tables for patterns of similar length: slices (start, length) of ``pool``."""

    def __init__(self, pool: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray):
        self.m = int(length.min())
        self.b = min(8, self.m)
        self.mask = U((1 << (8 * self.b)) - 1)
        reach = self.m - self.b
        shift = np.full(1 << _TABLE_BITS, min(reach + 1, 255), dtype=np.uint8)
        for j in range(max(0, reach - 254), reach + 1):
            np.minimum.at(shift, self.slot(self.blocks(pool, start + j)), np.uint8(reach - j))
        self.shift = shift
        suffix = self.blocks(pool, start + reach)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.start, self.length, self.number = suffix[order], start[order], length[order], number[order]
        self.first = self.blocks(pool, self.start)

    def blocks(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        view = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        return view[at] & self.mask

    @staticmethod
    def slot(block: np.ndarray) -> np.ndarray:
        return ((block * U(0x9E3779B97F4A7C15)) >> U(64 - _TABLE_BITS)).astype(np.int64)

    def find(self, data: np.ndarray, n: int, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern number) of all occurrences in data[:n]; data has 8 more bytes."""
        last = n - self.m + 1
        none = np.zeros(0, np.int64)
        if last <= 0:
            return none, none
        at = np.arange(0, last, LANE, dtype=np.int64)
        end = np.minimum(at + LANE, last)
        stopped = []
        while len(at):
            block = self.blocks(data, at + (self.m - self.b))
            shift = self.shift[self.slot(block)]
            zero = shift == 0
            if zero.any():
                stopped.append(at[zero])
            at = at + np.maximum(shift, 1)
            going = at < end
            if not going.all():
                at, end = at[going], end[going]
        if not stopped:
            return none, none
        at = np.concatenate(stopped)
        block = self.blocks(data, at + (self.m - self.b))
        low, high = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        hit = high > low
        at, low, many = at[hit], low[hit], (high - low)[hit]
        out_at, out_number = [], []
        for lo in range(0, len(at), 4096):
            a, l, c = at[lo : lo + 4096], low[lo : lo + 4096], many[lo : lo + 4096]
            heads = np.zeros(len(c), np.int64)
            np.cumsum(c[:-1], out=heads[1:])
            a, entry = np.repeat(a, c), np.repeat(l - heads, c) + np.arange(c.sum())
            same = (self.blocks(data, a) == self.first[entry]) & (a + self.length[entry] <= n)
            a, entry = a[same], entry[same]
            equal = np.ones(len(a), bool)
            for j in range(0, int(self.length[entry].max()) if len(a) else 0, 8):
                # direct comparison, eight bytes a step, the last step shortened to the pattern's end
                left = np.clip(self.length[entry] - j, 0, 8).astype(U)
                todo = equal & (left > 0)
                if not todo.any():
                    break
                mask = np.where(left[todo] == 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (left[todo] * U(8) % U(64))) - U(1))
                x = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))[a[todo] + j]
                y = np.ndarray(shape=(len(pool) - 7,), dtype="<u8", buffer=pool, strides=(1,))[self.start[entry][todo] + j]
                equal[todo] = (x & mask) == (y & mask)
            out_at.append(a[equal])
            out_number.append(self.number[entry[equal]])
        return (np.concatenate(out_at), np.concatenate(out_number)) if out_at else (none, none)


class Matcher:
    """All windows of a block of benchmark items, compiled."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int):
        pool, start, length, span, owner, at = [], [], [], [], [], 0
        for name, text in items:
            w = words(text)
            if not w:
                continue
            line = b" " + b" ".join(w) + b" "
            ends = np.cumsum([0, *(len(x) + 1 for x in w)])
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                start.append(at + ends[i])
                length.append(ends[i + size] - ends[i] + 1)
                span.append(size)
                owner.append(name)
            pool.append(line)
            at += len(line)
        self.pool = np.frombuffer(b"".join(pool) + b"\n" * 8, dtype=np.uint8)
        raw = self.pool.tobytes()
        number: dict[bytes, int] = {}
        self.owners: list[set[str]] = []
        first, size = [], []
        for s, n, k, o in zip(start, length, span, owner):
            key = raw[s : s + n]
            if key not in number:
                number[key] = len(number)
                self.owners.append(set())
                first.append(s)
                size.append((n, k))
            self.owners[number[key]].add(o)
        self.owners = [tuple(sorted(o)) for o in self.owners]
        start, sizes = np.array(first, dtype=np.int64), np.array(size, dtype=np.int64).reshape(-1, 2)
        self.span = sizes[:, 1]
        self.classes = []
        edges = [0, 10, 24, np.iinfo(np.int64).max]
        for lo, hi in zip(edges, edges[1:]):
            own = np.flatnonzero((sizes[:, 0] >= lo) & (sizes[:, 0] < hi))
            if len(own):
                self.classes.append(_Class(self.pool, start[own], sizes[own, 0], own))

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document its merged hit spans (first word, end word) and the owners of its windows."""
        lines = [b"\n " + b" ".join(w) + b" \n" for w in docs]
        sizes = np.array([len(x) for x in lines])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data = np.frombuffer(b"".join(lines) + b"\n" * 8, dtype=np.uint8)
        n = len(data) - 8
        found = [c.find(data, n, self.pool) for c in self.classes]
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
        at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        if not len(at):
            return out
        number = np.concatenate([f[1] for f in found])
        doc = np.searchsorted(begin, at, "right") - 1
        spaces = np.cumsum(data[:n] == 32, dtype=np.int64)
        word = spaces[at] - np.where(begin[doc] > 0, spaces[begin[doc] - 1], 0) - 1
        order = np.lexsort((word, doc))
        for i in order:
            spans, owners = out[doc[i]]
            owners.update(self.owners[number[i]])
            s, e = int(word[i]), int(word[i] + self.span[number[i]])
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], e))
            else:
                spans.append((s, e))
        return out


def _merge(a: list[int], b: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *b]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _pass(matcher):
    """One pass: (id, text, key, spans, items) with the hits of this block of items added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Matcher = matcher.value
        for batch in batches:
            text = batch.column(1)
            at = 0
            while at < len(batch):
                docs, size, end = [], 0, at
                while end < len(batch) and (end == at or size < SCAN_BYTES):
                    docs.append(words(text[end].as_py()))
                    size += sum(map(len, docs[-1])) + len(docs[-1])
                    end += 1
                found = search.scan(docs)
                spans = [_merge(old or [], new[0]) for old, new in zip(batch.column(3)[at:end].to_pylist(), found)]
                items = [sorted({*(old or []), *new[1]}) for old, new in zip(batch.column(4)[at:end].to_pylist(), found)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:end], text[at:end], pa.array([len(d) for d in docs], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    ["id", "text", "n_words", "spans", "items"],
                )
                at = end

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    held, size = [], 0
    for row in benchmark.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= PASS_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search_windows(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 8) -> DataFrame:
    """(id, text, n_words, spans, items) for each row of docs.

    spans holds first and end word numbers of the merged hits, one after the other; items the ids (as strings,
    sorted, distinct) of the benchmark items of which a window occurs.  Words are runs of digits, letters A-Z
    (lowered) and anything beyond ASCII; a window is ``window`` consecutive words of an item, or all words of a
    shorter one.  Null or wordless texts have no words and no hits; null or wordless items have no windows; an
    item without id is named "null"; repeated items count once.  Every row of docs is searched as a whole.

    The driver reads the benchmark in blocks of PASS_BYTES; each block is one broadcast of a known bound and one
    more pass, which reads the table that the pass before wrote, so a larger benchmark takes more passes and not more
    memory.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    schema, scratch = out.schema, Scratch(spark, "windows")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    blocks = 0
    for block in _blocks(items):
        blocks += 1
        if blocks > 1:  # a pass reads what the one before has written: only one search is in memory at a time
            out = scratch.cut(out, "pass")
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(Matcher(block, window))), schema)
    if not blocks:
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(Matcher([], window))), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 8, min_items: int = 2) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, items_sha256, contaminated) for each row of docs; see search_windows."""
    found = search_windows(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, window=window)
    hit = F.expr("aggregate(transform(sequence(0, size(spans)), i -> CASE WHEN i < size(spans) THEN (CASE WHEN i % 2 = 0 THEN -1L ELSE 1L END) * get(spans, i) ELSE 0L END), 0L, (a, x) -> a + x)")
    return found.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 8, min_items: int = 1, min_words: int = 8) -> DataFrame:
    """The rows of docs, with all their columns, that are clean of the benchmark.

    A row goes if it holds windows of min_items items of min_words words or more, or of two or more different items
    of any length: a shorter item alone is too short to tell a passage.  Null and empty texts stay, repeated rows are judged
    alike, texts of any length are searched whole, and what the columns are called plays no part; an empty table or
    benchmark takes nothing.
    """
    long_enough = F.regexp_count(F.col(text_col).cast("string"), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")) >= min_words
    named = F.concat(F.when(long_enough, F.lit("L")).otherwise(F.lit("S")), F.coalesce(F.col(item_col).cast("string"), F.lit("null")))
    items = benchmark.select(named.alias(item_col), F.col(text_col))
    # the search takes any columns along: the row itself is the id
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    found = search_windows(rows, items, id_col="row", text_col="text", item_col="item", window=window)
    long_items = F.size(F.filter("items", lambda i: i.startswith("L")))
    every = F.size(F.array_distinct(F.transform("items", lambda i: F.substr(i, F.lit(2)))))
    return found.where((long_items < min_items) & (every < max(min_items, 2))).select("id.*")

"""Token ids as ORC: ascending documents, integer run-length encoding, row indexes, Bloom filters on ids.

Texts are dealt by ranges of the document id and sorted, each task encodes its range and writes one file whose
stripes hold (doc_id, at, ids): ORC's integer columns are run-length encoded, every stripe carries a row index
(minimum and maximum per ``ROW_STRIDE`` rows) and a Bloom filter on doc_id.  Readers split files by stripe and
skip stripes and row groups through those.  ``at`` counts the ids before the document in its file, so the place in
the whole stream needs only one sum per file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.scratch import Scratch, small_batches
from locusframe.llm.wordhash import WHITE, U, mix, text_slices

STRIPE_BYTES, ROW_STRIDE = 8 << 20, 1000
#: Slots of a worker's table of pieces (a power of two, filled to half; some 60 bytes a piece), and ids it holds.
SLOTS, POOL = 1 << 19, 1 << 21
#: Bytes of a piece that is remembered; longer ones are encoded wherever they occur.
PIECE_BYTES = 16
#: Pieces that share a call.
GROUP = 128
#: Files up to which their table is broadcast (some 100 bytes each); beyond, it is joined. Files of a partial sum.
BROADCAST_FILES, FILE_GROUP = 200_000, 1024

_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b".,")] = True


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the pieces of all texts: runs of anything but ASCII white space, cut before a full
    stop or comma that follows an ASCII letter."""
    inside = ~WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (_ALPHA[data[:-1]] & _SIGN[data[1:]])
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Pieces:
    """A hash table of pieces up to PIECE_BYTES and their ids, of bounded size: once it is full, the pieces that
    were met again since the last time stay if they fill less than half of it."""

    def __init__(self):
        self.bits = SLOTS.bit_length() - 1
        self.clear()

    def clear(self) -> None:
        self.n = self.ids = 0
        self.slots = np.full(SLOTS, -1, dtype=np.int32)
        self.low, self.high = np.zeros(SLOTS // 2, dtype=U), np.zeros(SLOTS // 2, dtype=U)
        self.size = np.zeros(SLOTS // 2, dtype=np.uint8)
        self.start = np.zeros(SLOTS // 2, dtype=np.int32)
        self.count = np.zeros(SLOTS // 2, dtype=np.int32)
        self.again = np.zeros(SLOTS // 2, dtype=bool)
        self.pool = np.zeros(POOL, dtype=np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high + size * U(0x9E3779B97F4A7C15))) >> U(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each piece (its bytes as two numbers, its length), -1 if there is none; all is compared."""
        slot = self._slot(low, high, size)
        entry = self.slots[slot].astype(np.int64)
        at = np.flatnonzero(entry >= 0)
        while len(at):
            e = entry[at]
            at = at[(self.low[e] != low[at]) | (self.high[e] != high[at]) | (self.size[e] != size[at])]
            slot[at] = (slot[at] + 1) & (SLOTS - 1)
            entry[at] = self.slots[slot[at]]
            at = at[entry[at] >= 0]
        return entry

    def fits(self, pieces: int, ids: int) -> bool:
        return self.n + pieces <= SLOTS // 2 and self.ids + ids <= POOL

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New distinct pieces with their ids one after the other; they must fit."""
        entry = np.arange(self.n, self.n + len(low))
        self.low[entry], self.high[entry], self.size[entry], self.count[entry] = low, high, size, count
        self.start[entry] = self.ids + np.cumsum(count) - count
        self.pool[self.ids : self.ids + len(ids)] = ids
        self.n, self.ids = self.n + len(low), self.ids + len(ids)
        slot = self._slot(low, high, size)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            lost = self.slots[slot] != entry
            entry, slot = entry[lost], (slot[lost] + 1) & (SLOTS - 1)

    def shrink(self) -> None:
        own = np.flatnonzero(self.again[: self.n])
        kept = None
        if 0 < len(own) < SLOTS // 4 and self.count[own].sum() < POOL // 2:
            kept = self.low[own], self.high[own], self.size[own], self.count[own], _gather(self.pool, self.start[own], self.count[own])
        self.clear()
        if kept:
            self.add(*kept)


def _gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pool[start : start + count] of all pieces, one after the other."""
    ends = np.cumsum(count, dtype=np.int64)
    return pool[np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids (int32) of whole texts with the tokenizers library.

    For a tokenizer that lower-cases, drops white space and splits letters from other signs (``splits``), pieces
    between white space encode by themselves, so a distinct piece is encoded once as long as the table of pieces
    holds it, and the ids of a batch of texts are gathered from the table.  Many pieces go in one call with a
    special token between them, which the library splits on before anything else; ASCII words go through a copy of
    the tokenizer without normaliser, lower-cased, and their last tokens carry the mark of a word's end.  Any other
    tokenizer encodes whole texts.
    """

    def __init__(self, path: str, memo: bool = True):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table: Pieces | None = None
        every = self.tokenizer.get_added_tokens_decoder()
        special = [(i, t.content) for i, t in every.items() if t.special and not (t.single_word or t.lstrip or t.rstrip or t.normalized)]
        whole = all(t.special and "<" in t.content and not set(t.content) & set(" \t\n\v\f\r.,") for t in every.values())
        if memo and special and whole and splits(json.loads(self.tokenizer.to_str())):
            self.mark, self.table = min(special), Pieces()
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _call(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, their ids one after the other)."""
        word = [i for i, p in enumerate(pieces) if p.isalpha()]  # of bytes: ASCII letters only
        other = [i for i, p in enumerate(pieces) if not p.isalpha()]
        rest, marked = [i for i in other if b"<" in pieces[i]], [i for i in other if b"<" not in pieces[i]]
        between, ids, number = self.mark[1].encode(), [np.zeros(0, np.int32)], []
        groups = [word[i : i + GROUP] for i in range(0, len(word), GROUP)]
        found = np.concatenate(ids + self._call(self.plain, [b" ".join([pieces[i] for i in g]).lower().decode() for g in groups]))
        number.append(np.diff(np.flatnonzero(self.ends[found]), prepend=-1))
        ids.append(found)
        groups = [marked[i : i + GROUP] for i in range(0, len(marked), GROUP)]
        found = np.concatenate(ids[:1] + self._call(self.tokenizer, [(between.join([pieces[i] for i in g]) + between).decode() for g in groups]))
        number.append(np.diff(np.flatnonzero(found == self.mark[0]), prepend=-1) - 1)
        ids.append(found[found != self.mark[0]])
        single = self._call(self.tokenizer, [pieces[i].decode() for i in rest])
        number.append(np.array([len(x) for x in single], dtype=np.int64))
        number, order = np.concatenate(number), np.array(word + marked + rest, dtype=np.int64)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return number[place].astype(np.int32), _gather(np.concatenate(ids + single), (np.cumsum(number) - number)[place], number[place])

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number in each text; offsets bound the texts in data."""
        if self.table is None:
            found = self._call(self.tokenizer, [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])])
            return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(f) for f in found], dtype=np.int64)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts, ends = _pieces(data, offsets)
        start, count, pool = self._ids_of(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return _gather(pool, start, count), np.diff(total[np.searchsorted(starts, offsets)])

    def _ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, pool): where each piece's ids stand in pool."""
        table, size = self.table, ends - starts
        padded = np.concatenate([data, np.zeros(PIECE_BYTES, np.uint8)])
        view = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        short = np.flatnonzero(size <= PIECE_BYTES)
        length = size[short].astype(U)
        low, high = view[starts[short]], view[starts[short] + 8]
        for lane, bits in ((low, np.minimum(length, U(8)) * U(8)), (high, np.maximum(length, U(8)) * U(8) - U(64))):
            lane &= np.where(bits == 64, ~U(0), (U(1) << (bits & U(63))) - U(1))
        entry = table.find(low, high, length)
        table.again[entry[entry >= 0]] = True
        raw = data.tobytes()
        text = lambda at: [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]

        missing = np.flatnonzero(entry < 0)
        if len(missing):
            order = missing[np.lexsort((length[missing], high[missing], low[missing]))]
            new = np.ones(len(order), bool)
            new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]) | (length[order][1:] != length[order][:-1])
            once = order[new]
            number, ids = self._encoded(text(short[once]))
            if not table.fits(len(once), len(ids)):
                table.shrink()
                if not table.fits(len(once), len(ids)):
                    table.clear()
                missing = np.arange(len(entry))  # places have changed
            if table.fits(len(once), len(ids)):  # else the batch is beyond the table: its pieces are not remembered
                table.add(low[once], high[once], length[once], number, ids)
            entry[missing] = table.find(low[missing], high[missing], length[missing])
        start, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        has = entry >= 0
        start[short[has]], count[short[has]] = table.start[entry[has]], table.count[entry[has]]
        rest = np.concatenate([np.flatnonzero(size > PIECE_BYTES), short[~has]])
        pool = table.pool
        if len(rest):
            words = text(rest)
            each = list(dict.fromkeys(words))
            number, ids = self._encoded(each)
            place = dict(zip(each, range(len(each))))
            at = np.array([place[w] for w in words])
            start[rest], count[rest] = len(pool) + (np.cumsum(number, dtype=np.int64) - number)[at], number[at]
            pool = np.concatenate([pool, ids])
        return start, count, pool


def splits(config: dict) -> bool:
    """Whether a tokenizer's configuration is the one that Encoder's piecewise path is made for."""
    normal = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
    before = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = before[0] if before else {}
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and [p["type"] for p in before] == ["Split", "ByteLevel"]
        and split["behavior"] == "Removed" and split["invert"]
        and split["pattern"].get("Regex", "").endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
        and config["model"].get("end_of_word_suffix") == "</w>" and config["model"].get("dropout") is None
    )


def _encode(path: str, end_id: int, memo: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, before = Encoder(path, memo), 0
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids, number = encoder.batch(data, offsets)
                sizes = number + 1
                at = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                ids = np.insert(ids, np.cumsum(number), end_id).astype(np.int32, copy=False)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(at), pa.ListArray.from_arrays(bounds.astype(np.int32), ids)], ["doc_id", "at", "ids"])

    return run


def write_tokens(docs: DataFrame, out: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, memo: bool = True) -> None:
    """Encode every whole text (null: empty), append end_id, write ORC files in ascending id order to ``out``.

    A null id comes first; rows that repeat an id follow each other by the hash of their text.  Every row is
    written once.  File names ascend with the ids.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a repeated id is spread by its texts, equal rows by where they come from
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    rows = rows.repartitionByRange("doc_id", "h", "m").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ids = rows.mapInArrow(_encode(tokenizer, end_id, memo), f"doc_id {id_type}, at bigint, ids array<int>")
    writer = ids.write.option("compression", "zstd").option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(ROW_STRIDE))
    writer.option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    small_batches(docs.sparkSession)
    writer.orc(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, at, ids); a filter on doc_id reaches the files' indexes and Bloom filters."""
    return spark.read.orc(path).select("doc_id", F.col("_metadata.file_name").alias("file"), "at", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets = ids.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).view(np.uint8))
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "at", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; an empty folder gives no rows."""
    files = read_tokens(spark, path).groupBy("file").agg(F.sum(F.size("ids")).alias("n"))
    # the sum over all files before, by groups of files in the order of their names
    files = files.withColumn("g", (F.regexp_extract("file", "part-([0-9]+)", 1).cast("bigint") / FILE_GROUP).cast("bigint"))
    groups = files.groupBy("g").agg(F.sum("n").alias("n"))
    groups = groups.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"))  # a row for FILE_GROUP files
    inside = F.sum("n").over(Window.partitionBy("g").orderBy("file")) - F.col("n")
    files = files.withColumn("inside", inside).join(groups, "g").select(F.col("file").alias("f"), (F.col("before") + F.col("inside")).alias("base"))
    if len(read_tokens(spark, path).inputFiles()) <= BROADCAST_FILES:
        files = F.broadcast(files)
    id_type = read_tokens(spark, path).schema["doc_id"].dataType.simpleString()
    rows = read_tokens(spark, path).mapInArrow(_digest, f"doc_id {id_type}, file string, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(files, F.col("file") == F.col("f")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, name: str = "tokens") -> DataFrame:
    """Write the token files to shared scratch space and return their digest."""
    scratch = Scratch(docs.sparkSession, name)
    path = scratch.path("orc")
    write_tokens(docs, path, tokenizer=tokenizer, id_col=id_col, text_col=text_col, end_id=end_id)
    return digest(docs.sparkSession, path).withColumnRenamed("doc_id", id_col)

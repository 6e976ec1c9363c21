"""BCF2 files as the same site columns that VCF text gives.

A BCF record stream cannot be split without an index, so one task decodes a file as a stream, record by record; the
records are then dealt out by ranges of ord for whatever comes next.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from locusframe.sources.vcf import Header

SCHEMA = "ord bigint, line string, chrom string, pos bigint, pos_raw string, id string, ref string, alt string, qual string, filter string, info string, format string, samples array<string>"
# fixed values of the format: type codes to struct letters, their missing and end-of-vector values
_TYPES = {1: ("b", -128, -127), 2: ("h", -32768, -32767), 3: ("i", -2147483648, -2147483647), 5: ("f", None, None)}
_FLOAT_MISSING, _FLOAT_END = 0x7F800001, 0x7F800002


def _number(x: float) -> str:
    text = f"{x:.6g}"
    return text[:-2] if text.endswith(".0") else text


class Decoder:
    """Header dictionaries and the parts of a record."""

    def __init__(self, header: str):
        self.strings, self.contigs = {0: "PASS"}, {}
        for line in header.splitlines():
            m = re.match(r"##(FILTER|INFO|FORMAT|contig)=<(.*)>", line)
            if not m:
                continue
            name = re.search(r"(?:^|,)ID=([^,]+)", m[2])[1]
            idx = re.search(r"(?:^|,)IDX=([0-9]+)", m[2])
            table = self.contigs if m[1] == "contig" else self.strings
            if name not in table.values():
                table[int(idx[1]) if idx else len(table)] = name
        names = next((x.split("\t") for x in header.splitlines() if x.startswith("#CHROM")), [])
        self.samples = names[9:]

    @staticmethod
    def size(data: bytes, at: int) -> tuple[int, int, int]:
        """(type, count, next place) of a typed value's descriptor."""
        kind, n, at = data[at] & 15, data[at] >> 4, at + 1
        if n == 15:
            t, _, at = Decoder.size(data, at)
            letter = _TYPES[t][0]
            (n,) = struct.unpack_from("<" + letter, data, at)
            at += struct.calcsize(letter)
        return kind, n, at

    @staticmethod
    def values(data: bytes, at: int, kind: int, n: int) -> tuple[list, int]:
        """n values: numbers, None for missing; what follows the end of a vector is cut."""
        if kind == 7:
            return [data[at : at + n].rstrip(b"\0").decode()], at + n
        if kind == 0:
            return [], at
        letter, missing, end = _TYPES[kind]
        width = struct.calcsize(letter)
        raw = struct.unpack_from(f"<{n}{letter}", data, at)
        if kind == 5:
            bits = struct.unpack_from(f"<{n}I", data, at)
            out = [None if b == _FLOAT_MISSING else x for x, b in zip(raw, bits) if b != _FLOAT_END]
        else:
            out = [None if x == missing else x for x in raw if x != end]
        return out, at + n * width

    def typed(self, data: bytes, at: int) -> tuple[list, int]:
        kind, n, at = self.size(data, at)
        return self.values(data, at, kind, n)

    @staticmethod
    def text(values: list) -> str:
        return ",".join("." if x is None else x if isinstance(x, str) else _number(x) if isinstance(x, float) else str(x) for x in values) or "."

    @staticmethod
    def genotype(values: list) -> str:
        out = ""
        for i, x in enumerate(values):
            x = 0 if x is None else x
            out += ("|" if x & 1 else "/") * (i > 0) + ("." if x >> 1 == 0 else str((x >> 1) - 1))
        return out or "."

    def record(self, shared: bytes, own: bytes) -> tuple:
        chrom, pos, _, _, counts, samples = struct.unpack_from("<iiifII", shared)
        (bits,) = struct.unpack_from("<I", shared, 12)
        (qual,) = struct.unpack_from("<f", shared, 12)
        n_info, n_allele = counts & 0xFFFF, counts >> 16
        n_sample, n_fmt = samples & 0xFFFFFF, samples >> 24
        ident, at = self.typed(shared, 24)
        alleles = []
        for _ in range(n_allele):
            a, at = self.typed(shared, at)
            alleles.append(self.text(a))
        filters, at = self.typed(shared, at)
        info = []
        for _ in range(n_info):
            key, at = self.typed(shared, at)
            kind, n, at = self.size(shared, at)
            value, at = self.values(shared, at, kind, n)
            name = self.strings[key[0]]
            info.append(name if kind == 0 or n == 0 else f"{name}={self.text(value)}")
        keys, columns, at = [], [], 0
        for _ in range(n_fmt):
            key, at = self.typed(own, at)
            kind, n, at = self.size(own, at)
            keys.append(self.strings[key[0]])
            column = []
            for _ in range(n_sample):
                value, at = self.values(own, at, kind, n)
                column.append(self.genotype(value) if keys[-1] == "GT" else self.text(value))
            columns.append(column)
        return (
            self.contigs[chrom], pos + 1, self.text(ident) if ident and ident[0] else ".", alleles[0] if alleles else ".", ",".join(alleles[1:]) or ".",
            "." if bits == _FLOAT_MISSING else _number(qual), ";".join(self.strings[f] for f in filters) or ".", ";".join(info) or ".", ":".join(keys), [":".join(c) for c in zip(*columns)],
        )


def _open(source: str | bytes) -> tuple[IO[bytes], str]:
    """The stream of a file (a path, or its bytes) behind the header, and the header's text."""
    f = gzip.open(io.BytesIO(source) if isinstance(source, bytes) else source, "rb")
    if f.read(3) != b"BCF":
        raise ValueError("not a BCF file" if isinstance(source, bytes) else f"not a BCF file: {source}")
    f.read(2)
    (n,) = struct.unpack("<I", f.read(4))
    return f, f.read(n).rstrip(b"\0").decode()


def records(source: str | bytes) -> Iterator[tuple]:
    """All records of a file, one after the other."""
    f, header = _open(source)
    with f:
        decoder, ord_ = Decoder(header), 0
        while head := f.read(8):
            a, b = struct.unpack("<II", head)
            chrom, pos, ident, ref, alt, qual, filt, info, fmt, samples = decoder.record(f.read(a), f.read(b))
            line = "\t".join([chrom, str(pos), ident, ref, alt, qual, filt, info, *([fmt, *samples] if fmt else [])])
            yield (ord_, line, chrom, pos, str(pos), ident, ref, alt, qual, filt, info, fmt, samples)
            ord_ += 1


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64() if n in ("ord", "pos") else pa.list_(pa.string()) if n == "samples" else pa.string() for n in names]
    for batch in batches:
        for source in batch.column(0).to_pylist():
            held = []
            for row in records(source):
                held.append(row)
                if len(held) == 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for source in batch.column(0).to_pylist():
            f, header = _open(source)
            f.close()
            found.append(header)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["header"])


def _source(spark: SparkSession, path: str, through_spark: bool | None) -> DataFrame:
    """One row: the path, or for storage that only Spark reads the file's bytes (2 GB at most)."""
    if through_spark if through_spark is not None else "://" in path and not path.startswith("file://"):
        return spark.read.format("binaryFile").load(path).select("content")
    return spark.createDataFrame([(path.removeprefix("file://"),)], "path string")


def read_header(spark: SparkSession, path: str, through_spark: bool | None = None) -> Header:
    """Header lines as VCF text has them, without the numbers of the dictionaries, and sample names."""
    text = _source(spark, path, through_spark).mapInArrow(_headers, "header string").first()[0]
    lines = [re.sub(r",IDX=[0-9]+(?=[,>])", "", line) if line.startswith("##") else line for line in text.splitlines()]
    return Header(lines, Decoder(text).samples)


def read_bcf(spark: SparkSession, path: str, partitions: int | None = None, through_spark: bool | None = None) -> DataFrame:
    """Records of a BCF file; missing values read as '.'. One task decodes the file: its records cannot be found
    without reading those before."""
    out = _source(spark, path, through_spark).mapInArrow(_decode, SCHEMA)
    return out.repartitionByRange(partitions, "ord") if partitions else out

"""Text, table and index sinks. Output order is input order: rows are sorted by ord as they are written.

The text of one file is made by the executors, a part for each sorted partition; the driver copies the parts into the
file one after the other and holds no rows.
"""

from __future__ import annotations

import gzip
import json
import os
import shutil
import struct
import sys
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import render
from locusframe.functions.render import ratio, trimmed
from locusframe.sources import shared

# what the tasks run travels with them, so that workers need no module of this package
for _module in (sys.modules[__name__], render):
    cloudpickle.register_pickle_by_value(_module)


class BlockGzipWriter:
    """Block-gzip: members of at most 64 KB that carry their size, closed by an empty one."""

    _END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

    def __init__(self, path: str, level: int = 6):
        self.file, self.level, self.held = open(path, "wb"), level, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= 0xFF00:
            self._block(bytes(self.held[:0xFF00]))
            del self.held[:0xFF00]

    def _block(self, data: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        self.file.write(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data)))

    def flush(self) -> None:
        if self.held:
            self._block(bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.file.write(self._END)
        self.file.close()


def open_output(path: str, compression: str = "auto"):
    """plain, gzip or bgzf; auto goes by the name."""
    kind = ("gzip" if path.endswith(".gz") else "plain") if compression == "auto" else compression
    if kind == "bgzf":
        return BlockGzipWriter(path)
    if kind == "gzip":
        return gzip.open(path, "wb")
    if kind == "plain":
        return open(path, "wb")
    raise ValueError(f"unknown compression {compression!r}")


def write_lines(path: str, lines: Iterable[str], compression: str = "auto") -> None:
    """One local file of lines that the driver has."""
    out = open_output(path, compression)
    try:
        for line in lines:
            out.write(line.encode("utf-8") + b"\n")
    finally:
        out.close()


class _Row(dict):
    """A row of an Arrow batch with its fields as attributes."""

    __getattr__ = dict.__getitem__


def _part_writer(folder: str, compression: str, render_row: Callable[[object], str] | None) -> Callable[[Iterator], Iterator]:
    """The function of the tasks: a partition's lines as a file of its own, without the mark of a file's end."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, out = TaskContext.get(), None
        name = os.path.join(folder, f"{task.partitionId()}-{task.taskAttemptId()}")
        for batch in batches:
            lines = batch.column(0).to_pylist() if render_row is None else [render_row(_Row(r)) for r in batch.to_pylist()]
            if lines:
                out = out or open_output(name, compression)
                out.write(("\n".join(lines) + "\n").encode("utf-8"))
        if out:
            if isinstance(out, BlockGzipWriter):
                out.flush()
                out = out.file
            out.close()
            yield pa.record_batch([pa.array([task.partitionId()], pa.int64()), pa.array([name])], ["part", "name"])

    return write


def _write_sorted(df: DataFrame, header: list[str], path: str, compression: str, render_row: Callable[[object], str] | None = None) -> None:
    """Header and the lines of df, which is sorted, as one local file.

    Tasks write their parts beside the file, on a cluster into ``spark.checkpoint.dir``, which driver and executors share.
    Without such a folder the driver fetches the lines, a partition at a time.
    """
    kind = ("gzip" if path.endswith(".gz") else "plain") if compression == "auto" else compression
    root = shared.parts_root(df.sparkSession, path)
    if root is None:
        rows = df.toLocalIterator(prefetchPartitions=True)
        write_lines(path, (x for part in (iter(header), (r[0] if render_row is None else render_row(r) for r in rows)) for x in part), kind)
        return
    write_lines(path, header, kind)
    folder = os.path.join(root, f"parts-{uuid.uuid4().hex}")
    os.makedirs(folder)
    try:
        parts = sorted(tuple(r) for r in df.mapInArrow(_part_writer(folder, kind, render_row), "part bigint, name string").collect())
        with open(path, "r+b") as out:
            out.seek(-len(BlockGzipWriter._END) if kind == "bgzf" else 0, os.SEEK_END)
            for _, name in parts:
                with open(name, "rb") as part:
                    shutil.copyfileobj(part, out, 16 << 20)
                os.remove(name)
            if kind == "bgzf":
                out.write(BlockGzipWriter._END)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def write_vcf(df: DataFrame, header: list[str], path: str, compression: str = "auto") -> None:
    """Header and the records' own lines in input order, as one local file."""
    _write_sorted(df.select("ord", "line").orderBy("ord").select("line"), header, path, compression)


def write_vcf_parts(df: DataFrame, path: str, compression: str = "none") -> None:
    """The records' lines as part files in input order, written by the executors: the form for large results."""
    df.select("ord", "line").repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.option("compression", compression).text(path)


def write_tsv(df: DataFrame, path: str, compression: str = "auto", order: tuple[str, ...] = ("ord",)) -> None:
    """All columns but ord as text, null as '.', tabs between, a header line first."""
    columns = [c for c in df.columns if c != "ord"]
    rows = df.orderBy(*order).select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(".")) for c in columns]).alias("line"))
    _write_sorted(rows, ["\t".join(columns)], path, compression)


def write_parquet(df: DataFrame, path: str, row_group_bytes: int = 128 << 20, rows: int = 1_000_000) -> None:
    """Typed export, sorted by position inside each file so that readers can skip row groups. A task sorts about ``rows``
    rows, whatever the size of the input's splits: beyond that many, rows are dealt by position first."""
    n = -(-df.count() // rows)
    if n > 1:
        df = df.repartition(max(n, df.rdd.getNumPartitions()), "CHROM", "POS")
    df.sortWithinPartitions("CHROM", "POS").write.option("parquet.block.size", str(row_group_bytes)).parquet(path)


def write_json(data: object, path: str | None = None) -> str:
    text = json.dumps(data, indent=2, sort_keys=True)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return text


def missingness_paths(prefix: str) -> tuple[str, str]:
    """<prefix>.lmiss and .imiss; an extension that the prefix has is replaced."""
    stem = os.path.splitext(prefix)[0] if os.path.basename(prefix).rpartition(".")[0] else prefix
    return f"{stem}.lmiss", f"{stem}.imiss"


# fixed values: header lines of the reports
HEADERS = {
    "freq": "CHROM\tPOS\tN_ALLELES\tN_CHR\t{ALLELE:FREQ}",
    "lmiss": "CHR\tPOS\tN_DATA\tN_GENOTYPE_FILTERED\tN_MISS\tF_MISS",
    "imiss": "INDV\tN_DATA\tN_GENOTYPES_FILTERED\tN_MISS\tF_MISS",
    "hardy": "CHROM\tPOS\tOBS_HOM_REF\tOBS_HET\tOBS_HOM_ALT\tE_HOM_REF\tE_HET\tE_HOM_ALT\tCHISQ_HWE",
    "het": "INDV\tO_HOM\tE_HOM\tN_SITES\tF",
    "hudson": "CHROM\tPOS\tHUDSON_FST",
    "weir-cockerham": "CHROM\tPOS\tWEIR_AND_COCKERHAM_FST",
    "pi": "CHROM\tPOS\tPI",
    "window_pi": "CHROM\tBIN_START\tBIN_END\tN_VARIANTS\tPI",
    "tajima": "CHROM\tBIN_START\tN_SNPS\tTajimaD",
    "sfs": "ALLELE_COUNT\tN_SITES",
    "ld": "CHR\tPOS1\tPOS2\tN_INDV\tR^2",
    "pixy_pi": "pop\tchromosome\twindow_pos_1\twindow_pos_2\tavg_pi\tno_sites\tcount_diffs\tcount_comparisons",
    "pixy_dxy": "pop1\tpop2\tchromosome\twindow_pos_1\twindow_pos_2\tavg_dxy\tno_sites\tcount_diffs\tcount_comparisons",
}


def _tab(*cells: object) -> str:
    return "\t".join(map(str, cells))


LINES = {
    "freq": lambda r: _tab(r.chrom, r.pos, r.n_alleles, r.n_chr, *(f"{a}:{trimmed(f, missing='.')}" for a, f in zip(r["labels"], r["freqs"]))),
    "lmiss": lambda r: _tab(r.chrom, r.pos, r.n_data, 0, r.n_miss, trimmed(r.f_miss or 0.0)),
    "imiss": lambda r: _tab(r["sample"], r.n_data, 0, r.n_miss, trimmed(r.f_miss)),
    "hardy": lambda r: _tab(r.chrom, r.pos, r.obs_hom_ref, r.obs_het, r.obs_hom_alt, trimmed(r.e_hom_ref), trimmed(r.e_het), trimmed(r.e_hom_alt), trimmed(r.chisq)),
    "het": lambda r: _tab(r["sample"], r.o_hom, trimmed(r.e_hom, 1), r.n_sites, trimmed(r.f, 5, ".")),
    "hudson": lambda r: _tab(r.chrom, r.pos, trimmed(r.fst)),
    "weir-cockerham": lambda r: _tab(r.chrom, r.pos, trimmed(r.fst)),
    "pi": lambda r: _tab(r.chrom, r.pos, trimmed(r.pi)),
    "window_pi": lambda r: _tab(r.chrom, r.bin_start, r.bin_end, r.n_variants, trimmed(r.pi)),
    "tajima": lambda r: _tab(r.chrom, r.bin_start, r.n_snps, trimmed(r.d)),
    "sfs": lambda r: _tab(r.allele_count, r.n_sites),
    "ld": lambda r: _tab(r.chrom, r.pos1, r.pos2, r.n_indv, trimmed(r.r2)),
    "pixy_pi": lambda r: _tab(r["pop"], r.chrom, r.window_start, r.window_end, ratio(r.avg_pi), r.no_sites, r.count_diffs, r.count_comparisons),
    "pixy_dxy": lambda r: _tab(r.pop1, r.pop2, r.chrom, r.window_start, r.window_end, ratio(r.avg_dxy), r.no_sites, r.count_diffs, r.count_comparisons),
}


def write_report(df: DataFrame, kind: str, path: str, *order: str) -> None:
    """A report as one local text file, in the order given."""
    _write_sorted(df.orderBy(*order), [HEADERS[kind]], path, "plain", LINES[kind])

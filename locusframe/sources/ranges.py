"""Lines of plain and block-gzip files by ranges: many tasks for one file, and only the ranges that are asked for.

Block-gzip is a row of gzip members of at most 64 KB that carry their size, so a task can start anywhere: it looks for
the next member, and as every line ends with a line feed, for the next line.  A place in such a file is 65536 times the
byte where its member starts plus the byte inside the member's text; in a plain file it is the byte itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

SPLIT, WINDOW = 64 << 20, 1 << 20
_MAGIC = b"\x1f\x8b\x08\x04"


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(at)


def is_blocked(spark: SparkSession, path: str) -> bool:
    """Whether path is one file that starts with a gzip member that carries its size."""
    files, at = _file(spark, path)
    if not files.exists(at) or files.getFileStatus(at).isDirectory():
        return False
    stream = files.open(at)
    try:
        head = [stream.read() for _ in range(18)]
    finally:
        stream.close()
    return -1 not in head and bytes(head[:4]) == _MAGIC and bytes(head[12:14]) == b"BC"


def served(spark: SparkSession, path: str) -> bool:
    """Whether workers can open this file by themselves: local, HDFS, S3 and GCS names."""
    return _file(spark, path)[1].toUri().getScheme() in ("file", "hdfs", "s3", "s3a", "gs")


def read_lines(spark: SparkSession, path: str, blocked: bool, places: list[tuple[int, int | None]] | None = None, split: int | None = None) -> DataFrame:
    """(ord, value): the file's lines and the places where they start, ord ascending in file order.

    ``places`` are pairs of places, each the start of a line, the second (None: the file's end) not included: only these
    ranges are read.  Without them the whole file is, in one task for every ``split`` bytes: SPLIT, or less if that
    would leave cores without a MB.
    """
    files, at = _file(spark, path)
    size, uri = files.getFileStatus(at).getLen(), at.toUri()
    name = uri.getPath() if uri.getScheme() == "file" else uri.toString().replace("s3a://", "s3://", 1)
    if places is None:
        split = split or min(SPLIT, max(1 << 20, -(-size // spark.sparkContext.defaultParallelism)))
        n = max(1, -(-size // split))
        asked = spark.range(0, n, 1, n).selectExpr(f"id * {split} as start", "cast(null as bigint) as place", f"least((id + 1) * {split}, {size}) as stop", "cast(null as bigint) as until")
    else:
        shift = 16 if blocked else 0
        rows = [(p >> shift, p, size if q is None else (q >> shift) + 1, q) for p, q in places]
        asked = spark.createDataFrame(rows, "start bigint, place bigint, stop bigint, until bigint").repartitionByRange(max(1, min(len(rows), 10_000)), "start")
    return asked.mapInArrow(_reader(name, size, blocked), "ord bigint, value string")


def _reader(name: str, size: int, blocked: bool) -> Callable[[Iterator], Iterator]:
    """The function of the tasks. It stands for itself, so that workers need no module of this package."""
    magic, window = _MAGIC, WINDOW

    def read(batches):
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        files, path = (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(name)
        f = files.open_input_file(path)
        held = [0, b""]

        def bytes_at(at, n):
            if not held[0] <= at <= at + n <= held[0] + len(held[1]):
                held[:] = [at, f.read_at(max(n, window), at) if at < size else b""]
            return held[1][at - held[0] : at - held[0] + n]

        def member_size(at):
            head = bytes_at(at, 12)
            if len(head) < 12 or head[:4] != magic:
                return 0
            extra, i = bytes_at(at + 12, int.from_bytes(head[10:12], "little")), 0
            while i + 6 <= len(extra):
                n = int.from_bytes(extra[i + 2 : i + 4], "little")
                if extra[i : i + 2] == b"BC" and n == 2:
                    return int.from_bytes(extra[i + 4 : i + 6], "little") + 1
                i += 4 + n
            return 0

        def is_member(at):
            n = member_size(at)
            if not n or (at + n != size and not member_size(at + n)):
                return False
            try:
                zlib.decompress(bytes_at(at, n), 31)
            except zlib.error:
                return False
            return True

        def first_member(at, stop):
            while at < stop:
                i = bytes_at(at, 1 << 16).find(magic)
                if i < 0:
                    at += (1 << 16) - 3
                elif is_member(at + i):
                    return min(at + i, stop)
                else:
                    at += i + 1
            return stop

        def pieces(at, stop):
            while at < size:
                if blocked:
                    n = member_size(at)
                    if not n:
                        raise ValueError(f"{name}: no block-gzip member at byte {at}")
                    yield at, at << 16, zlib.decompress(bytes_at(at, n), 31)
                else:
                    n = min(window, stop - at if at < stop else size - at)
                    yield at, at, bytes_at(at, n)
                at += n

        def lines(start, place, stop, until):
            if blocked and place is None and start:
                start = first_member(start, stop)
                if start == stop:
                    return
            drop = place - (start << 16 if blocked else start) if place is not None else 0
            skipping, limit, done, carry, begun = place is None and start > 0, None, 0, [], None
            for at, base, data in pieces(start, stop):
                if limit is None and at >= stop:
                    limit = done
                i, drop = drop, 0
                while i < len(data):
                    if begun is None and not skipping:
                        if (until is not None and base + i >= until) or (until is None and limit is not None and done + i > limit):
                            return
                        begun = base + i
                    j = data.find(b"\n", i)
                    if j < 0:
                        if not skipping:
                            carry.append(data[i:])
                        break
                    if skipping:
                        skipping = False
                    else:
                        yield begun, b"".join([*carry, data[i:j]])
                        carry, begun = [], None
                    i = j + 1
                done += len(data)
            if begun is not None:
                yield begun, b"".join(carry)

        def batch(places, texts):
            return pa.record_batch([pa.array(places, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["ord", "value"])

        try:
            for asked in batches:
                for r in asked.to_pylist():
                    places, texts, held_bytes = [], [], 0
                    for place, text in lines(r["start"], r["place"], r["stop"], r["until"]):
                        places.append(place)
                        texts.append(text)
                        held_bytes += len(text)
                        if len(places) >= 8192 or held_bytes >= 4 << 20:
                            yield batch(places, texts)
                            places, texts, held_bytes = [], [], 0
                    if places:
                        yield batch(places, texts)
        finally:
            f.close()

    return read

"""Archives as Spark data sources: ``linemill`` (blocks one after another) and ``linemill-indexed`` (row groups with an
index at the end, read by row range).

Register with ``register(spark)``. Reading yields (block_id, row_no, line); option ``rows`` ("low:high", from 0, inclusive,
several parted by commas) prunes row groups before they are opened. It is an option and not a pushed filter, as a relation that was read once with
a pushed filter keeps that filter when it is read again without. Writing takes rows of BLOCKS: see ``write_archive``.
Paths go through pyarrow's file systems, so that
whatever it can reach (local, S3, GCS, HDFS) works on every executor.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from linemill.functions.tokens import PLACEHOLDER, SEPARATOR
from linemill.sources.codecs import Codec, portable
from linemill.sources.codecs import codec as codec_of
from linemill.sources.framing import HEADER, RAW, Corrupt, Stored, index_bytes, opened, opened_group, read_index

LINES = "block_id long, row_no long, line string"
LAST_ROW = (1 << 63) - 1
BLOCKS = "place string, num_rows long, kind int, crc32 long, data binary"
MANIFEST = "_manifest.json"


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


@dataclass
class BlockPart(InputPartition):
    block_no: int
    offset: int
    size: int
    first_row: int
    kind: int = 0
    crc32: int = 0
    part: str = ""


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.codec = options["path"], options.get("codec", "xz")
        self.ranges = []
        for asked in options.get("rows", "").split(","):
            low, _, high = asked.partition(":")
            self.ranges.append((int(low or 0), int(high or LAST_ROW)))

    def _manifest(self) -> list[list] | None:
        """[part, offset, size, rows, kind, crc32] of each block in order, if the archive is a folder."""
        from pyarrow import fs

        system, path = _file(self.path)
        if system.get_file_info(path).type != fs.FileType.Directory:
            return None
        with system.open_input_stream(f"{path}/{MANIFEST}") as f:
            return json.loads(f.read())

    def _data(self, part: BlockPart) -> bytes:
        system, path = _file(self.path)
        with system.open_input_file(f"{path}/{part.part}" if part.part else path) as f:
            f.seek(part.offset)
            return f.read(part.size)

    def _wanted(self, first: int, rows: int) -> bool:
        return rows > 0 and any(first + rows > low and first <= high for low, high in self.ranges)

    def _emit(self, part: BlockPart, lines: list[bytes]) -> Iterator[tuple]:
        ranges = [(low, high) for low, high in self.ranges if part.first_row + len(lines) > low and part.first_row <= high]
        for i, line in enumerate(lines):
            if not any(low <= part.first_row + i <= high for low, high in ranges):
                continue
            try:
                text = line.decode()
            except UnicodeDecodeError:
                text = line.decode("latin-1")
            yield part.block_no, part.first_row + i, text


class ArchiveReader(_Reader):
    """Blocks found by hopping from header to header, or from the manifest of a folder. Without row counts in the format
    every block is opened, and row_no counts within its block."""

    def partitions(self) -> list[BlockPart]:
        if (found := self._manifest()) is not None:
            return [BlockPart(i, offset, size, 0, kind, crc, part) for i, (part, offset, size, _, kind, crc) in enumerate(found)]
        system, path = _file(self.path)
        out, at = [], 0
        with system.open_input_file(path) as f:
            end = f.size()
            while at < end:
                f.seek(at)
                head = f.read(HEADER.size)
                if len(head) < HEADER.size:
                    raise Corrupt("the archive ends inside a header")
                size = HEADER.size + sum(HEADER.unpack(head)[1:4])
                if at + size > end:
                    raise Corrupt("the archive ends inside a block")
                out.append(BlockPart(len(out), at, size, 0))
                at += size
        return out

    def read(self, part: BlockPart | None) -> Iterator[tuple]:
        if part is None:  # Spark asks once where there are no partitions
            return
        data = self._data(part)
        crc, a, b, c, flag = HEADER.unpack_from(data)
        at = HEADER.size
        lines = opened(Stored(crc, data[at : at + a], data[at + a : at + a + b], data[at + a + b : at + a + b + c], flag), codec_of(self.codec))
        yield from self._emit(part, lines)


class IndexedReader(_Reader):
    """Row groups from the index; only those that overlap the asked rows become partitions."""

    def partitions(self) -> list[BlockPart]:
        found = self._manifest()
        if found is None:
            system, path = _file(self.path)
            with system.open_input_file(path) as f:
                end = f.size()

                def at(offset: int, size: int) -> bytes:
                    f.seek(end + offset if offset < 0 else offset)
                    return f.read(size)

                found = [["", *entry] for entry in read_index(at)] if end else []
        out, first = [], 0
        for i, (part, offset, size, rows, kind, crc) in enumerate(found):
            if self._wanted(first, rows):
                out.append(BlockPart(i, offset, size, first, kind, crc, part))
            first += rows
        return out

    def read(self, part: BlockPart | None) -> Iterator[tuple]:
        if part is None:  # Spark asks once where there are no partitions
            return
        yield from self._emit(part, opened_group(self._data(part), codec_of(self.codec), part.crc32, part.kind == 1))


@dataclass
class Written(WriterCommitMessage):
    #: (place, rows, kind, crc32, size, file, offset) of each block of a task
    pieces: list[tuple[str, int, int, int, int, str, int]]


class ArchiveWriter(DataSourceWriter):
    """Rows of BLOCKS, in the order of ``place``. Each task writes a file. With option ``parts`` the archive is a folder: the
    files stay as they are, and the commit writes a manifest. Without it the commit joins them into one file. Either way the
    archive appears whole or not at all."""

    def __init__(self, options: dict, indexed: bool):
        self.path, self.indexed, self.key = options["path"], indexed, uuid.uuid4().hex
        self.parts = options.get("parts", "false") == "true"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, path = _file(self.path)
        task = f"{self.key}.{TaskContext.get().partitionId()}.{TaskContext.get().taskAttemptId()}"
        part = f"{path}/part-{task}" if self.parts else f"{path}.{task}"
        pieces, at = [], 0
        if self.parts:
            system.create_dir(path, recursive=True)
        f = None  # a task without rows leaves no file
        for row in iterator:
            f = f or system.open_output_stream(part)
            f.write(bytes(row.data))
            pieces.append((row.place, row.num_rows, row.kind, row.crc32, len(row.data), part, at))
            at += len(row.data)
        if f:
            f.close()
        return Written(pieces)

    def commit(self, messages: list) -> None:
        system, path = _file(self.path)
        pieces = sorted(p for m in messages if m for p in m.pieces)
        if self.parts:
            system.create_dir(path, recursive=True)
            listed = [[os.path.basename(part), offset, size, rows, kind, crc] for _, rows, kind, crc, size, part, offset in pieces]
            with system.open_output_stream(f"{path}/.{self.key}") as out:
                out.write(json.dumps(listed).encode())
            system.move(f"{path}/.{self.key}", f"{path}/{MANIFEST}")
            return
        entries, at = [], 0
        with system.open_output_stream(f"{path}.{self.key}.whole") as out:
            for _, rows, kind, crc, size, part, offset in pieces:
                with system.open_input_file(part) as f:
                    f.seek(offset)
                    out.write(f.read(size))
                entries.append((at, size, rows, kind, crc))
                at += size
            if self.indexed:
                out.write(index_bytes(entries, at))
        system.move(f"{path}.{self.key}.whole", path)
        self._clean(messages)

    def abort(self, messages: list) -> None:
        self._clean(messages)

    def _clean(self, messages: list) -> None:
        system, _ = _file(self.path)
        for part in {p[5] for m in messages if m for p in m.pieces}:
            system.delete_file(part)


class ChunkReader(DataSourceReader):
    """Files as blocks of about ``chunk_bytes``: a chunk holds the lines that begin in its range of bytes. A task reads its own
    range alone, whatever the size of the file."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("chunk_bytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _file(self.path)
        found = system.get_file_info(fs.FileSelector(path)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not os.path.basename(x.path).startswith((".", "_")))
        return [ChunkPart(p, at, min(at + self.size, n), i) for p, n in files for i, at in enumerate(range(0, n, self.size))]

    def read(self, part: ChunkPart | None) -> Iterator[tuple]:
        if part is None:
            return
        system, _ = _file(self.path)
        with system.open_input_file(part.path) as f:
            begin = _next_line(f, part.begin)
            end = _next_line(f, part.end)
            if begin < end:
                f.seek(begin)
                yield f"{part.path}#{part.number:09d}", f.read(end - begin)


@dataclass
class ChunkPart(InputPartition):
    path: str
    begin: int
    end: int
    number: int


def _next_line(f, at: int) -> int:
    """Where the first line begins at or behind a position."""
    if at == 0:
        return 0
    f.seek(at - 1)
    while data := f.read(1 << 16):
        if (found := data.find(b"\n")) >= 0:
            return f.tell() - len(data) + found + 1
    return f.tell()


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linemill-chunks"

    def schema(self) -> str:
        return "block_id string, payload binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkReader(self.options)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linemill"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options, False)


class IndexedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linemill-indexed"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return IndexedReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options, True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(IndexedSource)
    spark.dataSource.register(ChunkSource)


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = 64 << 20) -> DataFrame:
    """(block_id, payload): files, or all files of a folder, in chunks of whole lines; one task a chunk."""
    register(spark)
    return spark.read.format("linemill-chunks").option("path", path).option("chunk_bytes", str(chunk_bytes)).load()


def write_archive(encoded: DataFrame, path: str, parts: bool = False) -> None:
    """Encoded blocks (see ``plans.engine.encode``) to one archive, in the order of block_id; ``parts``: to a folder of a
    file for each task, which nothing copies again."""
    register(encoded.sparkSession)
    head = encoded.select(F.col("block_id").alias("place"), F.col("n_lines").alias("num_rows"), F.when(F.col("flag") == RAW, 1).otherwise(0).alias("kind"), "crc32", "flag", "c_reg", "c_ids", "c_vars")

    def frame(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            data = [Stored(x["crc32"], x["c_reg"] or b"", x["c_ids"] or b"", x["c_vars"] or b"", x["flag"]).to_bytes() for x in rows]
            yield pa.record_batch([batch["place"], batch["num_rows"], batch["kind"], batch["crc32"], pa.array(data, pa.binary())], names=["place", "num_rows", "kind", "crc32", "data"])

    head.mapInArrow(frame, BLOCKS).write.format("linemill").option("path", path).option("parts", str(parts).lower()).mode("append").save()


def write_restored(decoded: DataFrame, path: str) -> None:
    """The bytes of blocks (block_id, payload) to one file, in the order of block_id."""
    register(decoded.sparkSession)
    rows = decoded.select(F.col("block_id").cast("string").alias("place"), F.lit(0).cast("long").alias("num_rows"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("crc32"), F.col("payload").alias("data"))
    rows.write.format("linemill").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str, codec: str | Codec = "xz", indexed: bool = False, rows: tuple[int, int] | None = None) -> DataFrame:
    """(block_id, row_no, line); ``rows``: first and last row wanted, from 0. An indexed archive opens no other groups."""
    register(spark)
    reader = spark.read.format("linemill-indexed" if indexed else "linemill").option("path", path).option("codec", portable(codec))
    return (reader.option("rows", f"{rows[0]}:{min(rows[1], LAST_ROW)}") if rows else reader).load()


def block_starts(parsed_lines: DataFrame, rows: int) -> DataFrame:
    """(block_id, first_row, first_group, num_rows): where each block stands in an indexed archive, blocks in order of
    block_id. One row for each block."""
    from pyspark.sql import Window

    before = Window.orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = parsed_lines.groupBy("block_id").agg((F.max("line_no") + 1).alias("num_rows"))
    before_it = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).cast("long")
    return counted.select("block_id", before_it(F.col("num_rows")).alias("first_row"), before_it(F.ceil(F.col("num_rows") / rows)).alias("first_group"), "num_rows")


def group_blocks(parsed_lines: DataFrame, rows: int, codec: str | Codec = "xz") -> DataFrame:
    """BLOCKS of an indexed archive from parsed lines (block_id, line_no, line, mode, skeleton, vars), in groups of rows of
    one block; groups are numbered over the blocks as ``block_starts`` has them. A group is guarded as a block is: one that
    is binary, collides or has too many templates is stored raw."""
    import zlib

    import pyarrow as pa

    from linemill.plans.engine import _reason, parsed_of
    from linemill.sources.framing import group_bytes

    c = codec_of(codec)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("line_no").combine_chunks()
        column = lambda name: pa.concat_arrays(table[name].chunks)
        lines = table["line"].to_pylist()
        plain = "".join(lines).encode()
        odd = sum(x < 9 or 13 < x < 32 for x in plain[:4096])
        hit = next((i for i, x in enumerate(lines) if PLACEHOLDER in x or SEPARATOR in x), -1)
        p = parsed_of(column("skeleton"), column("vars"), False)
        raw = odd / max(1, len(plain[:4096])) > 0.01 or _reason(p, table["mode"][0].as_py(), plain.count(b"\n"), hit) is not None
        data = c.compress(plain) if raw else group_bytes(p, c)
        return pa.table({"place": [f"{table['group_no'][0].as_py():020d}"], "num_rows": pa.array([table.num_rows], pa.int64()), "kind": pa.array([int(raw)], pa.int32()), "crc32": pa.array([zlib.crc32(plain)], pa.int64()), "data": pa.array([data], pa.binary())})

    starts = F.broadcast(block_starts(parsed_lines, rows).select(F.col("block_id").alias("_block"), "first_group"))
    numbered = parsed_lines.join(starts, F.col("block_id").eqNullSafe(F.col("_block")))
    return numbered.select((F.col("first_group") + F.floor(F.col("line_no") / rows)).cast("long").alias("group_no"), "line_no", "line", "mode", "skeleton", "vars").groupBy("group_no").applyInArrow(pack, BLOCKS)


def write_indexed(parsed_lines: DataFrame, path: str, rows: int = 100_000, codec: str | Codec = "xz", parts: bool = False) -> None:
    register(parsed_lines.sparkSession)
    group_blocks(parsed_lines, rows, codec).write.format("linemill-indexed").option("path", path).option("parts", str(parts).lower()).mode("append").save()


def read_rows_of_blocks(starts: DataFrame, path: str, codec: str, rows: tuple[int, int]) -> DataFrame:
    """(block_id, row_no, line): the rows asked for of each block of an indexed archive, row_no counted within its block;
    starts: ``block_starts`` of what was written. Opens no other groups."""
    spark = starts.sparkSession
    register(spark)
    found = [(r.block_id, r.first_row, r.first_row + rows[0], r.first_row + min(rows[1], r.num_rows - 1)) for r in starts.collect() if rows[0] < r.num_rows]
    asked = ",".join(f"{low}:{high}" for _, _, low, high in found) or f"{LAST_ROW}:{LAST_ROW}"
    lines = spark.read.format("linemill-indexed").option("path", path).option("codec", portable(codec)).option("rows", asked).load()
    of_block = F.broadcast(spark.createDataFrame(found, "block_id string, first_row long, low long, high long"))
    return lines.drop("block_id").join(of_block, F.col("row_no").between(F.col("low"), F.col("high"))).select("block_id", (F.col("row_no") - F.col("first_row")).alias("row_no"), "line")

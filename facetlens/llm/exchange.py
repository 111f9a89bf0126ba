"""Questions from blocks of rows to buckets of hashes and back, without moving the texts.

A table is scanned in blocks: rows of one input file whose row numbers share a
multiple of `ROWS`. A block packs what it asks (sorted hashes, delta-coded) for
each bucket of the hash space; a bucket sees the packs of all blocks, and its
answers are written to one side file for each block in the shared folder, which
the next scan of the block reads. Packs are aggregated inside the block first,
so a passage that many rows share costs one entry a block. A lost task is run
again from the scan or from the shuffle; side files are written whole, under
the same name with the same content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, only, parallel, prepare, written
from .tokens import filesystem

U = np.uint64
#: Rows in a block, and bytes of text that are worked on at once.
ROWS, BYTES = 4096, 4 << 20
PACK = "bucket int, block string, data binary"
ANSWER = "block string, data binary"


def blocks(docs: DataFrame) -> DataFrame:
    """block, row (its number in the file), doc_id, text. A frame that is no plain scan of files is written first, so that blocks are the same at each reading."""
    prepare(docs.sparkSession)
    block = F.concat_ws("#", "_metadata.file_path", (F.col("_metadata.row_index") / ROWS).cast("long").cast("string")).alias("block")
    columns = [block, F.col("_metadata.row_index").cast("long").alias("row"), F.col("doc_id").cast("long"), "text"]
    try:
        return docs.select(*columns)
    except AnalysisException:  # no files under it, so no _metadata
        return written(only(docs, "doc_id", "text"), "scan").select(*columns)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[int | None], list[bytes]]]:
    """(block, row numbers, ids, texts as UTF-8) of rows of one block, up to BYTES of text (one row at least)."""
    block, rows, ids, texts, size = None, [], [], [], 0
    for b in batches:
        for k, r, d, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            if ids and (k != block or size + len(raw) > BYTES):
                yield block, np.array(rows, np.int64), ids, texts
                rows, ids, texts, size = [], [], [], 0
            block = k
            rows.append(r)
            ids.append(d)
            texts.append(raw)
            size += len(raw)
    if ids:
        yield block, np.array(rows, np.int64), ids, texts


def marks(rows: np.ndarray, starts: np.ndarray, run: np.ndarray, flags: np.ndarray) -> bytes:
    """An answer: runs of strings by row and place in it, with a flag for each string of a run."""
    return parts(rows.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), run.astype("<u2").tobytes(), np.packbits(flags).tobytes())


def marked(answers: list[bytes], rows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Places of the flagged strings in a chunk whose rows begin at offset."""
    out = [np.zeros(0, np.int64)]
    for a in answers:
        (r, s, n, m), _ = split(a)
        r, s, n = np.frombuffer(r, "<i8"), np.frombuffer(s, "<i8"), np.frombuffer(n, "<u2").astype(np.int64)
        flags = np.unpackbits(np.frombuffer(m, np.uint8), count=int(n.sum())).astype(bool)
        at = np.minimum(np.searchsorted(rows, r), len(rows) - 1)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(np.where(rows[at] == r, offset[at] + s, -1), n)
        own = flags & (place >= 0)
        out.append(place[own] + inside[own])
    return np.concatenate(out)


def packed(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as byte planes of their differences, compressed."""
    import zstandard

    if not len(values):
        return b""
    gaps = np.diff(values, prepend=U(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, U)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(U), dtype=U)


def parts(*data: bytes) -> bytes:
    return b"".join([np.array([len(data), *map(len, data)], "<u4").tobytes(), *data])


def split(data: bytes, at: int = 0) -> tuple[list[bytes], int]:
    n = int(np.frombuffer(data, "<u4", 1, at)[0])
    sizes = np.frombuffer(data, "<u4", n, at + 4)
    at += 4 + 4 * n
    out = []
    for s in sizes.tolist():
        out.append(data[at : at + s])
        at += s
    return out, at


def ask(rows: DataFrame, make: Callable, answer: Callable, name: str, buckets: int = 0) -> str:
    """One round. make(block, rows, ids, texts, buckets) gives (bucket, data) packs; answer(bucket, [(block, data), ...]) gives
    (block, data) answers of one bucket. Returns the folder of the side files."""
    spark = rows.sparkSession
    n = buckets or parallel(spark)
    folder = new_path(spark, name)

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, numbers, ids, texts in chunks(batches):
            out = list(make(block, numbers, ids, texts, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([block] * len(out)), pa.array([o[1] for o in out], pa.binary())], ["bucket", "block", "data"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[tuple[str, bytes]]] = {}  # one bucket: a partition of the hash space
        for b in batches:
            for bucket, k, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seen.setdefault(bucket, []).append((k, d))
        for bucket, packs in seen.items():
            for block, data in answer(bucket, sorted(packs)):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([data], pa.binary())], ["block", "data"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        where.create_dir(base)
        block, held, done = None, [], 0

        def save() -> None:
            with where.open_output_stream(f"{base}/{side_name(block)}") as f:
                f.write(b"".join(held))

        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != block and held:
                    save()
                    held, done = [], done + 1
                block = k
                held.append(parts(d))
        if held:
            save()
            yield pa.RecordBatch.from_arrays([pa.array([done + 1], pa.int64())], ["n"])

    packs = rows.mapInArrow(asks, PACK).repartitionById(n, F.col("bucket")).mapInArrow(answers, ANSWER)
    written(packs.repartition(n, "block").sortWithinPartitions("block", "data").mapInArrow(store, "n long"), name + "-done")
    return folder


def side_name(block: str) -> str:
    return hashlib.md5(block.encode()).hexdigest()


class Side:
    """Answers to the block that is being read."""

    def __init__(self, folder: str):
        self.folder, self.block, self.found = folder, None, []

    def of(self, block: str) -> list[bytes]:
        if block != self.block:
            where, base = filesystem(self.folder)
            self.block, self.found, data, at = block, [], b"", 0
            from pyarrow import fs

            path = f"{base}/{side_name(block)}"
            if where.get_file_info(path).type == fs.FileType.File:
                with where.open_input_file(path) as f:
                    data = f.read()
            while at < len(data):
                got, at = split(data, at)
                self.found += got
        return self.found


#: An odd factor, its inverse modulo 2**64, and their powers: prefix sums of terms times powers give the hash of any run.
FACTOR = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", FACTOR), ("down", pow(FACTOR, -1, 1 << 64))):
            p = np.ones(size, U)
            p[1:] = U(base)
            _powers[name] = np.cumprod(p, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(terms: np.ndarray) -> np.ndarray:
    up, _ = powers(len(terms) + 1)
    out = np.zeros(len(terms) + 1, U)
    np.cumsum(terms * up[:-1], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of terms start..end-1, by the sums of prefix()."""
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]

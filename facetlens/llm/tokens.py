"""Token-id output in length-delimited binary records.

A shard file is the magic number, one byte for the width of an id (2 or 4) and
records of

    u64 length | u32 masked crc of the length | payload | u32 masked crc of the payload

all little-endian, where the payload is a byte that tells whether there is a
doc_id, the doc_id as i64 and the ids, and a masked crc is the CRC-32 c turned
right by 15 bits plus 0xA282EAD8. Beside each file an index holds the offset and
the number of ids of each record, as pairs of u64, for reads in shuffled order
(`Shard`). Files are ordered, and records within them, by doc_id.

Tasks write under names of their own attempt and report them, so a task that
runs again leaves a file that nothing refers to, never a broken one.

Defined results: a null or empty text gives the end id alone; rows without
doc_id come first; rows of one doc_id are ordered by their ids; an empty table
gives no files; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, only, parallel, prepare, spread, written

MAGIC = b"FLTOKENS"
END = 0
#: Words whose ids a worker remembers before it starts afresh; only words that occur REMEMBER_FROM times in a chunk are.
REMEMBERED, REMEMBER_FROM = 200_000, 4
#: Bytes of text whose distinct words are looked up at once, and words that are put together at once.
CHUNK, SPAN = 24 << 20, 1 << 20
#: Stands before a unit that no space precedes.
MARK = "\x01"
#: A Latin letter before ASCII punctuation other than an apostrophe. White space beyond single spaces and up to two line ends between other characters: such texts are encoded whole.
LETTER_END = "([A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}])([!-&(-/:-@\\[-`{-~])"
ODD = "[ ][ \n]|\n |\n\n\n|[ \n]$|[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|" + MARK


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(take) -> bytes | None:
    """The next payload; take(n) gives n bytes, fewer at the end."""
    head = take(12)
    if not head:
        return None
    n, crc = struct.unpack("<QI", head)
    if masked(head[:8]) != crc:
        raise ValueError("corrupt record length")
    body = take(n + 4)
    if len(body) != n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("corrupt record")
    return body[:n]


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library.

    Byte-level pre-tokenisation cuts before a single space between other characters, around a line end between such, and
    between a Latin letter and ASCII punctuation behind it. So a text falls into units there, and the ids of a unit don't
    depend on what stands around it: each distinct unit of a chunk goes through the library once, and the texts are put
    together from the units' ids by array indexing. Texts with other white space or with added tokens are encoded whole, as
    all texts are if the tokenizer isn't byte-level of this kind."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.model.to_str())
        cutter = spec.get("pre_tokenizer") or {}
        self.by_units = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not spec.get("normalizer") and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges") and not spec.get("truncation") and not spec.get("padding")
        vocab = self.model.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[k for t, k in vocab.items() if t.startswith("\u0120")]] = True  # the byte-level sign of a space
        self.line = vocab.get("\u010a", -1)
        self.by_units = bool(self.by_units) and self.line >= 0
        self.odd = "|".join([ODD, *(re.sub(r"([^0-9A-Za-z])", r"\\\1", t["content"]) for t in spec.get("added_tokens") or [] if t["content"])])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        texts = [t or "" for t in texts]
        size = np.cumsum([0, *map(len, texts)])
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, size[a] + CHUNK, side="right")) - 1)
            yield from self._some(texts[a:b])
            a = b

    def _several(self, units: list[str], space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, one after another, and how many each has. They go through the library as one text, in which only a unit's first id starts with the space, or a line end follows each unit; where that doesn't hold each goes on its own."""
        if space:
            ids = np.array(self.model.encode_batch_fast([" " + " ".join(units)], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(self.spaced[ids])
            if len(cut) == len(units) and not cut[0]:
                return ids, np.diff(np.append(cut, len(ids)))
        else:
            ids = np.array(self.model.encode_batch_fast(["\n".join(units) + "\n"], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(ids == self.line)
            if len(cut) == len(units):
                return np.delete(ids, cut), np.diff(np.concatenate([[-1], cut])) - 1
        own = self.library([" " + u if space else u for u in units])
        return np.concatenate(own), np.array([len(x) for x in own])

    def _units(self, units: list[str], count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, at, size): the ids of units[k] are pool[at[k] : at[k] + size[k]]. A unit starts with MARK if no space precedes it."""
        get = self.known.get
        place = np.array([get(u, -1) for u in units], np.int64)
        new = np.flatnonzero(place < 0)
        at, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        old = place >= 0
        at[old], size[old] = self.at[place[old]], self.size[place[old]]
        parts, end = [self.pool], len(self.pool)
        plain, marked = [], []
        for k in new.tolist():
            u = units[k]
            (marked if u[:1] == MARK else plain).append(k)
        for space, rows in ((True, plain), (False, marked)):
            text = [units[k] if space else units[k][1:] for k in rows]
            for k in [k for k, t in zip(rows, text, strict=True) if not t or t == "\n"]:  # a space or a line end by itself, or nothing
                ids = self.library([" " + units[k] if space else units[k][1:]])[0]
                parts.append(ids)
                at[k], size[k], end = end, len(ids), end + len(ids)
            rows = [k for k, t in zip(rows, text, strict=True) if t and t != "\n"]
            for j in range(0, len(rows), 2048):
                some = rows[j : j + 2048]
                ids, n = self._several([units[k] if space else units[k][1:] for k in some], space)
                parts.append(ids)
                size[some] = n
                at[some] = end + np.cumsum(n) - n
                end += len(ids)
        pool = np.concatenate(parts)
        often = new[count[new] >= REMEMBER_FROM]
        if len(often):
            if len(self.known) + len(often) > REMEMBERED:
                self._forget()
                often = often[:REMEMBERED]
            first = len(self.pool)
            n = size[often]
            start = np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, pool[np.repeat(at[often] - start, n) + np.arange(n.sum())]])
            self.known.update(zip([units[k] for k in often.tolist()], range(len(self.at), len(self.at) + len(often)), strict=True))
            self.at, self.size = np.concatenate([self.at, first + start]), np.concatenate([self.size, n])
        return pool, at, size

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not self.by_units:
            yield from self.library(texts)
            return
        try:
            column = pa.array(texts, pa.large_string())
        except UnicodeEncodeError:  # half a surrogate pair, which the library takes as it may
            yield from self.library(texts)
            return
        whole = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False)
        if whole.any():
            column = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), column)
        column = pc.replace_substring(column, "\n", f" {MARK}\n {MARK}")
        column = pc.replace_substring_regex(column, LETTER_END, f"\\1 {MARK}\\2")
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), column, pa.scalar("", pa.large_string())), " ")
        code = lists.values.dictionary_encode()
        index = code.indices.to_numpy()
        units = code.dictionary.to_pylist()
        pool, at, size = self._units(units, np.bincount(index, minlength=len(units)))
        ends = lists.offsets.to_numpy().astype(np.int64)
        k = 0
        while k < len(texts):
            j = max(k + 1, int(np.searchsorted(ends, ends[k] + SPAN, side="right")) - 1)
            own = index[ends[k] : ends[j]]
            n = size[own]
            stop = np.cumsum(n)
            ids = pool[np.repeat(at[own] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
            cut = np.concatenate([[0], stop])[ends[k : j + 1] - ends[k]].tolist()
            for i in range(k, j):
                yield self.library([texts[i]])[0] if whole[i] else ids[cut[i - k] : cut[i - k + 1]]
            k = j


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END) -> DataFrame:
    """Writes shard files and their indexes; returns shard, path, n_records and n_tokens, a row for each file."""
    import zstandard

    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_path(spark, "tokens")
    df = only(spread(docs), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    n = parallel(spark)
    # Boundaries come from the ids alone: a range partitioning would encode every text twice to draw its sample.
    cut = F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5)), 10_000)
    bounds, rows_in, rows_known = df.agg(cut, F.count("*"), F.count("doc_id")).first()
    cuts = np.array(sorted(bounds or []), np.int64)
    # An id that is several boundaries has a shard for each, and rows without id have their share; checksums deal them out.
    unknown = -(-(rows_in - rows_known) * n // max(1, rows_in))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=1)
        tail = np.array([end], made.kind).tobytes()
        for b in batches:
            keys = b.column(0)
            known = keys.fill_null(0).to_numpy()
            low, high = np.searchsorted(cuts, known, side="left") + unknown, np.searchsorted(cuts, known, side="right") + unknown
            empty = keys.is_null().to_numpy(zero_copy_only=False)
            low[empty], high[empty] = 0, max(0, unknown - 1)
            crc, ids = [], []

            def out(at: int) -> pa.RecordBatch:
                own = slice(at - len(ids), at)
                check = np.array(crc, np.int64)
                to = low[own] + (check * np.maximum(1, high[own] - low[own] + empty[own]) >> 32)
                return pa.RecordBatch.from_arrays([keys[own.start : own.stop], pa.array(to.astype(np.int32)), pa.array(check), pa.array(ids, pa.binary())], ["doc_id", "shard", "crc", "ids"])

            k = 0
            for k, x in enumerate(made.batch(b.column(1).to_pylist()), 1):
                raw = x.tobytes() + tail
                crc.append(zlib.crc32(raw))
                ids.append(pack.compress(raw))
                if len(ids) >= 512:
                    yield out(k)
                    crc, ids = [], []
            if ids:
                yield out(k)

    rows = df.mapInArrow(encode, "doc_id long, shard int, crc long, ids binary")
    rows = rows.repartitionById(len(cuts) + 1 + unknown, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        unpack = zstandard.ZstdDecompressor()
        out = index = None
        at = records = tokens = 0
        for b in batches:
            for d, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if out is None:
                    where, base = filesystem(folder)
                    where.create_dir(base)
                    name = f"shard-{s:06d}-{uuid.uuid4().hex[:8]}"
                    out = where.open_output_stream(f"{base}/{name}.rec")
                    index = where.open_output_stream(f"{base}/{name}.idx")
                    at = out.write(MAGIC + bytes([made.kind.itemsize])) or len(MAGIC) + 1
                    shard = s
                ids = unpack.decompress(x.as_py())
                record = frame(struct.pack("<Bq", d is not None, d or 0) + ids)
                out.write(record)
                index.write(struct.pack("<QQ", at, len(ids) // made.kind.itemsize))
                at += len(record)
                records += 1
                tokens += len(ids) // made.kind.itemsize
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}.rec"]), pa.array([records], pa.int64()), pa.array([tokens], pa.int64())], ["shard", "path", "n_records", "n_tokens"])

    return written(rows.mapInArrow(store, "shard int, path string, n_records long, n_tokens long"), "shards")


def records_of(path: str, chunk: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record of a shard file, in order, without holding the file."""
    where, at = filesystem(path)
    with where.open_input_stream(at, buffer_size=chunk) as f:
        head = f.read(len(MAGIC) + 1)
        if head[:-1] != MAGIC:
            raise ValueError(f"{path} is no shard file")
        kind = np.dtype(f"<u{head[-1]}")
        while (body := unframe(f.read)) is not None:
            known, doc = struct.unpack("<Bq", body[:9])
            yield doc if known else None, np.frombuffer(body, kind, offset=9)


class Shard:
    """Records of one shard file by number, in any order, through its index."""

    def __init__(self, path: str):
        where, at = filesystem(path)
        with where.open_input_file(at[:-4] + ".idx") as f:
            self.index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
        self.file = where.open_input_file(at)
        self.kind = np.dtype(f"<u{self.file.read_at(1, len(MAGIC))[0]}")

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, k: int) -> tuple[int | None, np.ndarray]:
        offset = int(self.index[k, 0])

        def take(n: int) -> bytes:
            nonlocal offset
            data = self.file.read_at(n, offset)
            offset += n
            return data

        body = unframe(take)
        known, doc = struct.unpack("<Bq", body[:9])
        return doc if known else None, np.frombuffer(body, self.kind, offset=9)


def read_records(shards: DataFrame, digest: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record in the files (with ids in place of the checksum if not digest). start counts the ids of all records before it, in all files."""
    prepare(shards.sparkSession)
    # One row for each file, so a window without a key is small; it grows with the number of files alone.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = written(shards.coalesce(1).withColumn("before", F.coalesce(before, F.lit(0))).select("path", "before", "shard"), "files")
    files = files.repartition(parallel(shards.sparkSession), "shard")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                for doc, ids in records_of(path):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64)))
                    start += len(ids)
                    held += 1 if digest else len(ids)
                    if len(rows) >= 4096 or held >= 1 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    last = pa.int64() if digest else pa.list_(pa.int64())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        d, s, n, x = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(list(x), last)], ["doc_id", "start", "n_tokens", "x"])

    name = "ids_crc32" if digest else "ids"
    out = files.select("path", "before").mapInArrow(load, f"doc_id long, start long, n_tokens long, x {'long' if digest else 'array<long>'}")
    return out.withColumnRenamed("x", name)

"""Suffix-array dedup with a logarithmic index family.

Every byte covered by a LENGTH-byte string that starts anywhere else as well is
removed. `Family` holds the strings seen so far in levels, each a text with its
suffix array: starts in the order of the LENGTH bytes that follow, compared byte
by byte. A new batch gets its own suffix array; it is merge-scanned against each
level for matches over the whole LENGTH; what is new becomes a level, and levels
of equal size class merge, so there are logarithmically many.

Across a cluster one family serves each bucket of the hash space. A string
belongs to the bucket of its minimiser, the smallest hash of SEED bytes in it,
so equal strings meet. Consecutive strings of one minimiser form a segment.
First the minimisers alone are counted in all blocks; only segments whose
minimiser occurs again are sent, each distinct one once for a chunk (see
exchange). So unique text costs a few bytes for every 70, and a passage shared
by many documents one segment a chunk. Hashes only choose candidates; suffix
arrays decide on the bytes, and verdicts go back by row and place.

With `index`, a folder that all executors see, families are kept there: a later
call with further documents scans them against all documents of earlier calls
as well (and sends all segments, as any may occur there). A call that fails
leaves the index as it was; one call at a time.

Defined results: a null or empty text has no bytes; strings never cross rows;
rows without doc_id and rows that repeat one are documents like any other; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import drop_path
from .exchange import Side, U, ask, blocks, chunks, marked, marks, packed, parts, prefix, run_hashes, split, unpacked
from .shingles import mixed, sliding_min
from .substring_dedup import LOW, bits, by_bucket, found, spans_of
from .tokens import filesystem

LENGTH = 200
SEED = 64
SPAN = LENGTH - SEED + 1
#: Strings that are gathered before they become a batch of the family.
BATCH = 1_000_000
#: Buckets of an index that is kept.
BUCKETS = 256
_TERMS = mixed(np.arange(1, 257, dtype=U))


class Bytes:
    """The bytes of a chunk's texts in one row, with the segments of their strings of LENGTH bytes."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.n = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.sums = prefix(_TERMS[self.data])
        self.seg_start = self.seg_end = self.anchor = np.zeros(0, np.int64)
        self.mark = np.zeros(0, U)
        if len(self.data) < LENGTH:
            return
        at = np.arange(len(self.data) - SEED + 1)
        seed = mixed(run_hashes(self.sums, at, at + SEED))
        # the place in the low bits: of equal hashes the first is the minimiser
        low = sliding_min(seed >> U(30) << U(30) | at.astype(U), SPAN)
        doc = np.repeat(np.arange(len(texts)), self.n)
        ok = np.flatnonzero(doc[: len(low)] == doc[LENGTH - 1 : LENGTH - 1 + len(low)])
        if not len(ok):
            return
        anchor = (low[ok] & U((1 << 30) - 1)).astype(np.int64)
        new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(ok) != 1)) + 1
        first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(ok) - 1]])
        #: strings start at seg_start .. seg_end
        self.seg_start, self.seg_end, self.anchor = ok[first], ok[last], anchor[first]
        self.mark = seed[self.anchor]


def minimisers(block: str, rows: np.ndarray, ids: list, texts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    """For each bucket: the distinct minimisers, and whether each occurs twice here."""
    t = Bytes(texts)
    order = np.lexsort((t.mark & LOW, b := by_bucket(t.mark, buckets, 3)))
    b, v = b[order], (t.mark & LOW)[order]
    for bucket, x, y in spans_of(b):
        values, count = np.unique(v[x:y], return_counts=True)
        yield bucket, parts(packed(values), np.packbits(count > 1).tobytes())


def repeated(bucket: int, packs: list[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    got = []
    for block, data in packs:
        (v, m), _ = split(data)
        v = unpacked(v)
        got.append((block, v, bits(m, len(v))))
    allv = np.concatenate([g[1] for g in got])
    order = np.argsort(allv, kind="stable")
    values, first = np.unique(allv[order], return_index=True)
    good = values[np.add.reduceat(np.concatenate([1 + g[2] for g in got])[order], first) > 1]
    for block, v, _ in got:
        if len(own := v[found(good, v)]):
            yield block, packed(own)


def segments(folder: str | None):
    """For each bucket: the distinct segments of repeated minimisers (of all without a folder), how many strings each holds, and where they stand: row, first byte and number of the segment."""
    side = Side(folder) if folder else None

    def make(block: str, rows: np.ndarray, ids: list, texts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
        import zstandard

        t = Bytes(texts)
        take = np.arange(len(t.mark))
        if side:
            good = np.unique(np.concatenate([unpacked(d) for d in side.of(block)] or [np.zeros(0, U)]))
            take = np.flatnonzero(found(good, t.mark & LOW))
        b = by_bucket(t.mark[take], buckets, 3)
        order = np.argsort(b, kind="stable")
        take, b = take[order], b[order]
        doc = np.searchsorted(t.start + t.n, t.seg_start[take], side="right")
        zip_ = zstandard.ZstdCompressor(level=1)
        raw = t.data.tobytes()
        for bucket, x, y in spans_of(b):
            own = take[x:y]
            seen: dict[bytes, int] = {}
            number = [seen.setdefault(raw[s : e + LENGTH], len(seen)) for s, e in zip(t.seg_start[own].tolist(), t.seg_end[own].tolist(), strict=True)]
            run = np.array([len(s) - LENGTH + 1 for s in seen], "<u2")
            yield bucket, parts(zip_.compress(b"".join(seen)), run.tobytes(), np.array(number, "<u4").tobytes(), rows[doc[x:y]].astype("<i8").tobytes(), (t.seg_start[own] - t.start[doc[x:y]]).astype("<i8").tobytes())

    return make


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as numbers that compare like the bytes."""
    return np.ndarray((max(0, len(text) - 7),), ">u8", text.data, strides=(1,))[at].astype(U)


def rest_equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the strings at a and at b agree from depth to LENGTH."""
    out = np.ones(len(a), bool)
    open_ = np.arange(len(a))
    for k in range(depth, LENGTH, 8):
        same = words_at(text, a[open_] + k) == words_at(text, b[open_] + k)
        out[open_[~same]] = False
        open_ = open_[same]
        if not len(open_):
            break
    return out


def suffix_order(text: np.ndarray, at: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of LENGTH bytes at `at`, and which of them, in that order, differs from the one before. Equal ones stay as they stood.

    Eight bytes at a time, from the front; only strings that are still tied go on, and those of a tie that agree to the
    end, as repeats do, are told early. key: the first eight bytes, which as sorted runs merge in linear time."""
    key = words_at(text, at) if key is None else key
    order = np.argsort(key, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    settled = np.zeros(len(at), bool)
    for depth in range(8, LENGTH, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        own = np.flatnonzero(tied & ~settled)
        if not len(own):
            break
        group = np.cumsum(new)[own]
        if depth in (24, 64, 128):
            inner = np.flatnonzero(~new[own])
            equal = np.ones(len(own), bool)
            equal[inner] = rest_equal(text, at[order[own[inner]]], at[order[own[inner] - 1]], depth)
            head = np.flatnonzero(np.diff(group, prepend=-1))
            whole = np.repeat(np.minimum.reduceat(equal, head), np.diff(np.append(head, len(own))))
            settled[own[whole]] = True
            own, group = own[~whole], group[~whole]
            if not len(own):
                continue
        w = words_at(text, at[order[own]] + depth)
        sub = np.lexsort((w, group))
        order[own] = order[own[sub]]
        w = w[sub]
        new[own[1:]] |= (w[1:] != w[:-1]) & (group[1:] == group[:-1])
    return order, new


class Level:
    """A text with its suffix array: starts of distinct strings in order, their first eight bytes, and the number of the string that came first (-1: before this call)."""

    def __init__(self, text: np.ndarray, at: np.ndarray, key: np.ndarray, owner: np.ndarray):
        self.text, self.at, self.key, self.owner = text, at, key, owner

    def scan(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """Places in this and in the other suffix array of the strings they share: a merge of the parts that agree in eight bytes."""
        mine, theirs = np.flatnonzero(found(other.key, self.key)), np.flatnonzero(found(self.key, other.key))
        if not len(mine):
            return mine, theirs
        text = np.concatenate([self.text, other.text])
        at = np.concatenate([self.at[mine], other.at[theirs] + len(self.text)])
        order, new = suffix_order(text, at, np.concatenate([self.key[mine], other.key[theirs]]))
        second = np.flatnonzero(~new)  # strings of a level are distinct, so equals come in twos, this level's first
        return mine[order[second - 1]], theirs[order[second] - len(mine)]

    def merged(self, other: Level) -> Level:
        text = np.concatenate([self.text, other.text])
        at, key = np.concatenate([self.at, other.at + len(self.text)]), np.concatenate([self.key, other.key])
        order, _ = suffix_order(text, at, key)
        return Level(text, at[order], key[order], np.concatenate([self.owner, other.owner])[order])


class Family:
    """Levels of strings; add() marks the strings, old and new, that have an equal."""

    def __init__(self, levels: list[Level] | None = None):
        self.levels = levels or []
        self.marks: list[np.ndarray] = []
        self.count = 0

    def add(self, text: np.ndarray, at: np.ndarray, twice: np.ndarray) -> None:
        """A batch: a text, the starts of its strings, and whether each is known to occur twice."""
        own = twice.copy()
        self.marks.append(own)
        order, new = suffix_order(text, at)
        own[order[~new]] = True
        head = np.flatnonzero(new)
        own[order[head[np.diff(np.append(head, len(at))) > 1]]] = True
        first = order[head]
        batch = Level(text, at[first], words_at(text, at[first]), first + self.count)
        group = np.cumsum(new) - 1
        fresh = np.ones(len(first), bool)
        for level in self.levels:
            old, here = level.scan(batch)
            fresh[here] = False
            self._mark(level.owner[old])
        own[order[~fresh[group]]] = True
        self.count += len(at)
        if fresh.any():
            self.levels.append(Level(text, batch.at[fresh], batch.key[fresh], batch.owner[fresh]))
        while len(self.levels) > 1 and len(self.levels[-1].at).bit_length() >= len(self.levels[-2].at).bit_length():
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))

    def _mark(self, owners: np.ndarray) -> None:
        owners = owners[owners >= 0]
        ends = np.cumsum([len(m) for m in self.marks])
        batch = np.searchsorted(ends, owners, side="right")
        for k in np.unique(batch):
            self.marks[k][owners[batch == k] - (ends[k] - len(self.marks[k]))] = True


def level_path(index: str, bucket: int, turn: int) -> str:
    return f"{index}/bucket-{bucket:05d}-{turn:08d}.npz"


def load_family(index: str, bucket: int, turn: int) -> Family:
    """The family as the last of the first `turn` calls that had strings of the bucket left it."""
    from pyarrow import fs

    where, base = filesystem(index)
    got = [f.base_name for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith(f"bucket-{bucket:05d}-")]
    got = sorted(n for n in got if int(n[13:21]) <= turn)
    if not got:
        return Family()
    with where.open_input_file(f"{base}/{got[-1]}") as f:
        data = np.load(io.BytesIO(f.read()))
    return Family([Level(data[f"text{k}"], data[f"at{k}"], words_at(data[f"text{k}"], data[f"at{k}"]), np.full(len(data[f"at{k}"]), -1)) for k in range(len(data.files) // 2)])


def save_family(family: Family, index: str, bucket: int, turn: int) -> None:
    where, base = filesystem(level_path(index, bucket, turn))
    out = io.BytesIO()
    np.savez(out, **{f"text{k}": x.text for k, x in enumerate(family.levels)}, **{f"at{k}": x.at for k, x in enumerate(family.levels)})
    with where.open_output_stream(base) as f:
        f.write(out.getvalue())


def matched(index: str | None = None, turn: int = 0):
    """To each block, its segments in which some string occurs again, with a flag for each string."""

    def answer(bucket: int, packs: list[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
        import zstandard

        numbers: dict[bytes, int] = {}
        got = []
        for block, data in packs:
            (text, run, n, r, s), _ = split(data)
            text, end, of = zstandard.ZstdDecompressor().decompress(text), 0, []
            for size in np.frombuffer(run, "<u2").tolist():
                of.append(numbers.setdefault(text[end : end + size + LENGTH - 1], len(numbers)))
                end += size + LENGTH - 1
            got.append((block, np.array(of)[np.frombuffer(n, "<u4")], np.frombuffer(r, "<i8"), np.frombuffer(s, "<i8")))
        times = np.bincount(np.concatenate([g[1] for g in got]), minlength=len(numbers))
        texts = list(numbers)
        del numbers
        run = np.array([len(t) - LENGTH + 1 for t in texts], np.int64)
        ends = np.cumsum(run)
        family = load_family(index, bucket, turn) if index else Family()
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH, side="right")))
            size = run[a:b]
            begin = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            family.add(np.frombuffer(b"".join(texts[a:b]), np.uint8), at, np.repeat(times[a:b] > 1, size))
            a = b
        if index:
            save_family(family, index, bucket, turn + 1)
        flags = np.concatenate(family.marks)
        begin = ends - run
        for block, n, r, s in got:
            size = run[n]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            own = flags[np.repeat(begin[n], size) + inside]
            some = np.add.reduceat(own.astype(np.int64), np.cumsum(size) - size) > 0
            if some.any():
                yield block, marks(r[some], s[some], size[some], own[np.repeat(some, size)])

    return answer


def turns(index: str) -> int:
    """Calls that the index holds."""
    from pyarrow import fs

    where, base = filesystem(index)
    where.create_dir(base)
    return max([int(f.base_name[5:]) for f in where.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("turn-")], default=0)


def remove_duplicates(docs: DataFrame, index: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) for every row of docs."""
    rows = blocks(docs)
    if index:
        turn = turns(index)
        side = ask(rows, segments(None), matched(index, turn), "segments", BUCKETS)
        where, base = filesystem(f"{index}/turn-{turn + 1:08d}")
        where.open_output_stream(base).close()
    else:
        known = ask(rows, minimisers, repeated, "minimisers")
        side = ask(rows, segments(known), matched(), "segments")
        drop_path(docs.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Side(side)
        for block, numbers, ids, texts in chunks(batches):
            n = np.array([len(x) for x in texts], np.int64)
            first = np.cumsum(n) - n
            start = marked(answers.of(block), numbers, first)
            edge = None
            if len(start):
                edge = np.zeros(int(n.sum()) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + LENGTH, -1)
                edge = np.cumsum(edge[:-1]) > 0
            removed, spans, kept, at = [], [], [], 0
            for x in texts:
                gone = edge[at : at + len(x)] if edge is not None else np.zeros(0, bool)
                at += len(x)
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if removed[-1] else 0)
                kept.append(np.frombuffer(x, np.uint8)[~gone].tobytes() if removed[-1] else x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""Substring dedup by fixed-block anchors.

The words of each document are cut into non-overlapping blocks of BLOCK words,
which are indexed. Every rolling window of BLOCK words probes the index. A
repeat of WINDOW words holds at least one whole block, so it shows as a hit.
Hits are extended to all windows of WINDOW words around them; their words are
compared as they are, and the smallest document that has a window keeps it. Runs
of windows that another document had first are the maximal exact repeats.

Index and probes are compared by hashes in buckets of the hash space (see
exchange), which only costs needless candidates where hashes collide. Windows
that agree in the hit of the smallest hash go to that hash's bucket together, as
one run of words, each distinct one once for a chunk; there their words decide.
Each window's verdict goes back by row and place, so texts are hashed twice and
moved only where they repeat.

Defined results: a null or empty text has no words; rows without doc_id neither
lose words nor make others lose them; rows of one doc_id are one document for
this purpose and take nothing from each other; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import Side, U, ask, blocks, chunks, marked, marks, packed, parts, prefix, run_hashes, split, unpacked
from .shingles import mixed, sliding_min, word_hashes

WINDOW = 50
BLOCK = 25
LOW = U((1 << 40) - 1)


class Words:
    """The words of a chunk's texts in one row of hashes."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.sums = prefix(mixed(word_hashes([w for ws in self.words for w in ws]) + U(1)))
        self.doc = np.repeat(np.arange(len(texts)), self.n)

    def windows(self, width: int) -> np.ndarray:
        """Starts of all windows inside one text."""
        at = np.arange(max(0, len(self.doc) - width + 1))
        return at[self.doc[at] == self.doc[at + width - 1]]

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        return mixed(run_hashes(self.sums, at, at + width) + U(width))


def by_bucket(h: np.ndarray, buckets: int, salt: int) -> np.ndarray:
    return ((mixed(h + U(salt)) >> U(40)) % U(buckets)).astype(np.int64)


def spans_of(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of runs in a sorted row."""
    if len(keys):
        cut = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
            yield int(keys[a]), a, b


def probes(block: str, rows: np.ndarray, ids: list, texts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    """For each bucket: the distinct probes, whether each occurs twice here, and whether it is an indexed block."""
    w = Words(texts)
    at = w.windows(BLOCK)
    h = w.hashes(at, BLOCK)
    order = np.lexsort((h & LOW, b := by_bucket(h, buckets, 1)))
    b, v, index = b[order], (h & LOW)[order], ((at - w.start[w.doc[at]]) % BLOCK == 0)[order]
    for bucket, x, y in spans_of(b):
        values, first, count = np.unique(v[x:y], return_index=True, return_counts=True)
        yield bucket, parts(packed(values), np.packbits(count > 1).tobytes(), np.packbits(np.maximum.reduceat(index[x:y], first)).tobytes())


def bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def hits(bucket: int, packs: list[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """To each block, its probes that are indexed blocks and occur at least twice in all."""
    got = []
    for block, data in packs:
        (v, m, i), _ = split(data)
        v = unpacked(v)
        got.append((block, v, bits(m, len(v)), bits(i, len(v))))
    allv = np.concatenate([g[1] for g in got])
    order = np.argsort(allv, kind="stable")
    values, first = np.unique(allv[order], return_index=True)
    count = np.add.reduceat(np.concatenate([1 + g[2] for g in got])[order], first)
    known = np.maximum.reduceat(np.concatenate([g[3] for g in got])[order], first)
    good = values[(count > 1) & known]
    for block, v, _, _ in got:
        if len(own := v[found(good, v)]):
            yield block, packed(own)


def found(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


NOT = np.iinfo(U).max
PLACE = U(30)


def extend(folder: str):
    """For each bucket: the distinct runs of words whose windows have their hit of the smallest hash in common, how many windows each holds, and where they stand: row, first word, doc_id and number of the run."""
    side = Side(folder)

    def make(block: str, rows: np.ndarray, ids: list, texts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
        import zstandard

        good = np.unique(np.concatenate([unpacked(d) for d in side.of(block)] or [np.zeros(0, U)]))
        if not len(good):
            return
        w = Words(texts)
        at = w.windows(BLOCK)
        h = w.hashes(at, BLOCK)
        hit = found(good, h & LOW)
        value = np.full(max(0, len(w.doc) - BLOCK + 1), NOT, U)
        value[at[hit]] = h[hit] >> PLACE << PLACE | at[hit].astype(U)
        at = w.windows(WINDOW)
        low = sliding_min(value, WINDOW - BLOCK + 1)[at]
        known = np.array([d is not None for d in ids])
        some = (low != NOT) & known[w.doc[at]]
        at, low = at[some], low[some]
        if not len(at):
            return
        anchor = (low & U((1 << int(PLACE)) - 1)).astype(np.int64)
        new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1)) + 1
        first, last = at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]
        b = by_bucket(w.hashes(anchor[np.concatenate([[0], new])], BLOCK), buckets, 2)
        order = np.argsort(b, kind="stable")
        words = [x for ws in w.words for x in ws]
        zip_ = zstandard.ZstdCompressor(level=1)
        for bucket, x, y in spans_of(b[order]):
            own = order[x:y]
            seen: dict[bytes, int] = {}
            number = [seen.setdefault(b" ".join(words[i : j + WINDOW]), len(seen)) for i, j in zip(first[own].tolist(), last[own].tolist(), strict=True)]
            doc = w.doc[first[own]]
            owner = np.array([ids[d] for d in doc.tolist()], "<i8")
            yield bucket, parts(zip_.compress(b"\n".join(seen)), np.array(number, "<u4").tobytes(), rows[doc].astype("<i8").tobytes(), (first[own] - w.start[doc]).astype("<i8").tobytes(), owner.tobytes())

    return make


def firsts(bucket: int, packs: list[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """To each block, its runs in which some window stands in a smaller document, with a flag for each window."""
    import zstandard

    numbers: dict[bytes, int] = {}
    got = []
    for block, data in packs:
        (texts, n, r, s, d), _ = split(data)
        of = np.array([numbers.setdefault(t, len(numbers)) for t in zstandard.ZstdDecompressor().decompress(texts).split(b"\n")])
        got.append((block, of[np.frombuffer(n, "<u4")], np.frombuffer(r, "<i8"), np.frombuffer(s, "<i8"), np.frombuffer(d, "<i8")))
    low = np.full(len(numbers), np.iinfo(np.int64).max)
    for _, n, _, _, d in got:
        np.minimum.at(low, n, d)
    least: dict[bytes, int] = {}
    windows: list[list[bytes]] = []
    for text, doc in zip(numbers, low.tolist(), strict=True):
        cut = [-1, *(np.flatnonzero(np.frombuffer(text, np.uint8) == 32)).tolist(), len(text)]
        own = [text[cut[k] + 1 : cut[k + WINDOW]] for k in range(len(cut) - WINDOW)]
        windows.append(own)
        for x in own:
            if doc < least.get(x, NOT):
                least[x] = doc
    run = np.array([len(own) for own in windows], np.int64)
    begin = np.cumsum(run) - run
    least_of = np.array([least[x] for own in windows for x in own], np.int64)
    for block, n, r, s, d in got:
        size = run[n]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flags = least_of[np.repeat(begin[n], size) + inside] < np.repeat(d, size)
        some = np.add.reduceat(flags.astype(np.int64), np.cumsum(size) - size) > 0
        if some.any():
            yield block, marks(r[some], s[some], size[some], flags[np.repeat(some, size)])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text that stays) for every row of docs."""
    rows = blocks(docs)
    side = ask(rows, probes, hits, "block-hits")
    side = ask(rows, extend(side), firsts, "first-windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Side(side)
        for block, numbers, ids, texts in chunks(batches):
            words = [t.split() for t in texts]
            n = np.array([len(x) for x in words], np.int64)
            start = np.cumsum(n) - n
            gone = np.zeros(int(n.sum()) + 1, np.int64)
            at = marked(answers.of(block), numbers, start)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + WINDOW, -1)
            gone = np.cumsum(gone[:-1]) > 0
            removed, kept = [], []
            for k, own_words in enumerate(words):
                own = gone[start[k] : start[k] + n[k]]
                removed.append(int(own.sum()))
                kept.append(b" ".join([x for x, g in zip(own_words, own.tolist(), strict=True) if not g] if removed[-1] else own_words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode("utf-8", "surrogatepass") for x in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")

"""MinHash near-dedup: chosen-path set similarity join.

Each distinct set of word shingles gets a signature of minwise tokens. Trees
branch documents by selected tokens: the root of tree t by token t, so that
documents that share it meet in a node. Small nodes are compared exhaustively.
In larger nodes every document is compared with one leader; the few that
aren't like it are held against the rest, and where they are many the node
branches again by two tokens that its path selects, none of them shared by the
path already, and so on. A pair of similarity 0.8 shares none of twelve roots in
4 of 10**9 cases (0.2**12). Where nodes branch, each level loses (1 - 0.8)**2 of
a tree's chance, so that four levels leave 0.68 of it and twelve trees miss the
pair in about 1 of 10**6 cases; one of 0.85 in under 1 of 10**7. The trees share
one signature of 32 tokens, so inner branches of different trees aren't quite
independent.

Tokens only propose: links are confirmed on the full sets, inside the node, by
a scan that compares every document outside the node's largest component with
all others. So copies of one text cost one comparison each, not one for every
pair, and no pair of the node is left undecided. Equal sets are one vertex.

Defined results: texts without words (null, empty, blank) have an empty set and
are linked with nothing; texts of fewer words than a shingle are one shingle;
rows without doc_id are linked with nothing, belong to no component and stay;
rows that repeat a doc_id share its vertex if their texts are equal; an empty
table gives an empty result; further columns are ignored by `components` and
kept by `near_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, only, parallel, prepare, spread, written
from .shingles import U, mixed, shingle_set

#: Tokens in a signature, independent trees, largest node that is compared at once, levels, and tokens that a node branches by.
TOKENS, TREES, SMALL, LEVELS, FAN = 32, 12, 64, 4, 2
#: Trees confirmed together; later ones skip nodes whose documents are known to be one component.
PHASES = ((0, 1), (1, TREES))
#: Share of equal tokens from which a pair is confirmed on full sets: 0.8 is below 16 of 32 once in 10**4 a tree, over twelve trees never.
MAYBE = 14
#: Documents of one large node, and shingles of them, that a task holds at once.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000

_ODD = mixed(np.arange(1, TOKENS + 1, dtype=U)) | U(1)
_XOR = mixed(np.arange(1001, TOKENS + 1001, dtype=U))


def signature(s: np.ndarray) -> tuple[bytes, bytes]:
    """TOKENS minwise tokens of 16 bits, to compare and to branch inside a node by, and the first TREES of them in 64 bits, which are the roots."""
    low = np.full(TOKENS, U(2**64 - 1))
    for k in range(0, len(s), 4096):
        part = s[k : k + 4096]
        low = np.minimum(low, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    low = mixed(low)
    return (low >> U(48)).astype("<u2").tobytes(), low[:TREES].astype("<u8").tobytes()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (128 bits of it), sig and roots."""
    prepare(docs.sparkSession)
    df = only(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, sig, roots = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                k1.append(int(s.sum(dtype=U).astype(np.int64)))
                k2.append(int(mixed(s + U(77)).sum(dtype=U).astype(np.int64)))
                tokens, root = signature(s) if len(s) else (None, None)
                sig.append(tokens)
                roots.append(root)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary()), pa.array(roots, pa.binary())], ["doc_id", "n", "k1", "k2", "sig", "roots"])

    return df.mapInArrow(run, f"doc_id {df.dtypes[0][1]}, n long, k1 long, k2 long, sig binary, roots binary")


def token(sig: Column, at: Column | int) -> Column:
    return F.substring(sig, 2 * at + 1, F.lit(2)) if isinstance(at, Column) else F.substring(sig, 2 * at + 1, 2)


def alike(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sigs == one).sum(axis=1)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each node (first column), from batches sorted by it."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        node = b.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(node[1:] != node[:-1]) + 1
        if rest and rest[-1].column(0)[0].as_py() != node[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        last = 0
        for c in cut:
            yield pa.Table.from_batches([*rest, b.slice(last, c - last)])
            rest, last = [], c
        rest.append(b.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each small node (node, id, tree, sig), the documents that have a partner of at least MAYBE equal tokens."""
    out: list[tuple[np.ndarray, ...]] = []
    for t in grouped(batches):
        sigs = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u2").reshape(-1, TOKENS)
        ok = np.zeros(len(sigs), bool)
        for k in range(len(sigs) - 1):
            near = alike(sigs[k + 1 :], sigs[k]) >= MAYBE
            ok[k + 1 :] |= near
            ok[k] |= near.any()
        if ok.any():
            out.append(tuple(t.column(i).to_numpy()[ok] for i in range(3)))
        if len(out) >= 2000:
            yield packed(out)
            out = []
    if out:
        yield packed(out)


def packed(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], ["node", "id", "tree"])


def sorted_nodes(df: DataFrame) -> DataFrame:
    return df.repartition(parallel(df.sparkSession), "node").sortWithinPartitions("node", "id")


def proposals(sets: DataFrame) -> DataFrame:
    """node, id, tree of the documents to confirm. sets: id, sig, roots."""
    roots = F.explode(F.array(*[F.struct(F.xxhash64(F.lit(t), F.substring("roots", 8 * t + 1, 8)).alias("node"), F.lit(t).alias("tree")) for t in range(TREES)])).alias("r")
    # Most roots hold one document, so tokens join them only once those are gone.
    # path: a bit for each token that the documents of a node share by how they got there
    nodes = sets.select("id", roots).select("r.node", "id", "r.tree", F.expr("shiftleft(1L, r.tree)").alias("path"))
    found, smalls = [], []
    for level in range(LEVELS + 1):
        stat = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("leader"), F.bit_xor(F.xxhash64("id")).alias("who")).where("size > 1")
        # Nodes of the same documents are one node, whatever tree they stand in.
        stat = stat.groupBy("size", "leader", "who").agg(F.min("node").alias("node")).drop("who")
        members = nodes.join(stat, "node")
        members = written(members if level else members.join(sets.select("id", "sig"), "id").select("node", "id", "tree", "path", "sig", "size", "leader"), "nodes")
        smalls.append(members.where(F.col("size") <= SMALL).select("node", "id", "tree", "sig"))
        large = members.where(F.col("size") > SMALL)
        lead = large.where("id = leader").select("node", F.col("sig").alias("lead")).dropDuplicates(["node"])
        same = reduce(lambda a, b: a + b, [(token(F.col("sig"), k) == token(F.col("lead"), k)).cast("int") for k in range(TOKENS)])
        large = written(large.join(lead, "node").withColumn("near", same >= MAYBE), "large")
        if large.isEmpty():
            break
        stars = large.where("near or id = leader").select("node", "id", "tree")
        if level == LEVELS:  # what has shared five tokens and is still many is compared as it is
            stars = large.select("node", "id", "tree")
        found.append(stars)
        # A node whose documents are all like the leader is settled by its star. Where at most SMALL are not, those few are
        # held against all others at once; only nodes with more of them branch.
        odd = large.groupBy("node").agg(F.sum((~F.col("near")).cast("int")).alias("odd")).where("odd > 0")
        large = large.join(odd, "node")
        few = large.where((F.col("odd") <= SMALL) & ~F.col("near")).select(F.col("node").alias("f_node"), F.col("id").alias("f_id"), F.col("sig").alias("f_sig"))
        equal = reduce(lambda a, b: a + b, [(token(F.col("sig"), k) == token(F.col("f_sig"), k)).cast("int") for k in range(TOKENS)])
        partners = large.where(F.col("near") & (F.col("odd") <= SMALL)).join(few, (F.col("node") == F.col("f_node")) & (equal >= MAYBE), "left_semi")
        few = large.where((F.col("odd") <= SMALL) & ~F.col("near"))
        # a node of its own: what is like the leader has been compared in the star
        found.append(written(partners.unionByName(few).select(F.xxhash64("node", F.lit("odd")).alias("node"), "id", "tree"), "odd"))
        rows = large.where(F.col("odd") > SMALL)
        free = F.expr(f"filter(sequence(0, {TOKENS - 1}), x -> (shiftright(path, x) & 1) = 0)")
        pick = lambda j: F.get("free", F.pmod(F.xxhash64("node") + j, F.size("free")).cast("int"))  # noqa: E731  FAN different ones
        rows = rows.withColumn("free", free)
        fan = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), pick(j).alias("at")) for j in range(FAN)])).alias("c")
        child = F.xxhash64("node", "c.j", token(F.col("sig"), F.col("c.at")))
        # written, as it is read twice: for the sizes of the nodes and for their members
        nodes = written(rows.select("node", "id", "tree", "path", "sig", fan).select(child.alias("node"), "id", "tree", F.expr("path | shiftleft(1L, c.at)").alias("path"), "sig"), "children")
    small = sorted_nodes(reduce(DataFrame.unionByName, smalls))
    found.append(written(small.mapInArrow(hopeful, "node long, id long, tree int"), "small"))
    return reduce(DataFrame.unionByName, found)


def confirm(percent: int, width: int):
    """Links of each node's documents: (node, id, label, probe, text) to (a, b), enough of them to join what belongs together."""

    def node_links(ids: np.ndarray, labels: np.ndarray, probe: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
        own = [shingle_set(t, width) for t in texts]
        size = np.array([len(s) for s in own])
        _, inv = np.unique(np.concatenate(own), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)])
        comp = np.unique(labels, return_inverse=True)[1].copy()
        done = np.zeros(len(ids), bool)
        mark = np.zeros(inv.max() + 1, bool)
        links = []
        some = probe.any()
        while True:
            if some:
                todo = np.flatnonzero(probe & ~done)
            else:
                todo = np.flatnonzero(~done & (comp != np.bincount(comp).argmax()))
            if not len(todo):
                return links
            x = int(todo[0])
            done[x] = True
            mark[inv[start[x] : start[x + 1]]] = True
            both = np.add.reduceat(mark[inv].astype(np.int64), start[:-1])
            mark[inv[start[x] : start[x + 1]]] = False
            near = np.flatnonzero((100 * both >= percent * (size + size[x] - both)) & (comp != comp[x]))
            for y in near:
                if comp[y] != comp[x]:
                    links.append((int(ids[x]), int(ids[y])))
                    comp[comp == comp[y]] = comp[x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in grouped(batches):
            out += node_links(*(t.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)), t.column(4).to_pylist())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def confirmed(work: DataFrame, texts: DataFrame, labels: DataFrame | None, percent: int, width: int) -> list[DataFrame]:
    """Links (a, b) of the nodes of work (node, id, n) whose documents have several labels. Nodes of over BLOCK documents, or
    over BLOCK_SHINGLES shingles, are dealt out in blocks, each with the leader; documents that aren't linked to it are then held against every block."""
    work = work.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")) if labels is not None else work.withColumn("label", F.col("id"))
    stat = work.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("label").alias("l1"), F.max("label").alias("l2"), F.min("id").alias("leader")).where("l1 < l2").drop("l1", "l2")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.least(F.col("shingles") / BLOCK_SHINGLES, F.col("size") / 2)))
    rows = work.join(stat, "node").withColumn("blocks", blocks.cast("int"))
    whole = rows.where("blocks = 1").select("node", "id", "label", F.lit(False).alias("probe"))
    many = written(rows.where("blocks > 1"), "blocks")
    link = confirm(percent, width)
    check = lambda df: written(sorted_nodes(df.join(texts, "id").select("node", "id", "label", "probe", "text")).mapInArrow(link, "a long, b long"), "links")
    edges = [check(whole)]
    if many.isEmpty():
        return edges
    block = F.xxhash64("node", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")))
    head = many.where("id = leader").select("node", "id", "label", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    head = head.select(F.xxhash64("node", F.col("k").cast("int")).alias("node"), "id", "label", F.lit(True).alias("probe"))
    rest = many.where("id <> leader").select(F.xxhash64("node", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")).alias("node"), "id", "label", F.lit(False).alias("probe"))
    edges.append(check(head.unionByName(rest)))
    linked = edges[-1].select(F.col("a").alias("leader"), F.col("b").alias("id")).unionByName(edges[-1].select(F.col("b").alias("leader"), F.col("a").alias("id"))).distinct()
    odd = many.where("id <> leader").join(linked, ["leader", "id"], "left_anti")
    odd = odd.select("node", "id", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    odd = odd.select(F.xxhash64("node", F.col("k").cast("int")).alias("node"), "id", "label", F.lit(True).alias("probe"))
    against = rest.join(odd.select("node").distinct(), "node", "left_semi").join(odd.select("node", "id"), ["node", "id"], "left_anti")
    edges.append(check(odd.unionByName(against)))
    return edges


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """id, label: the smallest vertex reachable from each vertex of the edges (a, b), by passing on minima and jumping to the minimum's own."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("low"))
        step = labels.join(near, "id").withColumn("low", F.least("low", "label"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = written(step.join(jump, "low").select("id", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved")), "labels")
        over = new.where("moved").isEmpty()
        drop_written(labels)
        labels = new.drop("moved")
        if over:
            return labels


def components(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; kept is true for the smallest doc_id of each component."""
    spark = docs.sparkSession
    docs = spread(docs)
    sk = written(sketches(docs, width), "sketches")
    sets = written(sk.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("roots").alias("roots")), "sets")
    work = written(proposals(sets.select("id", "sig", "roots")).join(sets.select("id", "n"), "id"), "work")
    ids = work.select("id").distinct()
    texts = written(only(docs, "doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("id")).where("text is not null").select("id", "text").dropDuplicates(["id"]), "texts")
    edges: list[DataFrame] = []
    labels = None
    for low, high in PHASES:
        edges += confirmed(work.where((F.col("tree") >= low) & (F.col("tree") < high)).select("node", "id", "n").distinct(), texts, labels, percent, width)
        labels = smallest_reachable(reduce(DataFrame.unionByName, edges))
    drop_written(texts)
    own = sets.join(labels, "id", "left").select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("n").alias("sn"), F.coalesce("label", "id").alias("comp"))
    out = sk.join(own, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")) & (F.col("n") == F.col("sn")) & F.col("doc_id").isNotNull(), "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs without the documents that are like one of a smaller doc_id, all columns kept."""
    gone = components(docs, percent, width).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")

"""N-gram Jaccard join with PartEnum signatures: an exact self-join of documents at Jaccard 0.8 on word 5-shingles.

A document's set holds 64-bit hashes of its distinct 5-word shingles (its whole word sequence if shorter).  Equal sets are one node.

Signatures.  Sizes fall into bands [2**j, 2**(j+1)).  Band j has an instance: a partition of the feature domain, by hash, into
parts(j) parts.  A set enumerates its non-empty parts in its own instance, and in the next one if a similar set may lie there;
a part's content makes a signature.  Similar sets of sizes r and s differ in at most d = (r + s) / 9 <= min(r, s) / 4 features and
so in at most d parts.  In the common order of signatures by hash, the first size/4 + need(size) of two similar sets then share at
least need(the smaller size): no link is lost.  Should a set have fewer non-empty parts than it must show, its instance is split
finer for the whole corpus (``levels``).

Candidates.  Nodes that share fewer than need() signatures with others are out.  Each other node gets as pivot the node that heads
most of its signature groups (the one with most partners), and is verified against it; a large family is dealt out to tasks.  For two nodes x, y with one pivot p:
if both link to p they are connected; else a link needs (a) a common feature outside p, found by the d + 1 least such features, or
(b) that the parts of both inside p suffice: 9 |x & p|, 9 |y & p| >= 4 (r + s), possible only if one does not link to p and the
other is smaller than p.  Nodes with different pivots are (c) compared if they share one of the signatures that are left when
each has put aside its need() - 1 most frequent ones: of need() shared ones the rarest is left with both.  All other pairs cannot
link; so a family of n copies costs about n verifications, not n squared.  Verification intersects the sets themselves.

Hot signatures, of a passage that very many documents hold, are found on a sample; all of their nodes share them, so their rows
are spread by node instead of being gathered.  The sample only says which way a row goes; no row is left out.

Components come from star contraction over link tables.  Nothing of document scale reaches the driver; every intermediate table is
written to the shared folder.  Broadcasts happen below BROADCAST_ROWS counted rows only, else the join is shuffled.

Edge cases: null texts and texts without words have an empty set, link with nothing and are their own component; repeated rows
and equal texts are in one class; rows that share a doc_id are one document to the result's component; rows
without a doc_id link like others and take the component of those that have one; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, binary_column, discard, free, materialize, mix, prepare, slices, table, text_bytes, tidied, word_hashes, word_spans

SHINGLE = 5
BROADCAST_ROWS = 200_000
#: Bytes of texts, signatures and names of sets that a task holds at a time.
SLICE, ROWS, SEEN = 1 << 20, 1 << 17, 50_000
#: Signatures that HOT of about SAMPLE texts show are spread over tasks; a family of over FAMILY members is, too.
SAMPLE, HOT, FAMILY = 10_000, 20, 2_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_STEP = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for some in slices(column, SLICE):
        data, offsets = text_bytes(some)
        data = _LOWER[data]
        starts, ends, at = word_spans(data, offsets, _WORD)
        words = word_hashes(data, starts, ends)
        with np.errstate(over="ignore"):
            n = len(words) - SHINGLE + 1
            shingles = mix(sum((words[k : k + n] * _STEP[k] for k in range(SHINGLE)), np.zeros(max(n, 0), np.uint64))) if n > 0 else words[:0]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a >= SHINGLE:
                    yield np.unique(shingles[a : b - SHINGLE + 1])
                elif b > a:
                    yield mix(np.array([(words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
                else:
                    yield words[:0]


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s ^ _STEP[0]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def need(n: int) -> int:
    """How many signatures similar sets must share, by the smaller size; never falls as n grows."""
    return (n + 1) // 2 if n <= 64 else max(32, n // 20)


def shown(n: int) -> int:
    """How many signatures a set of size n shows in an instance."""
    return n // 4 + need(n)


def band(n: int) -> int:
    return n.bit_length() - 1


def instances(n: int) -> list[int]:
    """A set's own band, and the next one if a similar set can be there."""
    return [band(n)] + [band(n) + 1] * (n + n // 4 >= 2 << band(n))


def parts(j: int, level: int = 0) -> int:
    """Parts of instance j: enough that sets rarely have fewer non-empty parts than they show."""
    top = (2 << j) - 1
    p = max(1, -(-top // 3))
    while p < 32 * top:
        empty = math.exp(-top / p)
        if p * (1 - empty) - 6 * math.sqrt(p * empty * (1 - empty)) >= shown(top):
            break
        p += -(-p // 10)
    return p << 2 * level


def signatures(s: np.ndarray, j: int, p: int) -> np.ndarray:
    """All signatures of a set in instance j with p parts, in order; the lowest bit tells odd and even instances apart."""
    with np.errstate(over="ignore"):
        part = s % np.uint64(p)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.add.reduceat(mix(s + _STEP[1])[order], first)
        sig = mix(content + part[first] * _STEP[2] + np.uint64(j) * _STEP[3])
    return np.sort((sig & ~np.uint64(1)) | np.uint64(j & 1))


def level_of(s: np.ndarray, j: int) -> int:
    """The least level at which the set has as many non-empty parts as it shows."""
    level = 0
    while len(np.unique(s % np.uint64(parts(j, level)))) < shown(len(s)):
        level += 1
    return level


CLASSES = "doc_id long, h long, n long, node long, j int, level int, next_level int"


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, set size and node of every row; and what levels its instances need."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(2)):
                n = len(s)
                js = instances(n) if n else []
                rows.append((n, node_of(s) if n else None, js[0] if n else None, level_of(s, js[0]) if n else None, level_of(s, js[1]) if len(js) > 1 else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "h", "n", "node", "j", "level", "next_level"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, CLASSES)


def levels(found: DataFrame) -> dict[int, int]:
    """The level of each instance: at most 64 rows."""
    own = found.select("j", "level").where("level > 0")
    after = found.select((F.col("j") + 1).alias("j"), F.col("next_level").alias("level")).where("level > 0")
    return {r["j"]: r["level"] for r in own.unionByName(after).groupBy("j").agg(F.max("level").alias("level")).collect()}


def signature_rows(docs: DataFrame, level: dict[int, int]) -> DataFrame:
    """(sig, node, n) of every set; a task shows a set once for up to SEEN others between its copies."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes = set(), {}
        sigs, nodes, ns, held = [], [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal held
            counts = [len(x) for x in sigs]
            columns = [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), counts)), pa.array(np.repeat(np.array(ns, np.int32), counts))]
            sigs.clear(), nodes.clear(), ns.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=["sig", "node", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                n = len(s)
                if not n or (node := node_of(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                for j in instances(n):
                    if j not in sizes:
                        sizes[j] = parts(j, level.get(j, 0))
                    got = signatures(s, j, sizes[j])[: shown(n)]
                    sigs.append(got), nodes.append(node), ns.append(n)
                    held += len(got)
                if held >= ROWS:
                    yield done()
        if held:
            yield done()

    return docs.select("text").mapInArrow(run, "sig long, node long, n int")


def hot_signatures(docs: DataFrame, rows: int, level: dict[int, int]) -> DataFrame:
    """Signatures that many sets show, found on about SAMPLE texts: at most a bounded number of rows, however many texts there are."""
    some = docs.where(F.pmod(F.xxhash64(F.lit("hot"), "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, rows))))
    found = signature_rows(some, level).select("sig", "node").distinct().groupBy("sig").agg(F.count("*").alias("c"))
    return found.where(F.col("c") >= HOT).select("sig")


def _first_shared(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of signatures that two nodes or more show. Those of hot ones need no look at their others, so each goes its own way."""
    marked = rows.join(_small(hot).withColumn("hot", F.lit(True)), "sig", "left").withColumn("salt", F.when(F.col("hot"), F.col("node")).otherwise(0))
    w = Window.partitionBy("sig", "salt")
    marked = marked.withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w))
    return marked.where("hot OR lo <> hi").select("sig", "node", "n")


def _shared(rows: DataFrame, *more: str) -> DataFrame:
    """The rows of signatures that two nodes or more show, with more columns that differ, too: sums a signature, then a join that may be split."""
    by = ("node", *more)
    ends = rows.groupBy("sig").agg(*(f(c).alias(f"{c}{k}") for c in by for k, f in enumerate((F.min, F.max))))
    both = ends.where(" AND ".join(f"{c}0 <> {c}1" for c in by)).select("sig")
    return rows.join(both, "sig", "left_semi")


_EIGHTY = "CAST((4 * n + 4) DIV 5 AS INT)"
#: need() of the least size that may be similar to n.
_NEED = f"CASE WHEN {_EIGHTY} <= 64 THEN ({_EIGHTY} + 1) DIV 2 ELSE greatest(32, {_EIGHTY} DIV 20) END"


def _enough(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of nodes that, in an instance, have as many signatures left as a link needs."""
    odd = F.expr("sig & 1").alias("odd")
    counts = rows.groupBy("node", odd).agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.expr(f"c >= {_NEED}"))
    return rows.withColumn("odd", odd).join(counts.select("node", "odd"), ["node", "odd"], "left_semi").select(*by)


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows in the order in which one of them stands for others: those without a doc_id come last.
_ROW = "struct(doc_id IS NULL AS none, doc_id, h)"


def fetch_sets(docs: DataFrame, found: DataFrame, nodes: DataFrame, ws: Workspace) -> DataFrame:
    """(node, items) of the given nodes: their sorted features as bytes, from one document each; from one without a doc_id only if no other has the node."""
    first = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.expr(_ROW)).alias("r"))
    wanted = ws(first.select("r.*").distinct(), "wanted")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            at = np.concatenate([[0], np.cumsum([8 * len(s) for s in sets])])
            data = np.concatenate(sets).view(np.uint8) if sets else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), binary_column(data, at)], names=["node", "items"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = texts.join(_small(wanted.where("NOT none").select("doc_id", "h")), ["doc_id", "h"], "left_semi").select("text")
    alone = wanted.where("none").select("h")
    if not alone.isEmpty():
        rows = rows.unionByName(texts.where("doc_id IS NULL").join(_small(alone), "h", "left_semi").dropDuplicates(["h"]).select("text"))
    return rows.mapInArrow(run, "node long, items binary").where("node IS NOT NULL")


VERIFIED = "p long, x long, np long, nx long, inter long, own array<long>"


def verify(pairs: DataFrame, sets: DataFrame, ws: Workspace) -> DataFrame:
    """Sizes and intersection of each pair (p, x), and the least nx / 4 + 1 features of x outside p."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, x = batch.column(0), batch.column(1)
            a, b = (c.to_pylist() for c in batch.columns[2:])
            rows = []
            for u, v in zip(a, b, strict=True):
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                own = np.setdiff1d(v, u, assume_unique=True)
                rows.append((len(u), len(v), len(v) - len(own), own[: len(v) // 4 + 1].view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([p, x, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int64()))], names=["p", "x", "np", "nx", "inter", "own"])

    pairs = ws(pairs.select("p", "x").distinct(), "pairs")
    # A large family is dealt out: each part of it meets its own copy of the pivot's set.
    large = pairs.groupBy("p").agg(F.expr(f"count(*) DIV {FAMILY} + 1").alias("deal")).where("deal > 1")
    large = _small(ws(large, "large"))
    deal = F.coalesce("deal", F.lit(1))
    heads = pairs.select("p").distinct().join(large, "p", "left").select("p", F.explode(F.sequence(F.lit(0), (deal - 1).cast("int"))).alias("part"))
    members = pairs.join(large, "p", "left").select("p", "x", F.pmod(F.xxhash64("x"), deal).cast("int").alias("part"))
    left = sets.withColumnsRenamed({"node": "x", "items": "xs"}).join(_small(members), "x").select("p", "part", "x", "xs")
    right = sets.withColumnsRenamed({"node": "p", "items": "ps"}).join(_small(heads), "p").select("p", "part", "ps")
    # Python gets pairs of sets: a bounded number at a time.
    return ws(left.join(right, ["p", "part"]).select("p", "x", "ps", "xs").mapInArrow(run, VERIFIED), "verified")


LINK = "9 * inter >= 4 * (np + nx)"


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (a, b): star contraction until each node hangs on its least."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").where("b <> m").union(least).toDF("a", "b").distinct()
        after = materialize(small, "small")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        discard(large), discard(edges)
        if mark == before:
            return after.withColumnsRenamed({"a": "node", "b": "root"})
        before, edges = mark, after


def links(docs: DataFrame, found: DataFrame, ws: Workspace) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links."""
    level = levels(found)
    hot = ws(hot_signatures(docs, found.count(), level), "hot")
    shared = ws(_first_shared(signature_rows(docs, level), hot).distinct(), "shared")
    for k in range(2):
        less = ws(_shared(_enough(shared, ["sig", "node", "n"])), f"shared{k}")
        ws.drop(shared)
        shared = less
    # Pivots: the node with most partners heads a group; a node's pivot heads most of its groups.
    groups = shared.groupBy("sig").agg(F.count("*").alias("size"))
    weights = shared.join(groups, "sig").groupBy("node").agg(F.sum("size").alias("weight"))
    heads = shared.join(weights, "node").groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("head"))
    votes = shared.join(heads, "sig").groupBy("node", "head").agg(F.count("*").alias("votes"))
    pivots = votes.groupBy("node").agg(F.max(F.struct("votes", "head"))["head"]["node"].alias("p"))
    pivots = ws(pivots.select("p", F.col("node").alias("x")), "pivots")
    sets = ws(fetch_sets(docs, found, pivots.select(F.col("x").alias("node")), ws), "sets", "none")
    near = verify(pivots.where("p <> x"), sets, ws)
    first = components(near.where(LINK).select(F.col("p").alias("a"), F.col("x").alias("b")))
    ws.made.append(first)
    rest = verify(candidates(shared, pivots, near, first, ws), sets, ws).where(LINK)
    return near.where(LINK).select(F.col("p").alias("a"), F.col("x").alias("b")).unionByName(rest.select(F.col("p").alias("a"), F.col("x").alias("b")))


def rare(rows: DataFrame) -> DataFrame:
    """The rows without each node's most frequent signatures: one less than a link needs of an instance. Of the signatures that two similar sets share, the rarest stays with both."""
    size = rows.groupBy("sig").agg(F.count("*").alias("size"))
    order = Window.partitionBy("node", F.expr("sig & 1")).orderBy(F.desc("size"), "sig")
    return rows.join(size, "sig").withColumn("place", F.row_number().over(order)).where(F.expr(f"place >= {_NEED}")).drop("size", "place")


def candidates(shared: DataFrame, pivots: DataFrame, near: DataFrame, first: DataFrame, ws: Workspace) -> DataFrame:
    """Pairs (p, x) of nodes not connected yet that may link, by rules (a), (b) and (c)."""
    roots = first.select(F.col("node").alias("x"), "root")
    member = near.withColumn("near", F.expr(LINK)).join(roots, "x", "left").withColumn("root", F.coalesce("root", "x"))
    far = member.where("NOT near").select("p").distinct()
    # Only families with a member that does not link to the pivot are of interest.
    member = ws(member.join(far, "p", "left_semi"), "members")
    side = lambda s: member.select("p", *(F.col(c).alias(s + c) for c in ("x", "nx", "inter", "near", "root")), F.col("np"))
    u = side("u").where("NOT unear").drop("np")
    v = side("v")
    apart = F.expr("uroot <> vroot AND (vnear OR ux < vx) AND 5 * unx >= 4 * vnx AND 5 * vnx >= 4 * unx")
    e = lambda s: member.select("p", F.col("x").alias(s + "x"), F.explode("own").alias("e"))
    own = e("v").join(v, ["p", "vx"])
    other = e("u").join(u, ["p", "ux"])
    # What two sets share is at most what either has in p and what either has outside.
    fits = F.expr("9 * (least(uinter, vinter) + least(unx - uinter, vnx - vinter)) >= 4 * (unx + vnx)")
    a = other.join(own, ["p", "e"]).where(apart & fits).select(F.col("ux").alias("p"), F.col("vx").alias("x")).distinct()
    inside = F.expr("vnx < np AND 9 * least(uinter, vinter) >= 4 * (unx + vnx)")
    least = member.groupBy("p").agg(F.min("nx").alias("least"))
    edge = u.join(least, "p").where("9 * uinter >= 4 * (unx + least)").drop("least")
    # Either may be the smaller one; both may be apart from p.
    apart_b = F.expr("uroot <> vroot AND ux <> vx AND 5 * unx >= 4 * vnx AND 5 * vnx >= 4 * unx")
    b = edge.join(v.where("vnx < np"), "p").where(apart_b & inside).select(F.col("ux").alias("p"), F.col("vx").alias("x"))
    pivot = pivots.withColumnRenamed("x", "node").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = ws(shared.join(pivot, "node"), "placed")
    mixed = ws(_enough(_shared(mixed, "p", "root"), ["sig", "node", "n", "p", "root"]), "mixed")
    few = ws(rare(mixed), "rare")
    left = few.select("sig", *(F.col(c).alias("u" + c) for c in ("node", "n", "p", "root")))
    right = few.select("sig", *(F.col(c).alias("v" + c) for c in ("node", "n", "p", "root")))
    cross = left.join(right, "sig").where("unode < vnode AND up <> vp AND uroot <> vroot AND 5 * un >= 4 * vn AND 5 * vn >= 4 * un")
    c = cross.select(F.col("unode").alias("p"), F.col("vnode").alias("x"))
    return a.unionByName(b).unionByName(c).select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x")).distinct()


def rooted(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, set size and component's root (null without words) of every row."""
    prepare(docs.sparkSession)
    ws = Workspace()
    found = ws(classes(docs), "classes")
    roots = components(links(docs, found, ws))
    rows = found.select("doc_id", "h", "n", "node").join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    out = materialize(rows.select("doc_id", "h", "n", "root"), "rooted")
    ws.clear(), discard(roots)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    rows = rooted(docs)
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c"))
    # Most documents are alone. What is left is written, so that a large component's rows may be split in the join.
    least = _small(materialize(least.where("c > 1").select("root", "component_id"), "least"))
    some = rows.where("root IS NOT NULL").join(least, "root", "left").unionByName(rows.where("root IS NULL").withColumn("component_id", F.lit(None).cast("long")))
    return some.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every component: that of its least doc_id, and of the least hash of a text if these repeat; rows without words all stay."""
    id_, h, n = free(docs.columns, "id", "h", "n")
    rows = rooted(docs).where("root IS NOT NULL").groupBy("root", "doc_id", "h").agg(F.count("*").alias("c"))
    kept = rows.groupBy("root").agg(F.min(F.struct(F.expr(_ROW).alias("r"), "c")).alias("k"))
    kept = materialize(kept.select(F.col("k.r.doc_id").alias(id_), F.col("k.r.h").alias(h), F.col("k.c").alias(n)), "kept")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(h))
    empty = docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    once = docs.join(_small(kept.where(F.col(n) == 1).select(id_, h)), same, "left_semi").unionByName(empty)
    again = kept.where(F.col(n) > 1).select(id_, h)
    if again.isEmpty():
        return once
    # Rows that repeat a doc_id with its text.
    return once.unionByName(docs.join(_small(again), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op6_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(b), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(g)"""
}

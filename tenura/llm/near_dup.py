"""Near-duplicate documents by b-bit MinHash.

A document's set of word shingles is hashed by HASHES functions; of each function's minimum BITS low bits (after mixing)
are kept and packed into a signature, and groups of ROWS minima make the BANDS band keys. Documents with equal sets are
one class, of which one representative goes on. Candidates are representatives that share a band key. The share of equal
signature lanes, counted with bit operations and corrected for chance collisions, estimates their similarity; those near
the threshold or above are confirmed on the full sets, which are made again from the texts.

Candidates are searched in three steps, so that large groups of near copies never meet pair by pair: two star steps
(over a few bands, then over all) compare each member of a bucket with one member of another component. Stars have two
levels: a bucket is dealt into parts, members meet the hub of their part, and the hubs of parts meet the bucket's; with
as many parts as the root of all classes, no hub meets more than a few times that many. A last step finds, within each
bucket that still holds several components and in blocks, which classes may be linked to which other component, and
compares each of those with all members of that component, again in blocks, which give only links. Pairs of one
component need no comparison, as they change no component.

Full sets are made once for each class that shares a bucket, and written as packed 64-bit hashes; a hub's set is sent
once to each block of its partners. Tables written on the way are deleted at the end, but for that of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, filtered, looked_up, map_arrow, mix64, relieve, scratch, table, words_of, written
from .components import components

ROWS, BANDS, BITS = 6, 40, 4
HASHES = ROWS * BANDS
LANES = 64 // BITS
WORDS64 = HASHES // LANES
FIRST_BANDS = 4
#: Rows of a bucket that meet within one cell of the last step, and partners that one copy of a hub's set serves.
CELL = 256
#: Words whose hashes a worker remembers.
KNOWN = 100_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


class Shingler:
    """Distinct shingles of `size` words as sorted 64-bit hashes; fewer words make one shingle, none make none."""

    def __init__(self, size: int):
        self.size = size
        self.hashes = WordHashes(KNOWN)

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes.array(words)
        k = min(self.size, len(h))
        n = len(h) - k + 1
        total = np.full(n, (k * 0x2545F4914F6CDD1D) & (2**64 - 1), np.uint64)
        for j in range(k):
            total += h[j : j + n] * ODD[j % 8] + (h[j : j + n] >> np.uint64(31)) * ODD[(j + 3) % 8]
        return np.unique(mix64(total))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 2048) -> np.ndarray:
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), block):
        h = np.multiply.outer(a, x[i : i + block])
        h += b[:, None]
        np.minimum(out, h.min(1), out=out)
    return out


def signatures(low: np.ndarray) -> np.ndarray:
    """(n, WORDS64) packed lanes of rows of minima."""
    lane = mix64(low.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))) >> np.uint64(64 - BITS)
    lane = lane.reshape(len(low), WORDS64, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(lane, axis=2)


def band_keys(low: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys, different for the same minima in different bands."""
    m = low.astype(np.uint64).reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD[0], m.shape[:2])
    for j in range(ROWS):
        key = mix64(key ^ (m[:, :, j] + ODD[1]))
    return key.view(np.int64)


def fold(x: np.ndarray) -> np.ndarray:
    """Lanes that differ, of xored signatures (..., WORDS64)."""
    x = x | (x >> np.uint64(1))
    x = x | (x >> np.uint64(2))
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


def most_differing(percent: int, sigmas: float = 4.5) -> int:
    """Lanes that may differ at most between documents of that similarity, but for chances of about one in 300,000.

    Equal lanes have probability s + (1 - s) / 2^BITS at similarity s: the correction for chance collisions.
    """
    s = percent / 100
    p = (1 - s) * (1 - 2.0**-BITS)
    return int(np.ceil(HASHES * p + sigmas * np.sqrt(HASHES * p * (1 - p))))


def differing(a: Column, b: Column) -> Column:
    """As `fold`, in the JVM, over arrays of longs."""

    def lanes(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))).cast("int")

    return F.aggregate(F.zip_with(a, b, lambda x, y: lanes(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


SIGNED = "row long, doc_id long, text_hash long, n_shingles long, f1 long, f2 long, signature array<long>, bands array<long>"


def signed(docs: DataFrame, size: int) -> DataFrame:
    """One row for each document (doc_id, text, text_hash): a number of its own (stable once written), set size, fingerprint of the set, signature and band keys (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (a, b) = Shingler(size), functions()
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for r in batches:
            n, f1, f2, low, full = [], [], [], [], []
            for i, text in enumerate(r.column("text")):
                s = shingles(text.as_py())
                n.append(len(s))
                if len(s):
                    f1.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(mix64(s ^ ODD[2]).sum(dtype=np.uint64).view(np.int64)))
                    low.append(minima(s, a, b))
                    full.append(i)
                else:  # spread over partitions; no class has an empty set
                    f1.append(row + i)
                    f2.append(0)
            sig: list = [None] * len(n)
            keys: list = [None] * len(n)
            if full:
                m = np.stack(low)
                for i, s, k in zip(full, signatures(m).view(np.int64), band_keys(m), strict=True):
                    sig[i], keys[i] = s, k
            kind = pa.list_(pa.int64())
            ids = pa.array(np.arange(row, row + len(n)))
            row += len(n)
            columns = [ids, r.column("doc_id"), r.column("text_hash"), *(pa.array(x, pa.int64()) for x in (n, f1, f2)), pa.array(sig, kind), pa.array(keys, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text_hash", "n_shingles", "f1", "f2", "signature", "bands"])

    return map_arrow(docs.select("doc_id", "text", "text_hash"), run, SIGNED)


def sets_of(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, set), the sorted shingle hashes as packed bytes, of nodes (node, doc_id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for r in batches:
            for i in range(0, r.num_rows, 200):
                part = r.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingles(x.as_py()).tobytes() for x in part.column("text")], pa.binary())], ["node", "set"])

    key = ["doc_id", "text_hash"]
    likely = filtered(docs, [F.col(c) for c in key], nodes.select(*key), "likely").where("likely").drop("likely")
    found = likely.join(nodes, key).select("node", "text").dropDuplicates(["node"])
    return written(map_arrow(found, run, "node long, set binary"), "sets")


def common_of(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def meeting(percent: int):  # noqa: ANN201
    """A mapInArrow function over rows (c, i, j, side, node, signature, set) sorted by cell (c, i, j) and side: links (a, b) between the rows of either side of a cell."""
    most = most_differing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets, sigs, packed = None, [], [], [], None
        for r in batches:
            out_a, out_b = [], []
            cells = zip(*(r.column(k).to_pylist() for k in ("c", "i", "j", "side", "node")), strict=True)
            signature = r.column("signature").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS64)
            for (c, i, j, side, node), sig, packed_set in zip(cells, signature, r.column("set"), strict=True):
                if (c, i, j) != cell:
                    cell, nodes, sets, sigs, packed = (c, i, j), [], [], [], None
                mine = np.frombuffer(packed_set.as_py(), np.uint64)
                if side == 0:
                    nodes.append(node)
                    sets.append(mine)
                    sigs.append(sig.copy())
                elif nodes:
                    packed = np.stack(sigs) if packed is None else packed
                    for k in np.flatnonzero(fold(packed ^ sig) <= most).tolist():
                        both = common_of(mine, sets[k])
                        if 100 * both >= percent * (len(mine) + len(sets[k]) - both) and both:
                            out_a.append(min(node, nodes[k]))
                            out_b.append(max(node, nodes[k]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def linked(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in cells: rows (c, i, j, side, node, signature, set)."""
    dealt = cells.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "side")
    return map_arrow(dealt, meeting(percent), "a long, b long")


def cell_pairs(most: int):  # noqa: ANN201
    """A mapInArrow function over rows sorted by cell: (x, other), a class and the component of a smaller label that holds one with at most `most` lanes differing from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def met(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            cell = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            node, comp, side = (t.column(c).to_numpy() for c in ("node", "comp", "chunk"))
            sig = t.column("signature").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), WORDS64)
            first = np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(0)] if len(node) else np.zeros(0, bool)
            run_end = np.r_[np.flatnonzero(first)[1:], len(node)].repeat(np.diff(np.r_[np.flatnonzero(first), len(node)]))
            i, j = cell[1], cell[2]
            out_x, out_other = [], []
            at, step = np.arange(len(node)), 1
            while len(at := at[at + step < run_end[at]]):
                to = at + step
                # a cell of two chunks is for pairs across them
                ok = (comp[at] != comp[to]) & (((i == j)[at]) | (side[at] != side[to]))
                a, b = at[ok], to[ok]
                near = fold(sig[a] ^ sig[b]) <= most
                a, b = a[near], b[near]
                out_x.append(np.where(comp[a] > comp[b], node[a], node[b]))
                out_other.append(np.minimum(comp[a], comp[b]))
                step += 1
            x, other = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (out_x, out_other))
            found = np.unique(np.stack([x, other]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["x", "other"])

        for r in batches:
            if not r.num_rows:
                continue
            last = [r.column(c)[r.num_rows - 1].as_py() for c in ("key", "i", "j")]
            at = r.num_rows
            cols = [r.column(c) for c in ("key", "i", "j")]
            while at and [c[at - 1].as_py() for c in cols] == last:
                at -= 1
            if at:
                yield met(pa.Table.from_batches([*held, r.slice(0, at)]))
                held = []
            held.append(r.slice(at))
        if held:
            yield met(pa.Table.from_batches(held))

    return run


class Search:
    """The links between classes `reps` (node, doc_id, text_hash, signature, bands), and the components they make.

    Only classes that share a bucket with another one are looked at; their sets are made at once, so that texts move once.
    """

    def __init__(self, reps: DataFrame, n_reps: int, docs: DataFrame, size: int, percent: int):
        self.percent = percent
        self.parts = max(16, int(n_reps**0.5))
        keys = reps.select("node", F.posexplode("bands").alias("band", "key"))
        many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("many"))
        many = written(many, "many")
        likely = filtered(keys, [F.col("key")], many.select("key"), "likely").where("likely").drop("likely")
        self.keys = written(looked_up(likely, many, ["key"], "node").where("many").drop("many"), "keys")
        wanted = written(self.keys.select("node").distinct().join(reps, "node").select("node", "doc_id", "text_hash", "signature"), "wanted")
        self.signature = wanted.select("node", "signature")
        self.sets = sets_of(wanted.drop("signature"), docs, size)
        self.edges: DataFrame | None = None
        self.comp: DataFrame | None = None
        self.tried: DataFrame | None = None

    def with_comp(self, rows: DataFrame) -> DataFrame:
        """`rows` (node, ...) with the label of the component so far."""
        if self.comp is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(self.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def learn(self, cells: DataFrame) -> None:
        """Takes in the links found in cells (c, i, j, side, node, signature)."""
        cells = written(cells, "cells")
        sets = filtered(self.sets, [F.col("node")], cells.select("node").distinct(), "likely").where("likely").drop("likely")
        new = written(linked(cells.join(sets, "node"), self.percent), "links")
        if not new.isEmpty():
            self.edges = new if self.edges is None else self.edges.union(new)
            self.comp = components(self.edges)

    def stars(self, bands: int) -> None:
        """Members of a bucket against the hub of their part, and the hubs of its parts against the bucket's."""
        k = self.with_comp(self.keys.where(F.col("band") < bands)).withColumn("part", F.pmod(F.xxhash64("node"), F.lit(self.parts)).cast("int"))
        hub = [F.min("comp").alias("least"), F.max("comp").alias("top"), F.min_by("node", "comp").alias("hub")]
        of_part = k.groupBy("key", "part").agg(*hub)
        inner = of_part.where("least < top").drop("top")
        low = k.join(inner, ["key", "part"]).where("comp <> least").select("hub", "node")
        of_key = of_part.groupBy("key").agg(F.min("least").alias("first"), F.max("least").alias("last"), F.min_by("hub", "least").alias("top_hub")).where("first < last")
        high = of_part.select("key", "least", "hub").join(of_key, "key").where("least <> first").select(F.col("top_hub").alias("hub"), F.col("hub").alias("node"))
        pairs = low.union(high).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        if pairs.isEmpty():
            return
        degree = pairs.groupBy("a").count().agg(F.max("count")).head()[0]
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(-(-degree // CELL))).cast("int"))
        hubs = written(salted.select("a", "salt").distinct().join(self.signature.withColumnsRenamed({"node": "a", "signature": "x"}), "a"), "hubs")
        near = salted.join(self.signature.withColumnsRenamed({"node": "b", "signature": "y"}), "b").join(hubs, ["a", "salt"])
        near = written(near.where(differing(F.col("x"), F.col("y")) <= most_differing(self.percent)).select("a", "salt", "b", F.col("y").alias("signature")), "near")
        if near.isEmpty():
            return
        cell = [F.col("a").alias("c"), F.col("salt").alias("i"), F.lit(0).alias("j")]
        centre = near.select("a", "salt").distinct().join(hubs, ["a", "salt"]).select(*cell, F.lit(0).alias("side"), F.col("a").alias("node"), F.col("x").alias("signature"))
        around = near.select(*cell, F.lit(1).alias("side"), F.col("b").alias("node"), "signature")
        self.learn(centre.union(around))

    def rest(self) -> None:
        """Buckets that hold several components still: their classes against each other by signature, in blocks, then by sets against whole components."""
        k = self.with_comp(self.keys)
        mixed = k.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("top"), F.count("*").alias("n")).where("least < top").select("key", F.ceil(F.col("n") / CELL).cast("int").alias("chunks"))
        cells = k.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        cells = cells.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "comp", "chunk")
        cells = cells.join(self.signature, "node").select("key", "i", "j", "node", "comp", "chunk", "signature")
        cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        asked = written(map_arrow(cells, cell_pairs(most_differing(self.percent)), "x long, other long").distinct(), "asked")
        if asked.isEmpty():
            return
        member = self.with_comp(self.signature.select("node"))
        per = asked.groupBy(F.col("other").alias("comp")).agg(F.count("*").alias("n"))
        held = member.groupBy("comp").agg(F.count("*").alias("m"))  # counted before it is joined: a component may be giant
        sizes = held.join(per, "comp").select("comp", F.ceil(F.col("m") / CELL).cast("int").alias("ni"), F.ceil(F.col("n") / CELL).cast("int").alias("nj"))
        sizes = written(sizes, "sizes")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        some = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        inside = looked_up(member, sizes, ["comp"], "node").where("ni is not null").withColumn("i", some("ni")).withColumn("j", every("nj")).withColumn("side", F.lit(0))
        outside = looked_up(asked.select(F.col("x").alias("node"), F.col("other").alias("comp")), sizes, ["comp"], "node").withColumn("i", every("ni")).withColumn("j", some("nj")).withColumn("side", F.lit(1))
        columns = [F.col("comp").alias("c"), "i", "j", "side", "node"]
        self.learn(inside.select(*columns).union(outside.select(*columns)).join(self.signature, "node"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, chosen) for every row.

    Two rows are linked if 100 * common >= percent * union of their sets of `size`-word shingles; component_id is the
    least doc_id that links reach, kept tells whether it is the row's own. Words are runs without ASCII white space, A-Z
    lower-cased; a text of fewer words is one shingle as a whole; a text that is null or has no words has no shingle and
    is linked with nothing. Rows that repeat an id are compared each by its own text: equal ones are linked, others only
    if similar enough. text_hash is xxhash64 of the text; chosen marks the rows of one (doc_id, text) of each component,
    and all rows that no link reaches. Rows without an id are linked with nothing, kept and chosen.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession, keep=True):
        return written(decided(docs, size, percent, id_col, text_col), "near-duplicates")


def decided(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """As `near_duplicates`, read from tables that were written on the way."""
    relieve(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    whole = written(signed(rows, size), "signed")
    key = ["n_shingles", "f1", "f2"]
    first = F.min(F.struct("doc_id", "row", "text_hash")).alias("first")
    classes = whole.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(first, F.count("*").alias("n"))
    classes = written(classes.select(*key, F.col("first.row").alias("node"), F.col("first.doc_id").alias("least"), F.col("first.text_hash").alias("first_text"), "n"), "classes")
    # rows that stand for their class; signatures and bands are heavy, so only rows that may be copies are joined
    worded = whole.where("n_shingles > 0 and doc_id is not null").withColumnRenamed("row", "node")
    copies = written(worded.select("node").join(classes.select("node"), "node", "left_anti"), "copies")
    sifted = filtered(worded, [F.col("node")], copies, "likely")
    reps = sifted.where("not likely").union(sifted.where("likely").join(copies, "node", "left_anti").select(*sifted.columns))
    search = Search(reps.select("node", "doc_id", "text_hash", "signature", "bands"), classes.count(), rows, size, percent)
    for step in (lambda: search.stars(FIRST_BANDS), lambda: search.stars(BANDS), search.rest):
        relieve(docs.sparkSession)
        step()
    relieve(docs.sparkSession)

    # only classes of several rows, or in a component, differ from what a row by itself tells
    grouped = classes.where("n > 1").withColumn("comp", F.col("node"))
    if search.comp is not None:
        grouped = classes.join(search.comp, "node", "left").where("n > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "node"))
    best = grouped.groupBy("comp").agg(F.min(F.struct("least", *key)).alias("best"))
    in_best = F.struct(*key) == F.struct(*(f"best.{c}" for c in key))
    named = looked_up(grouped.select(*key, "node", "comp", "first_text"), best, ["comp"], "node")
    named = written(named.select(*key, F.col("best.least").alias("component_id"), F.when(in_best, F.col("first_text")).alias("chosen_text")), "named")
    found = named.withColumn("grouped", F.lit(True))
    out = looked_up(whole.where("doc_id is not null").select("doc_id", *key, "row", "text_hash"), found, key, "row")
    component = F.coalesce("component_id", "doc_id")
    kept = F.col("doc_id") == component
    chosen = F.col("grouped").isNull() | (kept & F.coalesce(F.col("text_hash") == F.col("chosen_text"), F.lit(False)))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", chosen.alias("chosen"))
    alone = whole.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash", F.lit(True).alias("chosen"))
    return out.union(alone)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


def op2_sql(size: int = 4, percent: int = 80) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

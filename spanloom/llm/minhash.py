"""Near-duplicates by the Jaccard similarity of word shingles, from SimHash links and banded minima with every candidate verified.

Every text gets a SimHash fingerprint of its shingles, and fingerprints at most two bits apart meet by anchor-point covering
(simhash.links()). Pairs at 0.8 mostly differ in more bits than a covering can reach, so bands find the rest: a text's
distinct shingles get 40 bands of 4 minima, and a pair of texts at 0.8 shares no band with probability (1 - 0.8 ** 4) ** 40,
under 1e-9. Equal sets meet in one node before anything is replicated. Each node is first compared with those that its
fingerprint links it to and with the least one that it shares a band with; after those links are contracted, the pairs of a
band that still lie in different components are compared, so no pair that a band holds is passed over. In a band of over CROWD such nodes not all
pairs are made. Its nodes are first compared with the most typical one, whose shingles are the most common there, which
gathers copies with faults around what they are copies of; those still apart meet by the rarest of their shingles, of which
two sets at 0.8 must share one at places that leave room for their overlap. How rare a shingle is comes from counts in SLOTS
slots, a table of fixed size that each task sums by itself and sends in PARTS parts; which order they give decides how many pairs are compared, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, mix, parts, slices, span_hashes, stored
from .simhash import SEED, components, fingerprints_of, keep_least, links, shingle_hashes, text_hash

WIDTH, THRESHOLD, BANDS, ROWS, CROWD, SLOTS, PARTS, SETS_SLICE = 5, 0.8, 40, 4, 64, 1 << 21, 64, 100_000
_FLIP = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = mix(_FLIP) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each text in order, their n + 1 offsets, and a hash of each set."""
    return _distinct(*shingle_hashes(texts, width, SEED))


def _distinct(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets() of texts whose shingle_hashes() are known."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h = h[new]
    at = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(counts)))]).astype(np.int64)
    return h, at, span_hashes(h, at[:-1], at[1:]) if len(h) else np.zeros(len(counts), np.uint64)


def band_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """uint64 keys, a row of BANDS for each set that is not empty."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat((h ^ _FLIP[k]) * _TIMES[k], starts))
        out[:, band] = key
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp, node, n, keys) of every row: its text's hash and fingerprint, its set's hash and size, and its bands; an empty set has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                every, counts = shingle_hashes(part.column(1), WIDTH, SEED)
                fp = fingerprints_of(every, counts)
                h, at, node = _distinct(every, counts)
                n = np.diff(at)
                keys = band_keys(h, at).reshape(-1).view(np.int64) if len(h) else np.empty(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fp.view(np.int64)), pa.array(node.view(np.int64)), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], ["doc_id", "h", "fp", "node", "n", "keys"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_hash(text_col).alias("h"))
    return slim.mapInArrow(run, "doc_id long, h string, fp long, node long, n long, keys array<long>")


def _linked_by_fingerprint(rows: DataFrame) -> DataFrame:
    """(u, v, least_u, least_v): nodes of rows (doc_id, fp, node) that one fingerprint has or that links() joins, as stars."""
    own = stored(rows.where("n > 0").groupBy("fp", "node").agg(F.min("doc_id").alias("least")), "fingerprints")
    first = stored(own.groupBy("fp").agg(F.min(F.struct("node", "least")).alias("m")), "first-of-fingerprint")
    of = lambda x: first.select(F.col("fp").alias(x), F.col("m").alias("m" + x))
    near = links(first.select("fp")).join(of("u").hint("merge"), "u").join(of("v").hint("merge"), "v").select("mu", "mv")
    same = own.join(first.hint("merge"), "fp").select(F.col("m").alias("mu"), F.struct("node", "least").alias("mv"))
    both = near.unionByName(same).where("mu.node <> mv.node")
    return both.select(F.col("mu.node").alias("u"), F.col("mv.node").alias("v"), F.col("mu.least").alias("least_u"), F.col("mv.least").alias("least_v"))


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, s) of nodes (node, least), from the texts of the rows that have their least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, at, node = shingle_sets(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["node", "s"])

    ids = nodes.select("least").distinct().hint("merge")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = slim.join(ids, F.col("id").eqNullSafe(F.col("least")), "left_semi").select("text")
    return rows.mapInArrow(run, "node long, s array<long>").join(nodes.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"])


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v) those whose sets' Jaccard reaches threshold."""
    a, b = sets.select(F.col("node").alias("u"), F.col("s").alias("x")), sets.select(F.col("node").alias("v"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "u").join(b, "v").where(both >= threshold * (F.size("x") + F.size("y") - both)).select("u", "v")


def _slots(g: np.ndarray) -> np.ndarray:
    return (mix(g.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists and n + 1 offsets."""
    at = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _few(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SETS_SLICE shingles of a column of lists."""
    for batch in batches:
        yield from parts(batch, np.diff(_lists(batch.column(column))[1]), SETS_SLICE)


def _counts(sets: DataFrame) -> np.ndarray:
    """How often each of SLOTS slots is hit by the shingles of sets (node, s): no less than a shingle's own count."""

    def add(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.int64)
        for slot, n in batches:
            np.add.at(table, slot, n)
        for part in range(PARTS):
            slot = np.flatnonzero(table[part * SLOTS // PARTS : (part + 1) * SLOTS // PARTS]) + part * SLOTS // PARTS
            if len(slot):
                whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), whole(slot, pa.int32()), whole(table[slot], pa.int64())], ["part", "slots", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(np.unique(_slots(_lists(batch.column(0))[0]), return_counts=True) for batch in _few(batches, 0))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add((_lists(batch.column(1))[0], _lists(batch.column(2))[0]) for batch in batches)

    kinds, out = "part int, slots array<int>, n array<long>", np.zeros(SLOTS, np.uint32)
    for r in sets.select("s").mapInArrow(count, kinds).repartition("part").mapInArrow(gather, kinds).toArrow().to_batches():
        out[_lists(r.column(1))[0]] = np.minimum(_lists(r.column(2))[0], 2**31)
    return out


def _typical(sets: DataFrame, counts) -> DataFrame:
    """(node, typical): the mean count of the shingles of each of sets (node, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, 1):
            g, at = _lists(batch.column(1))
            total = np.concatenate([[0.0], np.cumsum(counts.value[_slots(g)], dtype=np.float64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1))], ["node", "typical"])

    return sets.select("node", "s").mapInArrow(run, "node long, typical double")


def _first_shingles(sets: DataFrame, counts, threshold: float) -> DataFrame:
    """(g, node, n, c, r): of sets (node, n, c, s) the first n - ceil(threshold * n) + 1 shingles in order of their slots' counts, then themselves.

    r is the place, from 1. What is alone in its slot has no partner and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, 3):
            g, at = _lists(batch.column(3))
            row, often = np.repeat(np.arange(len(at) - 1), np.diff(at)), counts.value[_slots(g)]
            order = np.lexsort((g, often, row))
            g, often = g[order], often[order]
            r = np.arange(len(g)) - at[row] + 1
            n = np.diff(at)[row]
            keep = (r <= n - np.ceil(n * threshold - 1e-9) + 1) & (often > 1)
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(g[keep]), *(batch.column(i).take(take) for i in range(3)), pa.array(r[keep])], ["g", "node", "n", "c", "r"])

    return sets.select("node", "n", "c", "s").mapInArrow(run, "g long, node long, n long, c long, r long")


def _rare_pairs(first: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of nodes of different c that share one of their first shingles, (g, node, n, c, r).

    Of two sets whose Jaccard reaches the threshold, in a common order of shingles, the larger one's first n - ceil(threshold
    * n) + 1 and the smaller one's first n - ceil(2 * threshold / (1 + threshold) * n) + 1 share one; and from the first that
    they share on, both have as many left as they must have in common. The rarest first make the fewest pairs.
    """
    up = lambda x: F.ceil(x - 1e-9)
    both = lambda n, m: up((F.col(n) + F.col(m)) * (threshold / (1 + threshold)))
    # what has no partner at this shingle, or too little after it for the smallest there, goes before the join
    there = first.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("g", "least")
    first = first.join(there.hint("merge"), "g").where(F.col("n") - F.col("r") + 1 >= both("n", "least"))
    first = stored(first.select("g", "node", "n", "c", "r"), "rare-left")
    a, b = (first.select("g", *[F.col(c).alias(c + x) for c in ("node", "n", "c", "r")]) for x in "ab")
    a = a.where(F.col("ra") <= F.col("na") - up(F.col("na") * (2 * threshold / (1 + threshold))) + 1)
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("nodea") < F.col("nodeb")))
    room = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + 1 >= both("na", "nb")
    return a.join(b.hint("merge"), "g").where(smaller & room & (F.col("ca") != F.col("cb"))).select(F.col("nodea").alias("u"), F.col("nodeb").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, component_id, h, group) for every row of docs; component_id is the least id among all that links reach.

    Null and empty texts have the empty set and are one group. A null id names no component unless nothing else is in it.
    Texts of any length are read whole. h and group are for keep_least().
    """
    rows = stored(signatures(docs, id_col, text_col), "signatures")
    groups = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "distinct")
    placed = groups.select(F.explode("keys").alias("key"), "node", "n", "least")
    crowd = placed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("least", "node", "n")).alias("first")).where("members > 1").select("key", "first")
    held = stored(placed.join(crowd.hint("merge"), "key"), "bands")
    # of the sizes alone a pair may be too far apart
    fits = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    best = held.where(F.col("node") != F.col("first.node")).where(fits(F.col("n"), F.col("first.n"))).groupBy(F.col("node").alias("v")).agg(F.min("first").alias("f"))
    alike_bits = stored(_linked_by_fingerprint(rows), "linked-fingerprints")
    ends = [alike_bits.select(F.col(x).alias("node"), F.col("least_" + x).alias("least")) for x in "uv"]
    needed = held.select("node", "least").unionByName(ends[0]).unionByName(ends[1]).distinct()
    sets = stored(_sets(docs, needed, id_col, text_col), "sets")
    sure = stored(_alike(best.select(F.col("f.node").alias("u"), "v").unionByName(alike_bits.select("u", "v")).distinct(), sets, threshold), "sure")
    root = components(sure).withColumnRenamed("root", "c")
    named = stored(held.select("key", "node", "n").join(root, "node", "left").withColumn("c", F.coalesce("c", "node")), "named-bands")
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("key", F.col("members").alias("crowd"))
    rest = stored(named.join(mixed.hint("merge"), "key"), "mixed")
    few = rest.where(F.col("crowd") <= CROWD).drop("crowd")
    a, b = (few.select("key", F.col("node").alias(x), F.col("n").alias("n" + x), F.col("c").alias("c" + x)) for x in "uv")
    pairs = a.join(b.hint("merge"), "key").where((F.col("cu") < F.col("cv")) & fits(F.col("nu"), F.col("nv"))).select("u", "v")
    many = rest.where(F.col("crowd") > CROWD).select("key", "node", "n", "c")
    if not many.isEmpty():
        held_sets = stored(sets.join(many.select("node").distinct(), "node"), "crowded-sets")
        counts = docs.sparkSession.sparkContext.broadcast(_counts(held_sets))  # SLOTS numbers, whatever the corpus
        placed = stored(many.join(_typical(held_sets, counts), "node"), "crowded")
        centre = placed.groupBy("key").agg(F.max(F.struct("typical", "node", "n", "c")).alias("m"))
        near = placed.join(centre.hint("merge"), "key").where((F.col("c") != F.col("m.c")) & fits(F.col("n"), F.col("m.n"))).groupBy(F.col("node").alias("v")).agg(F.max(F.struct("m.typical", "m.node")).alias("m"))
        around = stored(_alike(near.select(F.col("m.node").alias("u"), "v"), sets, threshold), "around")
        sure = sure.unionByName(around)
        own = placed.select("node", "n", "c").distinct()
        of = lambda x: own.select(F.col("node").alias(x), F.col("c").alias("c" + x))
        joined = components(around.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        own = own.join(joined.select(F.col("node").alias("c"), "root"), "c", "left").select("node", "n", F.coalesce("root", "c").alias("c"))
        pairs = pairs.unionByName(_rare_pairs(stored(_first_shingles(held_sets.join(own, "node"), counts, threshold), "rare"), threshold))
    pairs = stored(pairs.distinct(), "pairs")
    root = components(sure.unionByName(_alike(pairs, sets, threshold)))
    linked = stored(groups.select("node", "least").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "linked")
    least = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    ids = stored(linked.select("node", "root").join(least, "root").select("node", "component_id", F.col("root").alias("group")), "ids")
    return rows.select("doc_id", "h", "node").join(ids, "node").select("doc_id", "component_id", "h", "group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of near_duplicates(); keep_least() says which."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)

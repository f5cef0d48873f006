"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code. Each half of a fingerprint is 32 bits: 31 in the perfect Hamming code [31, 26]
and one free bit, which covers with radius 1. Of two fingerprints at most two bits apart one half differs in one bit or
none, and the nearest anchor of one is then within 1 + 1 of the other. So each fingerprint goes to every anchor within 2
of either half (17 at most) and is compared there, per anchor, over all 64 bits.

Copies meet in one fingerprint before anything is replicated, and an anchor's task returns a spanning star for each group
that it finds, never pairs. An anchor of very many fingerprints is dealt out by the three segments of the other half: that
half differs in two bits at most, so one segment is equal. Components are contracted from the stars with tables in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, stored, text_buffers

WIDTH, SEED, BITS = 3, 42, 2
#: Fingerprints that one anchor holds before it is dealt out, and how many anchors may be, as those hold the most; halves
#: in an anchor's reach. A half of fewer than HOT_ANCHOR / REACH fingerprints cannot make an anchor hot by itself.
HOT_ANCHOR, MOST_HOT, REACH = 200_000, 10_000, 529
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_hashes(texts: pa.Array, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of `width` words of the texts in order, and how many each text has; one of fewer words has one run."""
    raw, at = text_buffers(texts)
    n = len(at) - 1
    # every text with one space after it; a run of spaces becomes one space, so a shingle is a slice of bytes
    flat = np.full(len(raw) + n, 32, np.uint8)
    keep = np.ones(len(flat), bool)
    keep[at[1:] + np.arange(n)] = False
    flat[keep] = _LOWER[raw]
    doc = at[:-1] + np.arange(n)
    space = _SPACE[flat]
    first = ~space
    first[1:] &= space[:-1]
    first[doc] = ~space[doc]
    if not first.any():
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    flat[space] = 32
    kept = ~space
    kept[1:] |= ~space[:-1]
    where = np.cumsum(kept) - 1
    starts = where[first]  # of words, in the text without repeated spaces
    packed = flat[kept].tobytes()
    words = np.diff(np.append(np.searchsorted(np.flatnonzero(first), doc), len(starts)))
    ends = np.append(starts[1:], len(packed) + (not space[-1]))  # one after the space that follows; a text ends with one
    shingles = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    word0, sh0 = np.cumsum(words) - words, np.cumsum(shingles) - shingles
    a = np.arange(shingles.sum()) + np.repeat(word0 - sh0, shingles)
    b = np.minimum(a + width, np.repeat(word0 + words, shingles)) - 1
    f, view = xxhash.xxh64_intdigest, memoryview(packed)
    return np.fromiter((f(view[i:j], seed) for i, j in zip(starts[a].tolist(), (ends[b] - 1).tolist())), np.uint64, len(a)), shingles


def fingerprint_batch(texts: pa.Array, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprints of the texts: a bit is set if over half of the shingles' XXH64 have it."""
    return fingerprints_of(*shingle_hashes(texts, width, seed))


def fingerprints_of(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """fingerprint_batch() of texts whose shingle_hashes() are known."""
    n, sh0 = len(shingles), np.cumsum(shingles) - shingles
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    full = np.flatnonzero(shingles)
    counts = np.zeros((n, 64), np.int64)
    step = 100_000
    for lo in range(0, len(h), step):  # the bits of so many shingles at a time
        part = h[lo : lo + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d0, d1 = np.searchsorted(sh0[full], lo, "right") - 1, np.searchsorted(sh0[full], lo + len(part), "left")
        own = full[d0:d1]
        counts[own] += np.add.reduceat(bits, np.maximum(sh0[own] - lo, 0), axis=0, dtype=np.int64)
    over = 2 * counts > shingles[:, None]
    out[:] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, with_text_hash: bool = False) -> DataFrame:
    """(doc_id, fp[, h]): the 64-bit fingerprint of every whole text, as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprint_batch(part.column(1), width, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *["h"] * with_text_hash])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[text_hash(text_col).alias("h")] * with_text_hash)
    return slim.mapInArrow(run, "doc_id long, fp long" + ", h string" * with_text_hash)


def _pairs_of_syndrome() -> np.ndarray:
    """For each syndrome of [31, 26] but 0: the 15 masks of two bits with that syndrome."""
    out = np.zeros((32, 15), np.uint64)
    for s in range(1, 32):
        out[s] = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
    return out


_TWO = _pairs_of_syndrome()
_PARITY = [np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)) for k in range(5)]


def half_anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the code's words within radius 1 + 1 of each 32-bit half."""
    one, top = np.uint64(1), np.uint64(1 << 31)
    s = np.zeros(len(x), np.int64)
    for k, mask in enumerate(_PARITY):
        s |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << k
    on, off = np.flatnonzero(s), np.flatnonzero(s == 0)
    near = x[on] ^ (one << (s[on] - 1).astype(np.uint64))
    rows, words = [on, on, off, off, np.repeat(on, 15)], [near, near ^ top, x[off], x[off] ^ top, (x[on, None] ^ _TWO[s[on]]).reshape(-1)]
    return np.concatenate(rows), np.concatenate(words)


def anchors(fp: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of each fingerprint: half << 32 | word for the anchors of its halves.

    For an anchor in hot (sorted keys) three keys instead, with the other half's segments: 1 + segment << 33 + 11 bits above.
    """
    rows, words = [], []
    low = np.uint64(0xFFFFFFFF)
    for half in (0, 1):
        r, w = half_anchors((fp >> np.uint64(32 * half)) & low)
        w = w | np.uint64(half << 32)
        if hot is not None and len(hot):
            on = hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w
            other = (fp[r[on]] >> np.uint64(32 * (1 - half))) & low
            for k in range(3):
                segment = (other >> np.uint64(11 * k)) & np.uint64(0x7FF)
                rows.append(r[on])
                words.append(w[on] | (np.uint64(k + 1) << np.uint64(33)) | (segment << np.uint64(35)))
            r, w = r[~on], w[~on]
        rows.append(r)
        words.append(w)
    return np.concatenate(rows), np.concatenate(words)


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of each one's component."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return nodes, nodes[root]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]


def _near_pairs(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the pairs at most `bits` bits apart, by comparing each with each."""
    us, vs = [fp[:0]], [fp[:0]]
    rows = max(1, 1_000_000 // max(len(fp), 1))
    for lo in range(0, len(fp), rows):
        i, j = np.nonzero(np.bitwise_count(fp[lo : lo + rows, None] ^ fp[None, :]) <= bits)
        near = i + lo < j
        u, v = fp[i[near] + lo], fp[j[near]]
        if len(u) > len(fp):  # keep a star of each component of these
            nodes, root = local_roots(u, v)
            u, v = root[nodes != root], nodes[nodes != root]
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def _near_masks(fp: np.ndarray, free: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the pairs of fp (sorted) at most `bits` of the bits of free apart: each looks its neighbours up, in time linear in them."""
    ones = [np.uint64(1 << b) for b in range(64) if free >> b & 1]
    masks = ones + ([a | b for i, a in enumerate(ones) for b in ones[:i]] if bits > 1 else [])
    nodes, root = fp, np.arange(len(fp))
    for m in masks if bits else []:
        other = fp ^ m
        at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
        a = np.flatnonzero((fp[at] == other) & (fp < other))
        b = at[a]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        while len(a):
            ra, rb = root[a], root[b]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    far = root != np.arange(len(fp))
    return nodes[root[far]], nodes[far]


def _links(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in one group (sorted, distinct) at most `bits` bits apart, or as many of them as join the same fingerprints."""
    if len(fp) <= 2048:
        return _near_pairs(fp, bits)
    # of four segments of 16 bits, two differences leave at least two alone: meet where two are equal
    us, vs = [fp[:0]], [fp[:0]]
    segments = [0xFFFF << 16 * k for k in range(4)]
    for i in range(4):
        for j in range(i):
            mask = np.uint64(segments[i] | segments[j])
            key = fp & mask
            order = np.argsort(key, kind="stable")
            for g in np.split(fp[order], np.flatnonzero(np.diff(key[order])) + 1):
                if len(g) > 1:
                    u, v = _near_pairs(g, bits) if len(g) <= 2048 else _near_masks(np.sort(g), ~int(mask) & (1 << 64) - 1, bits)
                    us.append(u)
                    vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def links_in_groups(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of what is linked in any group of equal keys; key is sorted."""
    us, vs = [], []
    cuts = np.flatnonzero(np.diff(key)) + 1
    start, size = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(key)]]))
    small = np.repeat(size <= 64, size)
    k, f = key[small], fp[small]
    for d in range(1, 64):  # all small groups at once, by distance in the sorted rows
        if len(k) <= d:
            break
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        a, b = f[same], f[same + d]
        near = np.bitwise_count(a ^ b) <= bits
        us.append(a[near])
        vs.append(b[near])
    for s, n in zip(start[size > 64], size[size > 64]):
        u, v = _links(np.unique(fp[s : s + n]), bits)
        us.append(u)
        vs.append(v)
    u, v = (np.concatenate(x) if x else fp[:0] for x in (us, vs))
    if not len(u):
        return u, v
    nodes, root = local_roots(u, v)
    far = nodes != root
    return root[far], nodes[far]


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): edges between distinct fingerprints that join all those at most `bits` (2 at most) bits apart."""
    if bits > 2:
        raise ValueError("the covering code's anchors reach two differing bits")

    sent = fps.sparkSession.sparkContext.broadcast(hot_anchors(fps))  # at most MOST_HOT

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fp), 20_000):
                part = fp[lo : lo + 20_000]
                row, word = anchors(part, sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(part[row].view(np.int64))], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps_, held = [], [], 0  # a group goes on until another key comes; batches of a large one are joined once

        def found(key, fp):
            u, v = links_in_groups(key, fp, bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            if held >= 100_000 and (keys[-1][-1] != key[-1]):  # the last group may go on
                cut = np.searchsorted(key, key[-1])
                yield found(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps_, fp[:cut]]))
                keys, fps_, held = [], [], 0
                key, fp = key[cut:], fp[cut:]
            keys.append(key)
            fps_.append(fp)
            held += len(key)
        if held:
            yield found(np.concatenate(keys), np.concatenate(fps_))

    placed = fps.mapInArrow(replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor", "fp")
    return placed.mapInArrow(compare, "u long, v long").distinct()


def hot_anchors(fps: DataFrame, hot: int | None = None) -> np.ndarray:
    """Sorted keys of the anchors that hold over `hot` fingerprints (HOT_ANCHOR, or more so that few do), by halves that many share.

    Which anchors these are decides how the work is dealt out, not what is found.
    """
    each = fps.select(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)).alias("high"))
    hot = hot or max(HOT_ANCHOR, fps.count() * 34 // MOST_HOT)
    halves = each.select(F.explode(F.array("low", "high")).alias("half")).groupBy("half").count().where(F.col("count") > hot // REACH)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, word = half_anchors(half & np.uint64(0xFFFFFFFF))
            word |= half[row] & np.uint64(1 << 32)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), batch.column(1).take(pa.array(row))], ["anchor", "n"])

    held = halves.mapInArrow(reach, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    return np.array(sorted(r[0] for r in held.select("anchor").collect()), np.int64).view(np.uint64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (u, v) with one node that stands for its component.

    Each round draws an order of the nodes by a salted hash, sends a node to the least of its neighbours and itself, and that
    one's, and contracts the edges. In a drawn order at least half of the nodes have a lesser neighbour whatever the graph's
    shape, so rounds grow with the logarithm of the nodes, on chains and stars alike. Nothing is collected but whether edges
    are left.
    """
    now, maps = stored(edges.where("u <> v").select("u", "v"), "edges"), []
    while not now.isEmpty():
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("n"))
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy(F.col("u").alias("node")).agg(F.min(drawn("v")).alias("m")).select("node", F.least("m", drawn("node"))["n"].alias("p"))
        up = stored(up, "parents")
        above = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        top = up.select(F.col("node").alias("pp"), F.col("p").alias("root"))
        up = stored(up.join(above, "p").join(top, "pp").select("node", "root"), "jumped")
        maps.append(up)
        a = up.select(F.col("node").alias("u"), F.col("root").alias("a"))
        b = up.select(F.col("node").alias("v"), F.col("root").alias("b"))
        now = stored(now.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    out = None
    for up in reversed(maps):
        if out is None:
            out = up
        else:
            later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
            out = stored(up.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
    return out if out is not None else now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, bits: int = BITS, with_text_hash: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the least id among all that links reach.

    Null and empty texts have fingerprint zero, linked like any other. Repeated rows each get a row. A null id stays null
    and never names a component unless nothing else is in it. Texts of any length are read whole; other columns of docs,
    whatever their names, are not read. An empty table gives no rows. with_text_hash adds h, for keep_least(), and group.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width, seed, with_text_hash), "fingerprints")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(groups.select("fp"), bits))
    linked = stored(groups.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "linked")
    least = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stored(linked.select("fp", "root").join(least, "root").select("fp", "component_id", F.col("root").alias("group")), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", *["h", "group"] * with_text_hash)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each near-duplicate group; see keep_least()."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, with_text_hash=True), id_col, text_col)


def text_hash(text: str) -> Column:
    """What tells the texts of rows with one id apart; a null text counts as empty."""
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def keep_least(docs: DataFrame, named: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of named, (doc_id, h, group): h is the row's text_hash().

    The row with the least id stays, of several with that id the one with the least text hash, and of rows that repeat both one,
    the least by a hash of its other columns. Rows without an id stay, as nothing names them.
    """
    named = named.where("doc_id is not null")
    first = named.groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("m")).select("m.doc_id", "m.h")
    rows = named.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    kept = stored(first.join(rows.hint("merge"), ["doc_id", "h"]), "kept")
    own, own_h = fresh(docs.columns, "kept_id"), fresh(docs.columns, "kept_h")
    keys = kept.select(F.col("doc_id").alias(own), F.col("h").alias(own_h), "n")
    here = (F.col(f"`{id_col}`").cast("long") == F.col(own)) & (text_hash(f"`{text_col}`") == F.col(own_h))
    # merge joins at every size: what stays is most of the corpus, so sending it out would not scale
    out = docs.join(keys.where("n = 1").drop("n").hint("merge"), here, "left_semi")
    out = out.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
    if kept.where("n > 1").isEmpty():
        return out
    again = docs.join(keys.where("n > 1").drop("n").hint("merge"), here)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = again.groupBy(own, own_h).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in plain])).alias("row"))
    return out.unionByName(one.select("row.*"))

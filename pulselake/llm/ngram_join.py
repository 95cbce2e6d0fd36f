"""Exact n-gram Jaccard self-join by token-combination prefixes, and the components of its links."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import Words, arrow_bytes, blocks, discard, free_name, materialize, mix, partitions, shingle_hashes, sized, table
from pulselake.llm.components import components

SHINGLE = 5
PERCENT = 80
#: The frequency sketch has a cell for so many bytes of text, and so many cells at most: what is broadcast, a byte for
#: each cell, stays bounded. Frequencies are kept on a scale of logarithms, so that they never overflow a byte.
CELL_BYTES, MOST_CELLS, SCALE = 64, 1 << 24, 8
SLICES = 64
#: Bytes of text whose signatures go to one partition, about.
PART_BYTES = 16 << 20
#: Longs of a set's parity bitmap.
LONGS = 16
BITS = [f"b{i}" for i in range(LONGS)]


def _sets(part: pa.Table, id_col: str, text_col: str, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of a block."""
    data, off = arrow_bytes(part[text_col])
    words = Words(data, off, fold=True)
    for row in range(part.num_rows):
        own = words.hashes[words.offsets[row] : words.offsets[row + 1]]
        if len(own) >= k:
            yield row, np.unique(shingle_hashes(own, k))
        elif len(own):
            yield row, shingle_hashes(own, len(own))
        else:
            yield row, np.zeros(0, np.uint64)


def _vertex(h: np.ndarray) -> int:
    """A number of the set itself: documents with equal sets are one vertex."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parity(h: np.ndarray) -> np.ndarray:
    """A bitmap of the set: whether the number of its hashes with each leading bits is odd. Bitmaps of two sets differ in
    as many bits at most as the sets differ in hashes."""
    odd = np.bincount((h >> np.uint64(64 - (64 * LONGS - 1).bit_length())).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _profile(id_col: str, text_col: str, k: int, cells: int):
    """A row for each document (vertex, set size, three keys of minimum hashes, bitmap); then the task's frequency sketch in slices."""
    names = ["doc", "v", "n", "k0", "k1", "k2", *BITS, "slice", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(cells, np.uint16)
        mask = np.uint64(cells - 1)
        seeds = mix(np.arange(1, 7, dtype=np.uint64))
        for part in blocks(batches, text_col):
            vs, ns, keys, bits = [], [], [], []
            for _, h in _sets(part, id_col, text_col, k):
                at = (h & mask).astype(np.int64)
                now = sketch[at]
                sketch[at] = now + (now < 65535)
                vs.append(_vertex(h))
                ns.append(len(h))
                bits.append(_parity(h))
                if len(h):
                    low = [int(mix(h ^ s).min()) for s in seeds]
                    keys.append([hash((a, b, c)) for c, (a, b) in enumerate(zip(low[::2], low[1::2], strict=True))])
                else:
                    keys.append([None] * 3)
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays([
                part[id_col].combine_chunks().cast(pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64()),
                *[pa.array([x[i] for x in keys], pa.int64()) for i in range(3)], *[pa.array(x) for x in np.array(bits, np.int64).reshape(rows, LONGS).T],
                pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()),
            ], names=names)
        step = cells // SLICES
        packed = [zlib.compress(sketch[i * step : (i + 1) * step].tobytes(), 1) for i in range(SLICES)]
        empty = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([empty] * (6 + LONGS) + [pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return run


def level(count):
    """A frequency on the sketch's scale, from 0 to 255."""
    return np.minimum(255, np.rint(SCALE * np.log2(1.0 + count))).astype(np.uint8)


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch["slice"].to_pylist(), batch["cells"], strict=True):
            own = np.frombuffer(zlib.decompress(raw.as_py()), np.uint16)
            sums[i] = sums[i] + own if i in sums else own.astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([level(x).tobytes() for x in sums.values()], pa.binary())], names=["slice", "cells"])


def _commonness(id_col: str, text_col: str, k: int, sketch):
    """How frequent a set's shingles are on average. Of a group of edited copies, the original has the highest: every
    edit brings shingles of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(sketch.value, np.uint8)
        mask = np.uint64(len(cells) - 1)
        for part in blocks(batches, text_col):
            rows = [(_vertex(h), float(cells[(h & mask).astype(np.int64)].mean())) for _, h in _sets(part, id_col, text_col, k) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=["x", "common"])

    return run


def size_class(n: int) -> int:
    """Size class: linked sets, whose sizes differ by a factor of 1.25 at most, are in the same or neighbouring classes."""
    return int(math.log(n) / math.log(1.25) + 1e-9)


def signatures(h: np.ndarray, counts: np.ndarray, cutoff: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set (sorted distinct hashes h, with the frequency of each), and each one's place in the order; -1: a combination.

    Tokens are taken in the global order of (frequency, hash). Two sets that link miss at most n - ceil(t n) of
    either's tokens, so a prefix has to be long enough that so many misses can't empty it. A rare token in the
    prefix counts one and is a signature itself. Frequent tokens fall into classes by hash; m of one class count
    m - 1, and every pair of them is a signature: the prefix is extended until the count is reached. How many
    classes there are depends on a size class, and each set signs for its own and the next one, so that linked sets
    have one in common.
    """
    n = len(h)
    if n < 2:  # a set of one token links with equal sets only
        return h[:0], np.zeros(0, np.int32)
    order = np.argsort(counts, kind="stable")
    need = n - (percent * n + 99) // 100 + 1
    rare = int((counts <= cutoff).sum())
    if rare >= need:
        return h[order[:need]], np.arange(need, dtype=np.int32)
    out = [h[order[:rare]]]
    frequent = h[order[rare:]]
    for tag in (size_class(n), size_class(n) + 1):
        classes = max(1, int(1.25**tag / 20))
        own = (mix(frequent ^ np.uint64(tag)) % np.uint64(classes)).astype(np.int64)
        counted = np.ones(len(own), np.int64)
        counted[np.unique(own, return_index=True)[1]] = 0
        size = int(np.searchsorted(np.cumsum(counted), need - rare)) + 1
        own, tokens = own[:size], frequent[:size]
        by = np.argsort(own, kind="stable")
        own, tokens = own[by], tokens[by]
        ends = np.searchsorted(own, own, side="right")
        left = np.repeat(np.arange(len(own)), ends - np.arange(len(own)) - 1)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.concatenate([[0], np.cumsum(ends - np.arange(len(own)) - 1)[:-1]]), ends - np.arange(len(own)) - 1)
        out.append(mix(tokens[left] * np.uint64(0x9E3779B97F4A7C15) + mix(tokens[right] + np.uint64(tag))))
    sig = np.concatenate(out)
    return sig, np.where(np.arange(len(sig)) < rare, np.arange(len(sig)), -1).astype(np.int32)


def _sign(id_col: str, text_col: str, k: int, percent: int, sketch, cutoff: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(sketch.value, np.uint8)
        mask = np.uint64(len(cells) - 1)
        for part in blocks(batches, text_col):
            known, comps = part["_v"].to_pylist(), part["_c"].to_pylist()
            sigs, combined, v, c, n, sizes = [], [], [], [], [], []
            for row, h in _sets(part, id_col, text_col, k):
                sig, combo = signatures(h, cells[(h & mask).astype(np.int64)], cutoff, percent)
                if not len(sig):
                    continue
                own = _vertex(h)
                sigs.append(sig)
                combined.append(combo)
                sizes.append(len(sig))
                v.append(own)
                c.append(comps[row] if known[row] == own else own)
                n.append(len(h))
            if sigs:
                spread = lambda x: pa.array(np.repeat(np.array(x, np.int64), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(combined)), spread(v), spread(c), spread(n)], names=["sig", "pos", "v", "c", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of (sig, v), each (signature, vertex) once: combinations (which are salted, so that others can
    be elsewhere), and rare signatures found in two components. Only the rows of one rare signature, which the cutoff
    bounds, are held from batch to batch."""
    names = ["sig", "v", "c", "n", "pos"]
    held = [np.zeros(0, np.int64) for _ in names]

    def sift(cols: list[np.ndarray]) -> pa.RecordBatch:
        sig, v, c, _, pos = cols
        first = np.ones(len(sig), bool)
        first[1:] = (sig[1:] != sig[:-1]) | (v[1:] != v[:-1])
        cols = [x[first] for x in cols]
        sig, v, c, _, pos = cols
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        several = np.minimum.reduceat(c, starts) < np.maximum.reduceat(c, starts)
        keep = np.repeat(several, np.diff(np.append(starts, len(sig)))) | (pos < 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int32 if n == "pos" else np.int64)) for x, n in zip(cols, names, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.concatenate([h, batch[x].to_numpy().astype(np.int64)]) for h, x in zip(held, names, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1])) if cols[4][-1] >= 0 else len(cols[0])
        held = [x[last:] for x in cols]
        if last:
            yield sift([x[:last] for x in cols])
    if len(held[0]):
        yield sift(held)


def _exact(percent: int):
    """Pairs with both sets: those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep)) for c in ("u", "v")], names=["u", "v"])

    return run


def _emit_sets(id_col: str, text_col: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col):
            hs = [h for _, h in _sets(part, id_col, text_col, k)]
            yield pa.RecordBatch.from_arrays([pa.array([_vertex(h) for h in hs], pa.int64()), pa.array([h.tobytes() for h in hs], pa.binary())], names=["x", "s"])

    return run


def _verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of vertices that link, from the whole sets of one document each. pairs: materialized."""
    needed = materialize(pairs.select(F.col("u").alias("v")).union(pairs.select("v")).distinct().join(reps, "v").select(F.col("doc").alias("_need")).distinct(), "needed")
    texts = docs.join(sized(needed), docs[id_col] == F.col("_need"), "left_semi").select(id_col, text_col)
    sets = materialize(texts.mapInArrow(_emit_sets(id_col, text_col, k), "x long, s binary").dropDuplicates(["x"]), "sets")
    left, right = sets.select(F.col("x").alias("u"), F.col("s").alias("sa")), sets.select(F.col("x").alias("v"), F.col("s").alias("sb"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").mapInArrow(_exact(percent), "u long, v long")


def _near_sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _candidates(common: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, cu, c) of vertices from different components that share a signature and may link.

    Signatures of the same vertices give the same pairs, so of those one combination is kept (a passage that many
    documents share makes many such). A signature's vertices outside its largest component meet all its vertices; those
    inside it don't meet each other. Filters, exact all: length; for rare signatures, position: a pair that links has
    at least `least` shingles in common, and its first common signature comes early enough in both sets to leave room
    for them; for combinations, bitmaps, which may differ in as many bits as the sets may differ in shingles.
    """
    each = common.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("k"), F.max("pos").alias("pos"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "v")).alias("y"))
    per = each.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("m"), F.max("pos").alias("pos"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    per = materialize(per.where("c0 < c1").select("sig", "pos", "m", "x", "y", F.col("top.c").alias("big")), "postings")
    least = F.expr(f"({percent} * (nu + n) + {99 + percent}) div {100 + percent}")

    def meet(kept: DataFrame, more: list[str], condition) -> DataFrame:
        b = kept.select("sig", "v", "c", "n", "big", *more)
        a = b.where("c <> big").select("sig", *[F.col(x).alias(f"{x}u") for x in more], F.col("v").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu"))
        return a.join(b, "sig").where("cu <> c and (c = big or cu < c)").where(_near_sizes("nu", "n", percent)).where(condition).select("u", "v", "cu", "c")

    rare = common.join(per.where("pos >= 0").select("sig", "big"), "sig")
    found = meet(rare, ["pos"], (F.col("posu") + least <= F.col("nu")) & (F.col("pos") + least <= F.col("n")))
    one = per.where("pos < 0").groupBy("m", "x", "y").agg(F.min(F.struct("sig", "big")).alias("s")).select("s.sig", "s.big")
    bitmaps = reps.select(F.col("v").alias("_v"), *BITS)
    combined = common.join(one, "sig").join(bitmaps, F.col("v") == F.col("_v"))
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}u"))) for b in BITS[1:]), F.bit_count(F.col(BITS[0]).bitwiseXOR(F.col(f"{BITS[0]}u"))))
    return found.unionByName(meet(combined, BITS, differ <= F.col("nu") + F.col("n") - 2 * least)).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) of each document, over all links of Jaccard percent / 100 or more.

    Documents with equal shingle sets are one vertex. Steps:
    1. One pass gives each document's vertex, set size and three min-hash keys, and a frequency sketch of shingles
       over all documents: a bounded number of cells, each with the logarithm of its count in a byte.
    2. Vertices are compared, exactly, with the vertex of most frequent shingles among those that share a min-hash
       key. This joins the bulk of large groups of copies by a star around the original instead of all their pairs.
    3. A second pass signs every set (see signatures). A rare signature is found in at most as many documents as
       the cutoff allows (the sketch counts too much, never too little); combinations are salted. Only signatures that two different components share go on.
    4. All pairs of vertices from different components that share a signature and pass the length, positional and
       bitmap filters (see _candidates) are verified exactly; with step 2's links they give the components. Pairs inside one component need no look, so
       no link between components is lost.

    Fewer than k words: the whole sequence is the one shingle. Null or empty text, or no words: no shingles, no links, the
    document is its own component. A null id gets a null component and takes no part; rows with equal ids are one
    document each and share the id's component by their links. Other columns are ignored. An empty table gives no rows.
    """
    if percent < PERCENT:  # sizes of linked sets may differ by more than a class, and one-token sets have no signature
        raise ValueError(f"percent is {PERCENT} at least: signatures would miss links below it")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    cells = 1 << min(MOST_CELLS.bit_length() - 1, max(14, int(size // CELL_BYTES).bit_length()))
    seen = materialize(docs.mapInArrow(_profile(id_col, text_col, k, cells), f"doc long, v long, n long, k0 long, k1 long, k2 long, {', '.join(f'{b} long' for b in BITS)}, slice int, cells binary"), "profile")
    profile = seen.where("slice is null")
    slices = seen.where("slice is not null").select("slice", "cells").repartition(SLICES, "slice").mapInArrow(_add_slices, "slice int, cells binary").collect()  # cells bytes in all
    sketch = np.concatenate([np.frombuffer(bytes(r["cells"]), np.uint8) for r in sorted(slices, key=lambda r: r["slice"])]) if slices else np.zeros(cells, np.uint8)
    # Well above what cells hold on average, and few enough to keep the pairs of a rare signature bounded.
    mean = float(np.bincount(sketch, minlength=256) @ (np.exp2(np.arange(256) / SCALE) - 1)) / len(sketch)
    cutoff = int(level(max(32.0, 4 * mean)))
    shared = spark.sparkContext.broadcast(sketch.tobytes())
    del slices, sketch

    reps = profile.where("doc is not null and n > 0").groupBy("v", "n", "k0", "k1", "k2").agg(F.min("doc").alias("doc"), *[F.min(b).alias(b) for b in BITS])
    reps = materialize(reps, "vertices")
    common = docs.mapInArrow(_commonness(id_col, text_col, k, shared), "x long, common double").groupBy("x").agg(F.max("common").alias("common"))
    keyed = reps.join(common, reps["v"] == common["x"]).select("v", "n", "common", F.posexplode(F.array("k0", "k1", "k2")).alias("p", "key"))
    hubs = keyed.groupBy("p", "key").agg(F.max(F.struct("common", "v", "n")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    stars = keyed.join(hubs, ["p", "key"]).select(F.col("hub.v").alias("u"), F.col("hub.n").alias("nu"), "v", "n").where(F.col("u") != F.col("v")).where(_near_sizes("nu", "n", percent))
    stars = materialize(stars.select("u", "v").distinct(), "pairs")
    ids = reps.select("v", "doc")
    links = materialize(_verify(docs, ids, stars, id_col, text_col, k, percent), "links")
    comp = materialize(components(links), "components")
    discard(stars, links)

    grouped = materialize(profile.where("doc is not null").join(comp, profile["v"] == comp["node"]).select(F.col("doc").alias("_doc"), F.col("v").alias("_v"), F.col("component").alias("_c")).distinct(), "grouped")
    to_sign = docs.where(F.col(id_col).isNotNull()).join(sized(grouped), docs[id_col] == F.col("_doc"), "left").select(id_col, text_col, "_v", "_c")
    signed = to_sign.mapInArrow(_sign(id_col, text_col, k, percent, shared, cutoff), "sig long, pos int, v long, c long, n long")
    parts = max(partitions(spark), -(-int(size) // PART_BYTES))
    salt = F.when(F.col("pos") < 0, F.pmod("v", F.lit(parts))).otherwise(0)
    dealt = signed.repartition(parts, "sig", salt).sortWithinPartitions("sig", "v")
    common = materialize(dealt.mapInArrow(_shared, "sig long, v long, c long, n long, pos int"), "signatures")
    pairs = materialize(_candidates(common, reps, percent), "pairs")
    more = _verify(docs, ids, pairs, id_col, text_col, k, percent)
    # Links of the second kind join whole components.
    joined = more.join(pairs, ["u", "v"]).select(F.col("cu").alias("u"), F.col("c").alias("v"))
    comp = materialize(components(joined.union(comp.select("node", "component"))), "components")
    discard(common, pairs, grouped)

    placed = profile.join(comp, profile["v"] == comp["node"], "left").select("doc", "n", F.when(F.col("n") > 0, F.coalesce("component", "v")).alias("c"))
    smallest = comp.join(ids, comp["node"] == ids["v"]).groupBy("component").agg(F.min("doc").alias("_least"))
    alone = placed.where("c is null or doc is null").select("doc", "n", F.col("doc").alias("component_id"))
    # Vertices outside comp are copies of one set: their smallest document is the vertex's own.
    tops = smallest.unionByName(ids.join(comp, ids["v"] == comp["node"], "left_anti").select(F.col("v").alias("component"), F.col("doc").alias("_least")))
    linked = placed.where("c is not null and doc is not null").join(tops, F.col("c") == F.col("component")).select("doc", "n", F.col("_least").alias("component_id"))
    return linked.unionByName(alone).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that link, directly or not, to one of smaller id."""
    gone = free_name(docs, "_drop")
    drop = materialize(jaccard_components(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct(), "dropped")
    return docs.join(sized(drop), docs[id_col] == F.col(gone), "left_anti")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))

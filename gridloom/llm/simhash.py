"""SimHash near-duplicates with multi-index hashing, and their components.

Fingerprint: the whole text in lower case (A-Z), its words, and all shingles of
``width`` words, repeats included, joined by a space (fewer words: the whole
sequence; none: fingerprint 0).  Each shingle votes with the 64 bits of its XXH64
(seed 42); a bit is 1 if it is set in over half of the votes.

Links at 2 or fewer differing bits are found among distinct fingerprints by
multi-index hashing.  The 64 bits are two segments of 32.  There is a table for each
segment, by its value.  Of two fingerprints within 2 bits either the high segments
differ in one bit at most, or the low ones agree.  So a fingerprint enumerates the
Hamming ball of radius 1 of its high segment and the ball of radius 0 of its low one,
looks these values up in the tables and verifies the complete distance of what it
finds.  Of the ball of radius 1 the values with a bit less than the centre are enough,
as the partner enumerates the others.

A segment value can be crowded: near copies agree in much.  Fingerprints that hold
or look up a value with more than ``CROWD`` holders meet by a finer table as well,
which keeps both segments: its keys are the 65 values within one bit of the whole
fingerprint.  Two fingerprints within 2 bits share such a key, only those do, and
a key holds 65 at most, where they are chained in order: that keeps the components.
``neighbours`` gives every link itself.

Near-duplicates of similarity 0.8 or more (``keep_one``), by the Jaccard similarity
of the sets of five-word shingles, lie further apart than 2 bits.  Texts with the same
set are one node.  Candidates are nodes that share a key: one of 36 disjoint triples of
bins of a one-permutation MinHash sketch of ``BINS`` bins (empty bins of short texts
are filled from other bins, in an order of each bin's own), or one of the five
segments of a 160-bit SimHash by words.  A pair at similarity J misses all triples
with probability (1 - J^3)^36, about 6e-12 at 0.8, wherever the texts differ.  One
hashed bit a bin, carried with the keys, drops pairs that differ in more than
``BITS_APART`` of 128 (at 0.8: 12.8 expected, standard error 3.4).  The others are
verified by their exact sets.

All pairs that share a key are compared, in the first key that they share.  In a key of
up to ``NEAREST`` + 1 holders the pairs are rows.  In a fuller one the holders are dealt
into blocks of about ``SIGHT`` by a hash, each two blocks meet in a task of their own, sets
included, and only links come out: pairs that are connected already there are passed over,
all others are verified.  So a hot key is many tasks and makes no rows of pairs; its
comparisons grow with the square of its holders, its rows with holders times blocks.

Components: alternating large-star and small-star steps on the links, each round
checkpointed; no link ever reaches the driver.

Defined cases: null text counts as empty; texts without a word share fingerprint 0
and are linked; repeated rows share a component; a null doc_id is never the
smallest unless the component has no other (its component_id is null then).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import BATCH_BYTES, Shelf, cut, map_text, maybe_broadcast

SEED = 42
#: Holders of a segment value that are all compared with each other.
CROWD = 32


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by a space, as uint64."""
    from xxhash import xxh64_intdigest

    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Bits set in over half of the (weighted) votes, as an unsigned integer."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    if weights is None:
        ones, total = bits.sum(0, dtype=np.int64), len(hashes)
    else:
        ones, total = weights.astype(np.float32) @ bits.astype(np.float32), float(weights.sum())
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int) -> int:
    words = text.encode().lower().split() if text else []
    return majority(shingle_hashes(words, width)) if words else 0


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def with_fingerprint(docs: DataFrame, width: int = 5, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns plus simhash long (the 64 bits, as a signed number)."""

    def make():
        return lambda texts: [pa.array([signed(fingerprint(t, width)) for t in texts], pa.int64())]

    return map_text(docs, make, [T.StructField("simhash", T.LongType())], text_col, carry)


def hex16(simhash: Column) -> Column:
    return F.lower(F.lpad(F.hex(simhash), 16, "0"))


def ball_keys(simhash: Column) -> Column:
    """The 65 keys of a fingerprint in the finer table: all values within one bit."""
    low = [1 << i for i in range(32)]
    high = [signed(1 << i) for i in range(32, 64)]
    return F.array(simhash, *[simhash.bitwiseXOR(F.lit(b).cast("long")) for b in low + high])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def segment(simhash: Column, number: int) -> Column:
    """Segment 0 (low) or 1 (high) as a number from 0."""
    return F.shiftrightunsigned(simhash, 32 * number).bitwiseAND(F.lit((1 << 32) - 1))


def looked_up(simhash: Column) -> Column:
    """Array of (seg, value): the low segment, the high one, and the high one with one
    of its set bits cleared."""
    low, high = segment(simhash, 0), segment(simhash, 1)
    at = lambda seg, value: F.struct(F.lit(seg).alias("seg"), value.alias("value"))
    bits = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]), lambda b: high.bitwiseAND(b) != 0)
    return F.concat(F.array(at(0, low), at(1, high)), F.transform(bits, lambda b: at(1, high.bitwiseXOR(b))))


def segment_links(prints: DataFrame, radius: int = 2, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Of distinct simhash: the links (a, b) by segment values of at most ``crowd``
    holders, and the fingerprints (simhash) that hold or look up a fuller one."""
    at = lambda seg: F.struct(F.lit(seg).alias("seg"), segment(F.col("simhash"), seg).alias("value"))
    table = prints.select(F.explode(F.array(at(0), at(1))).alias("k"), F.col("simhash").alias("b")).select("k.seg", "k.value", "b")
    held = table.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n"))
    full = cut(held.where(F.col("n") > crowd).select("seg", "value"))
    asked = prints.select(F.explode(looked_up(F.col("simhash"))).alias("k"), F.col("simhash").alias("a")).select("k.seg", "k.value", "a")
    if full.isEmpty():
        crowded = prints.limit(0)
    else:
        crowded = cut(asked.join(maybe_broadcast(full), ["seg", "value"], "left_semi").select("a").union(table.join(maybe_broadcast(full), ["seg", "value"], "left_semi").select("b")).distinct().toDF("simhash"))
        table = table.join(maybe_broadcast(full), ["seg", "value"], "left_anti")
    near = (F.col("a") != F.col("b")) & (distance(F.col("a"), F.col("b")) <= radius)
    pairs = asked.join(table, ["seg", "value"]).where(near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), crowded


def chained_links(prints: DataFrame, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b), a < b, of distinct simhash whose components are those of all
    links within ``radius``, up to 2."""
    links, crowded = segment_links(prints, radius, crowd)
    if radius < 2:  # the finer table's chains need all links of two bits
        return links.unionByName(_finer_pairs(crowded, radius)).distinct()
    keyed = crowded.select("simhash", F.explode(ball_keys(F.col("simhash"))).alias("key"))
    before = F.lag("simhash").over(Window.partitionBy("key").orderBy("simhash"))
    pairs = keyed.select(before.alias("a"), F.col("simhash").alias("b")).where(F.col("a").isNotNull())
    return links.unionByName(pairs.where(distance(F.col("a"), F.col("b")) <= radius)).distinct()


def _finer_pairs(prints: DataFrame, radius: int) -> DataFrame:
    keyed = prints.select("simhash", F.explode(ball_keys(F.col("simhash"))).alias("key"))
    held = keyed.groupBy("key").agg(F.sort_array(F.collect_list("simhash")).alias("holders")).where(F.size("holders") > 1)
    pairs = held.select(F.explode(F.flatten(F.transform("holders", lambda x, i: F.transform(F.slice(F.col("holders"), i + 2, 65), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.select("p.a", "p.b").where(distance(F.col("a"), F.col("b")) <= radius)


def neighbours(prints: DataFrame, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """Every link (a, b), a < b, between distinct fingerprints at most 2 apart."""
    links, crowded = segment_links(prints, radius, crowd)
    return links.unionByName(_finer_pairs(crowded, radius)).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes that have links.

    links(a, b).  Large-star: every node points its larger neighbours to the
    smallest it knows; small-star: a node points its smaller neighbours, and
    itself, to the smallest.  Ends when a round changes nothing.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).distinct())
    seen = None
    while True:
        # star(node, root) with root < node; both directions for large-star
        both = edges.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(edges.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("node"), F.col("m").alias("root")).where(F.col("root") < F.col("node")).distinct()
        smallest = large.groupBy("node").agg(F.min("root").alias("m"))
        others = large.join(smallest, "node").where(F.col("root") != F.col("m")).select(F.col("root").alias("node"), F.col("m").alias("root"))
        edges = cut(others.unionByName(smallest.select("node", F.col("m").alias("root"))).distinct())
        # a bounded summary: stars only, when no root is a node and it stays the same
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).collect()[0]
        if seen == state:
            return edges
        seen = state


def group_documents(marked: DataFrame, roots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """marked(id, node, ...) rows plus root and component_id, the smallest id reachable.

    roots(node, root) of linked nodes; rows of one node belong together anyway.
    """
    nodes = marked.groupBy("node").agg(F.min(id_col).alias("least_id"))
    rooted = cut(nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("node", "root", "component_id")
    return marked.join(named, "node")


def link_documents(docs: DataFrame, width: int = 5, radius: int = 2) -> DataFrame:
    """doc_id, simhash, component_id of every row: links at ``radius`` (0 to 2) bits."""
    marked = cut(with_fingerprint(docs, width, carry=["doc_id"]).withColumn("node", F.col("simhash")))
    links = chained_links(cut(marked.select("simhash").distinct()), radius, CROWD)
    return group_documents(marked, components(links)).drop("node", "root")


SEGMENTS, MAX_WEIGHT = 5, 16
BINS = 128
#: Disjoint triples of bins; one agrees in full if at most 35 bins differ.
TRIPLES = 36
#: Bits of 128 in which candidates may differ.
BITS_APART = 28
#: Holders of a key, less one, whose pairs are rows; the holders of a fuller key meet in
#: blocks of about ``SIGHT``.
NEAREST, SIGHT = 3, 512


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, as int32; 0 where a bin has none."""
    least = np.full(BINS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(least, (hashes & np.uint64(BINS - 1)).astype(np.int64), np.maximum(hashes >> np.uint64(32), 1).astype(np.uint32))
    return np.where(least == 0xFFFFFFFF, 0, least).astype(np.uint32).view(np.int32)


def wide_fingerprint(text: str | None, width: int = 5) -> tuple[list[int], list[int], np.ndarray]:
    """(five signed 32-bit segments by words, sketch of the shingles, their sorted set).

    The set has the upper 32 bits of each hash: two texts of 20,000 words share 0.1
    of them by chance.
    """
    from xxhash import xxh3_128_digest, xxh32_digest

    words = text.encode().lower().split() if text else []
    if not words:
        return [0] * SEGMENTS, [0] * BINS, np.empty(0, np.int32)
    terms = list(dict.fromkeys(words))
    long = np.frombuffer(b"".join(map(xxh3_128_digest, terms)), np.uint8).reshape(-1, 16)
    short = np.frombuffer(b"".join(map(xxh32_digest, terms)), np.uint8).reshape(-1, 4)
    bits = np.unpackbits(np.hstack([long, short]), axis=1).astype(np.float32)
    weights = np.minimum(np.fromiter(map(len, terms), np.float32, len(terms)), MAX_WEIGHT)
    votes = np.packbits(2 * (weights @ bits) > weights.sum())
    hashes = shingle_hashes(words, width)
    return votes.view("<i4").tolist(), sketch(hashes).tolist(), np.unique((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))


def with_wide_fingerprint(docs: DataFrame, carry: list[str], width: int = 5) -> DataFrame:
    """``carry`` plus segments, sketch and shingles (array<int>) and node long (the hash of shingles)."""

    def make():
        def run(texts):
            made = [wide_fingerprint(t, width) for t in texts]
            return [pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in (0, 1, 2)]

        return run

    fields = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("segments", "sketch", "shingles")]
    # small batches: the workers live on, with what they have taken, into the next stages
    return map_text(docs, make, fields, "text", carry, BATCH_BYTES >> 2).withColumn("node", F.xxhash64("shingles"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def filled(sketches: np.ndarray) -> np.ndarray:
    """Sketches (rows, BINS) as uint64, empty bins taken from the first bin that is
    not empty in an order fixed for each bin, so that they agree as often as others."""
    own = sketches.view(np.uint32).astype(np.uint64)
    out = own.copy()
    orders = np.random.default_rng(SEED).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
    for t in range(BINS):
        empty = out == 0
        if not empty.any():
            break
        out = np.where(empty, own[:, orders[:, t]], out)
    return out


def candidate_keys(sketches: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys (rows, TRIPLES + SEGMENTS), bits (rows, 2)) as int64."""
    bins = filled(sketches)
    keys = np.broadcast_to(np.arange(1, TRIPLES + 1, dtype=np.uint64), (len(bins), TRIPLES))
    for k in range(3):
        keys = _mixed(keys ^ bins[:, k : 3 * TRIPLES : 3])
    by_words = _mixed(segments.view(np.uint32).astype(np.uint64) ^ (np.arange(1, SEGMENTS + 1, dtype=np.uint64) << np.uint64(40)))
    # the bin's number goes in too: a value that fills many bins gives each a bit of its own
    one = _mixed(_mixed(bins ^ (np.arange(1, BINS + 1, dtype=np.uint64) << np.uint64(40)))) >> np.uint64(63)
    bits = np.packbits(one.astype(np.uint8), axis=1).view("<i8")
    return np.hstack([keys, by_words]).view(np.int64), bits


def _ints(column, n: int) -> np.ndarray:
    """Arrow lists of ``n`` numbers as an array (rows, n) of int32."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.int32).reshape(-1, n)


def with_keys(sets: DataFrame) -> DataFrame:
    """node, size, hi, lo, keys, a row for each node of sets(node, segments, sketch,
    shingles) that has a shingle."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, size, segments, sketches = batch.columns
            keys, bits = candidate_keys(_ints(sketches, BINS), _ints(segments, SEGMENTS))
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
            columns = [node, size, pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "hi", "lo", "keys"])

    rows = sets.where(F.exists("sketch", lambda v: v != 0)).select("node", F.size("shingles").alias("size"), "segments", "sketch")
    return rows.mapInArrow(run, "node long, size int, hi long, lo long, keys array<long>").dropDuplicates(["node"])


def shared_keys(made: DataFrame) -> DataFrame:
    """key, slot, node, n of keys with n > 1 holders, of the rows of :func:`with_keys`."""
    rows = made.select("node", F.posexplode("keys").alias("slot", "key"))
    held = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return held.where(F.col("n") > 1).select("key", "slot", "node", "n")


def candidates(shared: DataFrame, made: DataFrame) -> DataFrame:
    """(a, b) of all pairs to verify that share a key of few holders."""
    few = shared.where(F.col("n") <= NEAREST + 1).join(made.select("node", "size", "hi", "lo"), "node")
    held = few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "size", "hi", "lo"))).alias("holders"))
    pairs = held.select(F.explode(F.flatten(F.transform("holders", lambda x, i: F.transform(F.slice(F.col("holders"), i + 2, NEAREST + 1), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    apart = distance(F.col("a.hi"), F.col("b.hi")) + distance(F.col("a.lo"), F.col("b.lo"))
    alike = 5 * F.least("a.size", "b.size") >= 4 * F.greatest("a.size", "b.size")
    return pairs.where((apart <= BITS_APART) & alike).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def near_in_blocks(keys, bits, sizes, flat, slot: int, at, pair) -> list[tuple[int, int]]:
    """Links (i, j) that connect what all near pairs of two blocks of a key's holders do.

    ``at``: the block of each holder; ``pair``: the two blocks, the same one for the pairs
    within it.  ``flat``: the sorted shingles of all holders, ``sizes`` of each.
    """
    hi, lo = bits[:, 0].view(np.uint64), bits[:, 1].view(np.uint64)
    ends = np.cumsum(sizes)
    left, right = np.flatnonzero(at == pair[0]), np.flatnonzero(at == pair[1])
    group, links = np.arange(len(sizes)), []
    for i in left.tolist():
        js = right[(group[right] != group[i]) & (right > i if pair[0] == pair[1] else True)]
        js = js[np.bitwise_count(hi[js] ^ hi[i]) + np.bitwise_count(lo[js] ^ lo[i]) <= BITS_APART]
        js = js[5 * np.minimum(sizes[js], sizes[i]) >= 4 * np.maximum(sizes[js], sizes[i])]
        js = js[(keys[js] == keys[i]).argmax(1) == slot]  # other pairs meet in an earlier key
        if not len(js):
            continue
        own = flat[ends[i] - sizes[i] : ends[i]]
        others = np.concatenate([flat[ends[j] - sizes[j] : ends[j]] for j in js.tolist()])
        hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
        common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[js])[:-1]]), dtype=np.int64)
        js = js[9 * common >= 4 * (sizes[js] + sizes[i])]
        _, one = np.unique(group[js], return_index=True)
        links += [(i, j) for j in js[one].tolist()]
        group[np.isin(group, group[js])] = group[i]
    return links


def crowd_links(shared: DataFrame, sets: DataFrame, shelf: Shelf) -> DataFrame:
    """(a, b): links of the same components as all near pairs that share a full key."""
    full = shared.where(F.col("n") > NEAREST + 1)
    used = shelf.store(full.select("node").distinct())
    moved = sets.select("node", "segments", "sketch", "shingles").join(maybe_broadcast(used), "node", "left_semi").dropDuplicates(["node"])
    count = F.ceil(F.col("n") / F.lit(SIGHT))
    dealt = full.withColumn("at", F.pmod(F.xxhash64("node", "slot"), count)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    dealt = dealt.select("node", "key", "slot", "at", F.least("at", "other").alias("one"), F.greatest("at", "other").alias("two"))

    def meet(table: pa.Table) -> pa.Table:
        node, at = (table[c].to_numpy() for c in ("node", "at"))
        segments, sketches, shingles = (table[c].combine_chunks() for c in ("segments", "sketch", "shingles"))
        keys, bits = candidate_keys(_ints(sketches, BINS), _ints(segments, SEGMENTS))
        sizes = pa.compute.list_value_length(shingles).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = shingles.flatten().to_numpy(zero_copy_only=False)
        slot, *pair = (table[c][0].as_py() for c in ("slot", "one", "two"))
        links = np.array(near_in_blocks(keys, bits, sizes, flat, slot, at, pair), np.int64).reshape(-1, 2)
        a, b = node[links[:, 0]], node[links[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.join(moved, "node").groupBy("key", "one", "two").applyInArrow(meet, "a long, b long").distinct()


def exactly_near(pairs: DataFrame, sets: DataFrame, shelf: Shelf) -> DataFrame:
    """The pairs (a, b) whose sets, of sets(node, shingles), have a Jaccard similarity of
    0.8 or more.  Only the sets of nodes in a pair move; rows of one node are equal."""
    used = shelf.store(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    moved = shelf.store(sets.select("node", "shingles").join(maybe_broadcast(used), "node", "left_semi").dropDuplicates(["node"]))
    side = lambda x: moved.select(F.col("node").alias(x), F.col("shingles").alias(f"h{x}"))
    common = F.size(F.array_intersect("ha", "hb"))
    # common / (both - common) >= 4 / 5
    return pairs.join(side("a"), "a").join(side("b"), "b").where(9 * common >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")


def near_roots(sets: DataFrame) -> DataFrame:
    """(node, root) of linked nodes, of sets(node, segments, sketch, shingles); rows of one
    node are equal."""
    shelf = Shelf(sets.sparkSession)
    made = shelf.store(with_keys(sets))
    shared = shelf.store(shared_keys(made))
    links = exactly_near(shelf.store(candidates(shared, made)), sets, shelf)
    roots = components(links.union(crowd_links(shared, sets, shelf)))
    shelf.clear()
    return roots


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id; of rows
    that share it, any one of those with the same text.  Columns as given."""
    shelf = Shelf(docs.sparkSession)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"))
    marked = shelf.store(with_wide_fingerprint(hashed, ["doc_id", "__hash"], width))
    grouped = group_documents(marked.select("doc_id", "__hash", "node"), near_roots(marked))
    first = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # repeated ids can be the least of more than one component: one row a root
    chosen = first.groupBy("root").agg(F.first("component_id").alias("__id"), F.min("__hash").alias("__keep"))
    chosen = cut(chosen.select("__id", "__keep"))
    shelf.clear()
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    kept = keyed.join(chosen, keyed["doc_id"].eqNullSafe(chosen["__id"]) & (keyed["__hash"] == chosen["__keep"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__hash"]).select(*[f"`{c}`" for c in docs.columns])

"""Document fingerprints: SimHash with weighted terms, searched by permuted tables.

Terms are the runs of two words of the lower-cased text (one word: the word).  A
term's weight is its number of bytes, at most ``MAX_WEIGHT``, once for each
occurrence: common short words say less about a document than long ones.  Each
term adds its weight to the votes of the bits its XXH64 sets and takes it from the
others; a bit is 1 if its votes are positive.  Likeness is 1 - differing bits / 64.

Search: the 64 bits are cut into blocks.  Of two fingerprints that differ in at most ``RADIUS`` bits, all blocks but ``RADIUS`` at least agree.  For every choice
of that many blocks there is a table of the fingerprints with these blocks
permuted to the front as its key; equal keys are fetched and the complete distance
is verified.  A pair counts in the first table only in which it agrees.  With n
distinct fingerprints a key has more than log2(n) bits, by cutting into more blocks as
n grows (10 at most), so few share a key by chance at any size.

Defined cases: null text counts as empty; a text without words has fingerprint 0;
null doc_ids come last in the order; ids may be of any type that can be ordered; rows
of one doc_id are ordered by the hash of the text and then the text, identical rows
are interchangeable; the one document of a table is its own next one; a very long text
is held alone, beside the one before it; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import cut, join_small, store
from gridloom.llm.simhash import distance, hex16, majority, shingle_hashes, signed

TERM_WORDS, MAX_WEIGHT = 2, 32
RADIUS, MOST_BLOCKS = 3, 10
#: Holders of a key that are all compared with each other.
CROWD = 64


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = shingle_hashes(words, TERM_WORDS)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    weights = sizes[:-1] + sizes[1:] if len(words) >= TERM_WORDS else sizes
    return majority(hashes, np.minimum(weights, MAX_WEIGHT))


def likeness(a: int, b: int) -> float:
    return 1.0 - (a ^ b).bit_count() / 64.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def blocks_for(prints: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose keys have as many bits as tell ``prints`` apart."""
    wanted = min(max(prints, 2).bit_length() + 4, 64 * (MOST_BLOCKS - radius) // MOST_BLOCKS)
    return next(b for b in range(radius + 1, MOST_BLOCKS + 1) if 64 * (b - radius) // b >= wanted)


def table_keys(simhash: Column, radius: int, blocks: int) -> list[tuple[int, Column]]:
    """(mask, key) of each permuted block table."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    tables = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    return [(m, simhash.bitwiseAND(F.lit(m).cast("long"))) for m in tables]


def split_rest(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in so many masks of about equal size."""
    rest = [b for b in range(64) if not mask >> b & 1]
    edges = [round(len(rest) * i / parts) for i in range(parts + 1)]
    return [signed(sum(1 << b for b in rest[lo:hi])) for lo, hi in zip(edges, edges[1:])]


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, crowd: int = CROWD) -> DataFrame:
    """All pairs (a, b), a < b, of distinct simhash within ``radius``, each once.

    In a key with more than ``crowd`` holders the other bits are cut again, into
    radius + 1 parts of which one at least agrees, and holders meet by these.
    """
    blocks = blocks or blocks_for(prints.count(), radius)
    keys = table_keys(F.col("simhash"), radius, blocks)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), k.alias("key")) for i, (_, k) in enumerate(keys)])
    held = prints.select("simhash", F.explode(tables).alias("k")).select("simhash", "k.t", "k.key", F.xxhash64("k.t", "k.key").alias("spot"))
    full = cut(held.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select(F.col("spot").alias("__spot")))
    parts = F.array(*[F.array(*[F.lit(x).cast("long") for x in split_rest(mask, radius + 1)]) for mask, _ in keys])
    marked = join_small(held, full, "spot", "__spot", "left").withColumn("rest", parts[F.col("t")])
    apart = F.when(F.col("__spot").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(radius)))
    spread = marked.select("simhash", "t", "key", "rest", F.explode(apart).alias("j"))
    spread = spread.withColumn("part", F.when(F.col("j") >= 0, F.col("simhash").bitwiseAND(F.get("rest", F.greatest("j", F.lit(0))))).otherwise(F.lit(0).cast("long")))
    a = spread.withColumnRenamed("simhash", "a")
    b = spread.select(F.col("simhash").alias("b"), "t", "key", "j", "part")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(len(keys))
    for i, (mask, _) in reversed(list(enumerate(keys))):
        first = F.when(differ.bitwiseAND(F.lit(mask).cast("long")) == 0, i).otherwise(first)
    earlier = F.exists(F.slice("rest", 1, F.greatest("j", F.lit(0))), lambda m: differ.bitwiseAND(m) == 0)
    pairs = a.join(b, ["t", "key", "j", "part"]).where((F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= radius))
    return pairs.where((first == F.col("t")) & ((F.col("j") <= 0) | ~earlier)).select("a", "b")


def near_counts(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """marked(simhash, ...) rows plus n_near: other distinct fingerprints in reach."""
    prints = cut(marked.select("simhash").distinct())
    pairs = near_pairs(prints, radius)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("simhash")).groupBy("simhash").agg(F.count(F.lit(1)).alias("n_near"))
    counted = prints.join(ends, "simhash", "left").na.fill(0, ["n_near"])
    return marked.join(counted, "simhash")


#: Bytes of text that a range of the id order holds at most, about; small tables
#: still have as many ranges as the session has shuffle partitions.
RANGE_BYTES = 64 << 20


def _edits_schema(docs: DataFrame) -> T.StructType:
    doubles = [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    longs = [T.StructField(c, T.LongType()) for c in ("simhash", "edited_simhash")]
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), *longs, *doubles])


def _edit_row(text: str, own: int, following: str, other: int) -> tuple:
    changed = edited(text, following)
    new = own if changed == text else fingerprint(changed)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), signed(own), signed(new), likeness(own, new), likeness(own, other)


def _edit_columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def fingerprint_edits(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document beside its edited text and the next document (ids ascending).

    doc_id, n_chars, edited_sha256, simhash, edited_simhash, near_edited, near_next.
    The texts move once, by ranges of the order.  A task streams its range and holds
    two texts at a time; it finishes all its documents but the last and hands out
    its first and last text as border rows.  These, two a range, are stored with the
    results and meet by the number of the range, so nothing but range numbers
    reaches the driver.
    """
    spark = docs.sparkSession
    schema = _edits_schema(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # identical rows are interchangeable; their read position lets a range end among them
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.col("text"), F.col("__read")]
    base = base.withColumn("__read", F.monotonically_increasing_id())
    ordered = base.repartitionByRange(ranges, order[0], order[1], order[3]).sortWithinPartitions(*order)
    names = [*schema.fieldNames(), "__range", "__kind", "__text"]
    out = T.StructType([*schema.fields, T.StructField("__range", T.IntegerType()), T.StructField("__kind", T.IntegerType()), T.StructField("__text", T.StringType())])

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()

        def made(ids, rows, kind, texts):
            columns = [pa.concat_arrays(ids), *_edit_columns(rows), pa.array([at] * len(kind), pa.int32()), pa.array(kind, pa.int32()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        blank = (None,) * 6
        held = None  # (doc_id as an array of one, text, fingerprint)
        for batch in batches:
            ids, rows, kind, texts = [], [], [], []
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0).slice(i, 1), batch.column(1)[i].as_py()
                own = fingerprint(text)
                if held is None:  # kind 1: the first text of the range
                    columns = doc_id, blank, 1, text
                else:
                    columns = held[0], _edit_row(held[1], held[2], text, own), 0, None
                for values, value in zip((ids, rows, kind, texts), columns):
                    values.append(value)
                held = doc_id, text, own
            if ids:
                yield made(ids, rows, kind, texts)
        if held is not None:  # kind 2: the last text of the range
            yield made([held[0]], [blank], [2], [held[1]])

    made = store(ordered.select("doc_id", "text").mapInArrow(run, out))
    done = made.where("__kind = 0").select(*schema.fieldNames())
    # ranges can be empty: each one's follower, from at most one number a range
    used = sorted(r[0] for r in made.where("__kind = 1").select("__range").collect())
    if not used:
        return done
    links = spark.createDataFrame(list(zip(used, [*used[1:], used[0]])), "__range int, __next int")
    last = made.where("__kind = 2").select("doc_id", "__range", F.col("__text").alias("text"))
    first = made.where("__kind = 1").select(F.col("__range").alias("__next"), F.col("__text").alias("following"))
    borders = last.join(F.broadcast(links), "__range").join(first, "__next").select("doc_id", "text", "following")

    def finish(batches):
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            rows = [_edit_row(a, fingerprint(a), b, fingerprint(b)) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_edit_columns(rows)], names=schema.fieldNames())

    return done.unionByName(borders.mapInArrow(finish, schema))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The edits' table with hex fingerprints and n_near (links within RADIUS)."""
    counted = near_counts(fingerprint_edits(docs))
    return counted.select("doc_id", "n_chars", "edited_sha256", hex16(F.col("simhash")).alias("fingerprint"), hex16(F.col("edited_simhash")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")

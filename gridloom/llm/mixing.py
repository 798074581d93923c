"""Mixing sources to target weights by cube-method balanced sampling.

Targets: the total size of all sources is shared by weight; a source's target
stops at ``cap`` times its own size and the excess is reshared by weight among
the others until none is above.  With ratio r = target / size, a document of the
source is taken floor(r) times for certain and once more with inclusion
probability r - floor(r).

The extra copies are drawn by the cube method.  The flight phase takes three
undecided documents at a time and moves their probabilities along the null space
of two constraints, the number of documents and the total of sizes, until one
reaches 0 or 1; both totals stay exactly as expected.  It runs in blocks of about
``BLOCK`` documents of a source, so a hot source is many tasks.  Each block leaves
two undecided documents at most; these meet again in blocks of the next level, at
each level 1/``BLOCK`` as many.  The last two of a source are the landing problem:
of the outcomes the one nearest to the expected size is taken.

The order within a block and the direction of each move come from hashes of the
row, and identical rows are numbered after being counted together, so reruns agree
however the table is split, ordered or read.

Defined cases: null text -> size 0; null source is a source of its own, ordered
last; a source of size 0 has target 0 and is not taken; repeated rows are drawn one
by one (identical rows are interchangeable); equal sizes and equal hashes are ties
that doc_id breaks; a very long text is a large size, no more; further columns are
not read, and ``apply_mix`` gives them back; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, expand, join_small, n_words_of, numbered

#: Documents of a source that one flight block handles.
BLOCK = 4096


def source_targets(digest: DataFrame, weights=(1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """One row a source: source, source_size, target, n_docs; the targets sum to all sizes.

    digest(source, size, n): n equal documents.  The level at which the shares stop
    rising is found by aggregates over the sources, however many there are: sources
    above their cap leave, the rest shares what they leave, until none is above.
    """
    totals = cut(digest.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")))
    ranked = numbered(totals, [F.asc_nulls_last("source")], totals.count(), "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    shared = cut(ranked.select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("most")))
    total = float(shared.agg(F.sum("source_size")).collect()[0][0] or 0)
    target, full = F.lit(0.0), -1
    over = F.lit(False)
    while total > 0:
        n, held, open_weight = shared.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).collect()[0]
        if n == full or not open_weight:
            target = F.when(over, F.col("most")).otherwise(target)
            break
        target = (total - held) * F.col("weight") / open_weight
        over, full = target > F.col("most"), n
    return cut(shared.select("source", "source_size", target.alias("target"), "n_docs"))


def flight(p: np.ndarray, z: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Flight phase on probabilities ``p`` under sum(p) and sum(z * p).

    ``u`` in [0, 1) decides the moves.  At most two values stay undecided.
    """
    p = p.astype(float).tolist()
    z = z.astype(float).tolist()
    tiny = 1e-9
    held: list[int] = []
    for k in range(len(p)):
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        # v with sum(v) = 0 and sum(z * v) = 0
        va, vb, vc = z[b] - z[c], z[c] - z[a], z[a] - z[b]
        if va == 0 and vb == 0 and vc == 0:
            va, vb = 1.0, -1.0
        up = down = math.inf
        for i, v in ((a, va), (b, vb), (c, vc)):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, -p[i] / v), min(down, (p[i] - 1) / v)
        step = up if u[k] * (up + down) < down else -down
        left = []
        for i, v in ((a, va), (b, vb), (c, vc)):
            x = p[i] + step * v
            if x < tiny:
                x = 0.0
            elif x > 1 - tiny:
                x = 1.0
            else:
                left.append(i)
            p[i] = x
        held = left
    return np.array(p)


def land(p: np.ndarray, z: np.ndarray, u: float) -> np.ndarray:
    """Decide the last few: the outcome whose size is nearest to the expected one."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    want = float((p[open_] * z[open_]).sum())
    count = float(p[open_].sum())
    outcomes = []
    for code in range(1 << len(open_)):
        bits = np.array([(code >> i) & 1 for i in range(len(open_))], float)
        outcomes.append((abs(float((bits * z[open_]).sum()) - want), abs(bits.sum() - count), (code + int(u * 64)) % (1 << len(open_)), code))
    code = min(outcomes)[-1]
    p = p.copy()
    p[open_] = [(code >> i) & 1 for i in range(len(open_))]
    return p


def _fly(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mix_hash", "doc_id", "size"], kind="stable")
        mixed = pdf["mix_hash"].to_numpy().astype(np.uint64)
        mixed = (mixed ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        u = (mixed >> np.uint64(11)).astype(float) / 2**53
        z = pdf["size"].to_numpy()
        p = flight(pdf["p"].to_numpy(), z, u)
        if last:
            p = land(p, z, float(u[0]))
        return pdf.assign(p=p).drop(columns="__block")

    return run


def cube_sample(rows: DataFrame, group_docs: int) -> DataFrame:
    """Decide p (0..1) of rows(source, doc_id, size, p, mix_hash, ...) to 0 or 1.

    ``group_docs``: the largest number of undecided rows of one source (a count).
    """
    done: list[DataFrame] = []
    level = 0
    while True:
        blocks = max(1, math.ceil(group_docs / BLOCK))
        last = blocks == 1
        block = F.pmod(F.xxhash64("mix_hash", F.lit(level)), F.lit(blocks))
        free = rows.where((F.col("p") > 0) & (F.col("p") < 1))
        done.append(rows.where((F.col("p") <= 0) | (F.col("p") >= 1)))
        flown = free.withColumn("__block", block).groupBy("source", "__block")
        rows = cut(flown.applyInPandas(_fly(level, last), rows.schema))
        if last:
            return reduce(DataFrame.unionByName, [*done, rows])
        group_docs, level = 2 * blocks, level + 1


def mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), cap: float = 3.0, size: Column | None = None) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, text_hash."""
    measured = n_words_of(F.col("text")) if size is None else size
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), measured.cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
    digest = cut(narrow.groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(digest, weights, cap).withColumnRenamed("source", "__source")
    spread = join_small(digest, targets, "source", "__source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    part = F.greatest(ratio - whole, F.lit(0.0))
    split = spread.select(
        "doc_id", "source", "size", "text_hash", "source_size", "target", "n",
        whole.cast("long").alias("whole"),
        F.when(part < 1e-9, 0.0).otherwise(part).alias("p"),
    )
    # identical rows have numbers, and so hashes, of their own, or all would fall into one block
    rows = cut(expand(split, "n", "copy").withColumn("mix_hash", F.xxhash64("doc_id", "text_hash", "size", "copy")).drop("n", "copy"))
    group_docs = targets.agg(F.max("n_docs")).collect()[0][0] or 0
    decided = cube_sample(rows, group_docs)
    return decided.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"), "text_hash")


def apply_mix(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents of the mix, each row as often as it is taken.

    Rows equal in doc_id, source and text are interchangeable: together they
    appear as often as their decisions add up to.
    """
    taken = (
        decisions.where("copies > 0")
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.sum("copies").alias("__copies"))
        .select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), "__copies")
    )
    one = docs.withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "__h"])
    match = one["doc_id"].eqNullSafe(taken["__id"]) & one["source"].cast("string").eqNullSafe(taken["__source"]) & (one["__h"] == taken["__hash"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return expand(one.join(taken, match).select(*columns, "__copies"), "__copies", "__n").select(*columns)

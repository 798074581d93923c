"""Consistent-hash ring with virtual nodes and bounded loads (native).

The ring has ``CELLS`` positions.  A row's position is xxhash64(doc_id) modulo
``CELLS``; every shard owns the positions before its virtual nodes.  Each shard
has a capacity, the capacities sum to the number of rows and differ by one at
most, so the balance is guaranteed (law ``rows``).  Rows that a full shard can't
take continue clockwise to the next shard, hop by hop; only those rows leave
their ring owner.

What the driver sees is bounded whatever the input: row counts of
``CELLS * SALTS`` units.  It deals those counts onto the ring; each row then finds
its shard and slot from its rank within its unit.  A unit is a position and a hash
of the row's other columns modulo ``SALTS``: it holds about 1/131072 of the rows, and
a hot id is spread by its different texts.  Identical rows are counted first and
move as one row with a count, so they are one rank interval; they are written out
again at the end.  Nothing depends on how the table was split or read.

Defined cases: null text -> size 1, crc32 of ''; null doc_id hashes to a fixed
position; repeated rows are rows of their own, ties of the order are such rows only;
a very long text is only measured; input columns called shard or slot are replaced;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, expand

CELLS = 4096
SALTS = 32
VIRTUAL_NODES = 128


def spread_hash(*parts: int) -> int:
    """A well-mixed 64-bit number for a node or unit."""
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big")


def ring_owners(shards: int, cells: int = CELLS, virtual_nodes: int = VIRTUAL_NODES) -> np.ndarray:
    """Virtual nodes in clockwise order as (cells,) arrays: owner of each cell.

    A node sits at a hash of (shard, k); the lower shard wins a shared cell.
    """
    at = np.full(cells, -1, np.int64)
    for shard in reversed(range(shards)):
        for k in range(virtual_nodes):
            at[spread_hash(shard, k) % cells] = shard
    owners = np.empty(cells, np.int64)
    current = at[at >= 0][0]
    for cell in reversed(range(cells)):
        if at[cell] >= 0:
            current = at[cell]
        owners[cell] = current
    return owners


def clockwise(owners: np.ndarray, shards: int) -> np.ndarray:
    """(cells, shards): the shards in the order a row at a cell meets them."""
    cells = len(owners)
    order = np.empty((cells, shards), np.int64)
    seen = list(dict.fromkeys(owners.tolist()))
    seen += [s for s in range(shards) if s not in seen]
    for cell in reversed(range(cells)):
        owner = int(owners[cell])
        if seen[0] != owner:
            seen.remove(owner)
            seen.insert(0, owner)
        order[cell] = seen
    return order


def deal(counts: dict[int, int], shards: int, cells: int = CELLS, salts: int = SALTS) -> list[tuple[int, int, int, int, int]]:
    """Place unit counts on the ring.  Returns (unit, first, end, shard, slot):
    ranks first..end-1 of the unit go to the shard from that slot on."""
    total = sum(counts.values())
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    order = clockwise(ring_owners(shards, cells), shards)
    slots = np.zeros(shards, np.int64)
    # a shared shuffled order, so that overflow isn't always the ring's last part
    waiting = sorted(((unit, 0, n) for unit, n in counts.items()), key=lambda u: spread_hash(u[0]))
    plan = []
    for hop in range(shards):
        left = []
        for unit, first, end in waiting:
            shard = order[unit // salts, hop]
            taken = min(end - first, int(room[shard]))
            if taken:
                plan.append((unit, first, first + taken, int(shard), int(slots[shard])))
                slots[shard] += taken
                room[shard] -= taken
            if first + taken < end:
                left.append((unit, first + taken, end))
        waiting = left
    return plan


def shard_rows(keyed: DataFrame, key: Column, shards: int = 16) -> DataFrame:
    """Add shard int and slot long to every row of ``keyed`` (a narrow digest).

    ``key`` is an expression of its columns.  The digest is checkpointed, so give it
    the columns you need and no texts.
    """
    keep = [c for c in keyed.columns if c.lower() not in ("shard", "slot")]
    columns = [F.col(f"`{c}`") for c in keep]
    counted = keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    unit = F.pmod(F.xxhash64(key), F.lit(CELLS)) * SALTS + F.pmod(F.xxhash64(*columns), F.lit(SALTS))
    spread = cut(counted.select(*columns, "__n", F.xxhash64(key).alias("__at"), unit.cast("int").alias("__unit")))
    counts = {r[0]: r[1] for r in spread.groupBy("__unit").agg(F.sum("__n")).collect()}  # at most CELLS * SALTS rows
    plan = keyed.sparkSession.createDataFrame(deal(counts, shards) or [], "__unit int, __first long, __end long, shard int, __slot long")
    before = Window.partitionBy("__unit").orderBy("__at", *columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = spread.withColumn("__rank", F.sum("__n").over(before) - F.col("__n"))
    # the plan has at most CELLS * SALTS + shards**2 rows: a proven bound
    low, high = F.greatest("__rank", "__first"), F.least(F.col("__rank") + F.col("__n"), F.col("__end"))
    placed = ranked.join(F.broadcast(plan), "__unit").where(low < high)
    runs = placed.select(*columns, "shard", (F.col("__slot") + low - F.col("__first")).alias("__slot"), (high - low).alias("__n"))
    return expand(runs, "__n", "__i").select(*columns, "shard", (F.col("__slot") + F.col("__i")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(digest, F.col("doc_id"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Bit-packed keys and padded names of the object table, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.arrayframe import ArrayMeta

# Fixed values of the id layout.
TILE_Z_BITS, TILE_Y_BITS, TILE_X_BITS, LOCAL_BITS = 10, 15, 15, 24


def _guard(value: Column, bits: int, name: str) -> Column:
    wrong = (value < 0) | (value >= (1 << bits))
    return F.when(wrong, F.raise_error(F.format_string(f"{name} %d does not fit {bits} bits", value)).cast("long")).otherwise(value)


def spatial_key(tz: Column, ty: Column, tx: Column) -> Column:
    """tz << 30 | ty << 15 | tx; raises beyond 10, 15 and 15 bits."""
    z, y, x = _guard(tz, TILE_Z_BITS, "tile_z"), _guard(ty, TILE_Y_BITS, "tile_y"), _guard(tx, TILE_X_BITS, "tile_x")
    return F.shiftleft(z, TILE_Y_BITS + TILE_X_BITS).bitwiseOR(F.shiftleft(y, TILE_X_BITS)).bitwiseOR(x)


def ordinal_bits(total_blocks: int) -> int:
    """Bits left for the ordinal beside the flat block index."""
    bits = LOCAL_BITS - (total_blocks - 1).bit_length()
    if bits <= 0:
        raise ValueError(f"{total_blocks} blocks leave no bits for ordinals")
    return bits


def local_id(flat: Column, ordinal: Column, bits: int) -> Column:
    wrong = (ordinal < 1) | (ordinal >= (1 << bits))
    checked = F.when(wrong, F.raise_error(F.format_string("ordinal %d is out of range", ordinal)).cast("long")).otherwise(ordinal)
    return F.shiftleft(flat, bits).bitwiseOR(checked)


def global_id(key: Column, local: Column) -> Column:
    """64 bits; negative as a signed number from tile_z 512 on."""
    return F.shiftleft(key, LOCAL_BITS).bitwiseOR(local)


def unsigned(bits: Column) -> Column:
    """The unsigned value of 64 bits, as decimal(20,0)."""
    wide = bits.cast("decimal(20,0)")
    return F.when(bits < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def unsigned_order(bits: Column) -> Column:
    """A signed number that sorts as the unsigned 64 bits do."""
    return bits.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def prefix_width(blocks: int) -> int:
    return max(2, len(str(blocks - 1)))


def block_prefix(meta: ArrayMeta, separator: str = "") -> Column:
    """Zero-padded Z, Y, X block index; a missing axis is block 0 of 1."""
    parts = []
    for axis in "ZYX":
        if axis in meta.axes:
            i = meta.axes.index(axis)
            parts.append(F.format_string(f"%0{prefix_width(meta.numblocks[i])}d", F.col(f"b_{axis.lower()}")))
        else:
            parts.append(F.lit("0" * prefix_width(1)))
    return F.concat_ws(separator, *parts)


def nonspatial_prefix(meta: ArrayMeta) -> Column | None:
    """t00_c01 of the block index of the other axes, or None."""
    parts = [
        F.concat(F.lit(a.lower()), F.format_string(f"%0{prefix_width(meta.numblocks[i])}d", F.col(f"b_{a.lower()}")))
        for i, a in enumerate(meta.axes)
        if a not in "ZYX"
    ]
    return F.concat_ws("_", *parts) if parts else None

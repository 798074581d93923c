"""Instance segmentation plug-in: labels are local to a block and never stitched.

``threshold_components`` marks positions above a threshold and numbers connected
components inside each block from 1, as ``uint32``.  A model-backed segmenter has
the same signature and gets its model through ``ctx.cached``.
"""

from __future__ import annotations

import numpy as np

from gridloom.arrayframe import ArrayFrame
from gridloom.operators.blocks import map_blocks, map_overlap


def label_components(mask: np.ndarray) -> np.ndarray:
    """Face-connected components, numbered in C order of their first position."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        spread = labels.copy()
        for axis in range(mask.ndim):
            lo = [slice(None)] * mask.ndim
            hi = [slice(None)] * mask.ndim
            lo[axis], hi[axis] = slice(None, -1), slice(1, None)
            a, b = spread[tuple(lo)], spread[tuple(hi)]
            both = (a > 0) & (b > 0)
            least = np.minimum(a, b)
            # a position is in both views: neither write may raise what the other lowered
            np.minimum(a, least, out=a, where=both)
            np.minimum(b, least, out=b, where=both)
        if (spread == labels).all():
            break
        labels = spread
    _, dense = np.unique(labels[labels > 0], return_inverse=True)
    out = np.zeros(mask.shape, np.uint32)
    out[labels > 0] = dense + 1
    return out


def threshold_components(block: np.ndarray, threshold: float | None = None, cellprob_threshold: float = 0.0) -> np.ndarray:
    return label_components(block > (cellprob_threshold if threshold is None else threshold))


def segment(frame: ArrayFrame, segmenter=threshold_components, depth=None, boundary="reflect", **params) -> ArrayFrame:
    """uint32 mask of the same shape; with ``depth`` the segmenter sees a halo."""
    if depth is None:
        return map_blocks(frame, segmenter, dtype="uint32", **params)
    return map_overlap(frame, segmenter, depth, boundary, dtype="uint32", **params)

"""Bilinear resampling of single frames, as an Arrow function on array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def triangle_weights(n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) weights of a triangle filter that widens when shrinking; rows sum to one."""
    scale = n_in / n_out
    support = max(scale, 1.0)
    centre = (np.arange(n_out)[:, None] + 0.5) * scale
    distance = np.abs(np.arange(n_in)[None, :] + 0.5 - centre) / support
    weights = np.clip(1.0 - distance, 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def resize_frame(frame: np.ndarray, new_h: int, new_w: int) -> np.ndarray:
    return triangle_weights(frame.shape[0], new_h) @ frame @ triangle_weights(frame.shape[1], new_w).T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def letterboxed(pixels: pd.Series, h: pd.Series, w: pd.Series, size: pd.Series, box: pd.DataFrame) -> pd.Series:
    """Frames (flat, row by row) resized to box (new_h, new_w) and centred on a zero square."""
    out, weights = [], {}
    layout = zip(pixels, h, w, size, box["new_h"], box["new_w"], box["top"], box["left"])
    for flat, rows, cols, side, new_h, new_w, top, left in layout:
        key = (rows, cols, new_h, new_w)
        if key not in weights:
            weights[key] = triangle_weights(rows, new_h), triangle_weights(cols, new_w).T
        down, across = weights[key]
        canvas = np.zeros((side, side), np.float32)
        frame = np.asarray(flat, np.float64).reshape(rows, cols)
        canvas[top:top + new_h, left:left + new_w] = down @ frame @ across
        out.append(canvas.ravel())
    return pd.Series(out)

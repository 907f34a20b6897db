"""Brute-force references in plain Python/pandas using the same md5 draws."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd


def md5_draw(seed: int, r: int, s: int, n: int) -> int:
    h = hashlib.md5(f"{seed}|{r}|{s}".encode()).hexdigest()
    return int(h[:15], 16) % n


def md5_uniform(seed: int, r: int, key) -> float:
    h = hashlib.md5(f"{seed}|{r}|{key}".encode()).hexdigest()
    return int(h[:13], 16) / 2.0**52


def replicate_frames(pdf: pd.DataFrame, key: str, n_iter: int, seed: int = 42):
    """Yield (r, resampled frame) with rows duplicated as drawn (index order = sorted key)."""
    base = pdf.sort_values(key).reset_index(drop=True)
    n = len(base)
    for r in range(n_iter):
        idx = [md5_draw(seed, r, s, n) for s in range(n)]
        yield r, base.iloc[idx]


def nearest(values, q):
    v = sorted(x for x in values if x is not None and not (isinstance(x, float) and math.isnan(x)))
    if not v:
        return None
    return v[int(math.floor((len(v) - 1) * q + 0.5))]


def median(values):
    v = [x for x in values if x is not None and not (isinstance(x, float) and math.isnan(x))]
    return float(np.median(v)) if v else None

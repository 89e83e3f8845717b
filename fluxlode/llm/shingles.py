"""Sets of word shingles as sorted hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words, mix, runs


def sets(w: Words, k: int = 3) -> list[np.ndarray]:
    """Each row's sorted distinct shingles of k words; of all its words if it has fewer; empty without words."""
    every = runs(w.hash, k)
    out = []
    for a, b in zip(w.doc[:-1], w.doc[1:]):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        else:
            out.append(runs(w.hash[a:b], int(b - a), seed=1000) if b > a else np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0].view(np.int64))


def lists(values: list[np.ndarray]) -> pa.ListArray:
    at = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    flat = np.concatenate([v.view(np.int64) for v in values]) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))

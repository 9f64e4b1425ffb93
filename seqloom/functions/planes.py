"""Whole numbers as bytes in planes: all lowest bytes, then all second ones and so on, as many as the largest number takes.

Shuffles compress such planes to little where numbers are small or alike.
"""

from __future__ import annotations

import numpy as np


def planed(values: np.ndarray) -> bytes:
    """Numbers from 0; the number of planes comes first."""
    own = np.ascontiguousarray(values, "<i8")
    width = max((int(own.view(np.uint64).max(initial=0)).bit_length() + 7) // 8, 1)
    return bytes([width]) + own.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def numbers(data: object) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    width = int(raw[0])
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = raw[1:].reshape(width, -1).T
    return out.view("<i8").ravel()


def planed_steps(values: np.ndarray) -> bytes:
    """Any LONGs by their differences, in an order where these are small."""
    steps = np.diff(values, prepend=np.int64(0))
    return planed(steps << 1 ^ steps >> 63)


def summed_steps(data: object) -> np.ndarray:
    steps = numbers(data)
    return np.cumsum((steps.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(steps & 1))

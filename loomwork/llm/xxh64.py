"""XXH64 of many byte slices at once (the published algorithm, in numpy)."""

from __future__ import annotations

import numpy as np

# Fixed values of the published algorithm.
P1, P2, P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
P4, P5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: bytes | np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of ``data[start : start + size]`` for each pair."""
    raw = data.tobytes() if isinstance(data, np.ndarray) else bytes(data)
    raw += b"\0" * 8
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    four = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    one = np.frombuffer(raw, np.uint8)
    at, left = starts.astype(np.int64), sizes.astype(np.int64)
    start = np.array([seed], np.uint64)
    out = np.repeat(start + P5, len(at))
    long = np.flatnonzero(left >= 32)
    if len(long):
        a, n = at[long].copy(), left[long].copy()
        lanes = [np.repeat(s, len(long)) for s in (start + P1 + P2, start + P2, start, start - P1)]
        live = np.arange(len(long))
        while len(live):
            for k in range(4):
                lanes[k][live] = _round(lanes[k][live], eight[a[live] + 8 * k])
            a[live] += 32
            n[live] -= 32
            live = live[n[live] >= 32]
        acc = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for lane in lanes:
            acc = (acc ^ _round(np.zeros_like(lane), lane)) * P1 + P4
        out[long] = acc
        at, left = at.copy(), left.copy()
        at[long], left[long] = a, n
    out += sizes.astype(np.uint64)
    for size, step in ((8, lambda h, p: _turn(h ^ _round(np.zeros_like(h), eight[p]), 27) * P1 + P4), (4, lambda h, p: _turn(h ^ (four[p].astype(np.uint64) * P1), 23) * P2 + P3), (1, lambda h, p: _turn(h ^ (one[p].astype(np.uint64) * P5), 11) * P1)):
        live = np.flatnonzero(left >= size)
        while len(live):
            out[live] = step(out[live], at[live])
            at[live] += size
            left[live] -= size
            live = live[left[live] >= size]
    out = (out ^ (out >> np.uint64(33))) * P2
    out = (out ^ (out >> np.uint64(29))) * P3
    return out ^ (out >> np.uint64(32))

"""Arrays packed into one binary column, so that a shuffle moves blocks instead of rows."""

from __future__ import annotations

import struct

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    head = [struct.pack("<i", len(arrays))]
    for a in arrays:
        head.append(struct.pack("<4sq", a.dtype.str.encode()[:4].ljust(4), a.size))
    return b"".join(head + [np.ascontiguousarray(a).tobytes() for a in arrays])


def unpack(data: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<i", data, 0)
    at, out, kinds = 4, [], []
    for _ in range(n):
        code, size = struct.unpack_from("<4sq", data, at)
        kinds.append((np.dtype(code.decode().strip()), size))
        at += 12
    for kind, size in kinds:
        out.append(np.frombuffer(data, kind, size, at))
        at += kind.itemsize * size
    return out


def split(keys: np.ndarray, *arrays: np.ndarray):
    """(key, parts of the arrays with that key), keys ascending."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], cuts]) if len(keys) else np.zeros(0, np.int64)
    ends = np.concatenate([cuts, [len(keys)]]) if len(keys) else starts
    arrays = [a[order] for a in arrays]
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        yield int(keys[s]), [a[s:e] for a in arrays]


def join(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the smallest unsigned type that holds them."""
    if len(x) and int(x.min()) < 0:
        return x
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def seven(x: np.ndarray) -> np.ndarray:
    """Integers below 2**56 as seven bytes each."""
    return np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :7]).reshape(-1)


def from_seven(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 7, 8), np.uint8)
    out[:, :7] = x.reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def pack_lists(owner: np.ndarray, value: np.ndarray) -> bytes:
    """(owner, 56-bit value) pairs: each owner once, with the number of its values."""
    order = np.argsort(owner, kind="stable")
    used, count = np.unique(owner[order], return_counts=True)
    return pack(used[:1].astype(np.int64), narrow(np.diff(used)), narrow(count), seven(value[order]))


def unpack_lists(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, steps, count, value = unpack(data)
    return np.repeat(np.concatenate([first, first + np.cumsum(steps.astype(np.int64))]), count), from_seven(value)

"""Integer arrays as compact bytes: byte planes, then zstandard."""

from __future__ import annotations

import struct

import numpy as np


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    out = []
    for x in arrays:
        planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
        used = x.itemsize
        while used > 1 and x.dtype.kind == "u" and not planes[:, used - 1].any():
            used -= 1
        out.append(struct.pack("<2sBQ", x.dtype.str[1:].encode(), used, len(x)) + planes[:, :used].T.tobytes())
    return zstandard.compress(b"".join(out), level)


def unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.decompress(raw), 0, []
    while at < len(data):
        kind, used, n = struct.unpack_from("<2sBQ", data, at)
        at += struct.calcsize("<2sBQ")
        size = int(kind[1:2])
        planes = np.zeros((n, size), np.uint8)
        planes[:, :used] = np.frombuffer(data, np.uint8, used * n, at).reshape(used, n).T
        out.append(planes.reshape(-1).view(kind.decode()))
        at += used * n
    return out


def deltas(ascending: np.ndarray) -> np.ndarray:
    out = ascending.astype(np.uint64, copy=True)
    out[1:] -= ascending[:-1].astype(np.uint64)
    return out


def undeltas(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)

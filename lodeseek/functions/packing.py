"""Fixed-width bit packing, most significant bit first, as numpy batches."""

from __future__ import annotations

import numpy as np


def packed_length(n: int, bits: int) -> int:
    return -(-n * bits // 8)


def pack(values, bits: int) -> bytes:
    """The low `bits` bits of each value in a row; the last byte is filled with zeros."""
    return pack_rows(np.asarray(values, np.uint8)[None], bits)[0].tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    return unpack_rows(np.frombuffer(data, np.uint8)[None], n, bits)[0]


def pack_rows(codes: np.ndarray, bits: int) -> np.ndarray:
    """(rows, n) small integers -> (rows, packed_length) bytes."""
    planes = np.unpackbits(codes.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits :]
    return np.packbits(planes.reshape(len(codes), -1), axis=1)


def unpack_rows(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    planes = np.unpackbits(data, axis=1)[:, : n * bits].reshape(len(data), n, bits)
    return (planes * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8)


def read_bit(data: bytes, at: int) -> int:
    return data[at >> 3] >> (7 - (at & 7)) & 1

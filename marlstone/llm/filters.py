"""Filters of hashes that occur more than once, built by counting packed hashes bucket by bucket.

A batch of hashes leaves its task as one row a bucket, with 32 bits a hash, sorted and compressed. A bucket's counts give bits of the hashes met
twice or more. A filter has a fixed number of bits at most; where it fills, more hashes seem repeated, none is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Most bits of a filter, whatever the input (128 MB), the most bits of a bucket, and hashes of a bucket, about.
MAX_BITS = 1 << 30
BUCKET_BITS = 1 << 18
BUCKET_HASHES = 1 << 17
PACKED = "bucket long, hashes binary"


def shape(hashes: int) -> tuple[int, int]:
    """(buckets, bits of each) for so many hashes: powers of two."""
    buckets = 1 << min(20, max(4, (hashes // BUCKET_HASHES).bit_length()))
    return buckets, max(8, min(BUCKET_BITS, MAX_BITS // buckets))


def place(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32-bit rest) of hashes; sorted hashes have sorted buckets."""
    return (h >> np.uint64(65 - buckets.bit_length())).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bit(rest: np.ndarray, bits: int) -> np.ndarray:
    return ((rest * np.uint32(2654435761)) >> np.uint32(33 - bits.bit_length())).astype(np.int64)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of equal length as compressed bytes; unsigned integers that are sorted take least. ``spread`` reverses it."""
    parts = [np.array([len(columns[0])], np.int64).tobytes()]
    for x in columns:
        if x.dtype.kind == "u" and x.ndim == 1 and x.itemsize > 1 and (x[1:] >= x[:-1]).all():
            x, mark = np.diff(x, prepend=np.zeros(1, x.dtype)), b"d"
        else:
            mark = b"r"
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize * (x.shape[1] if x.ndim > 1 else 1))
        # byte planes, so that the high bytes of small numbers stand together; text stays as it is
        parts += [mark, (raw if x.ndim > 1 else np.ascontiguousarray(raw.T)).tobytes()]
    whole = b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def spread(blob: bytes, dtypes: list) -> list[np.ndarray]:
    """The columns of ``squeeze``; a dtype is numpy's, or (dtype, width) for a table of bytes."""
    whole = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, at, out = int(np.frombuffer(whole, np.int64, 1)[0]), 8, []
    for t in dtypes:
        kind, width = t if isinstance(t, tuple) else (t, 0)
        kind = np.dtype(kind)
        size = n * kind.itemsize * max(1, width)
        mark, raw = whole[at : at + 1], np.frombuffer(whole, np.uint8, size, at + 1)
        x = raw.reshape(n, width).view(kind) if width else np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel()
        out.append(np.cumsum(x, dtype=kind) if mark == b"d" else x)
        at += 1 + size
    return out


def pack(h: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a bucket of sorted distinct hashes ``h`` with their counts ``n``, of which 255 is the most that is kept."""
    bucket, rest = place(h, buckets)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    n, blobs = np.minimum(n, 255).astype(np.uint8), []
    for i, j in zip(cuts, [*cuts[1:], len(h)]):
        order = np.argsort(rest[i:j], kind="stable")
        blobs.append(squeeze(rest[i:j][order], n[i:j][order]))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "hashes"])


def build(packed: DataFrame, buckets: int, bits: int, least: tuple[int, ...] = (2,)) -> list[np.ndarray]:
    """For each number of ``least`` the filter (buckets x bits / 8 bytes) of the hashes that were counted so often."""

    def meet(table: pa.Table) -> pa.Table:
        rest, n = (np.concatenate(x) for x in zip(*[spread(b, [np.uint32, np.uint8]) for b in table["hashes"].to_pylist()]))
        own, code = np.unique(rest, return_inverse=True)
        total = np.bincount(code, weights=n)
        maps = []
        for k in least:
            flags = np.zeros(bits, np.uint8)
            flags[_bit(own[total >= k], bits)] = 1
            maps.append(np.packbits(flags).tobytes())
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int64()), "bits": pa.array([b"".join(maps)], pa.binary())})

    out = [np.zeros((buckets, bits // 8), np.uint8) for _ in least]
    maps = packed.groupBy("bucket").applyInArrow(meet, "bucket long, bits binary").toArrow()
    for b, m in zip(maps["bucket"].to_pylist(), maps["bits"]):
        got = np.frombuffer(m.as_py(), np.uint8).reshape(len(least), -1)
        for k, whole in enumerate(out):
            whole[b] = got[k]
    return out


def test(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may have been counted so often."""
    buckets, width = filter_.shape
    bucket, rest = place(h, buckets)
    bit = _bit(rest, width * 8)
    return (filter_[bucket, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0

"""Sealed payloads: ChaCha20-Poly1305 as RFC 8439 defines it, all blocks of a batch computed together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = 16
#: Bytes of payloads that are sealed or opened at a time.
SLICE = 4 << 20


def key_stream(key: bytes, nonces: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """A row of 64 bytes for each block: nonces (blocks, 3) and counters (blocks,) of 32 bits."""
    start = np.empty((16, len(counters)), np.uint32)
    start[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    start[4:12] = np.frombuffer(key, "<u4")[:, None]
    start[12], start[13:] = counters, nonces.T
    a, b, c, d = (start[i : i + 4].copy() for i in (0, 4, 8, 12))

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint32(n) | x >> np.uint32(32 - n)

    for half in range(20):
        # Columns in even half-rounds; in odd ones the rows are turned, so that diagonals are columns.
        if half % 2:
            b, c, d = np.roll(b, -1, 0), np.roll(c, -2, 0), np.roll(d, -3, 0)
        for first, second in ((16, 12), (8, 7)):
            a = a + b
            d = turn(d ^ a, first)
            c = c + d
            b = turn(b ^ c, second)
        if half % 2:
            b, c, d = np.roll(b, 1, 0), np.roll(c, 2, 0), np.roll(d, 3, 0)
    return np.ascontiguousarray((np.concatenate([a, b, c, d]) + start).T).astype("<u4").view(np.uint8).reshape(-1, 64)


def authenticator(key: bytes, message: bytes) -> bytes:
    """Poly1305 of a message under a one-time key."""
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    total, prime = 0, (1 << 130) - 5
    for i in range(0, len(message), 16):
        total = (total + int.from_bytes(message[i : i + 16] + b"\1", "little")) * r % prime
    return (total + int.from_bytes(key[16:32], "little") & (1 << 128) - 1).to_bytes(16, "little")


def _tagged(one_time: bytes, extra: bytes, data: bytes) -> bytes:
    padded = lambda b: b + bytes(-len(b) % 16)
    return authenticator(one_time, padded(extra) + padded(data) + len(extra).to_bytes(8, "little") + len(data).to_bytes(8, "little"))


def _streams(key: bytes, nonces: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """For each payload its one-time key's block, then the bytes that cover it."""
    blocks = np.array([1 + -(-n // 64) for n in sizes])
    ends = np.cumsum(blocks)
    words = np.frombuffer(b"".join(nonces), "<u4").reshape(-1, 3)
    counters = (np.arange(ends[-1]) - np.repeat(ends - blocks, blocks)).astype(np.uint32)
    flat = key_stream(key, np.repeat(words, blocks, axis=0), counters).reshape(-1)
    return np.split(flat, ends[:-1] * 64)


def seal(key: bytes, nonces: list[bytes], payloads: list[bytes], extra: bytes = b"") -> list[bytes]:
    """Each payload encrypted, its tag of 16 bytes behind it."""
    out = []
    for stream, data in zip(_streams(key, nonces, [len(p) for p in payloads]) if payloads else [], payloads, strict=True):
        hidden = (np.frombuffer(data, np.uint8) ^ stream[64 : 64 + len(data)]).tobytes()
        out.append(hidden + _tagged(stream[:32].tobytes(), extra, hidden))
    return out


def unseal(key: bytes, nonces: list[bytes], sealed: list[bytes], extra: bytes = b"") -> list[bytes | None]:
    """Each payload, or None where its tag is not right."""
    out: list[bytes | None] = []
    for stream, data in zip(_streams(key, nonces, [max(0, len(p) - TAG) for p in sealed]) if sealed else [], sealed, strict=True):
        hidden, tag = data[:-TAG], data[-TAG:]
        good = len(data) >= TAG and _tagged(stream[:32].tobytes(), extra, hidden) == tag
        out.append((np.frombuffer(hidden, np.uint8) ^ stream[64 : 64 + len(hidden)]).tobytes() if good else None)
    return out


def _column(work, key: bytes, payload: Column, number: Column, extra: bytes) -> Column:  # noqa: ANN001
    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, numbers in batches:
            # Payloads are taken out of a batch, and put back, a slice at a time.
            sizes = pc.fill_null(pc.binary_length(data), 0).to_pylist()
            at = 0
            while at < len(sizes):
                start, total = at, 0
                while at < len(sizes) and (total < SLICE or at == start):
                    total += sizes[at]
                    at += 1
                rows = data.slice(start, at - start).to_pylist()
                todo = [i for i, x in enumerate(rows) if x is not None]
                nonces = [int(numbers[start + i].as_py()).to_bytes(12, "little") for i in todo]
                for i, got in zip(todo, work(key, nonces, [rows[i] for i in todo], extra), strict=True):
                    rows[i] = got
                yield pa.array(rows, pa.binary())

    return run(payload, number.cast("long"))


def sealed(key: bytes, payload: Column, number: Column, extra: bytes = b"") -> Column:
    """Binary payloads sealed under a nonce made of a number of no repeat, not negative; null stays null."""
    return _column(seal, key, payload, number, extra)


def opened(key: bytes, payload: Column, number: Column, extra: bytes = b"") -> Column:
    """What was sealed; null where key, number, extra or bytes are not those."""
    return _column(unseal, key, payload, number, extra)

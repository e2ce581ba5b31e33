"""Elias-Fano sequences over numpy: monotone unsigned integers in about 2 + log2(universe / n) bits each.

Every value is cut into l low bits, packed, and a high part, written in unary in a bit string: a one for each value and a
zero behind each high part. Access selects ones, successor search selects zeros; both take whole arrays of questions.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16  # bytes of the unary bit string for each entry of the directory
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: PLACE[b, r]: position of the r-th one in byte b, least significant bit first.
PLACE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate(i for i in range(8) if _b >> i & 1):
        PLACE[_b, _r] = _p


class EliasFano:
    """Fields: n, l, low (packed uint64), high (uint8), ones and zeros (how many there are before each block of high).

    All of them may be views into a mapped file, so a sequence that is only looked up takes no memory of its own.
    """

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.low, self.high, self.ones, self.zeros = n, l, low, high, ones, zeros

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values: sorted, below universe, as uint64."""
        n = len(values)
        l = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = n * l
        low = np.zeros((bits >> 6) + 2, np.uint64)
        if l:
            part = values & np.uint64((1 << l) - 1)
            at = np.arange(n, dtype=np.int64) * l
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + l > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = (values >> np.uint64(l)).astype(np.int64)
        size = n + (int(universe) >> l) + 2
        blocks = -(-size // (BLOCK * 8)) + 1
        high = np.zeros(blocks * BLOCK * 8, bool)
        high[top + np.arange(n)] = True
        high = np.packbits(high, bitorder="little")
        per = ONES[high].reshape(blocks, BLOCK).sum(axis=1, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(per)[:-1]])
        kind = np.uint32 if blocks * BLOCK * 8 < 1 << 32 else np.uint64
        return cls(n, l, low, high, ones.astype(kind), (np.arange(blocks) * (BLOCK * 8) - ones).astype(kind))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.l
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        # A shift by 64 is undefined, so the next word is shifted in two steps.
        second = (self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return (first | second) & np.uint64((1 << self.l) - 1)

    def _select(self, counts: np.ndarray, k: np.ndarray, flip: int) -> np.ndarray:
        """Position in high of the k-th (from 0) one, or zero with flip=255."""
        out = np.empty(len(k), np.int64)
        for lo in range(0, len(k), 1 << 15):
            q = k[lo : lo + (1 << 15)]
            block = np.searchsorted(counts, q.astype(counts.dtype), "right") - 1
            rest = q - counts[block].astype(np.int64)
            raw = self.high[(block * BLOCK)[:, None] + np.arange(BLOCK)]
            raw = raw ^ np.uint8(flip)
            cum = np.cumsum(ONES[raw], axis=1, dtype=np.int16)
            byte = (cum <= rest[:, None]).sum(axis=1)
            rows = np.arange(len(q))
            rest = rest - np.where(byte > 0, cum[rows, np.maximum(byte - 1, 0)], 0)
            out[lo : lo + len(q)] = (block * BLOCK + byte) * 8 + PLACE[raw[rows, byte], rest]
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        top = (self._select(self.ones, i, 0) - i).astype(np.uint64)
        return top << np.uint64(self.l) | self._lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x, in 0 .. universe, the position of the first value >= x, and whether that value is x itself."""
        x = np.asarray(x, np.uint64)
        if not len(x) or not self.n:
            return np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        top, rest = (x >> np.uint64(self.l)).astype(np.int64), x & np.uint64((1 << self.l) - 1)
        lo = np.where(top > 0, self._select(self.zeros, np.maximum(top - 1, 0), 255) + 1 - top, 0)
        last = self._select(self.zeros, top, 255) - top
        hi = last.copy()
        live = np.flatnonzero(lo < hi)  # values with one high part are sorted by their low parts
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._lows(mid) < rest[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        same = lo < last
        same[same] = self._lows(lo[same]) == rest[same]
        return lo, same

    def parts(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.l], np.int64), "low": self.low, "high": self.high, "ones": self.ones, "zeros": self.zeros}

    @classmethod
    def of_parts(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        n, l = parts["head"].tolist()
        return cls(n, l, parts["low"], parts["high"], parts["ones"], parts["zeros"])


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in one file: each name, kind and length in a text line, then the arrays, each from a multiple of 8 on."""
    lines, body, at = [], [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        lines.append(f"{name} {a.dtype.str} {len(a)} {at}")
        body.append(raw + bytes(-len(raw) % 8))
        at += len(body[-1])
    head = "\n".join(lines).encode()
    size = 8 + len(head) + (-len(head) % 8)
    return size.to_bytes(8, "little") + head.ljust(size - 8, b"\n") + b"".join(body)


def unpack(raw: np.ndarray) -> dict[str, np.ndarray]:
    """Views into a (memory-mapped) file of pack."""
    size = int(raw[:8].view(np.uint64)[0])
    out = {}
    for line in raw[8:size].tobytes().decode().split("\n"):
        if line:
            name, kind, n, at = line.split(" ")
            dtype = np.dtype(kind)
            lo = size + int(at)
            out[name] = raw[lo : lo + int(n) * dtype.itemsize].view(dtype)
    return out


def prefixed(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def of_prefix(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k[len(prefix) + 1 :]: v for k, v in arrays.items() if k.startswith(prefix + ".")}

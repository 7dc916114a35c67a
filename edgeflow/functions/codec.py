"""Byte codes of positive gaps: zero-prefixed big-endian, and LEB128."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def delta_hex(gap: Column) -> Column:
    """A gap of k + 1 bytes is k zero bytes, then its bytes, highest first; upper-case hex."""
    digits = F.hex(gap)
    size = F.ceil(F.length(digits) / 2).cast("int")
    return F.concat(F.repeat(F.lit("00"), size - 1), F.lpad(digits, size * 2, "0"))


def delta_bytes(gap: Column) -> Column:
    return F.unhex(delta_hex(gap))


def delta_length(gap: Column) -> Column:
    return (2 * F.ceil(F.length(F.hex(gap)) / 2) - 1).cast("bigint")


def _byte_rows(values: np.ndarray) -> np.ndarray:
    """The eight bytes of each value, highest first."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)


def delta_encode(gaps: np.ndarray) -> bytes:
    """A whole stream at once: row by row the zeros, then the bytes; a gap of 0 is an error."""
    gaps = np.asarray(gaps, np.uint64)
    if (gaps == 0).any():
        raise ValueError("edge (0, 0) cannot be delta coded")
    if not len(gaps):
        return b""
    rows = _byte_rows(gaps)
    size = 8 - (rows != 0).argmax(axis=1)
    both = np.concatenate([np.zeros((len(gaps), 7), np.uint8), rows], axis=1)
    # Eight bytes end each row; a value of so many takes as many and one less zeros before them.
    return both[np.arange(15)[None, :] >= 15 - (2 * size - 1)[:, None]].tobytes()


#: Zeros before a value at most; places of values are found so many steps, and bytes, at a time.
ZEROS, STRIDE, PIECE = 7, 64, 1 << 18
#: How a block of a stream may be entered: inside a value that ends so many bytes later, or (below 0) after so many of its zeros.
ENTRIES = range(-ZEROS, ZEROS + 1)
BAD = ZEROS + 1


class _Places:
    """Where values would end in a piece of a stream, from every byte on as if one began there.

    Past the piece's ``n`` bytes lie the ways to leave it: ``n + k`` for k bytes of a value that
    come later, ``n + BAD + k`` after k of its zeros, ``n + 2 * BAD`` for no value of eight bytes.
    """

    def __init__(self, data: np.ndarray):
        n = self.n = len(data)
        at = np.arange(n, dtype=np.int32)
        # The first byte that is not zero, from each on.
        self.top = np.minimum.accumulate(np.where(data != 0, at, np.int32(n))[::-1])[::-1]
        zeros = self.top - at
        end = np.where(self.top < n, self.top + zeros + 1, n + BAD + zeros)
        stay = np.arange(n, n + 2 * BAD + 1, dtype=np.int32)
        self.next = np.concatenate([np.where(zeros > ZEROS, np.int32(n + 2 * BAD), end), stay])
        self.far = self.next
        for _ in range(STRIDE.bit_length() - 1):
            self.far = self.far[self.far]

    def leave(self, entry: int) -> int:
        """How the piece is left, as an entry to what follows, if it is entered so; ``BAD`` if that is no stream."""
        n, at = self.n, entry
        if entry < 0:
            top = int(self.top[0]) if n else 0
            if top == n:
                return entry - n if n - entry <= ZEROS else BAD
            at = 2 * top - entry + 1 if top - entry <= ZEROS else n + 2 * BAD
        if at >= n and at < n + BAD:
            return at - n
        while at < n:
            at = int(self.far[at])
        way = at - n
        return way if way < BAD else BAD - way if way < 2 * BAD else BAD

    def begins(self) -> np.ndarray:
        """Where the values from the first byte on begin, in order."""
        anchors, at = [], 0
        while at < self.n:
            anchors.append(at)
            at = int(self.far[at])
        steps = np.empty((STRIDE, len(anchors)), np.int32)
        now = np.array(anchors, np.int32)
        for k in range(STRIDE):
            steps[k] = now
            now = self.next[now]
        steps = steps.T.ravel()
        return steps[steps < self.n]


def _values(data: np.ndarray, begin: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The values that begin at some places and whose highest bytes are at others."""
    size = top - begin + 1
    out = np.zeros(len(begin), np.uint64)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[more] = (out[more] << np.uint64(8)) | data[top[more] + k]
    return out


class DeltaStream:
    """Gaps of a stream that comes in pieces; what a piece leaves unfinished goes before the next."""

    def __init__(self):
        self.rest = b""

    def feed(self, piece: bytes) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for i in range(0, len(piece), PIECE):
            data = np.frombuffer(self.rest + piece[i : i + PIECE], np.uint8)
            places = _Places(data)
            begin = places.begins()
            whole = begin[places.next[begin] <= len(data)]
            out.append(_values(data, whole, places.top[whole]))
            end = int(places.next[whole[-1]]) if len(whole) else 0
            self.rest = data[end:].tobytes()
            if len(self.rest) > 2 * ZEROS:
                raise ValueError("a value of over eight bytes")
        return np.concatenate(out)

    def close(self) -> None:
        if self.rest:
            raise ValueError("the delta stream ends inside a value")


def delta_exits(pieces) -> list[int]:
    """For each of ``ENTRIES`` to some bytes, the entry to what follows them; ``BAD`` if they are no stream from there on.

    So blocks of a stream can be looked at apart and stitched: one's exit is the next one's entry.
    """
    exits = list(ENTRIES)
    for data in pieces:
        for i in range(0, len(data), PIECE):
            places = _Places(np.frombuffer(data[i : i + PIECE], np.uint8))
            ways = {e: places.leave(e) if e != BAD else BAD for e in set(exits)}
            exits = [ways[e] for e in exits]
    return exits


def delta_decode(data: bytes) -> list[int]:
    """Gaps of a whole stream; a stream that ends inside a value is an error."""
    stream = DeltaStream()
    out = stream.feed(data).tolist()
    stream.close()
    return out


def leb128_length(gap: Column) -> Column:
    """Bytes of seven bits each, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(gap)) / 7)).cast("bigint")


def leb128(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Values as LEB128, one after the other, and how many bytes each takes."""
    values = np.asarray(values, np.uint64)
    steps = values[:, None] >> np.arange(0, 70, 7, dtype=np.uint64).clip(max=63)[None, :]
    steps[:, 9] = values >> np.uint64(63)
    size = np.maximum((steps != 0).sum(axis=1), 1)
    place = np.arange(10)[None, :]
    digits = (steps & np.uint64(127)).astype(np.uint8) | np.where(place < size[:, None] - 1, 128, 0).astype(np.uint8)
    return digits[place < size[:, None]].tobytes(), size


def leb128_decode(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of LEB128 bytes and where each begins; bytes that end inside a value are an error."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if data[-1] & 128:
        raise ValueError("the bytes end inside a value")
    start = np.flatnonzero(np.concatenate([[True], data[:-1] < 128]))
    place = np.arange(len(data)) - np.repeat(start, np.diff(start, append=len(data)))
    digits = (data & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64))
    return np.bitwise_or.reduceat(digits, start), start

"""Adaptive context-mixing range coder for token ids below 65535, many blocks side by side.

Each id is coded by one of three events: the id predicted by the last two ids, the id predicted by the last
one, or neither. The events' frequencies are a mix: the counts kept for the state of the order-2 prediction, of
the order-1 prediction and of the block as a whole are added, so the better tried context weighs more. An id
that was not predicted takes its share of the third event by its order-0 frequency, a table that adapts to each
segment and stands in its head. Predictions and counts start anew in every block, so blocks of a segment
decode independently. Blocks advance in step, one id each, and a step is a few numpy operations over all of
them. Only integer operations and one division of doubles decide, which any machine computes alike.

A segment is: magic, pairs (uint32), blocks (uint32), crc32 of all that follows up to the blocks, the order-0 table as
ids and then frequencies (uint16 each, summing up to 2**16), then the blocks. A block is: ids (uint32), words
(uint32), crc32 of the ids as little-endian uint32, the words of 24 bits each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"PFT2"
HEAD, BLOCK_HEAD = struct.Struct("<4sIII"), struct.Struct("<III")
#: Ids of a block; blocks that advance together at most: all of a usual segment (20 MB of text has about 4100), as a step
#: costs much the same for few of them. Their tables take 4 KB each. How many advance together leaves no trace in the bytes.
BLOCK, LANES = 2048, 5120
O_BITS, TOTAL = 9, 16
#: Ids are below this.
NO_ID = 65535
_U = np.uint64
#: The code's window has 62 bits: a word of 24 that is written next, and 38 below, which a range never stays under.
_WORD, _TOP, _MASK = _U(38), _U(1 << 38), _U((1 << 62) - 1)
_STEP_BITS, _REST = _U(24), _U(14)
_FIELD = _U((1 << 21) - 1)
#: What each event adds to the packed counts, by (order 2 held) + 2 * (order 1 held).
_EVENT = 24 * np.array([1 << 42, 1, 1 << 21, 1], np.int64)
#: Change of an entry by confidence, and by 4 + confidence if it held; a weak entry that failed is replaced.
_STEP = np.array([0, 0, -65536, -65536, 65536, 65536, 65536, 0], np.int32)


class Order0:
    """Frequencies of ids that sum up to 2**16, each id of the segment at least 1."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray) -> None:
        self.ids, self.freq = ids.astype(np.int64), freq.astype(np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.size[self.ids] = self.freq
        self.start = np.cumsum(self.size) - self.size
        self.of = np.repeat(self.ids, self.freq)

    @classmethod
    def fit(cls, ids: np.ndarray) -> Order0:
        n = np.bincount(ids, minlength=1 << 16)
        seen = np.flatnonzero(n)
        room = (1 << TOTAL) - len(seen)
        freq = 1 + n[seen] * room // max(int(n.sum()), 1)
        if len(seen):
            freq[np.argmax(freq)] += (1 << TOTAL) - freq.sum()
        return cls(seen, freq)

    def pack(self, blocks: int) -> bytes:
        # A frequency of 2**16 (one id only) is written as 0.
        body = self.ids.astype("<u2").tobytes() + (self.freq & 0xFFFF).astype("<u2").tobytes()
        return HEAD.pack(MAGIC, len(self.ids), blocks, zlib.crc32(body)) + body


class _Lanes:
    """Model and coder state of n blocks.

    Order 2 is row 0 and order 1 row 1 of all two-row arrays. An entry of a prediction table is the id that followed
    last plus its confidence (0 to 3) in the bits above; an empty one has an id that is none. The three events' counts are 21-bit fields of one
    integer, so that one addition mixes them.
    """

    def __init__(self, n: int) -> None:
        self.row = np.arange(n, dtype=np.int64)
        self.base = np.stack([self.row << O_BITS, (self.row + n) << O_BITS])
        self.table = np.full(2 * n << O_BITS, NO_ID, np.int32)
        self.past = np.zeros((2, n), np.uint32)  # the last two ids as one number, and the last one
        # Counts of the events by state; predictions of higher confidence start higher.
        e2 = [[1, 8, 32]] * 2 + [[8, 4, 16], [16, 1, 8], [32, 4, 8], [48, 1, 4], [64, 2, 4], [64, 1, 2]]
        e1 = [[4, 1, 32], [4, 8, 32], [4, 24, 16], [4, 48, 8]]
        packed = np.array([x + (y << 21) + (z << 42) for x, y, z in (*e2, *e1)], np.int64)
        self.events = np.concatenate([np.tile(packed[:8], n), np.tile(packed[8:], n)])
        self.state = np.stack([self.row << 3, 8 * n + (self.row << 2)])
        self.all = np.full(n, 4 + (4 << 21) + (16 << 42), np.int64)
        self.low, self.range = np.zeros(n, _U), np.full(n, 1 << 62, _U)

    def predict(self, m: int):
        """Ends of the first two events' shares, and the third's size."""
        h = self.past[:, :m] * np.uint32(2654435761)
        h >>= np.uint32(32 - O_BITS)
        self.at = self.base[:, :m] + h
        self.old = self.table.take(self.at, mode="clip")
        self.q = self.old & 0xFFFF
        self.conf = self.old >> 16
        s = self.state[:, :m] + self.conf
        s[0] += self.conf[0]
        s[0] += self.q[0] == self.q[1]
        self.s, e = s, self.events.take(s, mode="clip")
        self.counts = e
        e = (e[0] + e[1] + self.all[:m]).view(_U)
        a = e & _FIELD
        c = e >> _U(42)
        b = (e >> _U(21) & _FIELD) + a
        r = _quotient(self.range[:m], b + c)
        a *= r
        b *= r
        c *= r
        return a, b, c

    def learn(self, m: int, x: np.ndarray, hit: np.ndarray) -> None:
        """hit: whether the predictions held."""
        h = hit.view(np.int8)
        conf = self.conf + (h << 2)
        self.table[self.at] = np.where(conf > 1, self.old + _STEP.take(conf, mode="clip"), x.astype(np.int32) | 65536)
        inc = _EVENT.take(h[0] + 2 * h[1], mode="clip")
        self.events[self.s] = self.counts + inc
        self.all[:m] += inc
        last = self.past[1, :m]
        np.multiply(last, np.uint32(40503), out=self.past[0, :m])
        last[:] = x
        self.past[0, :m] += last


def _quotient(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """At most r / n, and hardly less: one division of doubles, which all machines round alike. r: from 2**38 to 2**62, n: below 2**18."""
    q = (((r >> _U(10)) - _U(1)).view(np.int64).astype(np.float64) / n.view(np.int64)).astype(np.int64).view(_U)
    q <<= _U(10)
    return q


def _narrow(l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
    """Where the range straddles a word's end, it is cut to what lies before it."""
    return np.where(((l ^ (l + r - _U(1))) >> _WORD) != 0, _TOP - (l & (_TOP - _U(1))), r)


def _encode(ids: np.ndarray, sizes: np.ndarray, order0: Order0) -> list[bytes]:
    """ids: steps by lanes, longest lane first."""
    steps, n = ids.shape
    s = _Lanes(n)
    # Words by their numbers and then by lanes, so that a step writes close together.
    flat = np.zeros((steps * 3 + 8) * n, np.uint32)
    pos = s.row.copy()
    low, rng = s.low, s.range
    starts, shares = order0.start.astype(_U), order0.size.astype(_U)
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    for t in range(steps):
        m = int(active[t])
        a, b, c = s.predict(m)
        x = ids[t, :m]
        hit = s.q == x.astype(np.int32)
        hit2, hit1 = hit
        c >>= _U(TOTAL)
        low[:m] += np.where(hit2, _U(0), np.where(hit1, a, b + starts.take(x, mode="clip") * c))
        rng[:m] = np.where(hit2, a, np.where(hit1, b - a, shares.take(x, mode="clip") * c))
        at = np.flatnonzero(rng[:m] < _TOP)
        while len(at):
            l = low[at]  # noqa: E741
            r = _narrow(l, rng[at]) << _STEP_BITS
            p = pos[at]
            flat[p] = l >> _WORD
            pos[at] = p + n
            low[at] = (l << _STEP_BITS) & _MASK
            rng[at] = r
            at = at[r < _TOP]
        s.learn(m, x, hit)
    for word in (low >> _WORD, low >> _REST, low << _U(10)):
        flat[pos] = word & _U(0xFFFFFF)
        pos += n
    count = pos // n
    lanes = np.ascontiguousarray(flat.reshape(-1, n)[: count.max()].T).astype("<u4", copy=False)
    return [x[:k].view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for x, k in zip(lanes, count.tolist())]


def _decode(words: list[np.ndarray], sizes: np.ndarray, order0: Order0) -> np.ndarray:
    n, steps = len(words), int(sizes.max())
    s = _Lanes(n)
    lanes = np.zeros((n, max(map(len, words)) + 3, 4), np.uint8)
    for x, w in zip(lanes, words):
        x[: len(w), :3] = w
    flat = np.ascontiguousarray(lanes.view("<u4")[:, :, 0].T).ravel()
    first = [flat[s.row + k * n].astype(_U) for k in range(3)]
    pos = s.row + 3 * n
    # gap is the code minus low; the last word read so far has ten bits to come.
    gap = (first[0] << _WORD) | (first[1] << _REST) | (first[2] >> _U(10))
    held = first[2] & _U(1023)
    low, rng = s.low, s.range
    starts, shares, of = order0.start.astype(_U), order0.size.astype(_U), order0.of
    out = np.zeros((steps, n), np.int64)
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    for t in range(steps):
        m = int(active[t])
        a, b, c = s.predict(m)
        c >>= _U(TOTAL)
        g = gap[:m]
        first, third = g < a, g >= b
        y = of.take(((g - np.where(third, b, g)) // c).view(np.int64), mode="clip")
        x = np.where(first, s.q[0], np.where(third, y, s.q[1]))
        start = np.where(first, _U(0), np.where(third, b + starts.take(x, mode="clip") * c, a))
        low[:m] += start
        gap[:m] -= start
        rng[:m] = np.where(first, a, np.where(third, shares.take(x, mode="clip") * c, b - a))
        at = np.flatnonzero(rng[:m] < _TOP)
        while len(at):
            l = low[at]  # noqa: E741
            r = _narrow(l, rng[at]) << _STEP_BITS
            p = pos[at]
            w = flat.take(p, mode="clip").astype(_U)  # a damaged stream ends in a wrong checksum
            gap[at] = (gap[at] << _STEP_BITS) | (held[at] << _REST) | (w >> _U(10))
            held[at] = w & _U(1023)
            pos[at] = p + n
            low[at] = (l << _STEP_BITS) & _MASK
            rng[at] = r
            at = at[r < _TOP]
        out[t, :m] = x
        s.learn(m, x, s.q == x.astype(np.int32))
    return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _together(n: int) -> int:
    """How many of n blocks advance at a time: alike shares of at most LANES."""
    return max(1, -(-n // max(1, -(-n // LANES))))


def encode_segment(ids: np.ndarray) -> bytes:
    """All ids (in order) as one segment; no ids give a head only."""
    if len(ids) and int(ids.max()) >= NO_ID:
        raise ValueError(f"ids must be below {NO_ID}")
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    order0 = Order0.fit(ids)
    coded: list[bytes] = []
    lanes = _together(len(blocks))
    for i in range(0, len(blocks), lanes):
        some = blocks[i : i + lanes]
        sizes = np.array([len(b) for b in some])
        table = np.zeros((int(sizes.max()), len(some)), np.int64)
        for j, b in enumerate(some):
            table[: len(b), j] = b
        coded += _encode(table, sizes, order0)
    return b"".join([order0.pack(len(blocks)), *(x for b, c in zip(blocks, coded) for x in (BLOCK_HEAD.pack(len(b), len(c) // 3, crc(b)), c))])


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError where the magic or a checksum differs."""
    magic, pairs, count, check = HEAD.unpack_from(data)
    at = HEAD.size + 4 * pairs
    if magic != MAGIC or zlib.crc32(data[HEAD.size : at]) != check:
        raise ValueError("not a segment of token ids")
    table = np.frombuffer(data, "<u2", 2 * pairs, HEAD.size).astype(np.int64)
    freq = table[pairs:]
    order0 = Order0(table[:pairs], np.where(freq == 0, 1 << TOTAL, freq))
    blocks = []
    for _ in range(count):
        n, words, check = BLOCK_HEAD.unpack_from(data, at)
        at += BLOCK_HEAD.size
        blocks.append((n, check, np.frombuffer(data, np.uint8, 3 * words, at).reshape(-1, 3)))
        at += 3 * words
    out = []
    lanes = _together(count)
    for i in range(0, count, lanes):
        some = blocks[i : i + lanes]
        table = _decode([b[2] for b in some], np.array([b[0] for b in some]), order0)
        for j, (n, check, _) in enumerate(some):
            ids = table[:n, j].astype(np.uint32)
            if crc(ids) != check:
                raise ValueError("checksum of a block differs")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)

"""An adaptive context-mixing range coder for token ids, in blocks that are reset and checksummed apart.

Blocks are independent, so a batch of them is coded side by side: every step codes one id of each block with NumPy. A
block is two range-coded streams: for each id, whether order 2, order 1 or neither foretold it, and the ids that neither
did, by order 0. All totals are powers of two, so that a step has no division by them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: A block on disk: magic, number of ids, number of 16-bit words that follow, crc32 of the ids as little-endian u32.
HEAD = struct.Struct("<4sIII")
#: What follows in a block that isn't empty, before its two streams: ids left to order 0, 32-bit words of the first stream.
PARTS = struct.Struct("<II")
MAGIC = b"NFR3"
BLOCK_IDS = 4096

_SLOTS_BITS = 11
_SLOTS = 1 << _SLOTS_BITS
_U = np.uint64
# Constants are arrays of no dimension: with scalars of NumPy, an operation on a thousand lanes takes twice as long.
_LEAST, _WORD, _TOTAL_BITS, _TOTAL = np.array(1 << 32, _U), np.array(32, _U), np.array(16, _U), np.array(1 << 16, _U)
_HALF, _LOW_HALF, _ONE, _TWO = (np.array(x, np.uint32) for x in (16, 0xFFFF, 1, 2))
_MIX, _MIX_SHIFT = np.array(0x9E3779B1, np.uint32), np.array(32 - _SLOTS_BITS, np.uint32)
_NEXT = np.array(1, np.int64)
#: Shares of 2**16 as order 2's | with order 1's << 16, and what is added when order 2's id came, order 1's or neither;
#: before that, each loses its 2**-4. No share becomes 0 and none all, however long one outcome lasts.
_SHARE = np.uint32(10923 | 21845 << 16)
_SHARE_RATE, _SHARE_MASK = np.array(5, np.uint32), np.array(0x07FF07FF, np.uint32)
_SHARE_INC = np.array([2046 | 2047 << 16, 1 | 2047 << 16, 1 | 2 << 16], np.uint32)
#: A row of bands has the shares of 2**16 below each; it loses its 2**-6, and gets a band's step when that comes.
_BANDS, _BAND_RATE = 16, np.array(7, np.uint16)
_ROW = np.arange(0, 1 << 16, 1 << 12).astype(np.uint16)
_STEP = np.where(np.arange(16)[None, :] > np.arange(16)[:, None], 496 + np.arange(16), np.arange(16)).astype(np.uint16)


class Prior:
    """The frequencies of order 0 that all blocks start from: a file's counts of ids, which it holds at its head.

    Ids in order of frequency are cut into 16 bands of about equal mass. How often each band comes is learned anew in
    every block; within a band, ids have their frequencies in the file. Without counts, all ids are equally frequent.
    """

    def __init__(self, counts: np.ndarray | None = None) -> None:
        counts = np.ones(1 << 16, np.int64) if counts is None else np.asarray(counts, np.int64)
        ids = np.lexsort((np.arange(len(counts)), -counts))
        ids = ids[counts[ids] > 0]
        own = counts[ids].astype(object)  # whole numbers of any size, so that every reader builds the same table
        total = int(own.sum()) if len(ids) else 1
        before = np.concatenate(([0], np.cumsum(own)))[:-1] if len(ids) else np.zeros(0, object)
        band = np.array([int(x) * _BANDS // total for x in before], np.int64)
        self.band, self.low, self.freq = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, _U), np.zeros(1 << 16, _U)
        # a band that never comes still has a share, and may be read from damaged data
        self.bits, self.base, found = np.zeros(_BANDS, _U), np.zeros(_BANDS, np.int64), [np.zeros(1, np.uint16)]
        at = 1
        for b in range(_BANDS):
            here = np.flatnonzero(band == b)
            if len(here):
                bits = 14 if len(here) <= 1 << 10 else 16
                mass, rest = int(own[here].sum()), (1 << bits) - len(here)
                f = np.array([1 + int(x) * rest // mass for x in own[here]], np.int64)
                f[0] += (1 << bits) - f.sum()
                self.band[ids[here]], self.freq[ids[here]], self.low[ids[here]] = b, f, np.cumsum(f) - f
                self.bits[b], self.base[b] = bits, at
                found.append(np.repeat(ids[here].astype(np.uint16), f))
                at += 1 << bits
        self.found = np.concatenate(found)


class _Model:
    """Predictions of `n` blocks.

    Order 1 and order 2: the id that last followed the same id, or the same two (one id each), with a confidence of 0 to 3
    that counts its successes; 0 is nothing known. A slot names the context that wrote it, so contexts never answer for
    one another; the later of two that fall on one slot has it. How much of the range goes to order 2's id, to order 1's
    and to order 0 is itself learned, for each pair of confidences.
    """

    def __init__(self, n: int) -> None:
        self.by_share = np.arange(n) * 16
        self.by_slot = (np.arange(2 * n) << _SLOTS_BITS).reshape(2, n)
        self.slots = np.zeros(2 * n << _SLOTS_BITS, _U)  # as two u32: confidence << 16 | id, and the context
        self.shares = np.full(n * 16, _SHARE)
        self.context = np.zeros((2, n), np.uint32)

    def start(self, k: int) -> None:
        """Looks the contexts of the first k blocks' next ids up."""
        self.context = c = self.context[:, :k]
        mixed = c * _MIX
        mixed >>= _MIX_SHIFT
        self.at = self.by_slot[:, :k] + mixed
        found = self.slots.take(self.at).view(np.uint32).reshape(2, k, 2)
        entry = found[:, :, 0] * (found[:, :, 1] == c)
        self.id, self.trust = entry & _LOW_HALF, entry >> _HALF
        which = self.trust[1] << _TWO
        which |= self.trust[0]
        self.which = self.by_share[:k] + which
        self.share = self.shares.take(self.which)

    def learn(self, k: int, ids: np.ndarray, came: np.ndarray) -> None:
        """ids: what came; came: 0 where it was order 2's id, 1 order 1's, 2 neither's."""
        less = self.share >> _SHARE_RATE
        less &= _SHARE_MASK
        self.share -= less
        self.share += _SHARE_INC.take(came)
        self.shares[self.which] = self.share
        new = np.empty((2, k, 2), np.uint32)
        new[:, :, 1] = self.context
        trust = self.trust * (self.id == ids)
        np.minimum(trust, _TWO, out=trust)
        trust += _ONE
        trust <<= _HALF
        np.copyto(self.id, ids, where=self.trust < _TWO)  # a trusted id stays, with the least confidence
        trust |= self.id
        new[:, :, 0] = trust
        self.slots[self.at] = new.view(_U)[:, :, 0]
        after = np.empty((2, k), np.uint32)
        after[0] = ids
        np.left_shift(self.context[0], _HALF, out=after[1])
        after[1] |= after[0]
        self.context = after


class _Parts:
    """The ranges of n lanes, cut into order 2's part, order 1's and order 0's."""

    def __init__(self, n: int) -> None:
        self.ends, self.lane = np.zeros((n, 4), _U), np.arange(n) * 4

    def cut(self, k: int, width: np.ndarray, m: _Model) -> None:
        ends, r = self.ends[:k], width >> _TOTAL_BITS
        np.multiply(r, m.share & _LOW_HALF, out=ends[:, 1])
        np.multiply(r, m.share >> _HALF, out=ends[:, 2])
        np.multiply(r, _TOTAL, out=ends[:, 3])

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where parts begin, and their widths; place: lane * 4 + the part's number."""
        flat = self.ends.ravel()
        below, width = flat.take(place), flat.take(place + _NEXT)
        width -= below
        return below, width


class _Out:
    """Range-coded words of n streams: low and range of 64 bits; a carry goes into the words already out."""

    def __init__(self, n: int, width: int) -> None:
        self.low, self.range = np.zeros(n, _U), np.full(n, 2**64 - 1, _U)
        self.width, self.room = width, width - 4  # a flush adds a word at most, so it needs no look at all streams
        self.words, self.first = np.zeros((n, width), np.uint32), np.arange(n) * width
        self.flat, self.at = self.words.ravel(), self.first.copy()

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.at.take(lanes)
        while len(at):
            at = at - 1
            more = self.flat.take(at) + np.uint32(1)
            self.flat[at] = more
            at = at[more == 0]

    def narrow(self, k: int, below: np.ndarray, width: np.ndarray) -> None:
        """The first k streams go on with the part of their range from below on that is so wide."""
        low = self.low[:k]
        low += below
        over = (low < below).nonzero()[0]
        if len(over):
            self._carry(over)
        self.range[:k] = width

    def flush(self, k: int) -> None:
        todo = (self.range[:k] < _LEAST).nonzero()[0]
        if len(todo):
            if not self.room:
                self._make_room()
            self.room -= 1
            low, at = self.low.take(todo), self.at.take(todo)
            self.flat[at] = low >> _WORD
            self.at[todo] = at + _NEXT
            self.low[todo] = low << _WORD
            self.range[todo] = self.range.take(todo) << _WORD

    def _make_room(self) -> None:
        n, used = len(self.low), self.at - self.first
        if used.max() > self.width // 2:
            self.words = np.concatenate((self.words, np.zeros_like(self.words)), axis=1)
            self.width *= 2
            self.first = np.arange(n) * self.width
            self.flat, self.at = self.words.ravel(), self.first + used
        self.room = self.width - 4 - int(used.max())

    def ended(self) -> list[bytes]:
        """The streams with one last word; a reader takes those behind it as 0."""
        self.flush(len(self.low))
        low = self.low + _U((1 << 32) - 1)
        over = np.flatnonzero(low < self.low)
        if len(over):
            self._carry(over)
        self.flat[self.at] = low >> _WORD
        return [self.words[j, :m].astype("<u4").tobytes() for j, m in enumerate((self.at + 1 - self.first).tolist())]


class _In:
    """Streams that _Out wrote, as how far the code is above low, and the range."""

    def __init__(self, streams: list[bytes], most: int) -> None:
        n, width = len(streams), max(map(len, streams), default=0) // 4 + 4
        flat = np.zeros(n * width + most, np.uint32)  # each step reads one word at most: damage doesn't lead beyond
        words = flat[: n * width].reshape(n, width)
        for j, s in enumerate(streams):
            words[j, : len(s) // 4] = np.frombuffer(s, "<u4")
        self.flat, self.at = flat, np.arange(n) * width + 2
        self.code = words[:, 0].astype(_U) << _WORD | words[:, 1]
        self.range = np.full(n, 2**64 - 1, _U)

    def narrow(self, k: int, below: np.ndarray, width: np.ndarray) -> None:
        self.code[:k] -= below
        self.range[:k] = width

    def fill(self, k: int) -> None:
        todo = (self.range[:k] < _LEAST).nonzero()[0]
        if len(todo):
            at = self.at.take(todo)
            self.code[todo] = self.code.take(todo) << _WORD | self.flat.take(at)
            self.range[todo] = self.range.take(todo) << _WORD
            self.at[todo] = at + _NEXT


def _lanes(sizes: np.ndarray, longest: int) -> list[int]:
    """How many blocks, longest first, still have an id at each step."""
    return np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()


def _side_by_side(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, sizes, ids): runs of ids as columns, longest first."""
    sizes = np.array([len(x) for x in runs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    ids = np.zeros((int(sizes[0]) if len(runs) else 0, len(runs)), np.uint16)
    for j, i in enumerate(order.tolist()):
        ids[: sizes[j], j] = runs[i]
    return order, sizes, ids


class _Bands:
    """The bands' shares in n lanes; a row ends in the 16 bits of all, which read as 0."""

    def __init__(self, n: int) -> None:
        self.flat, self.first = np.append(np.tile(_ROW, n), np.uint16(0)), np.arange(n) * _BANDS
        self.rows = self.flat[:-1].reshape(n, _BANDS)

    def of(self, k: int, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The share below each lane's band, and its own."""
        flat, place = self.flat, self.first[:k] + band
        below = flat.take(place)
        # behind the last band comes the next row's 0, and 16 bits wrap around to what is left of all
        own = flat.take(place + _NEXT) - below
        return below.astype(_U), own.astype(_U)

    def learn(self, k: int, band: np.ndarray) -> None:
        rows = self.rows[:k]
        rows -= rows >> _BAND_RATE
        rows += _STEP.take(band, axis=0)


def _encode_rest(runs: list[np.ndarray], prior: Prior) -> list[bytes]:
    """Streams of order 0: band by band's shares, id by its frequency in the band."""
    order, sizes, ids = _side_by_side(runs)
    n = len(runs)
    out, bands = _Out(n, 64 + len(ids) // 2), _Bands(n)
    for t, k in enumerate(_lanes(sizes, len(ids))):
        y = ids[t, :k].astype(np.int64)
        band = prior.band.take(y)
        below, own = bands.of(k, band)
        r = out.range[:k] >> _TOTAL_BITS
        below *= r
        r *= own
        r >>= prior.bits.take(band)
        below += prior.low.take(y) * r
        r *= prior.freq.take(y)
        out.narrow(k, below, r)
        out.flush(k)
        bands.learn(k, band)
    done = [b""] * n
    for i, s in zip(order.tolist(), out.ended(), strict=True):
        done[i] = s
    return done


def _decode_rest(streams: list[bytes], sizes: np.ndarray, prior: Prior) -> np.ndarray:
    """The ids of streams of order 0 in rows, each from the first place on."""
    n, order = len(streams), np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    ids = np.zeros((int(sizes[0]) if n else 0, n), np.uint16)
    read, bands = _In([streams[i] for i in order.tolist()], len(ids)), _Bands(n)
    ones, top, most = np.array(0x0101010101010101, _U), np.array(56, _U), np.array(0xFFFF, _U)
    last = (np.array(1, _U) << prior.bits) - _U(1)
    for t, k in enumerate(_lanes(sizes, len(ids))):
        code = read.code[:k]
        r = read.range[:k] >> _TOTAL_BITS
        v = np.minimum(code // r, most).astype(np.uint16)
        # how many of a row's sums are at most v: bytes of 0 and 1, whose sum comes out in the top byte
        eight = (bands.rows[:k] <= v.repeat(_BANDS).reshape(k, _BANDS)).view(_U)
        band = eight[:, 0] + eight[:, 1]
        band *= ones
        band >>= top
        band = band.astype(np.int64)
        band -= _NEXT
        below, own = bands.of(k, band)
        below *= r
        r *= own
        r >>= prior.bits.take(band)
        v = np.minimum((code - below) // r, last.take(band)).astype(np.int64)
        v += prior.base.take(band)
        y = prior.found.take(v).astype(np.int64)
        below += prior.low.take(y) * r
        r *= prior.freq.take(y)
        read.narrow(k, below, r)
        read.fill(k)
        bands.learn(k, band)
        ids[t, :k] = y
    out = np.zeros((n, len(ids)), np.uint16)
    out[order] = ids.T
    return out


def encode_blocks(blocks: list[np.ndarray], prior: Prior | None = None) -> list[bytes]:
    """Each block of ids (below 65536, at most BLOCK_IDS, all with a frequency in the prior) as bytes with its header. An
    empty block is its header."""
    prior = prior or Prior()
    if any(len(b) and not prior.freq.take(b).all() for b in blocks):
        raise ValueError("an id has no frequency in the prior")
    order, sizes, ids = _side_by_side(blocks)
    n = len(blocks)
    m, parts, out, came = _Model(n), _Parts(n), _Out(n, 64 + len(ids) // 8), np.zeros(ids.shape, np.uint8)
    for t, k in enumerate(_lanes(sizes, len(ids))):
        x = ids[t, :k].astype(np.uint32)
        m.start(k)
        other = m.id != x
        how = other[1].view(np.uint8) + other.view(np.uint8).all(axis=0)
        parts.cut(k, out.range[:k], m)
        out.narrow(k, *parts.of(parts.lane[:k] + how))
        if t & 1:
            out.flush(k)
        m.learn(k, x, how)
        came[t, :k] = how
    miss = (came == 2).T
    rest = _encode_rest([ids[: sizes[j], j][miss[j, : sizes[j]]] for j in range(n)], prior)
    done: list[bytes] = [b""] * n
    for j, (i, s) in enumerate(zip(order.tolist(), out.ended(), strict=True)):
        check = zlib.crc32(np.asarray(blocks[i], dtype="<u4").tobytes())
        data = PARTS.pack(int(miss[j].sum()), len(s) // 4) + s + rest[j] if sizes[j] else b""
        done[i] = HEAD.pack(MAGIC, int(sizes[j]), len(data) // 2, check) + data
    return done


def split_blocks(data: bytes) -> list[tuple[int, bytes, int]]:
    """(ids, payload, crc32) of the blocks that lie one behind the other in data."""
    out, at = [], 0
    while at < len(data):
        magic, n, words, check = HEAD.unpack_from(data, at)
        if magic != MAGIC or at + HEAD.size + 2 * words > len(data):
            raise ValueError("not a block of token ids")
        at += HEAD.size
        out.append((n, data[at : at + 2 * words], check))
        at += 2 * words
    return out


def decode_blocks(blocks: list[tuple[int, bytes, int]], prior: Prior | None = None) -> list[np.ndarray]:
    """The ids (little-endian u32) of blocks as split_blocks gives them, coded with the same prior; a ValueError if a
    checksum differs."""
    prior = prior or Prior()
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    n = len(blocks)
    sizes = np.array([blocks[i][0] for i in order], dtype=np.int64)
    longest = int(sizes[0]) if n else 0
    streams, rest, left = [], [], np.zeros(n, np.int64)
    for j, i in enumerate(order):
        size, data, _ = blocks[i]
        left[j], words = PARTS.unpack_from(data) if size and len(data) >= PARTS.size else (0, 0)
        cut = PARTS.size + 4 * words
        if size and (cut > len(data) or len(data) % 4 or left[j] > size):
            raise ValueError("a block of token ids fails its checksum: its parts are damaged")
        streams.append(data[PARTS.size : cut])
        rest.append(data[cut:])
    with np.errstate(divide="ignore"):  # a range of 0 is damage, which the checksum tells
        missed = _decode_rest(rest, left, prior)
    at = np.arange(n) * missed.shape[1]
    missed = np.append(missed.ravel(), np.zeros(longest + 1, np.uint16))  # damage may ask for more than there are
    m, parts, read = _Model(n), _Parts(n), _In(streams, longest)
    ids, may = np.zeros((longest, n), np.uint16), np.zeros((n, 4), np.uint32)
    for t, k in enumerate(_lanes(sizes, longest)):
        m.start(k)
        parts.cut(k, read.range[:k], m)
        not_two, neither = (parts.ends[:k, 1] <= read.code[:k]).view(np.uint8), (parts.ends[:k, 2] <= read.code[:k]).view(np.uint8)
        how = not_two + neither
        place = parts.lane[:k] + how
        read.narrow(k, *parts.of(place))
        if t & 1:
            read.fill(k)
        # an id of order 1 that is order 2's as well was coded as order 2's
        may[:k, 0], may[:k, 1], may[:k, 2] = m.id[1], m.id[0], missed.take(at[:k])
        x = may.ravel().take(place)
        at[:k] += neither
        m.learn(k, x, how)
        ids[t, :k] = x
    done: list[np.ndarray] = [np.empty(0, "<u4")] * n
    for j, i in enumerate(order):
        done[i] = ids[: sizes[j], j].astype("<u4")
        if zlib.crc32(done[i].tobytes()) != blocks[i][2]:
            raise ValueError("a block of token ids fails its checksum")
    return done

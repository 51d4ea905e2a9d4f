"""Context-mixing range coder for token ids, many blocks in lockstep.

A frame is cut into sections of up to LANES blocks.  Ids are numbered by falling frequency in
their section; order 0 is the frequencies of these numbers, told once in the section's head.
Orders 2 and 1 start empty in every block: they keep, for a hash of the last two numbers and of
the last one, the number that came next and how often it held.  Whether the number named by an
order holds is a binary event; its probability is a mix of an adaptive counter and of the
frequency that order 0 gives the number, with weights that move to the opinion that was
nearest.  A number that neither order 2 nor order 1 names is coded by order 0.  Event and number
narrow the interval in one step.  All arithmetic is exact, the same step of every block is one
numpy operation, and a block ends with a checksum, so it can be read with no other block.

Layout of a frame, little-endian: magic, number of sections.  A section: number of blocks, ids a
block, bytes of the head, CRC-32 of the head; the head (compressed: gaps of the ascending ids,
their counts, each number four planes of bytes); per block number of ids, number of 32-bit words,
CRC-32 of the ids as unsigned 32-bit integers; then the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"QTK3"
BLOCK_IDS = 1024
#: Blocks coded together; they need about 9 KB each, and their words.
LANES = 8192
#: Ids coded together, whatever the size of a block.
SECTION_IDS = LANES * BLOCK_IDS
SLOT_BITS = 9
SLOTS = 1 << SLOT_BITS
#: Different ids of a section: a number has 16 bits.
NUMBERS = 1 << 16
CONFIDENT = 7
#: Contexts of the counters of a block: confidence of either order, and whether they name the same.
CONTEXTS = 128
#: Events have 12 bits; neither is surer than this.
EVENT_BITS, MOST = 12, 4096 - 64
#: A counter (16 bits) moves by this part of its error; the weight of a mix by a constant.
RATE, WEIGHT_STEP = 4, 3

_LOW = np.uint64(1 << 32)
_W = np.uint64(32)
_K1, _K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_BACK, _TOP = np.uint32(3), np.uint32(32 - SLOT_BITS)
_CONF, _NUMBER = np.uint32(0xFFFF), np.uint32(16)
_U1 = np.uint32(1)
_CERTAIN, _STEPS = np.int32(1 << 16), np.int32(2 * WEIGHT_STEP)


class _Model:
    """Orders 2 and 1 of ``lanes`` blocks over ``numbers`` numbers; encoder and decoder drive it alike.

    ``often`` is the 16-bit frequency of each number in order 0.
    """

    def __init__(self, lanes: int, numbers: int, often: np.ndarray | None = None):
        lane = np.arange(lanes)
        self.base, self.context = lane * SLOTS, lane * CONTEXTS
        self.often = np.zeros(numbers, dtype=np.int32) if often is None else often
        # Orders 2 and 1: the number after a context above, and how sure that is (0: nothing known) below.
        self.table = [np.zeros(lanes * SLOTS, dtype="<u4") for _ in range(2)]
        self.next, self.conf = ([t.view("<u2")[i::2] for t in self.table] for i in (1, 0))
        # Counters of the two events of a context, and the weight of each against the opinion of order 0.
        self.counters = np.full(lanes * CONTEXTS, (1 << 13) << 16 | 1 << 13, dtype="<u4")
        self.counter = [self.counters.view("<u2")[i::2] for i in (1, 0)]
        self.weight = [np.full(lanes, 240, dtype=np.int32) for _ in range(2)]
        self.last, self.older = np.zeros(lanes, dtype=np.uint32), np.zeros(lanes, dtype=np.uint32)

    def predict(self, n: int) -> None:
        """What orders 2 and 1 name for the first ``n`` blocks, and the widths of the events that it holds."""
        last, base = self.last[:n], self.base[:n]
        self.slot = [((last + (self.older[:n] >> _BACK)) * _K2 >> _TOP) + base, (last >> _TOP) + base]
        self.entry = [t.take(s) for t, s in zip(self.table, self.slot, strict=True)]
        self.guess = [(e >> _NUMBER).view(np.int32) for e in self.entry]
        self.sure = [(e & _CONF).view(np.int32) for e in self.entry]
        other = self.guess[0] != self.guess[1]
        self.at = self.context[:n] + ((self.sure[0] << 4) + (self.sure[1] << 1) + other)
        both = self.counters.take(self.at)
        self.own = [(both >> _NUMBER).view(np.int32), (both & _CONF).view(np.int32)]
        self.zero = [self.often.take(g) for g in self.guess]
        # Both sides of an event need a width: 1 at least, and something left for the rest.
        p = []
        for own, zero, weight in zip(self.own, self.zero, self.weight, strict=True):
            x = (own - zero) * weight[:n]
            x += zero << 8
            x >>= 24 - EVENT_BITS
            np.maximum(x, 1, out=x)
            np.minimum(x, MOST, out=x)
            p.append(x)
        self.first = p[0]
        x = ((1 << EVENT_BITS) - p[0]) * p[1]
        x >>= EVENT_BITS
        np.maximum(x, 1, out=x)
        x *= other  # where both name the same, the second event cannot happen
        self.second = x

    def learn(self, n: int, numbers: np.ndarray, held: np.ndarray, second: np.ndarray) -> None:
        """``held``: order 2 named it; ``second``: order 1 did and order 2 did not."""
        new = []
        for k, event in enumerate((held, second)):
            own = self.own[k]
            error = event * _CERTAIN
            error -= own
            error >>= RATE
            # The counter was nearer where it was above order 0 and held, or not above and did not.
            better = ((own >= self.zero[k]) == event) * _STEPS
            better -= WEIGHT_STEP
            if k:  # the second event is only met where the first failed
                met = ~held
                error *= met
                better *= met
            weight = self.weight[k][:n]
            weight += better
            np.maximum(weight, 16, out=weight)
            np.minimum(weight, 252, out=weight)
            new.append(own + error)
        self.counters[self.at] = (new[0] << 16) + new[1]
        numbers = numbers.view(np.uint32)
        fresh = (numbers << _NUMBER) + _U1
        for k, named in enumerate((held, self.guess[1].view(np.uint32) == numbers)):
            sure, entry = self.sure[k], self.entry[k]
            kept = entry + (sure < CONFIDENT)
            weak = np.where(sure <= 1, fresh, entry - ((sure + 1) >> 1).view(np.uint32))
            self.table[k][self.slot[k]] = np.where(named, kept, weak)
        self.older[:n] = self.last[:n]
        np.multiply(numbers + _U1, _K1, out=self.last[:n])


class _OrderZero:
    """Frequencies of a section's numbers, scaled to a power of two; every number has 1 at least."""

    def __init__(self, counts: np.ndarray):
        self.bits = min(max(int(len(counts)).bit_length() + 4, 14), 32 - EVENT_BITS)
        whole = 1 << self.bits
        room = whole - len(counts)
        ends = np.cumsum(counts.astype(np.int64))
        ends = ends * room // ends[-1] + np.arange(1, len(counts) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        self.width = ends - starts
        self.start = starts
        self.often = (self.width << 16 >> self.bits).astype(np.int32)

    def numbers(self) -> np.ndarray:
        """The number that each part of the scale belongs to."""
        return np.repeat(np.arange(len(self.width), dtype=np.int32), self.width)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _by_frequency(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different ids ascending, their counts, and the number of each of ``ids``."""
    if int(ids.max()) < 4 * len(ids) + NUMBERS:
        n = np.bincount(ids)
        different = np.flatnonzero(n)
        number = np.zeros(len(n), dtype=np.int32)
        number[different[_by_frequency(n[different])]] = np.arange(len(different))
        return different.astype("<u4"), n[different], number.take(ids)
    different, place, n = np.unique(ids, return_inverse=True, return_counts=True)
    number = np.empty(len(n), dtype=np.int32)
    number[_by_frequency(n)] = np.arange(len(n))
    return different, n, number[place]


def _encode_section(ids: np.ndarray, block_ids: int) -> list[bytes]:
    blocks = -(-len(ids) // block_ids)
    different, n, numbers = _counted(ids)
    if len(different) > NUMBERS:  # more than a block can have
        half = blocks // 2 * block_ids
        return _encode_section(ids[:half], block_ids) + _encode_section(ids[half:], block_ids)
    head = zlib.compress(_planes(np.diff(different.astype(np.int64), prepend=0)) + _planes(n), 6)
    grid = np.zeros(blocks * block_ids, dtype=np.int32)
    grid[: len(ids)] = numbers
    length = min(block_ids, len(ids))
    last = len(ids) - block_ids * (blocks - 1)
    words = _encode_lanes(np.ascontiguousarray(grid.reshape(blocks, block_ids)[:, :length].T), last, _OrderZero(n[_by_frequency(n)]))
    heads = []
    for i, w in enumerate(words):
        own = ids[i * block_ids : (i + 1) * block_ids]
        heads.append(struct.pack("<III", len(own), len(w), zlib.crc32(own.tobytes())))
    return [b"".join([struct.pack("<IIII", blocks, block_ids, len(head), zlib.crc32(head)), head, *heads, *(w.tobytes() for w in words)])]


def _encode_lanes(numbers: np.ndarray, last: int, zero: _OrderZero) -> list[np.ndarray]:
    """Words of each column of ``numbers``; the last one ends after ``last`` rows."""
    length, lanes = numbers.shape
    model = _Model(lanes, len(zero.width), zero.often)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    room = length + 2  # a step puts out a word at most
    words, used = np.zeros(lanes * room, dtype="<u4"), np.arange(lanes) * room
    bits, scale = np.uint64(zero.bits + EVENT_BITS), zero.bits
    for j in range(length):
        n = lanes if j < last else lanes - 1
        x = numbers[j, :n]
        model.predict(n)
        first, second = model.first, model.second
        held = model.guess[0] == x
        named = (model.guess[1] == x) & ~held
        rest = (1 << EVENT_BITS) - (first + second)
        told = ~(held | named)
        # Starts and widths in parts of the whole scale.
        start = (first * ~held + second * told).astype(np.int64) << scale
        width = (first * held + second * named).astype(np.int64) << scale
        rest *= told
        start += rest * zero.start.take(x)
        width += rest * zero.width.take(x)
        lo, sp = low[:n], span[:n]
        unit = sp >> bits
        lo += unit * start.view(np.uint64)
        np.multiply(unit, width.view(np.uint64), out=sp)
        rows = np.flatnonzero(sp < _LOW)
        if len(rows):
            a, s = lo[rows], _uncrossed(lo[rows], sp[rows])
            at = used[rows]
            words[at] = a >> _W
            used[rows] = at + 1
            lo[rows], sp[rows] = a << _W, s << _W
        model.learn(n, x, held, named)
    words[used], words[used + 1] = low >> _W, low & (_LOW - np.uint64(1))
    return [words[i * room : end] for i, end in enumerate((used + 2).tolist())]


def _uncrossed(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Ends that differ in their first 32 bits never will agree: such an interval is cut at the border."""
    return np.where((low ^ (low + span)) < _LOW, span, (~low + np.uint64(1)) & (_LOW - np.uint64(1)))


def _decode_lanes(words: np.ndarray, starts: np.ndarray, length: int, last: int, zero: _OrderZero) -> np.ndarray:
    """Numbers, a column a block; the words of a block begin at its start."""
    lanes = len(starts)
    model = _Model(lanes, len(zero.width), zero.often)
    out = np.zeros((length, lanes), dtype=np.int32)
    of_scale = zero.numbers()
    words = np.concatenate([words, np.zeros(2, dtype="<u4")])
    used, end = starts + 2, len(words) - 1
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    ahead = (words[starts].astype(np.uint64) << _W) | words[starts + 1]  # the code, less low
    bits, scale = np.uint64(zero.bits + EVENT_BITS), zero.bits
    most = np.uint64((1 << zero.bits + EVENT_BITS) - 1)
    for j in range(length):
        n = lanes if j < last else lanes - 1
        lo, sp, ah = low[:n], span[:n], ahead[:n]
        model.predict(n)
        first, second = model.first, model.second
        unit = sp >> bits
        value = ah // unit
        np.minimum(value, most, out=value)  # the last part ends with the interval
        value = value.view(np.int64)
        event = (value >> scale).astype(np.int32)
        border = first + second
        rest = (1 << EVENT_BITS) - border
        held = event < first
        told = event >= border
        named = ~(held | told)
        # Quotients below 2^32 of numbers below 2^53 are exact after rounding down.
        part = ((value - (border.astype(np.int64) << scale)) / rest).astype(np.int64)
        x = np.where(told, of_scale.take(part, mode="clip"), np.where(held, model.guess[0], model.guess[1]))
        start = (first * ~held + second * told).astype(np.int64) << scale
        width = (first * held + second * named).astype(np.int64) << scale
        rest *= told
        start += rest * zero.start.take(x)
        width += rest * zero.width.take(x)
        step = unit * start.view(np.uint64)
        lo += step
        ah -= step
        np.multiply(unit, width.view(np.uint64), out=sp)
        rows = np.flatnonzero(sp < _LOW)
        if len(rows):
            a, s = lo[rows], _uncrossed(lo[rows], sp[rows])
            at = used[rows]
            ah[rows] = (ah[rows] << _W) + words.take(at, mode="clip")
            used[rows] = at + 1
            lo[rows], sp[rows] = a << _W, s << _W
        out[j, :n] = x
        model.learn(n, x, held, named)
    if (used > end + 1).any():
        raise ValueError("a block cannot be read")
    return out


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """A frame of all ``ids`` (unsigned 32-bit), at most 30,000 to a block."""
    if not 0 < block_ids <= 30_000:
        raise ValueError("a block has 1 to 30,000 ids")
    ids = np.ascontiguousarray(ids, dtype="<u4")
    many = min(LANES, max(SECTION_IDS // block_ids, 1)) * block_ids
    sections = [s for at in range(0, len(ids), many) for s in _encode_section(ids[at : at + many], block_ids)]
    return b"".join([MAGIC, struct.pack("<I", len(sections)), *sections])


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; raises ValueError if a block does not match its checksum."""
    if frame[:4] != MAGIC:
        raise ValueError("not a frame of this format")
    try:
        return _decode(frame)
    except (ArithmeticError, IndexError, struct.error, zlib.error) as e:  # damage can lead anywhere
        raise ValueError("a block cannot be read") from e


def _decode(frame: bytes) -> np.ndarray:
    (sections,) = struct.unpack_from("<I", frame, 4)
    offset, out = 8, []
    for _ in range(sections):
        blocks, block_ids, size, checksum = struct.unpack_from("<IIII", frame, offset)
        offset += 16
        if zlib.crc32(frame[offset : offset + size]) != checksum:
            raise ValueError("a head does not match its checksum")
        head = zlib.decompress(frame[offset : offset + size])
        gaps, n = _of_planes(head[: len(head) // 2]), _of_planes(head[len(head) // 2 :])
        by = _by_frequency(n)
        different = np.cumsum(gaps, dtype=np.uint32)[by]
        offset += size
        heads = np.frombuffer(frame, dtype="<u4", count=3 * blocks, offset=offset).reshape(-1, 3).astype(np.int64)
        offset += 12 * blocks
        ends = np.cumsum(heads[:, 1])
        words = np.frombuffer(frame, dtype="<u4", count=int(ends[-1]), offset=offset)
        offset += 4 * len(words)
        length = int(heads[0, 0])
        if not 0 < length <= block_ids or (heads[:-1, 0] != length).any() or not 0 < heads[-1, 0] <= length or (heads[:, 1] < 2).any():
            raise ValueError("a block cannot be read")
        numbers = _decode_lanes(words, ends - heads[:, 1], length, int(heads[-1, 0]), _OrderZero(n[by]))
        grid = different.astype("<u4")[numbers.T]
        for row, (own, _, checksum) in zip(grid, heads.tolist(), strict=True):
            if zlib.crc32(row[:own].tobytes()) != checksum:
                raise ValueError("a block does not match its checksum")
        out.append(grid.ravel()[: length * (blocks - 1) + int(heads[-1, 0])])
    if offset != len(frame):
        raise ValueError("a frame of another length")
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")

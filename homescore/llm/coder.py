"""Range coder for token ids under adaptive mixed predictions, many blocks at once.

Every block of ids starts from the same state, so blocks are coded, and read, independently; numpy
advances many blocks together, one id of each at a time. An id's frequency is a sum of

* order 0: the counts of ranges of ids (finer for low ids, which are the frequent pieces), spread
  evenly over a range, and a share for the id last seen in the range;
* order 1 and order 2: a mass on the id that last followed the previous id, or the previous two. The
  masses grow with the block's hits of that prediction and shrink with its misses.

The sum is one exact integer distribution, from which the coder takes one step an id. The writer knows all
ids: it looks up what the mixture remembers place by place and computes the mixture of many places at once.

Arrays hold a column a block. Numbers are 32 bits wide and masks are 0 or -1, so that choices are `&`.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 512
_SLOTS = 1024
_GAIN, _RECENT = 1024, 256
_NONE = 0xFFFF
_MOST = 1 << 21
#: Widths of ranges and what an id adds are multiples of it; in this unit sums of a block fit 16 bits.
_UNIT_BITS = 6
_ADDED = (_GAIN + _RECENT) >> _UNIT_BITS
#: Of what is remembered of a range: the id last seen, less the first, below its count.
_INSIDE_BITS = 10
_INSIDE = (1 << _INSIDE_BITS) - 1
#: Blocks advanced together, at most.
_LANES = 5120
#: Places whose mixture the writer computes at once.
_PLACES = 8
_U = np.uint64
_EQUAL, _SHORT, _LOW32 = _U(1 << 48), _U(1 << 32), _U((1 << 32) - 1)
_16, _48 = _U(16), _U(48)
MAGIC = b"ACM1"


class _Ranges:
    """Ranges of ids: 64 wide up to 512, 512 up to 4096, then 1024."""

    def __init__(self, vocabulary: int):
        first, width, at = [], [], 0
        while at < vocabulary:
            first.append(at)
            width.append(64 if at < 512 else 512 if at < 4096 else 1024)
            at += width[-1]
        self.n, self.total = len(first), at
        self.first, width = np.array(first), np.array(width)
        #: An id's weight is 1 and its range's count so many bits to the left.
        self.bits = np.log2(_GAIN // width).astype(np.int32)
        #: Of any 16-bit number; those beyond the vocabulary get range 0.
        self.of = np.zeros(max(_NONE + 1, at), np.int64)
        self.of[:at] = np.repeat(np.arange(self.n), width)


def _slots(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where order 1 and order 2 remember what followed."""
    spread = last * 40503
    return spread >> 4 & _SLOTS - 1, (spread + before * 30011) >> 3 & _SLOTS - 1


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b, in doubles, which are exact for numbers of 32 bits and faster."""
    return (a / b).astype(np.int32)


def _blocks(n: int) -> np.ndarray:
    return np.append(np.full(n // BLOCK_IDS, BLOCK_IDS), [n % BLOCK_IDS] * (n % BLOCK_IDS > 0)).astype(np.int64)


def _groups(n: int) -> list[slice]:
    """Blocks in groups of like size."""
    ends = np.linspace(0, n, -(-n // _LANES) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]


class _Coder:
    """Low end and width of each block's interval."""

    def __init__(self, n: int):
        self.low, self.span = np.zeros(n, _U), np.full(n, 0xFFFFFFFFFFFFFFFF, _U)
        self.equal, self.short = np.full(n, _EQUAL), np.full(n, _SHORT)

    def _ready(self, low: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Which blocks' first word is settled; of those with a short interval across two words, the lower part is kept."""
        n = len(low)
        go = ((low + span) ^ low) < self.equal[:n]
        short = (span < self.short[:n]) > go
        if short.any():
            span[short] = (_U(0) - low[short]) & _LOW32
            go |= short
        return go

    def first(self) -> np.ndarray:
        """Which blocks move a word, which is shifted out of low and span afterwards by `shift`."""
        return self._ready(self.low, self.span)

    def shift(self, by: np.ndarray) -> None:
        self.low <<= by
        self.span <<= by

    def more(self):
        """Blocks that move a further word, and the low ends they still have."""
        todo = np.flatnonzero(self.span < self.equal)
        while len(todo):
            low, span = self.low[todo], self.span[todo]
            go = self._ready(low, span)
            todo, low, span = todo[go], low[go], span[go] << _16
            if len(todo):
                yield todo, low
                self.low[todo], self.span[todo] = low << _16, span
                todo = todo[span < _EQUAL]


def _mixtures(ids: np.ndarray, vocabulary: int):
    """Of each place in turn: where the ids' frequencies begin, the frequencies, and the totals."""
    ranges, n = _Ranges(vocabulary), ids.shape[1]
    lane, first = np.arange(n), ranges.first.astype(np.int32)
    padded = np.concatenate([np.zeros((2, n), np.uint16), ids])
    after = [np.full(n * _SLOTS, _NONE, np.uint16) for _ in range(2)]
    seen = np.zeros(n * ranges.n, np.int32)
    # how many earlier ids lie in lower ranges, a row a block
    lower, above = np.zeros((n, ranges.n), np.int16), np.triu(np.ones((ranges.n, ranges.n), np.int16), 1)
    p, below = np.empty((2, _PLACES, n), np.uint16), np.empty((_PLACES, n), np.int16)
    was = np.empty((_PLACES, n), np.int32)
    hits, tries = np.zeros((2, _PLACES + 1, n), np.int32), np.zeros((2, _PLACES + 1, n), np.int32)
    for t in range(0, BLOCK_IDS, _PLACES):
        narrow = ids[t : t + _PLACES]
        wide, at = narrow.astype(np.int32), ranges.of.take(narrow)
        inside, place, row = wide - first.take(at), at * n + lane, at + lane * ranges.n
        slots = [s + lane * _SLOTS for s in _slots(padded[t + 1 : t + 1 + _PLACES].astype(np.int64), padded[t : t + _PLACES].astype(np.int64))]
        for k in range(_PLACES):
            for slot, table, found in zip(slots, after, p):
                found[k] = table.take(slot[k])
                table[slot[k]] = narrow[k]
            was[k] = seen.take(place[k])
            seen[place[k]] = (was[k] | _INSIDE) + 1 + inside[k]
            below[k] = lower.take(row[k])
            lower += above.take(at[k], axis=0)
        count = was >> _INSIDE_BITS
        share, weight = count * _RECENT, (count << ranges.bits.take(at)) + 1
        ahead = (was & _INSIDE) - inside
        begin = wide - inside + below.astype(np.int32) * (_GAIN + _RECENT) + inside * weight + (share & ahead >> 31)
        size = weight + share * (ahead == 0)
        base = (ranges.total + (_GAIN + _RECENT) * np.arange(t, t + _PLACES, dtype=np.int32))[:, None]
        hit, known = (p == narrow).astype(np.int32), (p != _NONE).astype(np.int32)
        for sums, now in ((hits, hit), (tries, known)):
            sums[:, 0] = sums[:, -1]
            for k in range(_PLACES):
                np.add(sums[:, k], now[:, k], out=sums[:, k + 1])
        h, tried = hits[:, :-1], tries[:, :-1]
        mass = np.minimum(_quotient(base * (h + 1), tried - h + 8), _MOST) * known
        own, passed = mass * hit, mass & p - wide >> 31
        yield from zip(*((a.astype(_U)) for a in (begin + passed[0] + passed[1], size + own[0] + own[1], mass[0] + mass[1] + base)))


def _encode(grid: np.ndarray, end: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each block (a row) and how many; the last block ends at `end`."""
    n = grid.shape[1]
    coder = _Coder(n)
    out = np.zeros((n, 3 * BLOCK_IDS + 8), "<u2")
    words, start = out.reshape(-1), np.arange(n) * out.shape[1]
    to = start.copy()

    def finish() -> None:
        """Four more words make a block whole."""
        for k in range(4):
            words[to + k] = coder.low >> _U(48 - 16 * k)

    for t, (begin, size, total) in enumerate(_mixtures(grid, vocabulary)):
        if t == end:  # what the last block codes from here on is cut off
            finish()
            kept, many = out[-1].copy(), to[-1] - start[-1]
            if n == 1:
                break
        coder.span //= total
        coder.low += coder.span * begin
        coder.span *= size
        go = coder.first()
        words[to] = (coder.low >> _48).astype(np.uint16)
        to += go
        coder.shift(go * _16)
        for todo, low in coder.more():
            words[to[todo]] = low >> _48
            to[todo] += 1
    finish()
    used = to - start
    if end < BLOCK_IDS:
        out[-1], used[-1] = kept, many
    return out, used + 4


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """Header, then of each block its ids, bytes and CRC-32 of the ids, then the coded blocks."""
    sizes = _blocks(len(ids))
    n = len(sizes)
    grid = np.zeros((n, BLOCK_IDS), np.uint16)
    grid.reshape(-1)[: len(ids)] = ids
    head, body = [MAGIC, struct.pack("<III", vocabulary, n, len(ids))], []
    narrow, at = ids.astype("<u2"), 0
    for group in _groups(n):
        out, used = _encode(np.ascontiguousarray(grid[group].T), sizes[group][-1], vocabulary)
        for size, words, many in zip(sizes[group], out, used):
            head.append(struct.pack("<HII", size, 2 * many, zlib.crc32(narrow[at : at + size].tobytes())))
            body.append(words[:many].tobytes())
            at += size
    return b"".join(head + body)


class _Reader:
    """State of n blocks, and the ids that their next values stand for."""

    def __init__(self, n: int, vocabulary: int):
        self.ranges = r = _Ranges(vocabulary)
        self.n, self.lane, self.base = n, np.arange(n), r.total
        #: Of any 16-bit number: its range's row in tables, the range's bits, and its place in the range; -1 for none.
        self.parts = (r.of * n << 13 | r.bits[r.of] << 10 | np.arange(len(r.of)) - r.first[r.of]).astype(np.int32)
        self.parts[_NONE] = -1
        #: What lies below each range, and, as the writer has it, what is remembered of it.
        self.below = np.repeat((r.first >> _UNIT_BITS).astype(np.int16)[:, None], n, axis=1)
        self.seen = np.zeros(r.n * n, np.int32)
        self.above = np.empty((r.n, n), np.int16)
        self.after = np.full(2 * n * _SLOTS, _NONE, np.uint16)
        self.rows = self.lane * _SLOTS, (self.lane + n) * _SLOTS
        self.slots, self.last, self.before = np.empty((2, n), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.hits1, self.misses8 = np.ones((2, n), np.int32), np.full((2, n), 8, np.int32)

    def predict(self) -> np.ndarray:
        """Look up both predictions; the total of frequencies."""
        for row, slot, to in zip(self.rows, _slots(self.last, self.before), self.slots):
            np.add(row, slot, out=to)
        self.p = self.parts.take(self.after.take(self.slots))
        self.known = ~(self.p >> 31)
        self.mass = np.minimum(_quotient(self.hits1 * np.int32(self.base), self.misses8), _MOST) & self.known
        return self.mass[0] + self.mass[1] + self.base

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose frequencies hold v, where these begin, and the frequencies."""
        p, mass, n = self.p, self.mass, self.n
        # of both predictions, where their frequencies begin and end in order 0, then in the mixture
        place = (p >> 13) + self.lane
        seen = self.seen.take(place)
        low = self.below.take(place).astype(np.int32) << _UNIT_BITS
        inside, count = p & _INSIDE, seen >> _INSIDE_BITS
        weight, share = (count << (p >> 10 & 7)) + 1, count << 8
        ahead = (seen & _INSIDE) - inside
        begin = low + inside * weight
        end = begin + weight + (share & ahead - 1 >> 31)
        begin += share & ahead >> 31
        other_lower = p[::-1] - p >> 31
        other = mass[::-1]
        from_begin = v - (begin + (other & other_lower))
        from_end = v - (end + mass + (other & ~other_lower[::-1]))
        hit = (from_end & ~from_begin) >> 31 & self.known
        passed = mass & ~(from_end >> 31)
        passed = passed[0] + passed[1]
        # order 0: v less the masses below it; of a hit, where the id begins
        back = from_begin & hit
        rest = v - passed - (back[0] | back[1])
        np.subtract((rest >> _UNIT_BITS).astype(np.int16), self.below, out=self.above)
        np.right_shift(self.above, 15, out=self.above)
        at = np.add.reduce(self.above, axis=0, dtype=np.int16).astype(np.int64) + (self.ranges.n - 1)
        place = at * n + self.lane
        seen = self.seen.take(place)
        low = self.below.take(place).astype(np.int32) << _UNIT_BITS
        recent, count = seen & _INSIDE, seen >> _INSIDE_BITS
        weight, share = (count << self.ranges.bits.take(at)) + 1, count << 8
        rest -= low
        inside = _quotient(np.minimum(rest, np.maximum(rest - share, recent * weight)), weight)
        ahead = recent - inside
        lower = ahead >> 31
        begin = low + inside * weight + (share & lower) + passed
        own = mass & hit
        size = weight + (share & (ahead - 1 >> 31 ^ lower)) + own[0] + own[1]
        self.hit, self.place, self.next = hit, place, (seen | _INSIDE) + 1 + inside
        return self.ranges.first.take(at) + inside, begin, size

    def update(self, x: np.ndarray) -> None:
        """Learn the ids found last."""
        np.bitwise_and(self.above, _ADDED, out=self.above)
        np.add(self.below, self.above, out=self.below)
        self.base += _GAIN + _RECENT
        self.seen[self.place] = self.next
        self.hits1 -= self.hit
        self.misses8 += self.hit - self.known
        narrow = x.astype(np.uint16)
        self.after[self.slots[0]] = narrow
        self.after[self.slots[1]] = narrow
        self.before, self.last = self.last, x


def _decode(coded: np.ndarray, steps: int, vocabulary: int) -> np.ndarray:
    """Ids, a column a block, of coded words, a row a block. A shorter block goes on with the others."""
    n = len(coded)
    code = np.zeros(n, _U)
    for k in range(4):
        code = code << _16 | coded[:, k].astype(_U)
    read, words = np.arange(n) * coded.shape[1] + 4, coded.reshape(-1)
    grid, reader, coder, one = np.zeros((BLOCK_IDS, n), np.uint16), _Reader(n, vocabulary), _Coder(n), np.ones(n, _U)
    for t in range(steps):
        total = reader.predict().astype(_U)
        coder.span //= total
        v = np.minimum((code - coder.low) // coder.span, total - one).astype(np.int32)
        x, begin, size = reader.find(v)
        coder.low += coder.span * begin.astype(_U)
        coder.span *= size.astype(_U)
        reader.update(x)
        grid[t] = x
        go = coder.first()
        by = go * _16
        coder.shift(by)
        code <<= by
        code |= (words.take(read, mode="clip") * go).astype(_U)
        read += go
        for todo, _ in coder.more():
            code[todo] = code[todo] << _16 | words.take(read[todo], mode="clip").astype(_U)
            read[todo] += 1
    return grid


def decode(data: bytes) -> np.ndarray:
    """The ids; raises ValueError where a block's checksum does not match."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of coded ids")
    vocabulary, n, total = struct.unpack_from("<III", data, 4)
    table = np.frombuffer(data, np.dtype([("ids", "<u2"), ("bytes", "<u4"), ("crc", "<u4")]), n, 16)
    sizes, words = table["ids"].astype(np.int64), table["bytes"].astype(np.int64) // 2
    at, grid = 16 + table.nbytes, np.zeros((n, BLOCK_IDS), "<u2")
    for group in _groups(n):
        coded = np.zeros((group.stop - group.start, int(words[group].max()) + 8), "<u2")
        for row, many in zip(coded, words[group]):
            row[:many] = np.frombuffer(data, "<u2", many, at)
            at += 2 * many
        grid[group] = _decode(coded, int(sizes[group].max()), vocabulary).T
    ids, at = grid.reshape(-1)[:total], 0
    for size, crc in zip(sizes, table["crc"]):
        if zlib.crc32(ids[at : at + size].tobytes()) != crc:
            raise ValueError(f"checksum of the block at id {at} does not match")
        at += size
    return ids

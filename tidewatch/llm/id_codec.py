"""Context-mixing range coder for 16-bit token ids, over many independent blocks at once.

A sequence (a file's ids) is cut into blocks of equal length, coded side by side, one numpy lane a
block.  The file's statistics are counted first and stored once as its :class:`Model`; every block
starts from them and from an empty order-2 memory, so each can be decoded alone.  Three predictions
are mixed for an id:

* order 2, learned while coding: the id that last followed the two ids before it in the block.  Its
  share of the scale follows how often the context and the block held in a row (``SHARE``);
* order 1, of the file: ids after the id before, in ``UNITS`` parts a context, with an escape;
* order 0, of the file: all ids in ``1 << SCALE`` slots, for what escapes from order 1.

The coder keeps 48 bits and emits 16 at a time; a carry is added to what has been emitted.  Its
quotients stay below 2^16 and its divisors below 2^32, so that division in doubles is exact.
"""

from __future__ import annotations

import zlib

import numpy as np

SCALE = 16
UNIT_BITS = 8
UNITS = 1 << UNIT_BITS  # of a context's order-1 row
LEAST_CONTEXT, LEAST_PAIR = 64, 4  # rarer contexts and pairs cost more in the model than they save
LANES = 4096
BITS2 = 10  # log2 of a block's order-2 table
HASH = np.int32(40503)
MOST = 15  # largest count of a context and of a block
ESCAPE = (1 << 16) - 1
_FLOOR = 1 << 32
_WORD = (1 << 32) - 1


def _shares() -> np.ndarray:
    """By ``streak << 4 | count``: order 2 takes ``1 - 2^-share`` of the scale, none of it for 0."""
    streak, count = np.divmod(np.arange(256), 16)
    held = count - 1 + 2.0 * streak
    miss = np.where(count > 0, 1.2 / (held + 1.5), 1)
    return np.clip(np.floor(-np.log2(np.minimum(miss, 1)) + 0.4), 0, 6).astype(np.int32)


SHARE = _shares()
SHIFT = SCALE - UNIT_BITS - SHARE  # size of an order-1 unit
EDGE = (1 << SCALE) - (UNITS << SHIFT)  # order 2 owns what lies below


class Model:
    """Order-0 and order-1 frequencies; symbols are places in the ascending list of the file's ids."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray, contexts: np.ndarray, counts: np.ndarray,
                 symbols: np.ndarray, units: np.ndarray):
        self.ids, self.freqs = ids.astype(np.int64), freqs.astype(np.int64)
        self.contexts, self.counts = contexts.astype(np.int64), counts.astype(np.int64)
        self.symbols, self.units = symbols.astype(np.int64), units.astype(np.int64)
        self.starts = np.cumsum(self.freqs) - self.freqs
        self.row = np.zeros(len(ids) + 1, np.int64)  # row 0: everything escapes; the last entry begins a block
        self.row[self.contexts] = np.arange(1, len(contexts) + 1)
        first = np.cumsum(self.counts) - self.counts
        ends = np.cumsum(self.units)
        before = np.concatenate([[0], ends])[first] if len(first) else first
        self.at = ends - self.units - np.repeat(before, self.counts)
        used = np.bincount(np.repeat(np.arange(len(contexts)), self.counts), self.units, len(contexts)).astype(np.int64)
        self.used = np.concatenate([[0], used])  # what lies beyond is the row's escape

    @classmethod
    def of(cls, symbols: np.ndarray, ids: np.ndarray) -> tuple["Model", np.ndarray]:
        """The model of a sequence of symbols, and the order-1 part of each symbol after the one before:
        ``start << 16 | parts``, and 1 << 32 where it escapes.  Order 0 counts what escapes."""
        d = len(ids)
        if d > ESCAPE:
            raise ValueError("more distinct ids than symbols")
        bits = len(symbols).bit_length()
        if bits > 31:
            raise ValueError("a file has too many ids")
        keys = symbols[:-1].astype(np.uint64) << np.uint64(16) | symbols[1:]
        keys = np.sort(keys << np.uint64(bits) | np.arange(1, len(symbols), dtype=np.uint64))
        by = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        keys = (keys >> np.uint64(bits)).astype(np.int64)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)]
        first = np.flatnonzero(new)
        ctx, sym, n = keys[first] >> 16, keys[first] & 0xFFFF, np.diff(np.append(first, len(keys)))
        total = np.bincount(ctx, n, d).astype(np.int64)
        units = n * (UNITS - 1) // np.maximum(total[ctx], 1)
        kept = (total[ctx] >= LEAST_CONTEXT) & (n >= LEAST_PAIR) & (units > 0)
        contexts, counts = np.unique(ctx[kept], return_counts=True)
        rest = np.bincount(symbols, minlength=d) - np.bincount(sym[kept], n[kept], d).astype(np.int64)
        slots = (1 << SCALE) - d
        freqs = 1 + rest * slots // max(1, int(rest.sum()))
        freqs[np.argmax(freqs)] += (1 << SCALE) - freqs.sum()
        model = cls(ids, freqs, contexts, counts, sym[kept], units[kept])
        part = model.escape(ctx)
        part[kept] = model.at << 16 | model.units
        parts = np.empty(len(symbols), np.int64)
        parts[by] = part[np.cumsum(new) - 1]
        return model, parts

    def escape(self, before: np.ndarray) -> np.ndarray:
        """The part of the scale that means an escape after these symbols."""
        used = self.used[self.row[before]]
        return 1 << 32 | used << 16 | (UNITS - used)

    def pack(self) -> bytes:
        # all symbols and frequencies lie below 2^16 but the frequency of an only id
        sizes = np.array([len(self.ids), len(self.contexts), len(self.symbols)], "<u4").tobytes()
        parts = [(self.ids, "<u2"), (self.freqs - 1, "<u2"), (self.contexts, "<u2"), (self.counts, "<u2")]
        steps = np.diff(self.symbols, prepend=0).astype("<u2")  # mostly small, so its high bytes are put apart
        tail = [(steps & 255).astype("u1").tobytes(), (steps >> 8).astype("u1").tobytes(), self.units.astype("u1").tobytes()]
        return zlib.compress(b"".join([sizes, *(a.astype(t).tobytes() for a, t in parts), *tail]), 6)

    @classmethod
    def unpack(cls, packed: bytes) -> "Model":
        raw = zlib.decompress(packed)
        d, rows, n = np.frombuffer(raw, "<u4", 3).tolist()
        parts, at = [], 12
        for size in (d, d, rows, rows):
            parts.append(np.frombuffer(raw, "<u2", size, at).astype(np.int64))
            at += 2 * size
        low, high, units = (np.frombuffer(raw, "u1", n, at + i * n).astype(np.int64) for i in range(3))
        return cls(parts[0], parts[1] + 1, parts[2], parts[3], np.cumsum(low | high << 8) & ESCAPE, units)

    def cells(self) -> np.ndarray:
        """By row and unit: ``symbol << 16 | start << 8 | parts - 1``, ESCAPE as the symbol of an escape."""
        rows = len(self.used)
        row = np.concatenate([np.repeat(np.arange(1, rows), self.counts), np.arange(rows)])
        symbol = np.concatenate([self.symbols, np.full(rows, ESCAPE)])
        start, units = np.concatenate([self.at, self.used]), np.concatenate([self.units, UNITS - self.used])
        by = np.argsort(row << 9 | start, kind="stable")
        return np.repeat((symbol << 16 | start << 8 | units - 1)[by].astype(np.uint32), units[by])


class _Memory:
    """Order 2 of all blocks; encoder and decoder drive it with the same symbols."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64) << BITS2
        self.table = np.zeros(lanes << BITS2, np.int32)  # symbol << 4 | how often it held in a row
        self.streak = np.zeros(lanes, np.int32)
        self.near = np.zeros(lanes, np.int32)
        self.far = np.zeros(lanes, np.int32)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predicted symbol, the edge of its share and the shift of what is left."""
        self.cell = self.base + ((self.near + self.far) >> 5 & ((1 << BITS2) - 1))
        self.value = self.table.take(self.cell, mode="clip")
        self.count = self.value & 15
        which = self.streak << 4 | self.count
        return self.value >> 4, EDGE.take(which, mode="clip"), SHIFT.take(which, mode="clip")

    def update(self, symbols: np.ndarray, held: np.ndarray) -> None:
        self.table[self.cell] = np.where(held, self.value + (self.count < MOST), symbols << 4 | 1)
        self.streak = np.minimum(self.streak + 1, MOST) * held
        self.far, self.near = self.near, symbols * HASH
        self.far *= 3


def block_length(n: int) -> int:
    """Ids a block: as many blocks as there are lanes, none below 256 ids."""
    return max(256, -(-n // LANES))


def _blocks(n: int, steps: int) -> int:
    return max(1, -(-n // steps))


def encode(ids: np.ndarray, steps: int) -> list[bytes]:
    """The packed model, then one payload for each block of ``steps`` ids (the last one is padded)."""
    lanes = _blocks(len(ids), steps)
    present = np.flatnonzero(np.bincount(ids, minlength=1)) if len(ids) else np.zeros(1, np.int64)
    place = np.zeros(1 << 16, np.uint16)
    place[present] = np.arange(len(present))
    flat = np.zeros(lanes * steps, np.uint16)
    flat[:len(ids)] = place[ids]
    model, parts = Model.of(flat, present)
    parts[::steps] = model.escape(np.array([len(present)]))  # a block begins after nothing
    grid = flat.reshape(lanes, steps).T.astype(np.int32, order="C")
    parts = parts.reshape(lanes, steps).T
    first = (parts >> 16 & 0xFFFF).astype(np.int32, order="C")
    wide, escapes = (parts & 0xFFFF).astype(np.int32, order="C"), (parts >> 32).astype(bool, order="C")
    memory = _Memory(lanes)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    out = np.zeros((2 * steps + 8) * lanes, np.uint16)  # a word of all lanes after the other
    pos = np.arange(lanes, dtype=np.int64) + lanes  # word 0 takes a carry out of the first word

    def emit() -> None:
        at = np.flatnonzero(width < _FLOOR)
        part, to = low.take(at, mode="clip"), pos.take(at, mode="clip")
        over = np.flatnonzero(part >> 48)
        if len(over):
            back = to[over] - lanes
            while len(back):
                out[back] += np.uint16(1)
                back = back[out[back] == 0] - lanes
        out[to] = part >> 32  # without the carry, 16 bits
        pos[at] = to + lanes
        low[at] = (part & _WORD) << 16
        width[at] = width.take(at, mode="clip") << 16

    for step in range(steps):
        x = grid[step]
        guess, edge, shift = memory.predict()
        held = x == guess
        hit = held & (edge > 0)
        unit = width >> SCALE
        low += unit * np.where(hit, 0, edge + (first[step] << shift))
        np.multiply(unit, np.where(hit, edge, wide[step] << shift), out=width)
        emit()
        rest = np.flatnonzero(escapes[step] & ~hit)
        if len(rest):
            unit, y = width.take(rest, mode="clip") >> SCALE, x.take(rest, mode="clip")
            low[rest] += model.starts.take(y, mode="clip") * unit
            width[rest] = model.freqs.take(y, mode="clip") * unit
            emit()
        memory.update(x, held)
    width[:] = 0
    for _ in range(3):
        emit()
    words, out = pos // lanes, out.reshape(-1, lanes)[:int(pos.max()) // lanes].T.astype("<u2", order="C")
    return [model.pack(), *(out[i, :n].tobytes() for i, n in enumerate(words.tolist()))]


def decode(parts: list[bytes], n: int, steps: int) -> np.ndarray:
    """The n ids of the blocks; ``parts`` as :func:`encode` gives them, or the model and a few blocks."""
    packed, *payloads = parts
    lanes = len(payloads)
    if lanes != _blocks(n, steps):
        raise ValueError("block count does not fit the number of ids")
    model = Model.unpack(packed)
    cells, slots = model.cells(), np.repeat(np.arange(len(model.ids), dtype=np.int32), model.freqs)
    memory = _Memory(lanes)
    wide = max(map(len, payloads)) // 2 + 4
    words = np.zeros((lanes, wide), np.uint16)
    for i, p in enumerate(payloads):
        words[i, :len(p) // 2] = np.frombuffer(p, "<u2")
    rest = words[:, :4].astype(np.int64) @ (1 << np.array([48, 32, 16, 0]))
    words = words.T.ravel()  # a word of all lanes after the other
    pos = np.arange(lanes, dtype=np.int64) + 4 * lanes
    width = np.full(lanes, 1 << 48, np.int64)
    out = np.zeros((steps, lanes), np.uint16)
    row = np.zeros(lanes, np.int64)
    top = np.int32((1 << SCALE) - 1)

    def fill() -> None:
        at = np.flatnonzero(width < _FLOOR)
        where = pos.take(at, mode="clip")
        rest[at] = rest.take(at, mode="clip") << 16 | words.take(where, mode="clip")
        pos[at] = where + lanes
        width[at] = width.take(at, mode="clip") << 16

    for step in range(steps):
        guess, edge, shift = memory.predict()
        unit = width >> SCALE
        v = np.minimum((rest / unit).astype(np.int32), top) - edge
        hit = v < 0
        cell = cells.take((row << UNIT_BITS) + np.maximum(v >> shift, 0), mode="clip")
        start, parts = (cell >> 8 & 255).view(np.int32), (cell & 255).view(np.int32) + 1
        symbol = (cell >> 16).view(np.int32)
        rest -= unit * np.where(hit, 0, edge + (start << shift))
        np.multiply(unit, np.where(hit, edge, parts << shift), out=width)
        fill()
        x = np.where(hit, guess, symbol)
        plain = np.flatnonzero((symbol == ESCAPE) & ~hit)
        if len(plain):
            unit, left = width.take(plain, mode="clip") >> SCALE, rest.take(plain, mode="clip")
            y = slots.take(np.minimum((left / unit).astype(np.int64), top), mode="clip")
            rest[plain] = left - model.starts.take(y, mode="clip") * unit
            width[plain] = model.freqs.take(y, mode="clip") * unit
            x[plain] = y
            fill()
        memory.update(x, x == guess)
        row = model.row.take(x, mode="clip")
        out[step] = x
    return model.ids[out.T.ravel()[:n]].astype(np.uint16)

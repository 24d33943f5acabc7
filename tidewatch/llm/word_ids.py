"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once a worker.

The vocabulary composes characters (NFC), makes white space one space, lower-cases, and divides words
into runs of letters, single digits, contractions and runs of other characters, none of which sees
its neighbours.  For texts of plain characters (ASCII and Latin letters, where nothing composes and
lower case is one character for one) that division is carried out on the bytes of a batch at once:
a cut wherever two kinds of bytes surely part.  Around an apostrophe or a sign beyond ASCII nothing
is cut; such a stretch goes to the library as it is and may come back as several pieces.

Stretches are looked up by their bytes, up to ``WIDTH`` of them as whole numbers, in a table with two
places a stretch; what is found there has been compared byte by byte.  The others are looked up in a
dictionary, and new ones are encoded by the library, many in a call.  Other texts (other scripts,
special strings) go to the library whole, in parts cut at spaces.
"""

from __future__ import annotations

import os
import re

import numpy as np

WIDTH = 24  # bytes of a stretch that the table compares; longer ones are in the dictionary only
CACHE = 1_000_000  # distinct stretches a worker keeps
SLOT_BITS = 22
PART = 50_000  # characters of a text given to the library at once, up to the next space
_PLAIN = re.compile("[\x00-\x1b\x20-\xd6\xd8-\xf6\xf8-įı-ſ]*")
# The vocabulary's own division of a lower-cased text of those characters
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d"
                     "|[a-z\xaa\xb5\xba\xc0-ſ]+"
                     "|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                     "|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-ſ]+")
_SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")
_SPACE, _LETTER, _DIGIT, _SIGN, _STICKY = range(5)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _SIGN, np.uint8)
    kinds[list(b"\t\n\x0b\x0c\r ")] = _SPACE
    kinds[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
    kinds[0x80:] = _LETTER  # but for what 0xC2 leads, see _cuts
    kinds[list(b"0123456789")] = _DIGIT
    kinds[ord("'")] = _STICKY
    return kinds


def _starts() -> np.ndarray:
    """By ``kind before * 5 + kind``: does a stretch start here?"""
    before, here = np.divmod(np.arange(25), 5)
    free = (before != _STICKY) & (here != _STICKY)
    return (here != _SPACE) & ((before == _SPACE) | free & ((before != here) | (here == _DIGIT)))


KINDS, STARTS = _kinds(), _starts()
_KEEP = np.frombuffer(b"".join(b"\xff" * n + b"\0" * (WIDTH - n) for n in range(WIDTH + 1)), "<u8").reshape(-1, WIDTH // 8)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)


class WordIds:
    """The library's tokenizer and what this worker has encoded with it."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.closes = np.zeros(1 << 16, bool)  # each piece ends with its only token that closes a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)  # entry 0, the end of a document, equals no stretch
        self.keys = np.zeros((CACHE + 1, WIDTH // 8), np.uint64)
        self.sizes = np.zeros(CACHE + 1, np.int32)
        self.at, self.count = np.zeros(CACHE + 1, np.int64), np.zeros(CACHE + 1, np.int64)
        self.pool = np.full(1 << 20, self.end_id, np.uint16)
        self.count[0], self.used = 1, 1
        self.entries: dict[bytes, int] = {}

    def _add(self, words: list[bytes]) -> None:
        """Entries of new stretches; may pass ``CACHE`` by what one batch holds."""
        for a in range(0, len(words), 2048):
            part = [w.decode() for w in words[a:a + 2048]]
            counts = np.array([len(_PIECES.findall(w)) for w in part])
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != counts.sum():
                raise ValueError("stretches do not match the tokenizer's division")
            ends = ends[np.cumsum(counts) - 1]
            first = len(self.entries) + 1
            last = first + len(part)
            while last > len(self.at):
                self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
                self.sizes, self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.at, self.count))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used:self.used + len(ids)] = ids
            self.count[first:last] = np.diff(ends, prepend=0)
            self.at[first:last] = self.used + ends - self.count[first:last]
            self.used += len(ids)
            self.entries.update(zip(words[a:a + 2048], range(first, last)))

    def _find(self, data: bytes, room: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entry of each stretch."""
        keys = np.lib.stride_tricks.sliding_window_view(room, WIDTH)[starts].view("<u8")
        keys &= _KEEP.take(np.minimum(sizes, WIDTH), axis=0)
        mixed = keys @ _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= _AGAIN
        places = [(mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (mixed & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)]
        out = np.zeros(len(starts), np.int64)
        left = np.arange(len(starts))
        for place in places:
            entry = self.slots.take(place[left])
            same = (self.sizes.take(entry) == sizes[left]) & (self.keys.take(entry, axis=0) == keys[left]).all(axis=1)
            out[left[same]] = entry[same]
            left = left[~same]
        if len(left):
            words = [data[a:a + n] for a, n in zip(starts[left].tolist(), sizes[left].tolist())]
            self._add([w for w in set(words) if w not in self.entries])
            entry = np.array([self.entries[w] for w in words])
            out[left] = entry
            short = sizes[left] <= WIDTH
            left, entry = left[short], entry[short]
            self.keys[entry], self.sizes[entry] = keys[left], sizes[left]
            free = self.slots[places[0][left]] == 0
            self.slots[np.where(free, places[0][left], places[1][left])] = entry
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.lower().replace("\x85", " ").replace("\xa0", " ").encode() for t in texts]
        if len(self.entries) > CACHE:
            self._clear()
        data = b"\n".join(parts) + b"\n" + bytes(WIDTH)
        room = np.frombuffer(data, np.uint8)
        size = len(data) - WIDTH
        kinds = KINDS.take(room[:size])
        lead = np.flatnonzero(room[:size] == 0xC2)
        kinds[lead], kinds[lead + 1] = _STICKY, _STICKY
        before = np.concatenate([[_SPACE], kinds[:-1]]).astype(np.uint8)
        begins = STARTS.take(before * 5 + kinds)
        ends = (before != _SPACE) & (begins | (kinds == _SPACE))
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
        entry = self._find(data, room, starts, stops - starts)
        borders = np.cumsum([len(p) + 1 for p in parts])
        of = np.searchsorted(starts, borders)
        entry = np.insert(entry, of, 0)
        count = self.count.take(entry)
        total = np.cumsum(count)
        where = np.repeat(self.at.take(entry) - total + count, count)
        where += np.arange(len(where))
        return np.split(self.pool.take(where), total[of + np.arange(len(parts))][:-1])

    def _whole(self, text: str) -> np.ndarray:
        parts, a = [], 0
        while a < len(text):
            b = text.find(" ", a + PART)
            b = len(text) if b < 0 else b
            parts.append(text[a:b])
            a = b
        ids = [i for part in parts for i in self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids]
        return np.array([*ids, self.end_id], np.uint16)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint16 ids of whole texts with the end id."""
        texts = [t or "" for t in texts]
        plain = [_PLAIN.fullmatch(t) is not None and not _SPECIAL.search(t) for t in texts]
        ready = iter(self._plain([t for t, p in zip(texts, plain) if p]) if any(plain) else [])
        return [next(ready) if p else self._whole(t) for t, p in zip(texts, plain)]

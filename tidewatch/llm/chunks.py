"""Content-defined chunks of texts: equal passages are cut alike wherever they stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 32  # code points the rolling hash looks back on
LEAST, MOST = 128, 4096  # code points a chunk; a cut depends on its chunk's text alone
RATE = 9  # one position in 2^RATE is a cut
GROUP = 1 << 20  # code points hashed at a time
FACTOR = np.uint32(0x9E3779B1)


def _cuts(text: str, back: int) -> np.ndarray:
    """Positions of ``text`` from ``back`` on after which the rolling hash asks for a cut.

    The hash of a position is the sum of the scrambled code points of its window, each shifted by its
    distance; five doublings add up 32 of them.
    """
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32) * FACTOR
    h = c ^ (c >> np.uint32(15))
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero(h[back:] >> np.uint32(32 - RATE) == 0) + back + 1


def _edges(n: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of a text of ``n`` code points, 0 first."""
    out, last = [0], 0
    for c in cuts:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if LEAST <= c - last and c < n:
            last = c
            out.append(c)
    while n - last > MOST:
        last += MOST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def chunk_edges(texts: list[str]) -> Iterator[list[int]]:
    """For each text the ends of its chunks, 0 first; ``[0]`` for an empty one.

    Short texts are hashed together: no cut stands within ``LEAST`` of a text's start, so no
    hash that counts looks into the text before.  Long ones are hashed piece by piece.
    """
    at = 0
    while at < len(texts):
        size, stop = len(texts[at]), at + 1
        while stop < len(texts) and size + len(texts[stop]) <= GROUP:
            size += len(texts[stop])
            stop += 1
        if size > GROUP:
            text, cuts = texts[at], []
            for a in range(0, size, GROUP):
                back = min(a, WINDOW)
                cuts.append(_cuts(text[a - back:a + GROUP], back) + (a - back))
        else:
            cuts = [_cuts("".join(texts[at:stop]), 0)] if size else []
        cuts = np.concatenate(cuts) if cuts else np.zeros(0, int)
        starts = np.cumsum([0] + [len(t) for t in texts[at:stop]])
        near = np.searchsorted(cuts, starts, side="right")
        for i in range(stop - at):
            yield _edges(len(texts[at + i]), (cuts[near[i]:near[i + 1]] - starts[i]).tolist())
        at = stop

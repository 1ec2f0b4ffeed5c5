"""Vectorised pre-tokenisation: the split patterns of the byte-level and the word-end tokenizers, as array operations.

Both patterns match runs of letters, of numbers and of other signs, and the contractions 's 't 're 've 'm 'll 'd where
a match can start at the apostrophe, that is where the apostrophe is a run of signs by itself.
"""

from __future__ import annotations

import numpy as np

from graphloom.llm.arrays import LETTER, NUMBER, OTHER, SPACE, classes, code_points


def _runs(kind: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and class of the maximal runs of one class that cross no edge."""
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[edges[edges < len(kind)]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(kind)), kind[starts]


def _contractions(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray, free: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that are an apostrophe a contraction starts with (``free``: no space stands before), and its letters."""
    here = np.flatnonzero((kind[:-1] == OTHER) & (kind[1:] == LETTER) & (ends[:-1] - starts[:-1] == 1) & free[:-1])
    here = here[(points[starts[here]] == 0x27) & ~edge[starts[here + 1]]]
    if not len(here):
        return here, here
    after = np.append(points, [0, 0])
    first, second = after[starts[here] + 1], after[starts[here] + 2]
    room = ends[here + 1] - starts[here + 1] >= 2
    size = np.zeros(len(here), np.int64)
    for letter in "stmd":
        size[first == ord(letter)] = 1
    for a, b in ("re", "ve", "ll"):
        size[(first == ord(a)) & (second == ord(b)) & room] = 2
    return here[size > 0], size[size > 0]


def split(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of all texts, in order.

    spaced: as the byte-level tokenizer has it (one space joins what follows, numbers are runs, white space is kept);
    else as the word-end tokenizer has it (each number sign by itself, white space dropped).
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points, at = code_points(data)
    kind = classes()[points]
    edges = np.searchsorted(at, offsets)
    edge = np.zeros(len(points) + 1, bool)
    edge[edges] = True
    starts, ends, kind = _runs(kind, edges)
    free = np.ones(len(starts), bool)
    if spaced:
        last = ends - 1
        joins = np.zeros(len(starts), bool)  # runs of white space whose last sign goes with what follows
        joins[:-1] = (kind[:-1] == SPACE) & (points[last[:-1]] == 0x20) & ~edge[starts[1:]]
        free[1:] = ~joins[:-1]
    which, size = _contractions(points, starts, ends, kind, free, edge)
    cuts = [starts]
    if spaced:
        followed = np.zeros(len(starts), bool)  # white space before more text gives up its last sign
        followed[:-1] = (kind[:-1] == SPACE) & ~edge[starts[1:]]
        cuts.append(last[followed])
    else:
        numbers = np.flatnonzero((kind == NUMBER) & (ends - starts > 1))
        cuts += [np.arange(starts[i], ends[i]) for i in numbers]
    cuts.append(starts[which + 1] + size)
    is_cut = np.zeros(len(points) + 1, bool)
    is_cut[np.concatenate(cuts)] = True
    if len(which):
        is_cut[starts[which + 1]] = False
    if spaced:
        is_cut[ends[joins]] = False
    is_cut[edges] = True
    first = np.flatnonzero(is_cut[:-1])
    byte_at = np.append(at, len(data))
    begin, end = byte_at[first], byte_at[np.append(first[1:], len(points))]
    if not spaced:
        keep = classes()[points[first]] != SPACE
        begin, end = begin[keep], end[keep]
    return begin, end

"""Burrows-Wheeler transforms of small shards of strings, and their merge by interleave refinement.

Each shard sorts the suffixes of its own strings once. Merging never sorts suffixes of different shards
against each other: it holds an interleave of (shard, suffix) items, at first shard after shard, and
refines it character by character. One step takes the BWT character of each item in the present
order, deals the items stably by that character and moves each to the suffix one character longer (LF).
After d steps the order is that of the first d characters; where two neighbours were first dealt
apart gives their common prefix, and runs never dealt apart are the repeated intervals.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Strings with a terminator each: bwt (character before each suffix, 0 the terminator, else byte + 1), lf, and rank (place in the order of each position of the text)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        texts = len(at) - 1
        sizes = np.diff(at) + 1
        end = np.cumsum(sizes) - 1
        text = np.zeros(int(sizes.sum()), np.uint16)
        body = np.ones(len(text), bool)
        body[end] = False
        text[body] = data.astype(np.uint16) + 1
        self.begin = end + 1 - sizes
        before = np.arange(len(text)) - 1
        before[self.begin] = end
        order = suffix_order(text)
        self.rank = np.empty(len(text), np.int64)
        self.rank[order] = np.arange(len(text))
        self.bwt = text[before[order]]
        self.lf = self.rank[before[order]]
        self.texts = texts


def suffix_order(text: np.ndarray, depth: int = 64) -> np.ndarray:
    """Positions in the order of their suffixes: by packed words of characters, later words only where earlier ones tie."""
    padded = np.concatenate([text.astype(np.uint64), np.zeros(depth + 8, np.uint64)])
    n = len(text) + depth
    two = (padded[:-1] << np.uint64(9)) | padded[1:]  # 9 bits a character, 7 in a word
    four = (two[:-2] << np.uint64(18)) | two[2:]
    word = (four[:n] << np.uint64(27)) | (two[4 : 4 + n] << np.uint64(9)) | padded[6 : 6 + n]
    order = np.argsort(word[: len(text)])  # ties are told apart below
    tied = word[order]
    same = np.concatenate([tied[1:] == tied[:-1], [False]])
    live = same | np.concatenate([[False], same[:-1]])
    group = np.cumsum(np.concatenate([[True], ~same[:-1]]))
    at = np.flatnonzero(live)
    skip = 7
    while len(at) and skip < depth:
        pos, g = order[at], group[at]
        key = word[np.minimum(pos + skip, len(word) - 1)]
        o = np.lexsort((key, g))
        order[at], key = pos[o], key[o]
        same = np.concatenate([(key[1:] == key[:-1]) & (g[1:] == g[:-1]), [False]])
        live = same | np.concatenate([[False], same[:-1]])
        group[at] = at[np.maximum.accumulate(np.where(np.concatenate([[True], ~same[:-1]]), np.arange(len(at)), 0))] + len(text) * skip
        at = at[live]
        skip += 7
    return order


def looked_up(shards: list[Shard], wide: int) -> tuple[np.ndarray, int]:
    """What is before each item and where that is, side by side, so that one look-up gives both; two characters at once if asked for and the alphabet is small enough for a pair to be 16 bits."""
    base = np.cumsum([0] + [len(s.bwt) for s in shards])
    lf = np.concatenate([s.lf + b for s, b in zip(shards, base, strict=False)])
    bwt = np.concatenate([s.bwt for s in shards])
    used = np.flatnonzero(np.bincount(bwt, minlength=1))
    if wide == 1 or len(used) > 256:
        return (lf << 16) | bwt, 1
    code = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
    code[used] = np.arange(len(used))
    one = code[bwt]
    return (lf[lf] << 16) | (one[lf] * len(used) + one), 2


def merge(shards: list[Shard], items: np.ndarray | None = None, depth: int = 50, repeated_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refine the interleave `depth` times: order (numbers of the given items), block (equal: the same `depth` characters), common (characters shared with the item before, `depth` at most).

    items: suffixes to start from, as ranks plus their shard's base; all suffixes by default. With
    `repeated_only`, items that are alone in their block leave: a longer match would need their block's company; a step
    then refines by two characters where it can, and `common` means nothing.
    """
    step_of, wide = looked_up(shards, 2 if repeated_only and depth % 2 == 0 else 1)
    items = np.arange(len(step_of)) if items is None else items
    number, block = np.arange(len(items), dtype=np.int32), np.zeros(len(items), np.int32)
    common = np.full(len(items), depth, np.int64)
    common[:1] = 0
    for step in range(depth // wide):
        found = step_of[items]
        order = np.argsort((found & 0xFFFF).astype(np.uint16), kind="stable")
        found, old, number = found[order], block[order], number[order]
        c, items = found & 0xFFFF, found >> 16
        edge = np.ones(len(items), bool)
        edge[1:] = (c[1:] != c[:-1]) | (old[1:] != old[:-1])
        if repeated_only:
            alone = edge.copy()
            alone[:-1] &= edge[1:]
            keep = ~alone
            items, number, edge = items[keep], number[keep], edge[keep]
        else:
            common[(common == depth) & edge] = step
        block = np.cumsum(edge, dtype=np.int32)
        if not len(items):
            break
    return number, block, common

"""The best paths over many runs of Chinese characters at once, by a dictionary that lies in a hash table of its beginnings.

It gives what `segment.best_path` gives for each run: the places of all runs of a slice of texts are looked up together, and
runs of about the same length go through their places side by side.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from loomlake.operators.grams import text_slices

#: Kinds of characters: between tokens, of ASCII letters, digits and underscores, Chinese, and tokens of their own.
SPACE, WORD, CHINESE, OTHER = range(4)
#: Places of runs that go side by side, with those that fill up shorter ones.
SIDE_BY_SIDE = 1 << 16
#: The weight of no word: less than the sum of any path.
NONE = -(1 << 60)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    kinds[[i for i in range(0x3001) if chr(i).isspace()]] = SPACE
    kinds[[i for i in range(128) if chr(i).isalnum() or chr(i) == "_"]] = WORD
    kinds[0x4E00:0xA000] = CHINESE
    return kinds


class Lattice:
    """Words with whole weights, the most characters of a word, and the weight of a character that is no word."""

    def __init__(self, weights: dict[str, int], longest: int, unknown: int):
        self.longest, self.unknown = longest, unknown
        nodes: dict[tuple[int, int], int] = {}  # (node of the beginning, next character): node; 0 is the empty beginning
        weight = [NONE]
        for word, w in weights.items():
            node = 0
            for c in word:
                at = nodes.get((node, ord(c)))
                if at is None:
                    at = nodes[(node, ord(c))] = len(weight)
                    weight.append(NONE)
                node = at
            weight[node] = w
        self.weight = np.array(weight, np.int64)
        keys = np.array([n << 21 | c for n, c in nodes], np.int64)
        values = np.fromiter(nodes.values(), np.int32, len(nodes))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several for one slot the last one stays
            done = self.keys[slots] == keys
            self.nodes[slots[done]] = values[done]
            keys, values, slots = keys[~done], values[~done], (slots[~done] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes one character on; 0 where there are none."""
        keys = node << 21 | char
        slots = self._slots(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.nodes[slots], 0).astype(np.int64)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.nodes[slots[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out

    def _begins(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> None:
        """Marks in begins where the words of runs begin that lie in points."""
        size = int(lengths.max())
        inside = np.arange(size)[:, None] < lengths  # a row for each place, a column for each run
        chars = np.where(inside, points[np.minimum(starts + np.arange(size)[:, None], len(points) - 1)], 0).astype(np.int64).ravel()
        # weight[n - 1]: of the word of n characters that begins at a place
        weight = np.full((self.longest, size * len(starts)), NONE, np.int64)
        at = np.flatnonzero(inside)
        left, node = (lengths - np.arange(size)[:, None]).ravel()[at], np.zeros(len(at), np.int64)
        for n in range(self.longest):
            node = self._next(node, chars[at + n * len(starts)])
            weight[n, at] = self.weight[node]
            more = np.flatnonzero((node > 0) & (left > n + 1))
            at, node, left = at[more], node[more], left[more]
        weight[0][weight[0] == NONE] = self.unknown
        weight = weight.reshape(self.longest, size, len(starts))
        best, step = np.zeros((size + 1, len(starts)), np.int64), np.ones((size + 1, len(starts)), np.int16)
        for end in range(1, size + 1):
            score = best[end]
            np.add(best[end - 1], weight[0, end - 1], out=score)
            for n in range(2, min(self.longest, end) + 1):
                own = best[end - n] + weight[n - 1, end - n]
                better = own >= score  # of equal ones the longer word
                np.maximum(own, score, out=score)
                step[end][better] = n
        place, own = lengths.copy(), np.arange(len(starts))
        while len(own):
            place[own] -= step[place[own], own]
            begins[starts[own] + place[own]] = True
            own = own[place[own] > 0]

    def tokens(self, texts: list[str | None]) -> pa.Array:
        """The tokens of each text; null texts have none."""
        parts = []
        for begin, end, points in text_slices(texts):
            kinds = _kinds()[points]
            before = np.concatenate([[SPACE], kinds[:-1]])
            starts = (kinds == OTHER) | ((kinds != before) & (kinds != SPACE))
            runs = np.flatnonzero(starts & (kinds == CHINESE))
            if len(runs):
                ends = np.flatnonzero((kinds == CHINESE) & (np.concatenate([kinds[1:], [SPACE]]) != CHINESE)) + 1
                lengths = ends - runs
                order = np.argsort(lengths, kind="stable")
                sizes = lengths[order]
                a = 0
                while a < len(order):
                    # runs in order of length: as many as fill SIDE_BY_SIDE places with the longest of them
                    b = int(np.searchsorted(sizes[a:] * np.arange(1, len(order) - a + 1), SIDE_BY_SIDE, "right")) + a
                    b = max(b, a + 1)
                    self._begins(points, runs[order[a:b]], sizes[a:b], starts)
                    a = b
            visible = kinds != SPACE
            own = points[visible]
            data = own.tobytes().decode("utf-32-le", "surrogatepass").encode()
            upto = np.concatenate([[0], np.cumsum(1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000))])
            first = np.flatnonzero(starts[visible])
            offsets = np.concatenate([upto[first], upto[-1:]]).astype(np.int32)
            words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
            sizes = [len(t or "") + 1 for t in texts[begin:end]]
            counts = np.bincount(np.repeat(np.arange(end - begin), sizes)[starts], minlength=end - begin)
            parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), words))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

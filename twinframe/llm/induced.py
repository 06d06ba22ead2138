"""Suffix sorting by induction, with queues that go to disk.

Suffixes are typed S or L by whether they sort before or after their right neighbour. The leftmost S suffixes (LMS) induce the order of all others:
going through the symbols upward, each sorted suffix puts its left neighbour into the queue of that neighbour's symbol, if it is L; going downward
the S suffixes follow alike. What arrives at one symbol's queue arrives in order, so the priority queue of all suffixes is one first-in-first-out
queue for each symbol, held in blocks; blocks beyond a memory limit wait in an unnamed temporary file, and the large arrays are mapped files.

A first induction sorts the LMS substrings and names them. The order of the LMS suffixes is then that of the suffixes of the string of names, found
by doubling the number of names compared, until all differ or the names reach past the depth asked for.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 256 << 20  # bytes that queues hold, and above which an array is a mapped file
SYMBOLS = 258  # end, separator, bytes


def space(size: int, kind, memory: int = MEMORY) -> np.ndarray:
    """An array in memory, or beyond the limit in a file without a name, which goes with the array."""
    if size * np.dtype(kind).itemsize <= memory:
        return np.empty(size, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(size,))


class Queues:
    """One first-in-first-out queue of positions for each symbol; blocks beyond the memory limit wait on disk."""

    def __init__(self, memory: int):
        self.parts: list[list] = [[] for _ in range(SYMBOLS)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, symbol: int, block: np.ndarray) -> None:
        if self.held + block.nbytes > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(block.tobytes())
            self.parts[symbol].append((at, len(block), block.dtype))
        else:
            self.held += block.nbytes
            self.parts[symbol].append(block)

    def deal(self, positions: np.ndarray, symbols: np.ndarray) -> None:
        """Put each position into its symbol's queue, keeping their order."""
        if len(positions):
            order = np.argsort(symbols, kind="stable")
            positions, symbols = positions[order], symbols[order]
            cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
            for first, block in zip(symbols[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
                self.put(first, block)

    def take(self, symbol: int) -> list[np.ndarray]:
        out = []
        for part in self.parts[symbol]:
            if isinstance(part, tuple):
                at, size, kind = part
                self.file.seek(at)
                part = np.frombuffer(self.file.read(size * kind.itemsize), kind)
            else:
                self.held -= part.nbytes
            out.append(part)
        self.parts[symbol] = []
        return out


def types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol, the smallest, is S."""
    step = np.sign(text[1:].astype(np.int32) - text[:-1]).astype(np.int8)
    there = np.flatnonzero(step)
    follow = np.searchsorted(there, np.arange(len(step)))  # an equal neighbour takes the type of the next unequal one
    out = np.ones(len(text), bool)
    out[:-1] = step[there[np.minimum(follow, len(there) - 1)]] > 0
    return out


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """The order of all suffixes from the LMS ones in order (or in any order within a symbol: then that of the LMS substrings)."""
    seeds, up, down = Queues(memory), Queues(memory), Queues(memory)
    seeds.deal(lms, text[lms])
    large: list[list[np.ndarray]] = []
    for symbol in range(SYMBOLS):
        sorted_here = []
        while blocks := up.take(symbol):  # a run of one symbol feeds its own queue
            for block in blocks:
                sorted_here.append(block)
                left = block[block > 0] - 1
                left = left[~small[left]]
                up.deal(left, text[left])
        for block in seeds.take(symbol):
            left = block[block > 0] - 1
            left = left[~small[left]]
            up.deal(left, text[left])
        large.append(sorted_here)
    out = space(len(text), text_index(len(text)), memory)
    end = len(text)
    for symbol in range(SYMBOLS - 1, -1, -1):
        if symbol == 0:  # the end sign stands alone and first
            down.put(0, np.array([len(text) - 1], out.dtype))
        while blocks := down.take(symbol):
            for block in blocks:
                out[end - len(block):end] = block[::-1]
                end -= len(block)
                left = block[block > 0] - 1
                left = left[small[left] & (text[left] <= symbol)]
                down.deal(left, text[left])
        for block in reversed(large[symbol]):
            out[end - len(block):end] = block
            end -= len(block)
            left = block[::-1]
            left = left[left > 0] - 1
            left = left[small[left]]
            down.deal(left, text[left])
    return out


def text_index(size: int):
    return np.int32 if size < 2**31 else np.int64


def equal_substrings(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether text[a:a+size] equals text[b:b+size], for pairs."""
    out = np.zeros(len(a), bool)
    left, k = np.arange(len(a)), 0
    while len(left):
        done = size[left] <= k
        out[left[done]] = True
        left = left[~done]
        left = left[text[a[left] + k] == text[b[left] + k]]
        k += 1
    return out


def order_of_names(names: np.ndarray, most: int) -> np.ndarray:
    """The order of the suffixes of names, compared over at least `most` names."""
    rank, reach = names.astype(np.int64), 1
    while True:
        after = np.full(len(rank), -1, np.int64)
        after[:-reach] = rank[reach:] if reach < len(rank) else after[:-reach]
        key = rank * (int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(len(rank), np.int64)
        new[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank, reach = new, 2 * reach
        if reach >= min(most, len(rank)) or rank[order[-1]] == len(rank) - 1:
            return order


def sort_suffixes(text: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """Positions of text (numbers below SYMBOLS, ending in its only 0) ordered by at least the first depth symbols."""
    small = types(text)
    index = text_index(len(text))
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(index)
    if len(lms) > 1:
        is_lms = np.zeros(len(text), bool)
        is_lms[lms] = True
        first = induce(text, small, lms, memory)
        first = first[is_lms[first]]  # by LMS substring
        size = np.zeros(len(text), index)
        size[lms[:-1]] = np.diff(lms) + 1
        size[lms[-1]] = 1
        a, b = first[:-1], first[1:]
        same = size[a] == size[b]
        same[same] = equal_substrings(text, a[same], b[same], size[a[same]])
        name = np.zeros(len(text), index)
        name[first] = np.append(0, np.cumsum(~same))
        names = name[lms]
        if names.max() + 1 < len(names):
            lms = lms[order_of_names(names, depth // 2 + 2)]  # a name stands for two symbols or more
        else:
            lms = first
    return induce(text, small, lms, memory)


def repeated_windows(strings: list[bytes], size: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each string the starts of its stretches of `size` bytes that also start elsewhere in the strings; none crosses two."""
    if not strings:
        return []
    lengths = np.array([len(s) for s in strings])
    body = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8)
    text = space(len(body), np.uint16, memory)
    text[:] = body
    text += 2
    starts = np.cumsum(lengths + 1) - lengths - 1
    text[starts + lengths] = 1
    text[-1] = 0
    rest = np.zeros(len(text), np.int64)
    rest[:-1] = np.repeat(starts + lengths, lengths + 1) - np.arange(len(text) - 1)
    order = sort_suffixes(text, size, memory)
    order = order[rest[order] >= size]
    a, b = order[:-1], order[1:]
    wide = np.lib.stride_tricks.as_strided(np.append(body, np.zeros(8, np.uint8)), (len(body), 8), (1, 1)).copy().view(np.uint64).ravel() if len(body) * 8 <= memory else None
    left = np.arange(len(a))
    for k in range(0, size, 8):
        if wide is not None and k + 8 <= size:
            left = left[wide[a[left] + k] == wide[b[left] + k]]
        else:
            for j in range(k, min(k + 8, size)):
                left = left[body[a[left] + j] == body[b[left] + j]]
    found = np.zeros(len(text), bool)
    found[a[left]] = True
    found[b[left]] = True
    places = np.flatnonzero(found)
    owner = np.searchsorted(starts, places, side="right") - 1
    return np.split(places - starts[owner], np.searchsorted(owner, np.arange(1, len(strings))))

"""External induced sorting of suffixes with carried common prefixes.

``repeat_chunks`` goes through the suffixes of a byte string in falling order and
says which start with the same ``match`` bytes as the one before:

* Suffixes are S-type or L-type; S* suffixes (an S after an L) are the seeds.
  They are dealt by their first byte into runs on disk; a run that fits in memory
  is put in order by its first ``match`` bytes, a word of eight at a time, and one
  that doesn't is dealt by the next byte, recursively.
* L-type suffixes are induced by scanning buckets of first bytes upwards, then
  S-type ones by scanning downwards.  A priority queue holds a tuple (suffix,
  common prefix with the tuple before it) for each that is still to be scanned.
  What is pushed into a bucket arrives in the order of that bucket, so the queue
  keeps runs for each byte and hands a bucket out block by block; pushes are
  stable partitions by preceding byte.
* The common prefix of two suffixes that follow each other in a bucket is one
  more than the smallest between their sources in the scan; where the L part and
  the S part of a bucket meet it is the shorter run of the bucket's byte.

Common prefixes are cut off at ``match``, the order of longer ones doesn't
matter; this is why the recursion of the seeds ends at that depth.

What is in memory are blocks of tuples and queues up to ``memory`` bytes each.
Queues beyond that write their runs to, and arrays beyond that lie in, unlinked
temporary files; these are the task's own scratch and go with it.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

from .textbytes import stable_order

#: Bytes that a queue, or an array, keeps in memory.
MEMORY = 64 << 20
#: Tuples that are taken from a queue at a time: a sixteenth of the memory, or so many.
LEAST_BLOCK = 1 << 12
_PAD = 64


def room(n: int, dtype: type, memory: int = MEMORY) -> np.ndarray:
    """An array of zeros, in an unlinked temporary file if it is larger than ``memory``."""
    if n * np.dtype(dtype).itemsize <= memory:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, dtype, "w+", shape=n)


class BucketQueue:
    """Runs of (suffix, common prefix) for each first byte, kept on disk beyond a budget."""

    def __init__(self, memory: int, dtype: type) -> None:
        self.memory, self.dtype, self.held = memory, np.dtype(dtype), 0
        self.runs: list[deque] = [deque() for _ in range(256)]
        self.size = [0] * 256
        self.file = None

    def push(self, byte: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.held += at.nbytes + lcp.nbytes
        self.size[byte] += len(at)
        self.runs[byte].append((at, lcp))
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs:
            for k, run in enumerate(runs):
                if len(run) == 2:
                    where = self.file.tell()
                    self.file.write(run[0].tobytes())
                    self.file.write(run[1].tobytes())
                    n = len(run[0])
                    runs[k] = (where, where + n * self.dtype.itemsize, n)
        self.held = 0

    def _load(self, run: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(run) == 2:
            self.held -= run[0].nbytes + run[1].nbytes
            return run
        self.file.seek(run[0])
        at = np.frombuffer(self.file.read(run[2] * self.dtype.itemsize), self.dtype)
        self.file.seek(run[1])
        return at, np.frombuffer(self.file.read(run[2]), np.uint8)

    def pop(self, byte: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first of what is known of a bucket, ``most`` tuples at most."""
        runs, got, n = self.runs[byte], [], 0
        while runs and n < most:
            run = runs.popleft()
            size = len(run[0]) if len(run) == 2 else run[2]
            if n + size > most:  # a part of the run stays
                k = most - n
                if len(run) == 2:
                    runs.appendleft((run[0][k:], run[1][k:]))
                    run = (run[0][:k], run[1][:k])
                else:
                    runs.appendleft((run[0] + k * self.dtype.itemsize, run[1] + k, size - k))
                    run = (run[0], run[1], k)
                size = k
            n += size
            got.append(self._load(run))
        self.size[byte] -= n
        if len(got) == 1:
            return got[0]
        if not got:
            return np.empty(0, self.dtype), np.empty(0, np.uint8)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def pop_last(self, byte: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The run of a bucket that was pushed last."""
        if not self.runs[byte]:
            return None
        at, lcp = self._load(self.runs[byte].pop())
        self.size[byte] -= len(at)
        return at, lcp

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as an integer, the first the most significant."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at].view(">u8").ravel().astype(np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading bytes of words."""
    x = a ^ b
    x &= ~(x >> np.uint64(1))  # so that rounding to a double leaves the highest bit
    _, top = np.frexp(x.astype(np.float64))
    return ((64 - top) >> 3).astype(np.uint8)


def _seed_order(text: np.ndarray, n: int, seeds: np.ndarray, match: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Seeds that share ``depth`` bytes by their first ``match`` bytes, with common prefixes, cut off at match."""
    w = _words(text, np.minimum(seeds.astype(np.int64) + depth, n))
    order = np.argsort(w)
    seeds, w = seeds[order], w[order]
    lcp = np.zeros(len(seeds), np.int64)
    more = _common(w[:-1], w[1:])
    lcp[1:] = depth + more
    tied = np.zeros(len(seeds), bool)
    tied[1:] = more == 8
    while tied.any() and depth + 8 < match:
        depth += 8
        member = tied.copy()
        member[:-1] |= tied[1:]  # the first of each tied group too
        rows = np.flatnonzero(member)
        group = np.cumsum(~tied[rows])
        w = _words(text, np.minimum(seeds[rows].astype(np.int64) + depth, n))
        order = np.argsort(w)
        order = order[stable_order(group[order])]  # groups stay in place
        seeds[rows], w = seeds[rows[order]], w[order]
        more = np.r_[np.uint8(0), _common(w[:-1], w[1:])]
        inside = tied[rows]
        lcp[rows[inside]] = depth + more[inside]
        tied[rows] = inside & (more == 8)
    return seeds, np.minimum(lcp, match).astype(np.uint8)


class _Seeds:
    """The S* suffixes by first byte, in order; all are sorted at once where they fit in a block."""

    def __init__(self, text: np.ndarray, n: int, s_type: np.ndarray, match: int, memory: int, block: int, dtype: type) -> None:
        self.text, self.n, self.match, self.memory, self.block = text, n, match, memory, block
        self.queue, self.whole, before, held, count = BucketQueue(memory, dtype), None, True, [], 0
        for lo in range(0, n, block):
            s = s_type[lo : min(lo + block, n)]
            at = (np.flatnonzero(s & ~np.r_[before, s[:-1]]) + lo).astype(dtype)
            before = bool(s[-1])
            held.append(at)
            count += len(at)
            if count > block:
                for part in held:
                    self._deal(part)
                held = []
        if count <= block and held:
            at, lcp = _seed_order(text, n, np.concatenate(held), match)
            self.whole = at, lcp, np.searchsorted(text[at], np.arange(257))

    def _deal(self, at: np.ndarray) -> None:
        byte = self.text[at]
        order, counts = np.argsort(byte, kind="stable"), np.bincount(byte, minlength=256)
        ends = np.cumsum(counts)
        for c in np.flatnonzero(counts).tolist():
            mine = at[order[ends[c] - counts[c] : ends[c]]]
            self.queue.push(c, mine, np.zeros(len(mine), np.uint8))

    def chunks(self, byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.whole is not None:
            at, lcp, cuts = self.whole
            if cuts[byte] < cuts[byte + 1]:
                yield at[cuts[byte] : cuts[byte + 1]], lcp[cuts[byte] : cuts[byte + 1]]
        elif self.queue.size[byte]:
            yield from _seed_chunks(self.text, self.n, self.queue, byte, self.match, self.memory, self.block)


def _seed_chunks(text: np.ndarray, n: int, queue: BucketQueue, byte: int, match: int, memory: int, block: int, depth: int = 1, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The seeds of a bucket, which share ``depth`` bytes, in order; the first has ``first`` bytes in common with the one before."""
    if queue.size[byte] <= block or depth >= match:
        while len((part := queue.pop(byte, block))[0]):
            at, lcp = _seed_order(text, n, part[0].copy(), match, depth) if depth < match else (part[0], np.full(len(part[0]), match, np.uint8))
            lcp[0] = first
            first = match  # only where all are alike does a bucket come in several parts
            yield at, lcp
        return
    inner = BucketQueue(memory, queue.dtype)
    while len((part := queue.pop(byte, block))[0]):
        after = text[np.minimum(part[0].astype(np.int64) + depth, n)]
        order = np.argsort(after, kind="stable")
        ends = np.cumsum(np.bincount(after, minlength=256))
        for c in np.unique(after).tolist():
            at = part[0][order[ends[c - 1] if c else 0 : ends[c]]]
            inner.push(c, at, np.zeros(len(at), np.uint8))
    for c in range(256):
        if inner.size[c]:
            yield from _seed_chunks(text, n, inner, c, match, memory, block, depth + 1, first)
            first = depth
    inner.close()


class _Scan:
    """Pushes the predecessors of scanned suffixes, with their common prefixes."""

    def __init__(self, text: np.ndarray, types: np.ndarray, wanted: bool, match: int, memory: int, dtype: type) -> None:
        self.text, self.types, self.wanted, self.match = text, types, wanted, match
        self.queue = BucketQueue(memory, dtype)
        self.least = np.zeros(256, np.uint8)  # smallest common prefix scanned since the last push into a bucket

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Scans suffixes in order; lcp[0] is to the one scanned before."""
        m = len(at)
        use = np.flatnonzero((at > 0) & (self.types[at - 1] == self.wanted))
        before = at[use] - 1
        byte = self.text[before]
        order = np.argsort(byte, kind="stable")
        counts = np.bincount(byte, minlength=256)
        targets = np.flatnonzero(counts)
        ends = np.cumsum(counts[targets])
        starts = ends - counts[targets]
        least = np.minimum(self.least, lcp.min())
        if len(use):
            before, k = before[order], use[order]
            # the smallest common prefix scanned since the one before it of the same bucket, and after the last of each
            since = np.r_[0, k[:-1] + 1]
            since[starts] = 0
            more = np.r_[lcp, np.uint8(255)]
            low = np.minimum.reduceat(more, np.stack([since, k + 1], 1).ravel())[::2]
            low[starts] = np.minimum(low[starts], self.least[targets])
            low = np.minimum(low, np.uint8(self.match - 1)) + np.uint8(1)
            last = k[ends - 1] + 1
            least[targets] = np.minimum.reduceat(more, np.stack([last, np.full(len(last), m)], 1).ravel())[::2]
            for c, x, y in zip(targets.tolist(), starts.tolist(), ends.tolist(), strict=True):
                self.queue.push(c, before[x:y], low[x:y])
        self.least = least


def _types(text: np.ndarray, n: int, match: int, memory: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S-type, and the length of the run of its first byte, cut off at match."""
    s_type, run = room(n, bool, memory), room(n, np.uint8, memory)
    after, after_s, after_run = None, False, 0
    for lo in reversed(range(0, n, block)):
        part = np.asarray(text[lo : min(lo + block, n)])
        m = len(part)
        follow = np.r_[part[1:], part[-1] if after is None else after]
        turn = part != follow
        turn[-1] |= after is None
        ends = np.flatnonzero(turn)
        size = np.diff(np.r_[-1, ends])
        known = int(ends[-1]) + 1 if len(ends) else 0
        s_type[lo : lo + known] = np.repeat((part < follow)[ends], size)
        s_type[lo + known : lo + m] = after_s
        run[lo : lo + known] = (np.repeat(ends, size) - np.arange(known) + 1).clip(max=match)
        run[lo + known : lo + m] = (m - np.arange(known, m) + after_run).clip(max=match)
        after, after_s, after_run = part[0], bool(s_type[lo]), int(run[lo])
    return s_type, run


def repeat_chunks(text: np.ndarray, n: int, match: int = 50, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, new) chunks of all positions in falling order of suffix, and whether each differs
    from the one before it within ``match`` bytes.

    ``text``: uint8, n bytes that end in 0 and _PAD zeros more; the byte 0 separates
    strings and doesn't count as content.
    """
    assert match < 255 and n and text[n - 1] == 0 and len(text) >= n + _PAD
    dtype = np.int32 if n < 1 << 31 else np.int64
    block = max(LEAST_BLOCK, memory // 16)
    s_type, run = _types(text, n, match, memory, block)
    seeds = _Seeds(text, n, s_type, match, memory, block, dtype)

    up = _Scan(text, s_type, False, match, memory, dtype)
    up.queue.push(0, np.array([n - 1], dtype), np.zeros(1, np.uint8))
    l_parts = BucketQueue(memory, dtype)
    for c in range(256):
        last = None
        while len((wave := up.queue.pop(c, block))[0]):
            at, lcp = wave
            if last is None:
                lcp = lcp.copy()
                lcp[0] = 0  # to another bucket
            l_parts.push(c, at, lcp)
            up.feed(at, lcp)
            last = at[-1]
        for at, lcp in seeds.chunks(c):
            if last is not None:
                lcp = lcp.copy()
                lcp[0], last = min(run[last], run[at[0]]), None
            up.feed(at, lcp)
    up.queue.close()
    seeds.queue.close()

    down = _Scan(text, s_type, True, match, memory, dtype)
    for c in range(255, -1, -1):
        last = None
        while len((wave := down.queue.pop(c, block))[0]):
            at, lcp = wave
            if last is None:
                lcp = lcp.copy()
                lcp[0] = 0
            yield at, lcp < match
            down.feed(at, lcp)
            last = at[-1]
        meet = None
        while (part := l_parts.pop_last(c)) is not None:
            at = part[0][::-1]
            lcp = np.r_[np.uint8((0 if last is None else min(run[last], run[at[0]])) if meet is None else meet), part[1][:0:-1]]
            meet = part[1][0]
            yield at, lcp < match
            down.feed(at, lcp)
    down.queue.close()
    l_parts.close()


def repeats(data: np.ndarray, match: int = 50, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """``repeat_chunks`` of bytes that end in 0, as whole arrays."""
    parts = list(repeat_chunks(np.r_[data, np.zeros(_PAD, np.uint8)], len(data), match, memory))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

"""External induced suffix sorting with common prefixes.

``sort_suffixes(text, folder)`` yields the suffix array of a disk-backed integer text in blocks, each suffix with the
length (up to ``cap``) of the prefix it shares with the one before.

The text is read through a memory map.  Suffixes are S or L; the leftmost S of each run are sampled (LMS).  LMS
substrings are sorted by induction and named; the string of names is sorted recursively (in memory once it is short
enough), which orders the LMS suffixes.  Two scans then induce the rest: smallest first for L suffixes, largest first
for S.  What a scan has found and not yet reached waits in a priority queue whose key is (first symbol, order of
arrival): ``SymbolQueues`` keeps a first-in first-out list for each symbol, appends whole blocks, and moves them to a
spill file when they exceed its memory.  A queued tuple is (suffix, common prefix with the one queued before it for
the same symbol); that value is one more than the smallest common prefix among the suffixes read in between, which
the scan tracks for each symbol.

Memory is a few blocks, the queues' allowance, and the bound for the recursion's end; the rest is on disk.
"""

from __future__ import annotations

import os

import numpy as np

#: Items a block holds; items the queues keep in memory; names sorted in memory at the recursion's end.
BLOCK = 1 << 17
QUEUED = 1 << 20
IN_MEMORY = 1 << 21


class SymbolQueues:
    """A priority queue of (suffix, common prefix) keyed by (symbol, arrival), on disk beyond ``limit`` items."""

    def __init__(self, path: str, limit: int = QUEUED):
        self.file = open(path, "w+b")
        self.limit, self.held = limit, 0
        self.parts: dict[int, list] = {}  # arrays, or (place, items) in the file

    def push(self, symbols: np.ndarray, items: np.ndarray, common: np.ndarray) -> None:
        """Appends tuples grouped by symbol: ``symbols`` must be sorted, equal ones in order of arrival."""
        if not len(items):
            return
        cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        both = np.stack((items, common.astype(np.int64)))
        for a, b in zip(cuts, np.r_[cuts[1:], len(items)]):
            self.parts.setdefault(int(symbols[a]), []).append(both[:, a:b])
        self.held += len(items)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file.seek(0, os.SEEK_END)
        for chunks in self.parts.values():
            for k, c in enumerate(chunks):
                if c is not None and isinstance(c, np.ndarray):
                    place = self.file.tell()
                    self.file.write(np.ascontiguousarray(c).tobytes())
                    chunks[k] = (place, c.shape[1])
        self.held = 0

    def _load(self, c) -> np.ndarray:
        if isinstance(c, np.ndarray):
            return c
        self.file.seek(c[0])
        return np.frombuffer(self.file.read(16 * c[1]), np.int64).reshape(2, c[1])

    def pop(self, symbol: int):
        """Blocks of a symbol in order of arrival, with those that arrive meanwhile."""
        chunks = self.parts.get(symbol)
        k = 0
        while chunks is not None and k < len(chunks):
            taken, size = [], 0
            while k < len(chunks) and size < BLOCK:
                c = chunks[k]
                if isinstance(c, np.ndarray):
                    self.held -= c.shape[1]
                taken.append(self._load(c))
                size += taken[-1].shape[1]
                chunks[k] = None
                k += 1
            yield taken[0] if len(taken) == 1 else np.concatenate(taken, 1)
        self.parts.pop(symbol, None)

    def peek(self, symbol: int, backwards: bool = False):
        """Blocks of a symbol without taking them out."""
        chunks = self.parts.get(symbol, [])
        order = range(len(chunks) - 1, -1, -1) if backwards else range(len(chunks))
        taken, size = [], 0
        for k in order:
            taken.append(self._load(chunks[k]))
            size += taken[-1].shape[1]
            if size >= BLOCK:
                yield np.concatenate(taken[::-1] if backwards else taken, 1)
                taken, size = [], 0
        if taken:
            yield np.concatenate(taken[::-1] if backwards else taken, 1)

    def close(self) -> None:
        self.file.close()


class _Scan:
    """Order of reading: tracks, for each symbol, the smallest common prefix since its last tuple was queued."""

    def __init__(self, sigma: int, queues: SymbolQueues, cap: int):
        self.since = np.full(sigma, -1, np.int64)  # -1: nothing queued yet
        self.queues, self.cap = queues, cap

    def read(self, common: np.ndarray, targets: np.ndarray, items: np.ndarray) -> None:
        """A block that was read in order: its common prefixes; where each induces a suffix, the symbol, else -1."""
        if not self.cap:
            which = np.flatnonzero(targets >= 0)
            which = which[np.argsort(targets[which], kind="stable")]
            self.queues.push(targets[which], items[which], np.zeros(len(which), np.int64))
            return
        low = int(common.min()) if len(common) else self.cap
        which = np.flatnonzero(targets >= 0)
        if len(which):
            which = which[np.argsort(targets[which], kind="stable")]
            t = targets[which]
            new = np.r_[True, t[1:] != t[:-1]]
            begin = np.where(new, 0, np.r_[0, which[:-1] + 1])
            padded = np.r_[common, self.cap]
            least = np.minimum.reduceat(padded, np.stack((begin, which + 1), 1).ravel())[::2]
            first = self.since[t]
            least = np.where(new, np.minimum(least, first), least)
            got = np.where(new & (first < 0), 0, np.minimum(least + 1, self.cap))
            self.queues.push(t, items[which], got)
            np.minimum(self.since, low, out=self.since, where=self.since >= 0)
            last = np.r_[new[1:], True]
            tails = np.minimum.accumulate(padded[::-1])[::-1]
            self.since[t[last]] = tails[which[last] + 1]
        else:
            np.minimum(self.since, low, out=self.since, where=self.since >= 0)


def _common(text, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a[k] and b[k], up to cap, by comparing the text sixteen symbols at a time."""
    n, wide = len(text), 16
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    step = 0
    if n >= wide:
        view = np.lib.stride_tricks.sliding_window_view(np.asarray(text), wide)
        slow = []
        while len(live) and step < cap:
            x, y = a[live] + step, b[live] + step
            fits = (x <= n - wide) & (y <= n - wide)
            slow.append(live[~fits])
            live, x, y = live[fits], x[fits], y[fits]
            same = view[x] == view[y]
            whole = same.all(1)
            out[live] += np.where(whole, wide, same.argmin(1))
            live = live[whole]
            step += wide
        live = np.concatenate(slow) if slow else live[:0]
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n) & (out[live] < cap)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live = live[ok]
        out[live] += 1
    return np.minimum(out, cap)


def _induce(text, sigma: int, lms_blocks, folder: str, cap: int, present: np.ndarray, tag: str):
    """From LMS suffixes (blocks of (suffix, common) for each symbol) to the queues of all L and all S suffixes."""
    n = len(text)
    left = SymbolQueues(f"{folder}/{tag}-l")
    left_out = SymbolQueues(f"{folder}/{tag}-lo")
    scan = _Scan(sigma, left, cap)
    # the last suffix is L unless it is a lone smallest symbol; it starts its bucket
    last = int(text[n - 1])
    left.push(np.array([last]), np.array([n - 1]), np.array([0]))
    if cap:
        scan.since[last] = cap
        scan.since[last] = 0  # the empty suffix, before all others, shares nothing
    for c in present:
        c = int(c)
        end = -1
        fresh = True
        for items, common in left.pop(c):
            if not len(items):
                continue
            common = common.copy()
            if fresh:
                common[0], fresh = 0, False
            end = int(items[-1])
            left_out.push(np.full(len(items), c), items, common)
            prev = np.where(items > 0, text[items - 1].astype(np.int64), -1)
            scan.read(common, np.where(prev >= c, prev, -1), items - 1)
        for items, common in lms_blocks(c):
            if not len(items):
                continue
            common = common.copy()
            if fresh:
                common[0] = 0
            elif end >= 0 and cap:
                common[0] = _common(text, np.array([end]), items[:1], cap)[0]
            end, fresh = -1, False
            prev = np.where(items > 0, text[items - 1].astype(np.int64), -1)
            scan.read(common, np.where(prev > c, prev, -1), items - 1)
    left.close()
    right = SymbolQueues(f"{folder}/{tag}-s")
    right_out = SymbolQueues(f"{folder}/{tag}-so")
    scan = _Scan(sigma, right, cap)
    for c in present[::-1]:
        c = int(c)
        end, fresh = -1, True
        for items, common in right.pop(c):
            if not len(items):
                continue
            common = common.copy()
            if fresh:
                common[0], fresh = 0, False
            end = int(items[-1])
            right_out.push(np.full(len(items), c), items, common)
            prev = np.where(items > 0, text[items - 1].astype(np.int64), -1)
            scan.read(common, np.where((prev >= 0) & (prev <= c), prev, -1), items - 1)
        carry = None
        for items, common in left_out.peek(c, backwards=True):
            if not len(items):
                continue
            # read backwards: a suffix's value is what it shares with the next larger one
            items, back = items[::-1], common[::-1]
            if carry is None:
                head = 0 if fresh or not cap else int(_common(text, np.array([end]), items[:1], cap)[0])
            else:
                head = carry
            values = np.r_[head, back[:-1]]
            carry, fresh = int(back[-1]), False
            prev = np.where(items > 0, text[items - 1].astype(np.int64), -1)
            scan.read(values, np.where((prev >= 0) & (prev < c), prev, -1), items - 1)
    right.close()
    return left_out, right_out


def _ordered(text, left: SymbolQueues, right: SymbolQueues, present: np.ndarray, cap: int):
    """The suffix array in blocks (suffixes, common prefixes with the one before)."""
    for c in present:
        c = int(c)
        end = -1
        for items, common in left.peek(c):
            if len(items):
                end = int(items[-1])
                yield items, common
        held = None
        for items, common in right.peek(c, backwards=True):
            if not len(items):
                continue
            items, back = items[::-1], common[::-1]
            first = 0 if end < 0 and held is None else held if held is not None else int(_common(text, np.array([end]), items[:1], cap)[0]) if cap else 0
            held = int(back[-1])
            yield items, np.r_[first, back[:-1]]


def _on_disk(path: str, n: int, kind) -> np.ndarray:
    return np.memmap(path, kind, "w+", shape=(max(1, n),))[:n]


def _scan_types(text, folder: str, tag: str):
    """On disk: where suffixes are S, the LMS suffix after each position, and the LMS suffixes in order of place."""
    n = len(text)
    s = _on_disk(f"{folder}/{tag}-types", n, np.bool_)
    after = _on_disk(f"{folder}/{tag}-after", n, np.int64)
    following, kind, nearest = -1, False, n  # symbol and type of the suffix on the right, LMS suffix on the right
    for b in range(n, 0, -BLOCK):
        a = max(0, b - BLOCK)
        t = np.r_[np.asarray(text[a:b]).astype(np.int64), following]
        change = t[:-1] != t[1:]
        own = np.where(change, t[:-1] < t[1:], kind)
        # equal neighbours take the type of the next change on the right
        at = np.where(change, np.arange(b - a), b - a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        block = np.where(at < b - a, own[np.minimum(at, b - a - 1)], kind)
        if b == n:
            block[-1] = False
            last = np.flatnonzero(change[:-1])
            block[(last[-1] + 1 if len(last) else 0) :] = False
        s[a:b] = block
        before = int(text[a - 1]) if a else -1
        # LMS: S with an L suffix on its left; the left neighbour of the block's first suffix is L if its symbol is larger
        left = np.r_[(before > t[0]) if a else False, ~block[:-1]]
        lms = block & left
        where = np.where(lms, np.arange(a, b), n)
        right = np.minimum.accumulate(where[::-1])[::-1]
        right[right == n] = nearest
        after[a:b] = np.r_[right[1:], nearest]
        nearest = int(right[0])
        following, kind = int(t[0]), bool(block[0])
    with open(f"{folder}/{tag}-lms", "wb") as out:
        for a in range(0, n, BLOCK):
            block = s[a : a + BLOCK]
            out.write((np.flatnonzero(block & ~np.r_[bool(s[a - 1]) if a else True, block[:-1]]) + a).astype(np.int64).tobytes())
    size = os.path.getsize(f"{folder}/{tag}-lms") // 8
    lms = np.memmap(f"{folder}/{tag}-lms", np.int64, "r", shape=(size,)) if size else np.zeros(0, np.int64)
    return s, after, lms


def _queue_lms(text, items, commons, path: str) -> SymbolQueues:
    """LMS suffixes (in any order that keeps a symbol's own order) as queues by first symbol."""
    queues = SymbolQueues(path)
    for a in range(0, len(items), BLOCK):
        i = np.asarray(items[a : a + BLOCK])
        first = np.asarray(text[i]).astype(np.int64)
        order = np.argsort(first, kind="stable")
        queues.push(first[order], i[order], np.zeros(len(i), np.int64) if commons is None else np.asarray(commons[a : a + BLOCK])[order])
    return queues


def _in_memory(names: np.ndarray) -> np.ndarray:
    """Suffix array of a short string of names, by doubling."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = rank * (n + 2)
        key[:-step or None] += rank[step:] if step < n else 0
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[True, k[1:] != k[:-1]])
        rank = new
        if rank[order[-1]] == n or step >= n:
            return order
        step *= 2


def _sorted_lms(text, sigma: int, folder: str, present: np.ndarray, depth: int, in_memory: int) -> np.ndarray:
    """LMS suffixes in order, on disk."""
    tag = f"n{depth}"
    s, after, lms = _scan_types(text, folder, tag)
    if len(lms) < 2:
        return lms
    seeds = _queue_lms(text, lms, None, f"{folder}/{tag}-seeds")
    left, right = _induce(text, sigma, seeds.peek, folder, 0, present, tag)
    seeds.close()
    name = _on_disk(f"{folder}/{tag}-name", len(text), np.int32)
    count, last = 0, None
    with open(f"{folder}/{tag}-order", "wb") as out:
        for items, _ in _ordered(text, left, right, present, 0):
            items = items[s[items] & (items > 0) & ~s[items - 1]]
            if not len(items):
                continue
            chain = items if last is None else np.r_[last, items]
            length = after[chain] - chain + 1
            same = length[1:] == length[:-1]
            which = np.flatnonzero(same)
            if len(which):
                same[which] = _common(text, chain[which], chain[which + 1], int(length[which].max())) >= length[which]
            new = np.cumsum(~same) + count
            name[items] = new if last is not None else np.r_[0, new]
            count, last = int(name[items[-1]]), items[-1]
            out.write(items.astype(np.int64).tobytes())
    left.close(), right.close()
    order = np.memmap(f"{folder}/{tag}-order", np.int64, "r")
    if count + 1 == len(lms):
        return order
    if len(lms) <= in_memory:
        return lms[_in_memory(name[lms])]
    path = f"{folder}/names-{depth}"
    with open(path, "wb") as out:
        for a in range(0, len(lms), BLOCK):
            out.write(name[lms[a : a + BLOCK]].tobytes())
    with open(f"{folder}/{tag}-sorted", "wb") as out:
        for items, _ in sort_suffixes(np.memmap(path, np.int32, "r"), folder, 0, depth + 1, in_memory):
            out.write(np.asarray(lms[items]).tobytes())
    os.remove(path)
    return np.memmap(f"{folder}/{tag}-sorted", np.int64, "r")


def sort_suffixes(text, folder: str, cap: int, depth: int = 0, in_memory: int = IN_MEMORY):
    """Blocks (suffixes, common prefix with the one before, up to cap) of the suffix array of an integer text."""
    n = len(text)
    if n == 0:
        return
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    present = np.unique(text)
    sigma = int(present[-1]) + 1
    lms = _sorted_lms(text, sigma, folder, present, depth, in_memory)
    commons = None
    if cap and len(lms) > 1:
        commons = _on_disk(f"{folder}/f{depth}-common", len(lms), np.int64)
        for a in range(0, len(lms), BLOCK):
            block = np.asarray(lms[max(0, a - 1) : a + BLOCK])
            commons[max(1, a) : a + BLOCK] = _common(text, block[:-1], block[1:], cap)
    seeds = _queue_lms(text, lms, commons, f"{folder}/f{depth}-seeds")
    left, right = _induce(text, sigma, seeds.peek, folder, cap, present, f"f{depth}")
    seeds.close()
    yield from _ordered(text, left, right, present, cap)
    left.close(), right.close()
    for f in os.listdir(folder):
        if f.split("-")[0] in (f"n{depth}", f"f{depth}"):  # mapped files stay readable until they are let go
            os.remove(f"{folder}/{f}")

"""N-gram Jaccard join by a prefix tree over globally ordered sets.

Every document is the set of its hashed word n-grams. The n-grams have one
order over the whole corpus, by how many distinct sets have them (counts from HOT on are one), then by hash. They are counted
exactly: all of them travel once, packed, by ranges, and those that several sets have go
back to their sets. What a set has alone comes first in its order and meets nothing, so it needs no place in a trie. Two
sets that are similar enough share one of their first n-grams: of n, those up to n - ceil(n * PERCENT / 100) + 1; a set that
shares less than PERCENT of its own has no link.

Sets that such shared beginnings connect, directly or through others, form a
cluster, and all links lie within clusters. A set travels to its cluster's task once. There the
sets are stored in a trie, and each set walks it: an edge's overlap with the set is
counted once for all sets below, and a subtree is left as soon as what remains
of the set, or of the longest set below, can't make up the overlap that the shortest set below
asks for. As links join documents to classes, a subtree whose sets are in the walker's class
already is left too; the sets that have most in common with their cluster walk first, so that
large groups of near copies are joined by few walks. Walks go level by
level, many at a time, in numpy.

Documents with equal sets are one node from the start. A cluster with more n-grams
than LIMIT is done in turns: the trie of a bounded part of it (of those not in its largest class)
goes to several tasks, each of which walks a part of its sets through it. Those in the trie are then
finished, and the others go on while their cluster has several classes. Nothing is capped or dropped.

Defined cases: a null or empty text, or one of white space, has no n-grams and
is linked with nothing; fewer words than an n-gram are one n-gram; rows with a null
id are linked with nothing; rows that share an id are one node, whose texts all
count; repeated rows get one answer each; an empty table gives an empty
result; extra columns play no part. A worker holds some 80 bytes for each n-gram of the
longest two texts of a cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, scratch, ship, spread_join
from corpusloom.llm.hashing import U, byte_runs, mix, shingle_sets
from corpusloom.llm.near_dedup import components

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
SEEDS = (0x1234567, 0xABCDEF987)
#: Bits of hashes that n-grams are told apart by.
TOKEN_BITS = 56
#: Counts up to which n-grams are ordered; so many sets of a chunk with one n-gram make it a hot one.
HOT = 64
#: N-grams that a task deals out at a time, and of a range, about.
CHUNK, RANGE = 2 << 20, 2 << 20
#: N-grams of a cluster that one task joins at a time.
LIMIT = 1 << 21
#: Nodes whose ids are broadcast to pick texts; more of them are joined by a shuffle.
MAX_BROADCAST = 500_000
#: Tokens of a trie's edge, walks that are held and bytes of their marks.
SEGMENT, FRONTIER, MARKS = 32, 1 << 20, 1 << 24


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    raw = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
    for a, b in byte_runs([len(x) + 1 for x in raw]):
        yield a, raw[a:b]


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, n and two hashes of each set."""
    for batch in batches:
        for a, texts in _texts(batch):
            sets = list(shingle_sets(texts, SHINGLE))
            hashes = [np.array([_set_hash(s, seed) for s in sets], dtype=U).view(np.int64) for seed in SEEDS]
            yield pa.record_batch([batch.column(0).slice(a, len(texts)), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, hashes)], names=["doc", "n", "s1", "s2"])


def _set_hash(s: np.ndarray, seed: int) -> int:
    return int(mix(s ^ U(seed)).sum(dtype=U)) if len(s) else 0


#: Rows between the steps that count n-grams: a place (a range of n-grams, or a bucket of sets), a kind, and packed arrays.
_PACKED = "place int, kind int, x binary, y binary, z binary"
_ENTRY, _HOT, _COUNT, _SIZE = range(4)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    place, kind, *data = zip(*rows, strict=True)
    return pa.record_batch([pa.array(place, pa.int32()), pa.array(kind, pa.int32()), *[pa.array(c, pa.binary()) for c in data]], names=["place", "kind", "x", "y", "z"])


def _bytes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of numbers, all first bytes, then all second ones: equal ones lie together for compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def _deal(ranges: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The n-grams of sets (num, s1, text), each with its set's number, by ranges of n-grams.

    An n-gram that HOT sets of one chunk have isn't sent to its range set by set: its entries go to any range, as
    ones whose count is HOT, and their number to its own.
    """
    bits = ranges.bit_length() - 1

    def rows_of(tokens: np.ndarray, nums: np.ndarray, salt: int) -> Iterator[tuple]:
        by = np.argsort(tokens, kind="stable")
        tokens, nums = tokens[by], nums[by]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        times = np.diff(np.append(first, len(tokens)))
        hot = np.repeat(times >= HOT, times)
        if hot.any():
            yield salt % ranges, _HOT, _bytes(tokens[hot], 7), _bytes(nums[hot], 5), b""
            known, many = tokens[first[times >= HOT]], times[times >= HOT]
            for place in np.unique(known >> U(TOKEN_BITS - bits)).tolist():
                own = known >> U(TOKEN_BITS - bits) == U(place)
                yield place, _COUNT, _bytes(known[own], 7), _bytes(many[own], 5), b""
            tokens, nums = tokens[~hot], nums[~hot]
        ends = np.searchsorted(tokens >> U(TOKEN_BITS - bits), np.arange(ranges + 1, dtype=U))
        for place in np.flatnonzero(np.diff(ends)).tolist():
            a, b = ends[place], ends[place + 1]
            yield place, _ENTRY, _bytes(tokens[a:b], 6), _bytes(nums[a:b], 5), b""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, nums, size, chunks = [], [], 0, 0
        for batch in batches:
            raw = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            for a, b in byte_runs([len(x) + 1 for x in raw]):
                for num, s1, s in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), shingle_sets(raw[a:b], SHINGLE), strict=True):
                    if len(s) and np.array(_set_hash(s, SEEDS[0]), dtype=U).view(np.int64) == s1:  # another text of the id isn't this set
                        sets.append(s >> U(64 - TOKEN_BITS))
                        nums.append(num)
                        size += len(s)
                if size >= CHUNK:
                    yield _packed(list(rows_of(np.concatenate(sets), np.repeat(np.array(nums), [len(s) for s in sets]), nums[0] + chunks)))
                    sets, nums, size, chunks = [], [], 0, chunks + 1
        if sets:
            yield _packed(list(rows_of(np.concatenate(sets), np.repeat(np.array(nums), [len(s) for s in sets]), nums[0] + chunks)))

    return run


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (kind, x, y, z) of each place; rows come in order of places."""
    last, held = None, []
    for batch in batches:
        for place, *row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if place != last and held:
                yield last, held
                held = []
            last = place
            held.append(row)
    if held:
        yield last, held


def _shared(ranges: int, buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each range the n-grams that several sets have, with their counts up to HOT in front, by buckets of sets."""
    bits = ranges.bit_length() - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, rows in _places(batches):
            top = U(place >> (bits - 8)) << U(48)
            none = np.zeros(0, dtype=U)
            of = lambda kind, k, width: np.concatenate([none, *[_numbers(r[k], width) for r in rows if r[0] == kind]])  # noqa: B023, E731
            tokens, nums = of(_ENTRY, 1, 6) | top, of(_ENTRY, 2, 5)
            by = np.argsort(tokens, kind="stable")
            tokens, nums = tokens[by], nums[by]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(first, len(tokens)))
            known = of(_COUNT, 1, 7)  # of these n-grams a chunk alone has HOT
            level = np.where(np.isin(tokens[first], known), HOT, np.minimum(times, HOT))
            level = np.repeat(level, times)
            keep = level > 1
            tokens = np.concatenate([tokens[keep] | (level[keep].astype(U) << U(TOKEN_BITS)), of(_HOT, 1, 7) | U(HOT << TOKEN_BITS)])
            nums = np.concatenate([nums[keep], of(_HOT, 2, 5)])
            by = np.lexsort((nums, nums % U(buckets)))
            tokens, nums = tokens[by], nums[by]
            ends = np.searchsorted(nums % U(buckets), np.arange(buckets + 1, dtype=U))
            out = [(bucket, _ENTRY, _bytes(tokens[a:b], 8), _bytes(nums[a:b], 5), b"") for bucket, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            if out:
                yield _packed(out)

    return run


def _sizes(buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sizes of sets (num, n), by buckets of sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num, n = (batch.column(c).to_numpy() for c in range(2))
            if len(num):
                yield _packed([(b, _SIZE, _bytes(num[num % buckets == b], 5), _bytes(n[num % buckets == b], 5), b"") for b in np.unique(num % buckets).tolist()])

    return run


def _able(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node (its number), n and items, in order, of sets that share enough of their n-grams with others to have a link."""
    for _, rows in _places(batches):
        none = np.zeros(0, dtype=U)
        of = lambda kind, k, width: np.concatenate([none, *[_numbers(r[k], width) for r in rows if r[0] == kind]])  # noqa: B023, E731
        items, nums = of(_ENTRY, 1, 8), of(_ENTRY, 2, 5)
        sized, n = of(_SIZE, 1, 5), of(_SIZE, 2, 5)
        by = np.argsort(sized)
        sized, n = sized[by], n[by].astype(np.int64)
        by = np.lexsort((items, nums))
        items, nums = items[by], nums[by]
        own, first, k = np.unique(nums, return_index=True, return_counts=True)
        n = n[np.searchsorted(sized, own)]
        able = np.flatnonzero(k * 100 >= n * PERCENT)
        for at in range(0, len(able), 1000):
            some = able[at : at + 1000]
            yield pa.record_batch([pa.array(own[some].astype(np.int64)), pa.array(n[some]), pa.array([items[first[i] : first[i] + k[i]].tobytes() for i in some], pa.binary())], names=["node", "n", "items"])


def beginning(n: int, k: int) -> int:
    """How many of a set's k shared n-grams are among its first n-grams, of which similar sets share one; its own n-grams come before them."""
    return max(0, n - (n * PERCENT + 99) // 100 + 1 - (n - k))


def _beginnings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(2)]
        items = [x[: beginning(n, len(x))] for n, x in zip(batch.column(1).to_pylist(), items, strict=True)]
        node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in items])
        yield pa.record_batch([pa.array(np.concatenate([*items, np.zeros(0, dtype=np.int64)])), pa.array(node)], names=["token", "node"])


def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least intersection of sets of n and m that makes a link."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


class Trie:
    """Sets of dense tokens, stored by shared beginnings, with bounds for each subtree.

    Sets of different groups have no tokens in common and lie below different edges.
    An edge has at most SEGMENT tokens. Leaves are in order, so that an edge's are a range.
    """

    def __init__(self, sets: list[np.ndarray], n: np.ndarray, groups: np.ndarray, n_groups: int):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=lambda i: (groups[i], keys[i])), dtype=np.int64)
        self.tokens = np.concatenate([*sets, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        first, length, upto, low, parent = [], [], [], [], []
        high: dict[int, int] = {}
        path: list[int] = []  # edges from the top to the last leaf
        ends_at = np.full(len(sets), -1, dtype=np.int64)
        last = last_group = None
        for leaf, i in enumerate(self.order.tolist()):
            s = sets[i]
            same = 0
            if last is not None and groups[i] == last_group:
                m = min(len(s), len(last))
                differ = np.flatnonzero(s[:m] != last[:m])
                same = int(differ[0]) if len(differ) else m
            while path and upto[path[-1]] > same and upto[path[-1]] - length[path[-1]] >= same:
                high[path.pop()] = leaf
            if path and upto[path[-1]] > same:  # an edge that only its first part is shared of: divided
                e = path.pop()
                keep = same - (upto[e] - length[e])
                top = len(first)
                first.append(first[e]), length.append(keep), upto.append(same), low.append(low[e]), parent.append(parent[e])
                first[e], length[e], parent[e] = first[e] + keep, length[e] - keep, top
                high[e] = leaf
                path.append(top)
            at = same
            while at < len(s):
                step = min(SEGMENT, len(s) - at)
                first.append(begin[i] + at), length.append(step), upto.append(at + step), low.append(leaf), parent.append(path[-1] if path else -1 - int(groups[i]))
                path.append(len(first) - 1)
                at += step
            ends_at[leaf] = path[-1]
            last, last_group = s, groups[i]
            if leaf + 1 < len(sets) and groups[self.order[leaf + 1]] != last_group:
                high.update((e, leaf + 1) for e in path)
                path = []
        high.update((e, len(sets)) for e in path)
        self.first, self.length, self.upto, self.low = (np.array(x, dtype=np.int64) for x in (first, length, upto, low))
        self.high = np.array([high[e] for e in range(len(first))], dtype=np.int64)
        self.ends = np.bincount(ends_at[ends_at >= 0], minlength=len(first))  # leaves that end with an edge; they come first among its leaves
        parent = np.array(parent, dtype=np.int64)
        by = np.argsort(parent, kind="stable")
        self.children, owner = by, parent[by]
        self.child_from, self.child_to = np.searchsorted(owner, np.arange(len(first))), np.searchsorted(owner, np.arange(len(first)), side="right")
        g = -1 - np.arange(n_groups)
        self.top_from, self.top_to = np.searchsorted(owner, g), np.searchsorted(owner, g, side="right")
        n, k = n[self.order], np.array([len(sets[i]) for i in self.order], dtype=np.int64)
        if len(first):
            ranges = np.stack([self.low, self.high], axis=1).reshape(-1)
            pad = lambda x, fill: np.append(x, fill)
            self.least_n = np.minimum.reduceat(pad(n, np.iinfo(np.int64).max), ranges)[::2]
            self.most_n = np.maximum.reduceat(pad(n, 0), ranges)[::2]
            self.most_k = np.maximum.reduceat(pad(k, 0), ranges)[::2]
        self.n = n


def _spans(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class _Classes:
    """Union-find over positions; ``of`` gives all labels."""

    def __init__(self, labels: np.ndarray):
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[back].tolist()

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def of(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], dtype=np.int64)


def join_groups(items: list[np.ndarray], n: np.ndarray, labels: np.ndarray, pivots: np.ndarray, groups: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) that join the classes of sets, between pivots and all sets of their group.

    ``items`` are those of a set's n n-grams that other sets have too. Of links between sets that others connect
    already, none is given. Groups are numbers from 0, in order.
    """
    size = np.array([len(x) for x in items], dtype=np.int64)
    flat, owner = np.concatenate(items), np.repeat(np.arange(len(items)), size)
    of_group = groups[owner]
    # dense tokens: by group, how many of its sets have them, then their order; those of one set alone meet nothing
    by = np.lexsort((flat, of_group))
    new = np.concatenate([[True], (flat[by][1:] != flat[by][:-1]) | (of_group[by][1:] != of_group[by][:-1])])
    number = np.cumsum(new) - 1
    found = np.bincount(number)
    rank = np.empty(len(found), dtype=np.int64)
    rank[np.lexsort((np.arange(len(found)), found, of_group[by][new]))] = np.arange(len(found))
    dense, times = np.empty(len(flat), dtype=np.int64), np.empty(len(flat), dtype=np.int64)
    dense[by], times[by] = rank[number], found[number]
    shared = times > 1
    k = np.bincount(owner[shared], minlength=len(items))
    able = (k > 0) & (k * 100 >= n * PERCENT)
    keep = shared & able[owner]
    centrality = np.bincount(owner, weights=times, minlength=len(items)) / np.maximum(n, 1)
    owner, dense = owner[keep], dense[keep]
    by = np.lexsort((dense, owner))
    owner, dense = owner[by], dense[by]
    k = np.where(able, k, 0)
    begin = np.concatenate([[0], np.cumsum(k)])
    chosen = np.flatnonzero(pivots & able)
    trie = Trie([dense[begin[i] : begin[i + 1]] for i in chosen], n[chosen], groups[chosen], int(groups.max()) + 1)
    leaves = chosen[trie.order]
    walk = _Walk(trie, leaves, n, k, begin, dense, groups)
    classes, links = _Classes(labels), []
    # who has most in common with the group walks first; 1, 2, 4 ... of each group at a time
    order = np.lexsort((-centrality, groups))
    order = order[able[order]]
    place = _spans(np.bincount(groups[order], minlength=int(groups.max()) + 1))
    turn = np.floor(np.log2(place + 1)).astype(np.int64)
    for t in range(int(turn.max(initial=-1)) + 1):
        known = classes.of()
        walk.relabel(known)
        for x, y in walk.links(order[turn == t], known):
            if classes.join(x, y):
                links.append((x, y))
    return links


class _Walk:
    def __init__(self, trie: Trie, leaves: np.ndarray, n: np.ndarray, k: np.ndarray, begin: np.ndarray, dense: np.ndarray, groups: np.ndarray):
        self.trie, self.leaves, self.n, self.k, self.begin, self.dense, self.groups = trie, leaves, n, k, begin, dense, groups
        # the range of each group's tokens, for marks
        of = groups[np.repeat(np.arange(len(k)), k)] if len(dense) else np.zeros(0, dtype=np.int64)
        count = int(groups.max(initial=0)) + 1
        self.least, most = np.full(count, np.iinfo(np.int64).max), np.full(count, -1)
        np.minimum.at(self.least, of, dense)
        np.maximum.at(most, of, dense)
        self.width = np.maximum(most - self.least + 1, 0)
        self.least = np.where(self.width > 0, self.least, 0)

    def relabel(self, known: np.ndarray) -> None:
        self.label = known[self.leaves]
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(0, dtype=np.int64)

    def _one_class(self, edge: np.ndarray, label: np.ndarray) -> np.ndarray:
        low, high = self.trie.low[edge], self.trie.high[edge]
        return (self.label[low] == label) & (self.changes[low] == self.changes[high - 1])

    def links(self, walkers: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of the walkers with leaves of other classes."""
        walkers = walkers[self.trie.top_to[self.groups[walkers]] > self.trie.top_from[self.groups[walkers]]]
        cost = self.width[self.groups[walkers]]
        for a, b in byte_runs(cost.tolist(), MARKS):
            yield from self._some(walkers[a:b], known)

    def _some(self, who: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int]]:
        t, g = self.trie, self.groups[who]
        ends = np.cumsum(self.width[g])
        base = ends - self.width[g] - self.least[g]  # where a walker's marks begin, less its group's first token
        marks = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=bool)
        size = self.k[who]
        own = np.repeat(self.begin[who], size) + _spans(size)
        marks[np.repeat(base, size) + self.dense[own]] = True
        held = np.cumsum(marks, dtype=np.int32)
        before = np.concatenate([[0], np.cumsum(size)])[:-1]
        n, k, label = self.n[who], size, known[who]
        tops = t.top_to[g] - t.top_from[g]
        stack = [(np.repeat(np.arange(len(who)), tops), t.children[np.repeat(t.top_from[g], tops) + _spans(tops)], np.zeros(int(tops.sum()), dtype=np.int64))]
        while stack:
            w, e, o = stack.pop()
            if len(w) > FRONTIER // SEGMENT:
                half = FRONTIER // SEGMENT
                stack.append((w[half:], e[half:], o[half:]))
                w, e, o = w[:half], e[:half], o[:half]
            fits = (t.most_n[e] * 100 >= n[w] * PERCENT) & (t.least_n[e] * PERCENT <= n[w] * 100) & ~self._one_class(e, label[w])
            w, e, o = w[fits], e[fits], o[fits]
            if not len(w):
                continue
            length = t.length[e]
            at = np.repeat(base[w], length) + t.tokens[np.repeat(t.first[e], length) + _spans(length)]
            sums = np.concatenate([[0], np.cumsum(marks[at], dtype=np.int64)])
            ends = np.cumsum(length)
            o = o + sums[ends] - sums[ends - length]
            passed = held[at[ends - 1]] - before[w]  # tokens of the walker up to the edge's last
            least = np.maximum(t.least_n[e], (n[w] * PERCENT + 99) // 100)
            able = o + np.minimum(t.most_k[e] - t.upto[e], k[w] - passed) >= need(n[w], least)
            w, e, o = w[able], e[able], o[able]
            done = t.ends[e]
            if done.any():
                leaf = np.repeat(t.low[e], done) + _spans(done)
                x, both = np.repeat(w, done), np.repeat(o, done)
                hit = (both >= need(n[x], t.n[leaf])) & (self.label[leaf] != label[x])
                yield from zip(who[x[hit]].tolist(), self.leaves[leaf[hit]].tolist(), strict=True)
            more = t.child_to[e] - t.child_from[e]
            stack.append((np.repeat(w, more), t.children[np.repeat(t.child_from[e], more) + _spans(more)], np.repeat(o, more)))


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of rows cluster, part, node, label, pivot, n, items, which come in order of cluster and part."""

    def answer(held: list[tuple]) -> pa.RecordBatch:
        groups = np.cumsum([0, *(x[:2] != y[:2] for x, y in zip(held, held[1:], strict=False))])
        _, _, node, label, pivot, n, items = zip(*held, strict=True)
        links = join_groups([np.frombuffer(x, dtype=U) for x in items], np.array(n), np.array(label), np.array(pivot), groups)
        pairs = np.array([(node[i], node[j]) for i, j in links], dtype=np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if size > LIMIT // 2 and held[-1][:2] != row[:2]:
                yield answer(held)
                held, size = [], 0
            held.append(row)
            size += len(row[6]) // 8
    if held:
        yield answer(held)


def _clusters(rows: DataFrame) -> DataFrame:
    """node, cluster of the nodes whose beginnings (token, node) meet others'."""
    met = rows.groupBy("token").agg(F.min("node").alias("centre"), F.count("*").alias("rows")).filter("rows > 1")
    kept = spread_join(rows, cut(met, "tokens"), ["token"], "rows")
    return components(kept.filter("centre != node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()).withColumnRenamed("label", "cluster")


def shared_sets(texts: DataFrame, nodes: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """node (a number), n, items of the sets (num, node, s1, n) that share most of their n-grams with others.

    All n-grams of distinct sets travel once, packed, to be counted, and those that several sets have go back to their
    sets. The row count of the first is that of chunks times ranges, which both grow with the input.
    """
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = 1 << max(8, (total // RANGE).bit_length())
    buckets = ranges // 4
    on = nodes.select("node", "num", "s1")
    few = on.limit(max_broadcast + 1).count() <= max_broadcast
    picked = texts.join(F.broadcast(on) if few else on, "node").select("num", "s1", "text")
    dealt = picked.mapInArrow(_deal(ranges), _PACKED)
    told = _in_order(dealt).mapInArrow(_shared(ranges, buckets), _PACKED)
    sizes = nodes.select("num", "n").mapInArrow(_sizes(buckets), _PACKED)
    return cut(_in_order(told.unionByName(sizes)).mapInArrow(_able, "node long, n long, items binary"), "sets")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("place").sortWithinPartitions("place")


def _placed(members: DataFrame, limit: int, turn: int) -> DataFrame:
    """Members (node, cluster, label, n) with pivot and parts: whole clusters in part 0, of large ones a part of the pivots' trie each."""
    by_label = members.groupBy("cluster", "label").agg(F.sum("n").alias("k"))
    sizes = by_label.groupBy("cluster").agg(F.sum("k").alias("total"), F.max_by("label", F.struct("k", "label")).alias("main"), (F.sum("k") - F.max("k")).alias("others"), F.count("*").alias("labels"))
    large = sizes.filter(F.col("total") > limit)
    joined = members.join(F.broadcast(large) if large.count() <= MAX_BROADCAST else large, "cluster", "left")
    one_class = F.col("labels") == 1
    chosen = (F.col("label") != F.col("main")) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("others") / limit)) == 0)
    pivot = F.col("total").isNull() | (chosen & ~one_class)
    parts = F.ceil(F.col("total") / limit).cast("int")
    salt = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    part = F.when(F.col("total").isNull(), F.array(F.lit(0))).when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(salt))
    return joined.select("node", "cluster", "label", pivot.alias("pivot"), part.alias("parts"))


def links(sets: DataFrame, limit: int = LIMIT, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """a, b: links between sets (node, n, items) that join all classes."""
    clusters = cut(_clusters(cut(sets.mapInArrow(_beginnings, "token long, node long"), "beginnings")), "clusters")
    sizes = sets.select("node", F.length("items").alias("n"))
    found: list[DataFrame] = []
    members, turn = clusters.join(sizes, "node").withColumn("label", F.col("node")), 0
    while True:
        placed = cut(_placed(members, limit, turn), "placed")
        few = placed.limit(max_broadcast + 1).count() <= max_broadcast
        sent = sets.join(F.broadcast(placed) if few else placed, "node").withColumn("part", F.explode("parts")).select("cluster", "part", "node", "label", "pivot", "n", "items")
        found.append(cut(sent.repartition("cluster", "part").sortWithinPartitions("cluster", "part").mapInArrow(_join, "a long, b long"), "links"))
        waiting = placed.filter("not pivot").select("node", "cluster")
        every = reduce(DataFrame.unionByName, found)
        if waiting.isEmpty():
            return every
        labels = components(every).select("node", "label")
        left = waiting.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = left.groupBy("cluster").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high").select("cluster")
        members, turn = cut(left.join(mixed, "cluster", "left_semi").join(sizes, "node"), "left"), turn + 1
        if members.isEmpty():
            return every


def _numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with num, from 0 without gaps: places in the files' partitions, after those of the partitions before."""
    rows = cut(nodes.withColumn("_id", F.monotonically_increasing_id()), "nodes")
    slot = F.shiftright("_id", 33)
    counts = rows.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn("_slot", slot).join(F.broadcast(counts.withColumn("_before", before)), "_slot")
    return cut(numbered.withColumn("num", F.col("_before") + F.col("_id") - F.shiftleft("_slot", 33)).drop("_id", "_slot", "_n", "_before"), "numbered")


def groups(docs: DataFrame, text: str = "text", doc: str = "doc_id", max_broadcast: int = MAX_BROADCAST, limit: int = LIMIT) -> DataFrame:
    """doc, n_shingles, component_id of every row: the smallest id that links lead to.

    Ids are integers. Results don't depend on ``max_broadcast`` and ``limit``.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(doc).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_sign, "doc long, n long, s1 long, s2 long"), "signed")
    full = signed.filter("n > 0 and doc is not null")
    nodes = _numbered(full.groupBy("s1", "s2").agg(F.min("doc").alias("node"), F.min("n").alias("n"), F.count("*").alias("rows")))
    with scratch(spark):
        by_number = links(shared_sets(texts, nodes, max_broadcast), limit, max_broadcast)
        name = lambda c: nodes.select(F.col("num").alias(f"{c}_"), F.col("node").alias(c))
        found = by_number.select(F.col("a").alias("a_"), F.col("b").alias("b_")).join(name("a"), "a_").join(name("b"), "b_").select("a", "b")
        same_id = _of_sets(full, nodes.select("s1", "s2", "node", "rows")).select(F.col("doc").alias("a"), F.col("node").alias("b")).filter("a != b")
        repeated = full.groupBy("doc").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).filter("x != y").select(F.col("doc").alias("a"))
        extra = same_id.join(repeated, "a", "left_semi")  # an id with several texts joins their nodes
        labels = cut(components(found.unionByName(extra)), "labels", inner=False)
    named = cut(nodes.select("s1", "s2", "node", "rows").join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("component"), "rows"), "components")
    known = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component")).otherwise(F.col("doc"))
    return _of_sets(signed, named).select("doc", F.col("n").alias("n_shingles"), known.alias("component_id"))


def _of_sets(signed: DataFrame, told: DataFrame) -> DataFrame:
    """Rows with what is told of their set (by s1, s2; rows counts those that have it)."""
    s1 = F.when(F.col("n") > 0, F.col("s1")).otherwise(F.xxhash64("doc")).alias("s1")
    return spread_join(signed.select("doc", "n", s1, "s2"), told, ["s1", "s2"], "rows", "left").drop("rows")

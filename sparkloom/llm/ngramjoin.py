"""N-gram Jaccard join: signature trees over the classes that share a key, then over blocks of candidate groups.

A document's set is that of its word shingles. Equal sets are one class, named by a hash, and only classes travel. Candidates come first, exactly: two sets of
Jaccard similarity p % or more, the smaller of a tokens, differ in at most d = floor(a (100 - p) / p) tokens; so if tokens are dealt
over d + 1 parts by hash, one part at least is the same in both. Sizes are put into ranges, each with the parts that its largest
size needs; a set gives keys for its own range and for those below that may hold a partner. More parts, as many as are likely to be empty, stand in for empty parts,
which give no keys (sets with more empty parts than that give keys for those too), so that sets don't meet by holding nothing.

The classes of each shared key go through a signature tree of their bitmaps, of which the nodes hold the OR and AND of token bitmaps and
the sizes' range; a dual traversal goes only where the greatest possible overlap suffices and the components aren't one
already. Those that may link are tied, and what ties connect is a candidate group.

Within a group, classes are dealt into blocks of bounded size, and the trees of blocks are traversed in the same way, but the pairs
that are left are compared exactly. What links connect is given by the least member, and never as all pairs of a group. Groups of
several blocks take four steps: each block with itself; all blocks with the group's leaders, the classes that joined most others and the
least one; the components that this gives, by their representatives; and last those classes outside their group's largest
component with every block.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UNBLANK, blocks, gram_hashes, joined_skewed, mapped, mix64, settled, text_bytes, word_hashes
from .forest import BLOCKS, CHUNK, Edges, batch, buckets_for, by_bucket, components, connected, cut, spread, squeeze, stars

GROWTH = 1.33
#: Classes in a block; children of a tree's node.
BLOCK, FANOUT = 800, 16
#: Leaders of a group.
LEADERS = 16
HASHES = "doc_id long, n long, h1 long, h2 long, bits binary"
#: Keys that are combined at a time before they are dealt out.
COMBINE = 1_000_000
#: Classes of a key that are refined together; those beyond, within a combined part or in all, are tied to the key's first as they are
#: (which loses no link: groups may hold more than what links).
TIE, KEY_ROWS = 1_000, 20_000
PAIRS = "kind int, n long, blob binary"
DEALT_KEYS = "bucket int, kind int, n long, blob binary"
MEET = "bucket int, kind int, c long, n long, bits binary, blob binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row: runs of `width` words, or the whole of fewer words; empty without words."""
    words, starts = word_hashes(data, offsets, UNBLANK)
    grams = gram_hashes(words, width)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def empty_parts(low: int, least: int) -> int:
    """How many parts may be empty for `low` tokens over `least` parts and as many more: the mean and four deviations."""
    extra = 2
    while True:
        parts = least + extra
        mean = parts * math.exp(-low / parts)
        wanted = math.ceil(mean + 4 * math.sqrt(mean)) + 1
        if wanted <= extra or extra > 4 * least:
            return extra
        extra = wanted


@functools.cache
def size_ranges(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, parts, of them to make up for empty ones) of each range up to the size `most`; no parts where only
    equal sets link."""
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * GROWTH))
        d = high * (100 - percent) // percent
        extra = empty_parts(low, d + 1) if d else 0
        out.append((low, high, d + 1 + extra if d else 0, extra))
        low = high + 1
    return out


def part_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set."""
    n = len(tokens)
    out = []
    for at, (_, high, parts, extra) in enumerate(size_ranges(percent, 1 << max(1, n).bit_length())):
        if not parts or 100 * high < percent * n:  # no smaller partner is that small
            continue
        if size_ranges(percent, 1 << max(1, n).bit_length())[at][0] > n:
            break
        part = (tokens % np.uint64(parts)).astype(np.int64)
        mixed = mix64(tokens + np.uint64(0x51ED270B))
        low_half = np.bincount(part, (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), parts).astype(np.uint64)
        high_half = np.bincount(part, (mixed >> np.uint64(32)).astype(np.float64), parts).astype(np.uint64)
        full = np.bincount(part, minlength=parts) > 0
        key = mix64((high_half << np.uint64(32)) + low_half + mix64(np.arange(parts, dtype=np.uint64) + np.uint64(at << 32)))
        out.append(key if parts - full.sum() > extra else key[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Which of `bits` places (a power of two) the tokens have, as bytes."""
    out = np.zeros(bits // 8, np.uint8)
    at = (mix64(tokens) & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def folded(maps: list[bytes], least: int | None = None) -> np.ndarray:
    """Bitmaps of several widths, all folded to `least` bytes, by default to the least width of all."""
    least = least or min(len(m) for m in maps)
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, least), axis=0) for m in maps])


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(column)
    for i, j in blocks(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)


def names_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set. The first also names its class on the way to candidates."""
    return tuple(int(mix64(tokens ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0x1234567, 0x89ABCDEF))


def described(docs: DataFrame, width: int) -> DataFrame:
    """HASHES of docs (doc_id long, text): the set's size, 128 bits that name it, and its bitmap."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, s in zip(b.column(0).to_pylist(), sets_of(b.column(1), width), strict=True):
                rows.append((doc, len(s), *names_of(s), bitmap(s, 1 << min(14, max(8, (2 * len(s)).bit_length()))).tobytes()))
            yield batch(HASHES, rows)

    return mapped(docs.select("doc_id", "text"), run, HASHES)


def distinct(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, owner) pairs in order; for each the number of its key's pairs, its rank among them, and its key's least owner."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[new], owners[new]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(keys)))
    first = np.repeat(head, count)
    return keys, owners, np.repeat(count, count), np.arange(len(keys)) - first, owners[first]


def packed_keys(keys: np.ndarray, owners: np.ndarray, buckets: int, ties: Edges) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of DEALT_KEYS, one for each bucket: its distinct (key, owner) pairs. Owners of a key beyond TIE go to ties instead.

    A key is in one bucket, so each bucket is sorted by itself, in memory of its own size.
    """
    bucket = ((mix64(keys.view(np.uint64)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    for at in cut(bucket):
        own, by, _, rank, least = distinct(keys[at], owners[at])
        if (late := rank >= TIE).any():
            ties.add(by[late], least[late])
            own, by = own[~late], by[~late]
        yield int(bucket[at[0]]), 0, len(own), squeeze(own, by)


def shared_keys(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """PAIRS of docs (doc_id long, text): blocks of (key, class) for each key of several classes (kind 0), and of ties (kind 1).

    Rows of one class that a map task combines are one. A key that very many classes share goes on with TIE of them from each
    combined part, and with KEY_ROWS in all; the others are tied to its least. Keys travel packed, a block for each bucket.
    """

    def deal(batches):
        held: list[np.ndarray] = []
        names: list[int] = []
        seen: set[tuple] = set()
        size, ties = 0, Edges()

        def flush():
            keys, owners = np.concatenate(held), np.repeat(np.array(names, np.int64), [len(h) for h in held])
            held.clear()
            names.clear()
            seen.clear()
            return batch(DEALT_KEYS, list(packed_keys(keys, owners, buckets, ties)))

        for b in batches:
            for tokens in sets_of(b.column(0), width):
                name = (len(tokens), *names_of(tokens))
                if not len(tokens) or name in seen:
                    continue
                seen.add(name)
                held.append(part_keys(tokens, percent).view(np.int64))
                names.append(name[1])
                size += len(held[-1])
                if size >= COMBINE:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        yield batch(DEALT_KEYS, [(k % buckets, 1, n, blob) for k, (n, blob) in enumerate(ties.rows())])

    def meet(batches):
        now, held, ties = None, [], Edges()

        def solve():
            keys, owners, count, rank, least = distinct(*np.concatenate(held, axis=1))
            late = rank >= KEY_ROWS
            ties.add(owners[late], least[late])
            keys, owners = keys[(count > 1) & ~late], owners[(count > 1) & ~late]
            return batch(PAIRS, [(0, len(keys[k : k + CHUNK]), squeeze(keys[k : k + CHUNK], owners[k : k + CHUNK])) for k in range(0, len(keys), CHUNK)])

        for b in batches:
            for bucket, kind, n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind:
                    ties.add(*spread(blob, n))
                    continue
                if bucket != now:
                    if held:
                        yield solve()
                    now, held = bucket, []
                held.append(spread(blob, n))
        if held:
            yield solve()
        yield batch(PAIRS, [(1, n, blob) for n, blob in ties.rows()])

    packed = mapped(docs.select("text"), deal, DEALT_KEYS)
    return mapped(packed.repartition("bucket").sortWithinPartitions("bucket"), meet, PAIRS)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, roots: np.ndarray):
        self.up = np.array(roots)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class Tree:
    """A signature tree over sets in order of size, from their sizes and bitmaps. levels[0] are the sets; a node of the next level has
    FANOUT children."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, maps: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.members, sizes, maps = members[order], sizes[order], np.ascontiguousarray(maps[order]).view(np.uint64)
        self.levels = [(maps, maps, sizes, sizes)]
        while len(self.levels[-1][0]) > 1:
            some, every, low, high = self.levels[-1]
            at = np.arange(0, len(some), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    @classmethod
    def of(cls, members: np.ndarray, sets: list[np.ndarray], bits: int) -> Tree:
        return cls(members, np.array([len(sets[m]) for m in members]), np.stack([bitmap(sets[m], bits) for m in members]))

    def span(self, level: int, node: int) -> np.ndarray:
        return self.members[node * FANOUT**level : (node + 1) * FANOUT**level]


def possible(one: tuple, i: np.ndarray, two: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes i of level `one` and j of level `two` may hold a link: bits that all sets of a node have, and no set of
    the other, are tokens outside any overlap."""
    some1, every1, low1, high1 = (x[i] for x in one)
    some2, every2, low2, high2 = (x[j] for x in two)
    outside1 = np.bitwise_count(every1 & ~some2).sum(axis=1).astype(np.int64)
    outside2 = np.bitwise_count(every2 & ~some1).sum(axis=1).astype(np.int64)
    overlap = np.minimum(high1 - outside1, high2 - outside2)
    # 100 overlap >= percent (size1 + size2 - overlap), at the least sizes that hold such an overlap
    return (100 + percent) * overlap >= percent * (np.maximum(low1, overlap) + np.maximum(low2, overlap))


def alike(sets: list[np.ndarray], percent: int, most: int = 64 << 20):
    """The exact test of pairs of sets, by bitmaps over the tokens that several sets have (at most `most` bytes), else one by one."""
    sizes = np.array([len(s) for s in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    wide = -(-int((count > 1).sum()) // 64) or 1
    if 8 * wide * len(sets) <= most:
        owner, at = np.repeat(np.arange(len(sets)), sizes)[count[at] > 1], column[at[count[at] > 1]]
        bits = np.zeros((len(sets), wide), np.uint64)
        np.bitwise_or.at(bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))

        def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.bitwise_count(bits[a] & bits[b]).sum(axis=1).astype(np.int64)

    else:

        def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = overlap(a, b)
        return 100 * shared >= percent * (sizes[a] + sizes[b] - shared)

    return test


def link(one: Tree, two: Tree, forest: Forest, percent: int, test=None) -> Iterator[tuple[int, int]]:
    """Links (pairs that the bounds leave and that pass the test, if there is one) between members of the trees that join components of
    the forest; the forest takes them in."""
    same = one is two
    if len(one.levels) == len(two.levels) == 1:
        if not same and forest.find(int(one.members[0])) != forest.find(int(two.members[0])):
            yield from _joined(one, np.zeros(1, int), two, np.zeros(1, int), forest, percent, test)
        return
    top1, top2 = len(one.levels) - 1, len(two.levels) - 1
    stack = [(top1, 0, top2, 0)]
    while stack:
        k1, i, k2, j = stack.pop()
        roots = {forest.find(int(m)) for m in one.span(k1, i)}
        if len(roots) == 1 and all(forest.find(int(m)) in roots for m in two.span(k2, j)):
            continue
        # the higher node is opened, both if they are level
        down1, down2 = k1 >= k2, k2 >= k1
        left = np.arange(i * FANOUT, min((i + 1) * FANOUT, len(one.levels[k1 - 1][0]))) if down1 else np.array([i])
        right = np.arange(j * FANOUT, min((j + 1) * FANOUT, len(two.levels[k2 - 1][0]))) if down2 else np.array([j])
        x, y = (m.ravel() for m in np.meshgrid(left, right, indexing="ij"))
        if same and k1 == k2:
            keep = x <= y if k1 > 1 else x < y
            x, y = x[keep], y[keep]
        l1, l2 = k1 - down1, k2 - down2
        if l1 == l2 == 0:
            yield from _joined(one, x, two, y, forest, percent, test)
            continue
        ok = possible(one.levels[l1], x, two.levels[l2], y, percent)
        x, y = x[ok], y[ok]
        order = np.argsort(np.where(x == y, 1, 0) if same else -np.abs(x - y), kind="stable")  # nodes with themselves come off the stack first
        stack.extend((l1, int(x[k]), l2, int(y[k])) for k in order)


def _joined(one: Tree, x: np.ndarray, two: Tree, y: np.ndarray, forest: Forest, percent: int, test) -> Iterator[tuple[int, int]]:
    """Links between leaves x of one tree and y of another."""
    apart = np.array([forest.find(int(a)) for a in one.members[x]]) != np.array([forest.find(int(b)) for b in two.members[y]])
    x, y = x[apart], y[apart]
    ok = possible(one.levels[0], x, two.levels[0], y, percent)
    a, b = one.members[x[ok]], two.members[y[ok]]
    if test is not None and len(a):
        good = test(a, b)
        a, b = a[good], b[good]
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if forest.find(i) != forest.find(j):
            forest.union(i, j)
            yield i, j


def linked(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """What the links within each task's rows (task long, side int, doc_id long, cls long, text) connect: (a, b, links), with b the least
    class that links connect class a with, and how many joins of components it took part in. A class without links has no row.

    Rows of side 1 are compared with those of side 0, or, if a task has none, those of side 0 with each other. Rows of one cls count
    as linked.
    """

    kind = "a long, b long, links long"

    def solve(part: pa.Table) -> list[tuple[int, int, int]]:
        cls, side = (np.asarray(part.column(k)) for k in ("cls", "side"))
        sets = list(sets_of(part.column("text"), width))
        first: dict[int, int] = {}
        order = np.argsort(cls, kind="stable")  # so that a root has the least class
        cls, side, sets = cls[order], side[order], [sets[k] for k in order]
        forest = Forest(np.array([first.setdefault(int(c), k) for k, c in enumerate(cls)]))
        most = max(len(s) for s in sets)
        bits = 1 << max(6, int(np.ceil(np.log2(4 * most + 1))))
        one = Tree.of(np.flatnonzero(side == 0), sets, bits)
        two = Tree.of(np.flatnonzero(side == 1), sets, bits) if (side == 1).any() else one
        if not len(one.members):
            return []
        links = np.zeros(len(sets), np.int64)
        for pair in link(one, two, forest, percent, alike(sets, percent)):
            links[list(pair)] += 1
        joins = np.bincount([first[int(c)] for c in cls], links, len(sets)).astype(np.int64)
        return [(c, int(cls[forest.find(k)]), int(joins[k])) for c, k in first.items() if joins[k] or forest.find(k) != k]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            out, task = [], np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != task[lo]:
                    out += solve(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
            yield batch(kind, out)
        if held:
            yield batch(kind, solve(pa.Table.from_batches(held)))

    dealt = rows.select("task", "side", "doc_id", "cls", "text").repartition("task").sortWithinPartitions("task")
    return mapped(dealt, run, kind)


def may_link(keys: np.ndarray, owner: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which owners (places in sizes and maps) may link, as stars of places: those of one key of which no bound of their bitmaps says that they don't.
    A size below 0 says that an owner's bitmap isn't known: it may link with all."""
    order = np.argsort(keys, kind="stable")
    head = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    groups = {}
    for at in np.split(owner[order], head[1:]):
        at = np.sort(at)
        groups[at.tobytes()] = at  # keys of the same owners count once
    # groups no larger than a tree's leaf: their different pairs, tested at once
    one, two = [], []
    few = [at for at in groups.values() if len(at) <= FANOUT]
    for m in {len(at) for at in few}:
        every = np.stack([at for at in few if len(at) == m])
        i, j = np.triu_indices(m, 1)
        one.append(every[:, i].ravel())
        two.append(every[:, j].ravel())
    pairs = np.unique(np.concatenate(one) * len(sizes) + np.concatenate(two)) if one else np.zeros(0, np.int64)
    one, two = pairs // len(sizes), pairs % len(sizes)
    width = np.array([len(m) for m in maps])
    keep = (sizes[one] < 0) | (sizes[two] < 0)
    lows = np.minimum(width[one], width[two])
    for w in np.unique(lows):
        at = np.flatnonzero((lows == w) & ~keep)
        mine, place = np.unique(np.concatenate([one[at], two[at]]), return_inverse=True)
        if not len(at):
            continue
        level = np.ascontiguousarray(folded([maps[k] for k in mine], w)).view(np.uint64)
        level = (level, level, sizes[mine], sizes[mine])
        for k in range(0, len(at), 50_000):
            part = slice(k, min(k + 50_000, len(at)))
            keep[at[part]] = possible(level, place[: len(at)][part], level, place[len(at) :][part], percent)
    node, root = stars(one[keep], two[keep])
    up = np.arange(len(sizes))
    up[node] = root
    forest = Forest(up)
    for at in sorted((g for g in groups.values() if len(g) > FANOUT), key=len):
        roots = {forest.find(int(k)) for k in at}
        if len(roots) > 1 and (sizes[at] < 0).any():
            for k in at[1:]:
                forest.union(int(at[0]), int(k))
        elif len(roots) > 1:
            tree = Tree(at, sizes[at], folded([maps[k] for k in at]))
            for _ in link(tree, tree, forest, percent):
                pass
    root = np.array([forest.find(k) for k in range(len(sizes))])
    node = np.flatnonzero(root != np.arange(len(sizes)))
    return node, root[node]


def refined(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """BLOCKS of ties between the classes of each key that may link by their bitmaps: equal components, each as stars.

    shared: PAIRS; classes: (h1, n, bits). Pairs first go to their classes, whose bitmaps then go with them to their keys, once for each
    bucket of classes and of keys. Classes of one name (there is one in 2 ** 64) count as if their bitmaps weren't known.
    """
    pairs = shared.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    buckets = buckets_for(shared, max(pairs, classes.count()), 4_000, 250_000)

    def split(batches):
        for b in batches:
            rows = []
            for n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, owners = spread(blob, n)
                home = owners % buckets
                rows += [(int(home[at[0]]), 0, None, len(at), None, squeeze(keys[at], owners[at])) for at in cut(home)]
            yield batch(MEET, rows)

    def attach(bucket, rows):
        asked = [spread(r[5], r[3]) for r in rows if r[1] == 0]
        if not asked:
            return
        keys, owners = np.concatenate(asked, axis=1)
        known: dict[int, tuple[int, bytes]] = {}
        for _, kind, c, n, bits, _ in rows:
            if kind == 1:
                known[c] = (-1 if c in known else n, bits)
        home = ((mix64(keys.view(np.uint64)) >> np.uint64(9)) % np.uint64(buckets)).astype(np.int64)
        for at in cut(home):
            own, where = np.unique(owners[at], return_inverse=True)
            maps = [known[c][1] for c in own.tolist()]
            head = squeeze(np.array([len(at), len(own)]), keys[at], where, own, np.array([known[c][0] for c in own.tolist()]), np.array([len(m) for m in maps]))
            yield int(home[at[0]]), 0, None, 2 + 2 * len(at) + 3 * len(own), pa.Codec("zstd", 1).compress(b"".join(maps), asbytes=True), head

    def solve(bucket, rows):
        keys, owners, names, sizes, maps = [], [], [], [], []
        base = 0
        for _, _, _, n, bits, head in rows:
            flat = spread(head, n, 1)[0]
            a, c = int(flat[0]), int(flat[1])
            keys.append(flat[2 : 2 + a])
            owners.append(flat[2 + a : 2 + 2 * a] + base)
            own, size, length = flat[2 + 2 * a :].reshape(3, c)
            names.append(own)
            sizes.append(size)
            raw = pa.Codec("zstd").decompress(bits, int(length.sum()), asbytes=True)
            ends = np.cumsum(length)
            maps += [raw[e - k : e] for e, k in zip(ends.tolist(), length.tolist(), strict=True)]
            base += c
        names = np.concatenate(names)  # a class comes from one bucket only, so its name stands here once
        node, root = may_link(np.concatenate(keys), np.concatenate(owners), np.concatenate(sizes), maps, percent)
        edges = Edges()
        edges.add(names[node], names[root])
        return edges.rows()

    asked = mapped(shared.where("kind = 0").select("n", "blob"), split, MEET)
    known = classes.select(F.pmod("h1", F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("kind"), F.col("h1").alias("c"), "n", "bits", F.lit(None).cast("binary").alias("blob"))
    return by_bucket(by_bucket(asked.union(known), buckets, attach, MEET), buckets, solve, BLOCKS)


def join(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id integer, text).

    Two rows link when 100 * intersection >= percent * union of their sets of `width`-word shingles; component_id is the smallest
    id that links reach. Words are runs of bytes other than ASCII blanks, A-Z lower-cased. Null texts and texts without words have empty
    sets, link with nothing, and are components of their own. Rows that share an id and a set are one document. An id with several
    texts joins the components of all of them. Null ids stand for themselves: their set takes part for none, and component_id is null.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    every = settled(described(ids, width), "shingles")
    sets = every.where("doc_id is not null and n > 0")
    classes = settled(sets.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits")), "classes")

    # candidate groups of classes
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = settled(shared_keys(ids.where("doc_id is not null"), width, percent, buckets), "keys")
    ties = settled(refined(shared, classes, percent).union(shared.where("kind = 1").select("n", "blob")), "ties")
    found = settled(connected(ties), "groups")
    nodes = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    placed = classes.select("rep", "h1").join(nodes, F.col("h1") == F.col("node")).select(F.col("rep").alias("doc_id"), F.col("root").alias("grp")).distinct()
    grouped = _sized(placed, block).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.col("nblocks")).cast("int"))
    # merged whatever the sizes: the groups grow with the documents
    texts = settled(ids.hint("merge").join(grouped, "doc_id"), "candidates")

    own = texts.select(F.xxhash64("grp", "block").alias("task"), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("cls"), "text")
    found = settled(linked(own, width, percent), "links")
    wide = texts.where("nblocks > 1")
    if not wide.isEmpty():
        found = settled(_across(wide, found, width, percent, block), "links")
    # classes of one representative (an id with several sets) meet below
    roots = classes.join(found, F.col("rep") == F.col("a"), "left").select("n", "h1", "h2", F.coalesce("b", "rep").alias("root"), "copies")
    out = joined_skewed(sets.select("doc_id", "n", "h1", "h2"), settled(roots, "roots"), ["n", "h1", "h2"], "copies").select("doc_id", F.col("n").alias("n_shingles"), "root")
    ends = [F.min(c) != F.max(c) for c in ("n", "h1", "h2")]
    several = sets.groupBy("doc_id").agg((ends[0] | ends[1] | ends[2]).alias("several")).where("several")
    if not several.isEmpty():  # an id with several sets joins their components
        both = components(out.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("doc_id"), F.col("root").alias("to"))
        out = out.join(both, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("to", "doc_id").alias("root"))
    rest = every.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.withColumnRenamed("root", "component_id").union(rest)


def _sized(nodes: DataFrame, block: int) -> DataFrame:
    """(doc_id, grp, nblocks) of the groups of two or more."""
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return nodes.join(sizes.select("grp", F.ceil(F.col("n") / block).cast("int").alias("nblocks")), "grp").select("doc_id", "grp", "nblocks")


def _across(texts: DataFrame, inside: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Every class's least one (a, b), from texts (grp, block, nblocks, doc_id, text) of groups of several blocks and what is connected
    within blocks."""

    def labelled(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
        near = known.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        return df.join(near, F.col(column) == F.col("_a"), "left").withColumn("cls", F.coalesce("_b", column)).drop("_a", "_b")

    def relabelled(known: DataFrame, edges: DataFrame) -> DataFrame:
        """known with the least of the classes that edges connect; a class's rows may be in several tasks."""
        near = components(edges).select(F.col("node").alias("a"), F.col("root").alias("b"))
        return settled(labelled(known.withColumnRenamed("cls", "was"), "was", near).drop("was"), "labels")

    # all with the leaders: of each block the class of most joins, of those the first LEADERS, and the group's least class
    first = settled(labelled(texts, "doc_id", inside.where("a <> b")), "labels")
    busy = first.join(inside.select(F.col("a").alias("doc_id"), "links").where("links > 0"), "doc_id")
    best = busy.groupBy("grp", "block").agg(F.max(F.struct("links", "doc_id")).alias("best")).select("grp", F.col("best.links").alias("links"), F.col("best.doc_id").alias("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("links"), "doc_id"))).where(F.col("rank") <= LEADERS)  # a row for each block
    chosen = ranked.select("grp", "doc_id").union(first.groupBy("grp").agg(F.min("doc_id").alias("doc_id"))).distinct()
    leaders = settled(first.join(chosen, ["grp", "doc_id"]).select("grp", "nblocks", "doc_id", "cls", "text"), "leaders")
    copied = leaders.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("nblocks") - 1)))  # LEADERS + 1 for each block
    rows = copied.select(F.xxhash64(F.lit("leaders"), "grp", "to").alias("task"), F.lit(0).alias("side"), "doc_id", "cls", "text")
    others = first.select(F.xxhash64(F.lit("leaders"), "grp", "block").alias("task"), F.lit(1).alias("side"), "doc_id", "cls", "text")
    once = relabelled(first, linked(rows.union(others), width, percent))
    # the representatives of the components, in blocks again
    heads = once.where("doc_id = cls").withColumn("nheads", F.ceil(F.col("nblocks") / 16).cast("int"))
    rows = heads.select(F.xxhash64(F.lit("heads"), "grp", F.pmod(F.xxhash64("doc_id"), F.col("nheads"))).alias("task"), F.lit(0).alias("side"), "doc_id", "cls", "text")
    now = relabelled(once, linked(rows, width, percent))
    # all but the largest component of each group meet every block
    sizes = now.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("grp").agg(F.max_by("cls", F.struct("n", "cls")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("n"))
    cut = largest.where("n < all").select("grp", "top", F.ceil((F.col("all") - F.col("n")) / block).cast("int").alias("nstray"))
    both = now.join(cut, "grp")
    every = both.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nstray") - 1)))
    side0 = every.select(F.xxhash64("grp", "block", "k").alias("task"), F.lit(0).alias("side"), "doc_id", "cls", "text")
    strays = both.where("cls <> top").withColumn("k", F.pmod(F.xxhash64(F.lit("stray"), "doc_id"), F.col("nstray")).cast("int"))
    spread = strays.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("nblocks") - 1)))
    side1 = spread.select(F.xxhash64("grp", "to", "k").alias("task"), F.lit(1).alias("side"), "doc_id", "cls", "text")
    last = components(linked(side0.union(side1), width, percent)).select(F.col("node").alias("a"), F.col("root").alias("b"))
    ends = labelled(now.select("doc_id", "cls").distinct().withColumnRenamed("cls", "was"), "was", last).select(F.col("doc_id").alias("a"), F.col("cls").alias("b"), F.lit(0).cast("long").alias("links"))
    # groups of one block keep what was found within them
    return inside.join(texts.select(F.col("doc_id").alias("a")).distinct(), "a", "left_anti").union(ends)


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that have a smaller id in their component; rows that share an id stay together, rows with a null id stay."""
    found = join(docs, width, percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(*docs.columns)


def op6(docs: DataFrame) -> DataFrame:
    """The join at three words and 90 %."""
    return join(docs, 3, 90)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+') if x <> ''] AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] END) AS t FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

"""N-gram Jaccard join by T-occurrence search.

1. Every text becomes its set of word shingles; equal sets are one class from here on, so exact copies cost nothing more.
2. Prefix filtering: two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of each, in one fixed order that puts
   shingles found often last. Classes that share such a shingle with another of a fitting size meet in the cluster of the smallest
   class with it.
   Parity bit maps of the sets, whose Hamming distance is never more than the sets' difference, then tell who surely links with nobody
   there, before any text is moved.
3. Within a cluster (or a block of a large one) DivideSkip finds the classes that reach the required overlap: the short inverted lists
   are merged with a heap that skips, the long ones are probed by bisection. What is already in the cluster's main component is
   found by the others' searches and does no search itself, so a large group of near copies never becomes all its pairs.
4. Links become components.

Every link between different sets lies within one component; nothing is capped or sampled. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Words, drop_written, fresh, mix, shingles, slices, written

SIZE = 5
#: Links: NUM * intersection >= DEN * union, as whole numbers.
NUM, DEN = 100, 75
#: A shingle in so many different sets of one block of rows is often; the OFTEN most frequent ones go last in the order.
LOCAL, OFTEN = 4, 500_000
#: Shingles of a cluster that one task holds; larger clusters are cut into blocks.
BLOCK = 2_000_000
#: Bit maps are compared in blocks of so many classes, two blocks a task; clusters of more than MOST classes are not sifted, all stay.
SIFT, MOST = 256, 32_768
#: Bits of the map that keeps texts without candidates from being shuffled.
MAP_BITS = 1 << 26


def sets_of(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; empty without words."""
    words = Words(texts)
    owner, keys = shingles(words.hashes(), words.bounds, size)
    edges = np.searchsorted(owner, np.arange(len(words.counts) + 1))
    out = []
    for k in range(len(words.counts)):
        part = np.sort(keys[edges[k] : edges[k + 1]])
        if len(part) > 1:
            new = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=new[1:])
            part = part[new]
        out.append(part)
    return out


def class_of(part: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(np.int64(np.uint64(mix(np.array([np.add.reduce(mix(part)) * np.uint64(3) + np.bitwise_xor.reduce(mix(part + np.uint64(0x632BE59BD9B4E019))) + np.uint64(len(part))], np.uint64))[0]).astype(np.int64)))


def need(a: int, b: int) -> int:
    """The overlap that sets of these sizes need: the least o with NUM * o >= DEN * (a + b - o)."""
    return -(-DEN * (a + b) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-DEN * n // NUM) + 1


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key (the first columns) of a partition that is sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def parity(part: np.ndarray) -> np.ndarray:
    """A bit for each residue of the shingles: whether it occurs an odd number of times. As many bits as shingles or more, a power of two."""
    bits = max(256, 1 << (len(part) - 1).bit_length())
    odd = np.bincount((part & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(maps: np.ndarray) -> np.ndarray:
    """The maps of half as many bits."""
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def may_link(sizes: np.ndarray, maps: list[bytes]) -> np.ndarray:
    """Which sets have another one of a fitting size whose map is near enough. Sets that do link always have."""
    n = len(sizes)
    words = np.array([len(x) // 8 for x in maps])
    if float(n) * n * words.mean() > 4e9:  # too many to compare; all stay
        return np.ones(n, bool)
    order = np.argsort(sizes, kind="stable")
    size, words = sizes[order].astype(np.int64), words[order]
    level, row = {}, np.zeros(n, np.int64)
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        level[int(w)] = (int(at[0]), np.frombuffer(b"".join(maps[order[k]] for k in at), np.uint64).reshape(len(at), int(w)))
        row[at] = np.arange(len(at))
    folded = {w // 2: (first, fold(m)) for w, (first, m) in level.items() if w > 4}
    near = np.zeros(n, bool)
    high = np.searchsorted(size, NUM * size // DEN, side="right")
    for i in range(n):
        w = int(words[i])
        mine = level[w][1][row[i]]
        for first, block in (level[w], folded.get(w, (0, None))):
            if block is None:
                continue
            a, b = max(i + 1, first), min(int(high[i]), first + len(block))
            if a < b:
                apart = np.bitwise_count(block[a - first : b - first] ^ mine).sum(axis=1, dtype=np.int64)
                both = size[i] + size[a:b]
                close = apart <= both - 2 * -(-DEN * both // (NUM + DEN))
                if close.any():
                    near[i] = True
                    near[a:b] |= close
    out = np.zeros(n, bool)
    out[order] = near
    return out


class Forest:
    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        return True


class Index:
    """Inverted lists over sets in order of size, and DivideSkip search."""

    def __init__(self, parts: list[np.ndarray]):
        self.sizes = [len(p) for p in parts]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(parts)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.begin = np.append(first, len(flat))
        self.docs = owner[order]

    def lists(self, part: np.ndarray, low: int, high: int) -> list[list[int]]:
        """The list of each of the set's shingles, within positions low to high, without empty ones."""
        at = np.searchsorted(self.keys, part)
        at = at[at < len(self.keys)] if len(at) and at[-1] >= len(self.keys) else at
        at = at[self.keys[at] == part[: len(at)]] if len(self.keys) else at[:0]
        out = []
        for a, b in zip(self.begin[at].tolist(), self.begin[at + 1].tolist(), strict=True):
            one = self.docs[a:b].tolist()
            if one[0] < low or one[-1] >= high:
                one = one[bisect_left(one, low) : bisect_left(one, high)]
            if one:
                out.append(one)
        return out

    def search(self, part: np.ndarray, skip: int = -1) -> Iterator[int]:
        """Positions of the sets that link with ``part``, but not ``skip``."""
        n = len(part)
        low, high = bisect_left(self.sizes, -(-DEN * n // NUM)), bisect_left(self.sizes, NUM * n // DEN + 1)
        if low >= high or (high - low == 1 and low == skip):
            return
        least = need(n, self.sizes[low])
        lists = self.lists(part, low, high)
        if skip >= 0 and low <= skip < high:  # its own postings are in every list and count for nothing
            lists = [x for x in lists if len(x) > 1]
        if len(lists) < least:
            return
        lists.sort(key=len)
        long = min(least - 1, int(least / (0.01 * log2(len(lists[-1]) + 1) + 1)))
        short, probe = lists[: len(lists) - long], lists[len(lists) - long :]
        for doc, count in merge_skip(short, least - long):
            if doc == skip:
                continue
            want, left = need(n, self.sizes[doc]), len(probe)
            for one in probe:
                if count >= want or count + left < want:
                    break
                k = bisect_left(one, doc)
                count += k < len(one) and one[k] == doc
                left -= 1
            if count >= want:
                yield doc


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(id, count) of the ids in at least ``least`` of the sorted lists, by a heap that jumps over ids that can't be."""
    places = [0] * len(lists)
    heap = [(one[0], k) for k, one in enumerate(lists)]
    heapify(heap)
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= least:
            yield top, len(popped)
            target = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
        for k in popped:
            at = bisect_left(lists[k], target, places[k])
            if at < len(lists[k]):
                places[k] = at
                heappush(heap, (lists[k][at], k))


def links(names: np.ndarray, parts: list[np.ndarray], main: int | None = None) -> tuple[list[tuple[int, int]], list[bool]]:
    """(links enough to connect what links among the sets, whether each set is outside the main component).

    The main component is that of ``main`` (a position), or else the largest one after the first searches. Its members do no search:
    a link between two of them adds nothing, and one to any other set is found by that set's own search.
    """
    order = sorted(range(len(parts)), key=lambda k: (len(parts[k]), k))
    parts = [parts[k] for k in order]
    names = [int(names[k]) for k in order]
    forest, found = Forest(len(parts)), []
    if len(parts) == 2:
        both = len(np.intersect1d(parts[0], parts[1], assume_unique=True))
        if both >= need(len(parts[0]), len(parts[1])):
            forest.join(0, 1)
            found.append((names[0], names[1]))
        hub = order.index(main) if main is not None else 0
    else:
        index = Index(parts)
        hub = order.index(main) if main is not None else None
        turn = sorted(range(len(parts)), key=lambda k: k != hub)
        for done, k in enumerate(turn):
            if hub is None and done == 32:
                hub = max(range(len(parts)), key=lambda x: forest.size[forest.find(x)])
            if hub is not None and k != hub and forest.find(k) == forest.find(hub):
                continue
            for other in index.search(parts[k], k):
                if forest.join(k, other):
                    found.append((names[k], names[other]))
        hub = 0 if hub is None else hub
    top = forest.find(hub) if parts else 0
    outside = [False] * len(parts)
    for k, at in enumerate(order):
        outside[at] = forest.find(k) != top
    return found, outside


def _scan(docs: DataFrame) -> DataFrame:
    """Rows (kind 0: doc, size, class, bit map) of each text, and (kind 1: shingle, sets) of shingles often found in a block of rows.

    A task gives a class's bit map with one of its rows.
    """

    def out(kind, a, b, c, bits=None):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(bits or [None] * len(a), pa.binary())], ["kind", "a", "b", "c", "bits"])

    def often(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= LOCAL
        return keys[keep].view(np.int64), n[keep], np.zeros(int(keep.sum()), np.int64)

    def run(batches):
        held, seen, size = [], set(), 0
        for batch in batches:
            for part in slices(batch, 1):
                sets = sets_of(part.column(1))
                names = [class_of(x) if len(x) else None for x in sets]
                maps = [None] * len(sets)
                for k, (name, x) in enumerate(zip(names, sets, strict=True)):
                    if name is not None and name not in seen:
                        seen.add(name)
                        held.append(x)
                        size += len(x)
                        maps[k] = parity(x).tobytes()
                yield out(0, part.column(0), list(map(len, sets)), names, maps)
                if size > 2_000_000:
                    yield out(1, *often(held))
                    held, seen, size = [], set(), 0
        if held:
            yield out(1, *often(held))

    return docs.mapInArrow(run, "kind int, a long, b long, c long, bits binary")


def _prefixes(docs: DataFrame, often) -> DataFrame:
    """(shingle, class, size) of the first shingles of each class, once for each task."""

    def run(batches):
        keys, counts = often.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 1):
                tokens, names, sizes = [], [], []
                for x in sets_of(part.column(1)):
                    if not len(x):
                        continue
                    name = class_of(x)
                    if name in seen:
                        continue
                    seen.add(name)
                    first = prefix_length(len(x))
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                        rare = keys[at] != x
                        few = int(rare.sum())
                        if few >= first:
                            mine = x[rare][:first]
                        else:
                            rest, n = x[~rare], counts[at[~rare]]
                            mine = np.concatenate((x[rare], rest[np.lexsort((rest, n))][: first - few]))
                    else:
                        mine = x[:first]
                    tokens.append(mine)
                    names.append(np.full(first, name, np.int64))
                    sizes.append(np.full(first, len(x), np.int32))
                if len(seen) > 2_000_000:
                    seen.clear()
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes))], ["token", "cls", "n"])

    return docs.mapInArrow(run, "token long, cls long, n int")


def _clusters(prefixes: DataFrame) -> DataFrame:
    """(leader, cls, n): the classes that share a first shingle with another of a fitting size, under the smallest class of them."""

    def close(token, cls, n):
        if len(token) < 2:
            return None
        order = np.lexsort((cls, n, token))
        token, cls, n = token[order], cls[order], n[order].astype(np.int64)
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, n = token[keep], cls[keep], n[keep]
        fits = (token[1:] == token[:-1]) & (NUM * n[:-1] >= DEN * n[1:])
        near = np.zeros(len(token), bool)
        near[1:] |= fits
        near[:-1] |= fits
        token, cls, n = token[near], cls[near], n[near]
        if not len(token):
            return None
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        leader = np.repeat(np.minimum.reduceat(cls, first), np.diff(np.append(first, len(token))))
        pair, at = np.unique(np.stack((leader, cls)), axis=1, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(n[at].astype(np.int32))], ["leader", "cls", "n"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)]
        for batch in batches:
            cols = [np.concatenate((h, batch.column(k).to_numpy(zero_copy_only=False))) for k, h in enumerate(held)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last shingle may go on
            done = close(*[c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
            if done is not None:
                yield done
        done = close(*held)
        if done is not None:
            yield done

    return prefixes.repartition("token").sortWithinPartitions("token").mapInArrow(run, "leader long, cls long, n int").groupBy("leader", "cls").agg(F.first("n").alias("n"))


def _sift(clusters: DataFrame, maps: DataFrame) -> DataFrame:
    """The clusters without the classes whose bit maps show that they link with nobody there, under the smallest class left.

    A cluster of more than SIFT classes is dealt to blocks, and each pair of blocks to a task.
    """

    def run(batches):
        for table in grouped(batches, 3):
            if table.num_rows < 2:
                continue
            cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
            near = may_link(n, table.column("bits").to_pylist())
            if near.any():
                yield pa.RecordBatch.from_arrays([table.column("leader").combine_chunks().filter(pa.array(near)), pa.array(cls[near]), pa.array(n[near].astype(np.int32))], ["leader", "cls", "n"])

    clusters = written(clusters)
    sizes = written(clusters.groupBy("leader").agg(F.count("*").alias("m")).where(F.col("m") > SIFT).withColumn("blocks", F.ceil(F.col("m") / SIFT).cast("int")))
    with_maps = clusters.join(maps, "cls")
    plain, untouched = with_maps, None
    if sizes.head(1):
        plain = with_maps.join(sizes, "leader", "left_anti")
        untouched = clusters.join(sizes.where(F.col("m") > MOST).select("leader"), "leader", "left_semi").select("leader", "cls", "n")
        dealt = with_maps.join(sizes.where(F.col("m") <= MOST), "leader").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> other")
        plain = plain.select("leader", F.lit(0).alias("one"), F.lit(0).alias("two"), "cls", "n", "bits").unionByName(dealt.select("leader", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "cls", "n", "bits"))
    else:
        plain = plain.select("leader", F.lit(0).alias("one"), F.lit(0).alias("two"), "cls", "n", "bits")
    kept = plain.repartition("leader", "one", "two").sortWithinPartitions("leader", "one", "two").mapInArrow(run, "leader long, cls long, n int")
    kept = kept if untouched is None else kept.unionByName(untouched)
    kept = written(kept.groupBy("leader", "cls").agg(F.first("n").alias("n")))
    first = kept.groupBy("leader").agg(F.min("cls").alias("first"))
    named = kept.join(first, "leader").select(F.col("first").alias("leader"), "cls", "n").groupBy("leader", "cls").agg(F.first("n").alias("n"))
    return named


def _texts(docs: DataFrame, wanted) -> DataFrame:
    """(cls, text) of the classes that the bit map names, once for each task."""

    def run(batches):
        bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 1):
                rows, names = [], []
                for k, x in enumerate(sets_of(part.column(1))):
                    if len(x):
                        name = class_of(x)
                        spot = name % MAP_BITS
                        if bits[spot >> 3] >> (spot & 7) & 1 and name not in seen:
                            seen.add(name)
                            rows.append(k)
                            names.append(name)
                if len(seen) > 2_000_000:
                    seen.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), part.column(1).take(pa.array(rows))], ["cls", "text"])

    return docs.mapInArrow(run, "cls long, text string")


def _bit_map(rows: DataFrame) -> np.ndarray:
    """A bit for each class named, MAP_BITS / 8 bytes however many there are."""
    spot = F.pmod("cls", F.lit(MAP_BITS))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    pieces = rows.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    for row in pieces.toLocalIterator():
        piece = np.frombuffer(row.bits, np.uint8)
        out_at = _spots(int(row.bucket), piece)
        np.bitwise_or.at(out, out_at >> 3, (1 << (out_at & 7)).astype(np.uint8))
    return out


def _spots(bucket: int, piece: np.ndarray) -> np.ndarray:
    """The numbers that a bucket's bits stand for: number x > 0 is bit (x - 1) % 32768 of bucket 1 + (x - 1) / 32768; x = 0 is bit 0 of bucket 0."""
    on = np.flatnonzero(np.unpackbits(piece, bitorder="little"))
    return on + (bucket - 1) * 32768 + 1 if bucket > 0 else on


def _in_blocks(members: DataFrame, texts: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(a, b) links and (leader, cls) of what stays outside its leader's component, from (leader, block, cls, role).

    Role 1 is the leader in its cluster's block, 0 a member, 2 a search from another block.
    """

    def run(batches):
        for table in grouped(batches, 2):
            names, roles, texts = table.column("cls").to_numpy(), table.column("role").to_numpy(), table.column("text").combine_chunks()
            if isinstance(texts, pa.ChunkedArray):
                texts = pa.concat_arrays(texts.chunks)
            parts = []
            for batch in slices(pa.record_batch([texts], ["text"]), 0):
                parts += sets_of(batch.column(0))
            leader = int(table.column("leader")[0].as_py())
            if (roles == 2).any():
                mine = np.flatnonzero(roles != 2)
                mine = mine[np.argsort([len(parts[k]) for k in mine], kind="stable")]
                index = Index([parts[k] for k in mine])
                found = [(int(names[q]), int(names[mine[at]])) for q in np.flatnonzero(roles == 2) for at in index.search(parts[q])]
                out = []
            else:
                blocks = len(set(roles.tolist())) > 1
                hub = int(np.flatnonzero(roles == 1)[0]) if blocks else None
                found, outside = links(names, parts, hub)
                out = [int(x) for x, o in zip(names, outside, strict=True) if o] if blocks else []
            rows = [(0, *x) for x in found] + [(1, leader, x) for x in out]
            if rows:
                kind, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    joined = members.join(texts, "cls").select("leader", "block", "cls", "role", "text")
    return joined.repartition("leader", "block").sortWithinPartitions("leader", "block").mapInArrow(run, "kind int, a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, cls) of each row.

    Null text, or text without words: an empty set, its own component, cls null. Fewer words than a shingle: the whole sequence is the
    one shingle. Rows with equal texts, or equal ids, are rows of one component; a null id takes part, and is nobody's component_id
    unless the component has no other. Ties at the threshold link. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scan = written(_scan(docs))
    rows = scan.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("cls"))
    top = scan.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "token").limit(OFTEN).toPandas()
    keys, counts = top.token.to_numpy(np.int64).view(np.uint64), top.n.to_numpy(np.int64)
    order = np.argsort(keys)
    often = spark.sparkContext.broadcast((keys[order], counts[order]))
    maps = scan.where("kind = 0 and bits is not null").select(F.col("c").alias("cls"), "bits").dropDuplicates(["cls"])
    pairs = written(_sift(_clusters(_prefixes(docs, often)), maps))
    wanted = spark.sparkContext.broadcast(_bit_map(pairs))
    texts = _texts(docs, wanted).dropDuplicates(["cls"])
    blocks = F.ceil(F.sum(F.col("n").cast("long")) / BLOCK).cast("int")
    large = written(pairs.groupBy("leader").agg(blocks.alias("blocks")).where(F.col("blocks") > 1))
    any_large = bool(large.head(1))
    if any_large:
        texts = written(texts)  # read twice
        dealt = pairs.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        members = dealt.where("blocks = 1 or leader <> cls").select("leader", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), "cls", F.lit(0).alias("role"))
        members = members.unionByName(large.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("cls"), F.lit(1).alias("role")))
    else:
        members = pairs.select("leader", F.lit(0).alias("block"), "cls", F.lit(0).alias("role"))
    found = written(_in_blocks(members, texts))
    edges = found.where("kind = 0").select("a", "b")
    if any_large:
        # what isn't in its leader's component is looked up in all other blocks of the cluster, in pieces
        rest = found.where("kind = 1").select(F.col("a").alias("leader"), F.col("b").alias("cls"))
        chunks = rest.groupBy("leader").agg(F.ceil(F.count("*") / 2000).cast("int").alias("chunks"))
        rest = rest.join(chunks, "leader").join(large, "leader").withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(1)), "chunks").cast("int"))
        asked = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> pmod(xxhash64(cls), blocks)")
        asked = asked.select("leader", (F.col("block") + F.col("blocks") * F.col("chunk")).alias("block"), "cls", F.lit(2).alias("role"))
        kept = members.where("role = 0").join(chunks, "leader").join(large, "leader").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        kept = kept.select("leader", (F.col("block") + F.col("blocks") * F.col("chunk")).alias("block"), "cls", "role")
        more = written(_in_blocks(kept.unionByName(asked), texts))
        edges = edges.union(more.where("kind = 0").select("a", "b"))
    drop_written(pairs)
    groups = common.components(edges)
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    joined = least.join(groups, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("component", "cls").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(roots, "root").select("cls", "component_id")
    full = rows.where("cls is not null").join(named, "cls").select("doc_id", "n_shingles", "component_id", "cls")
    return full.unionByName(rows.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "cls"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component, with all its columns.

    Rows without words and rows without an id all stay; of rows that share the id one stays.
    """
    found = jaccard_components(docs)
    keep = found.where("n_shingles > 0 and doc_id = component_id").select("doc_id").distinct()
    ident, kept = fresh(docs, "__id", "__kept")
    named = docs.withColumn(ident, F.col("doc_id").cast("long"))
    bare = F.col(ident).isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = named.where(~bare).join(keep.withColumnRenamed("doc_id", kept), F.col(ident) == F.col(kept), "left_semi").dropDuplicates([ident])
    return once.unionByName(named.where(bare)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cls")

"""Language-model scoring with a probabilistic suffix tree.

Unigram counts over all training tokens give the root. A context of words is a state of the tree if it and its next words are frequent, its
parent (the context without its first word) is a state, and its next-word distribution diverges from its parent's. Contexts grow by
a word a round until none diverges; depth has no limit but what a caller sets. A state's distribution is its counts, smoothed with its
parent's:

    P(x | s) = (n(s, x) + m(s) P(x | parent)) / (c(s) + LAMBDA),   m(s) = c(s) + LAMBDA - sum of the kept n(s, x)

Every token is scored by the state of its longest suffix. For a word outside the alphabet n(s, x) is 0, so only factors m / (c + LAMBDA)
meet its root probability. Texts are read once and kept as slices of numbers, with the counts of their words. The first rounds count grams;
then the places after states are dealt by state, with some words before each, and each subtree grows by itself. Words and states are
tables by hash that grow with the input, dealt to buckets by ranges of the hash; a slice of rows sends each bucket its distinct keys, packed,
and gets back what is known. What is sent to all tasks are filters of bounded size, which only spare questions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Words, crc_mod, slices, written

#: The end token's hash.
END = np.uint64(0xE0E0_5EED_0000_0001)
#: A word of the alphabet occurs so often, and so does a context with its next word, whatever the input's size.
SYMBOL_MIN, NEXT_MIN = 32, 8
#: Nats that a state must gain over its parent, on all its occurrences, to be kept.
GAIN = 20.0
LAMBDA = 4.0
#: Training tokens for each bucket of the table of words and states.
BUCKET = 4_000_000
#: Sets a state's hash apart from that of the same words as a gram.
STATE = 0x5EED_57A7_E000_0001
#: Filters have so many bits, as a power of 2, at least and at most; a hash sets those at these shifts.
SIEVE_LEAST, SIEVE_BITS, SHIFTS = 22, 27, (1, 32)
#: From this round on the places after states are dealt by state, with AHEAD words before each, then AHEAD times more each pass; a task grows
#: the states below its own as far as these reach. Both ways count the same.
NARROW, AHEAD = 4, 8
#: So many rounds together, places that are alike as far as these reach count as one.
STEP = 16
#: Places for each bucket of these passes, which costs a call for each round however few it has.
PLACES = 250_000
#: 0 deals each state by itself, else by buckets.
ONE_TASK_TOKENS = 4_000_000
#: Bytes of text of a slice; so many slices ask for what they need together, since they share much of it.
SLICE, GROUP = 8 << 20, 6
#: Bytes of an Arrow batch: rows are packed pieces of megabytes, and the JVM keeps the buffers that a batch took.
BATCH = 4 << 20
#: Places after states are followed in pieces of so many tokens, which stay in a core's cache, and from this round on all of a slice together.
PIECE, TOGETHER = 1 << 16, 4
RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def begins(sorted_: np.ndarray) -> np.ndarray:
    """Where another value begins."""
    out = np.ones(len(sorted_), bool)
    out[1:] = sorted_[1:] != sorted_[:-1]
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order. numpy.unique() takes ten times longer, since it hashes."""
    keys = np.sort(keys)
    return keys[begins(keys)]


class Alike:
    """Equal keys: the distinct ones in order, how often each occurs and one place of each. numpy.unique() sorts so that it is the first place, which takes three times longer."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        keys = keys[self.order]
        start = np.flatnonzero(begins(keys))
        self.keys, self.at, self.counts = keys[start], self.order[start], np.diff(start, append=len(keys))

    def of(self) -> np.ndarray:
        """Which of the distinct keys each is."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.keys)), self.counts)
        return out


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """The stable order of buckets; few are sorted by their two bytes."""
    return np.argsort(bucket.astype(np.uint16) if len(bucket) and 0 <= bucket.min() and bucket.max() < 1 << 16 else bucket, kind="stable")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens, bounds): each text's words and the end token."""
    w = Words(texts)
    n = len(w.counts)
    bounds = w.bounds + np.arange(n + 1)
    out = np.empty(len(w) + n, np.uint64)
    ends = bounds[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = w.hashes()
    out[ends] = END
    return out, bounds


def _turn(x: np.ndarray, k: int):
    right = x >> np.uint64(64 - k)
    x <<= np.uint64(k)
    x |= right


def _round(x: np.ndarray, seed) -> np.ndarray:
    h = x * P2
    _turn(h, 31)
    h *= P1
    h ^= seed + (P5 + np.uint64(8))
    _turn(h, 27)
    h *= P1
    h += P4
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


def lead(a: np.ndarray) -> np.ndarray:
    """What joined() makes of its first hash."""
    return _round(a, np.uint64(42))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order: xxhash64(a, b) of Spark, so that tables need not carry it."""
    return _round(b, lead(a))


class Grams:
    """The tokens of a batch of texts and the hashes of their grams: of d + 1 words, the last of which is the token, a gram is one word joined to the gram of d."""

    def __init__(self, texts: pa.Array):
        self._take(*tokens(texts))

    @classmethod
    def made(cls, words: np.ndarray, bounds: np.ndarray) -> Grams:
        out = cls.__new__(cls)
        out._take(words, bounds)
        return out

    def _take(self, words: np.ndarray, bounds: np.ndarray):
        self.words, self.bounds = words, bounds
        #: how many tokens of its text are before each
        self.at = np.arange(len(self.words)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def of(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams of d and of d + 1 words that end at each token; those of the first tokens of a text reach beyond it and mean nothing."""
        less, full = self.words, self.words
        for k in range(1, d + 1):
            less, full = full, joined(np.roll(self.words, k), full)
        return less, full

    def longer(self, d: int, places: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The grams of d + 1 words at some places from those of d."""
        return joined(self.words[places - d], grams)


class Sums:
    """Counts of keys of one task with what belongs to each key, merged now and then."""

    def __init__(self, limit: int = 1_500_000):
        self.limit, self.held, self.size = limit, [], 0

    def add(self, keys: np.ndarray, *more: np.ndarray):
        """Yields (keys, counts, more) when too many are held."""
        if more:
            same = Alike(keys)
            self.held.append((same.keys, same.counts, *[m[same.at] for m in more]))
        else:
            keys = np.sort(keys)
            first = np.flatnonzero(begins(keys))
            self.held.append((keys[first], np.diff(first, append=len(keys))))
        self.size += len(self.held[-1][0])
        if self.size > self.limit:
            found = self.merged()
            if len(found[0]) > self.limit // 2:
                self.held, self.size = [], 0
                yield found
            else:
                self.held, self.size = [found], len(found[0])

    def merged(self):
        keys, n, *more = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(begins(keys))
        return keys[first], np.add.reduceat(n, first) if len(first) else n, *[m[order][first] for m in more]

    def rest(self):
        if self.held:
            yield self.merged()


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays of any lengths as compressed bytes. Arrays that never fall are kept as steps; of all, the first bytes of the values stand together, then the second, as far as any value has them."""
    head, planes = [len(arrays)], []
    for a in arrays:
        rising = len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if rising:
            a = np.diff(a, prepend=np.zeros(1, a.dtype))
        wide = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head += [a.dtype.itemsize, len(a), wide, int(rising)]
        planes.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize)[:, :wide].T.tobytes())
    raw = b"".join([np.array(head, np.int64).tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: pa.Scalar) -> list[np.ndarray]:
    data = packed.as_buffer()
    raw = pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), codec="zstd")
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(n, 4).tolist(), 8 * (1 + 4 * n), []
    for size, count, wide, rising in head:
        a = np.zeros((count, size), np.uint8)
        a[:, :wide] = np.frombuffer(raw, np.uint8, wide * count, at).reshape(wide, count).T
        a = a.reshape(-1).view(f"u{size}")
        out.append(np.cumsum(a, dtype=a.dtype) if rising else a)
        at += wide * count
    return out


def code_of(ids: np.ndarray) -> np.ndarray:
    """What stands for a word in grams, from its number."""
    return common.mix(ids.astype(np.uint64) + np.uint64(1))


class Slice(Grams):
    """Rows of a slice as numbers: for each token its place in the slice's list of words, which has each word's training count and its number if it is of the alphabet, else 0. ``training`` leaves out the rows that are held out."""

    def __init__(self, body: pa.Scalar, told: pa.Scalar, training: bool = False):
        ids, valid, held_out, size, self.of_word, *often = unpack(body)
        self.count, self.number = (x for x in unpack(told))
        self.doc_id, self.held_out, self.size = pa.array(ids.view(np.int64), mask=valid == 0), held_out != 0, size.astype(np.int64)
        if training:
            self.of_word, self.size = self.of_word[np.repeat(~self.held_out, self.size)], self.size[~self.held_out]
        if often:  # the words' places are by how often they occur
            self.of_word = np.argsort(-often[0].astype(np.int64), kind="stable").astype(np.uint32)[self.of_word]
        self.code = code_of(self.number)
        self.bounds = np.concatenate(([0], np.cumsum(self.size)))

    @cached_property
    def words(self) -> np.ndarray:
        return self.code[self.of_word]

    @cached_property
    def lead(self) -> np.ndarray:
        return lead(self.code)

    @cached_property
    def at(self) -> np.ndarray:
        return np.arange(len(self.of_word), dtype=np.int32) - np.repeat(self.bounds[:-1].astype(np.int32), self.size)

    def before(self, places: np.ndarray) -> np.ndarray:
        """How many tokens of its text are before each of some places in order."""
        return self.at[places].astype(np.int64) if len(places) > len(self.of_word) >> 5 or "at" in self.__dict__ else places - self.bounds[np.searchsorted(self.bounds, places, side="right") - 1]


def encoded(docs: DataFrame) -> DataFrame:
    """(slice, kind, data) of all rows: pieces of about SLICE bytes of text, each a body and its list of distinct words with a training count each. A body holds ids, tokens as places in that list by falling frequency, and the frequencies."""

    def sent(at, held, ids):
        words, size = (np.concatenate(x) for x in zip(*held, strict=True))
        same = Alike(words)
        words, of_word, often = same.keys, same.of(), same.counts
        del same
        held_out = crc_mod(ids, 10) == 0
        count = np.bincount(of_word[np.repeat(~held_out, size)], minlength=len(words)).astype(np.uint64)
        valid = np.array([x is not None for x in ids], np.uint8)
        place = np.empty(len(words), np.uint32)
        place[np.argsort(-often, kind="stable")] = np.arange(len(words), dtype=np.uint32)
        body = pack(np.array([x or 0 for x in ids], np.int64).view(np.uint64), valid, held_out.astype(np.uint8), size.astype(np.uint64), place[of_word], often.astype(np.uint32))
        return pa.RecordBatch.from_arrays([pa.array([at, at], pa.int64()), pa.array(["body", "words"]), pa.array([body, pack(words, count)], pa.binary())], ["slice", "kind", "data"])

    def run(batches):
        at, held, ids, room = common.task_number() << 32, [], [], SLICE
        for batch in batches:
            for part in slices(batch, 1, min(SLICE, 1 << 20)):
                words, bounds = tokens(part.column(1))
                held.append((words, np.diff(bounds)))
                ids += part.column(0).to_pylist()
                room -= part.column(1).nbytes
                if room <= 0:
                    at += 1
                    yield sent(at, held, ids)
                    held, ids, room = [], [], SLICE
                    common.trim()
        if held:
            yield sent(at + 1, held, ids)
            common.trim()

    return docs.mapInArrow(run, "slice long, kind string, data binary")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so keys in order are in order of their buckets; 0 gives each key its own."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) if buckets else keys).view(np.int64)


def cuts(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values."""
    at = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1], [True]))) if len(sorted_) else np.zeros(1, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _sent(name: list, bucket: list, packed: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(bucket, pa.int64()), pa.array(packed, pa.binary())], ["slice", "bucket", "sent"])


SENT, ASKED = "slice long, bucket long, sent binary", "grp long, bucket long, sent binary"


def look(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each wanted key is, whether it is there)."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


class Facts:
    """Sorted hashes, found by their first bits."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 1
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.start = np.concatenate(([0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)))).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As look() does."""
        if not len(self.keys):
            return look(self.keys, wanted)
        top = (wanted >> self.shift).view(np.int64)
        at = self.start[top]
        has = self.keys.take(at, mode="clip") == wanted  # where none has these bits it is another's
        left = np.flatnonzero(~has)
        end = self.start[top[left] + 1]
        while len(left):
            at[left] += 1
            on = at[left] < end
            left, end = left[on], end[on]
            has[left] = same = self.keys[at[left]] == wanted[left]
            left, end = left[~same], end[~same]
        at[~has] = 0
        return at, has


def counted(words: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, sent) with training count and number of the words of each slice; where slice is null, sums over a bucket: tokens, distinct words."""

    def ask(batches):
        for batch in batches:
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, count = unpack(words)
                bucket = bucket_of(keys, buckets)
                runs = cuts(bucket)
                yield _sent([name] * len(runs), [int(bucket[a]) for a, _ in runs], [pack(keys[a:b], count[a:b]) for a, b in runs])

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [unpack(x) for x in table.column("sent")]
        same = Alike(np.concatenate([k for k, _ in parts]))
        keys, of = same.keys, same.of()
        n = np.bincount(of, weights=np.concatenate([c for _, c in parts]).astype(float), minlength=len(keys)).astype(np.uint64)  # exact below 2 ** 53
        number, often = np.zeros(len(keys), np.uint64), n >= SYMBOL_MIN
        rank = np.flatnonzero(often)
        rank = rank[np.argsort(-n[rank].astype(np.int64), kind="stable")]  # frequent words have small numbers
        number[rank] = np.arange(len(rank), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)
        ends = np.cumsum([len(k) for k, _ in parts])[:-1]
        said = [pack(n[x], number[x].astype(np.uint32)) for x in np.split(of, ends)]
        sums = pack(np.array([n.sum(), (n > 0).sum()], np.uint64))
        return pa.table({"slice": pa.array(table.column("slice").to_pylist() + [None], pa.int64()), "bucket": pa.array([bucket] * (len(said) + 1), pa.int64()), "sent": pa.array([*said, sums], pa.binary())})

    return words.mapInArrow(ask, SENT).groupBy("bucket").applyInArrow(answer, SENT)


def numbered(bodies: DataFrame, told: DataFrame, groups: int) -> DataFrame:
    """(grp, slice, body, told): the slices with the counts and numbers of their words, those of a group one after another."""
    grp = F.expr(f"pmod(shiftright(slice, 32) * 5 + (slice & 4294967295L), {groups}L)").alias("grp")

    def run(held: pa.Table, said: pa.Table) -> pa.Table:
        said, out = said.sort_by([("slice", "ascending"), ("bucket", "ascending")]), {}
        for a, b in cuts(said.column("slice").to_numpy()):
            count, number = (np.concatenate(x) for x in zip(*[unpack(x) for x in said.column("sent").slice(a, b - a)], strict=True))
            out[said.column("slice")[a].as_py()] = pack(count, number)
        rows = held.select(["grp", "slice", "data"]).append_column("told", pa.array([out[x] for x in held.column("slice").to_pylist()], pa.binary())).rename_columns(["grp", "slice", "body", "told"])
        return pa.concat_tables([rows.slice(k, 1) for k in range(rows.num_rows)]) if rows.num_rows else rows  # each goes by itself

    said = told.where("slice is not null").select(grp, "slice", "bucket", "sent")
    return bodies.select(grp, "slice", "data").groupBy("grp").cogroup(said.groupBy("grp")).applyInArrow(run, "grp long, slice long, body binary, told binary")


def each(batches, training: bool = False):
    """The slices of a task."""
    for batch in batches:
        for body, told in zip(batch.column("body"), batch.column("told"), strict=True):
            yield Slice(body, told, training)
        common.trim()


@dataclass
class Sieve:
    """A filter of 64-bit hashes: it lets all that were put in pass, and few others. Its size is bounded; a fuller one only sieves less."""

    bits: int
    words: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in SHIFTS:
            at = (keys >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


def sieve(keys: DataFrame):
    """The broadcast filter of a column of hashes. Tasks send the bits they set, packed by blocks of 2 ** 22."""
    bits = min(SIEVE_BITS, max(SIEVE_LEAST, (16 * keys.count()).bit_length()))

    def sent(held):
        at = distinct(np.concatenate([(k >> np.uint64(shift)) & np.uint64((1 << bits) - 1) for k in held for shift in SHIFTS]))
        runs = cuts(at >> np.uint64(22))
        return pa.RecordBatch.from_arrays([pa.array([int(at[a]) >> 22 for a, _ in runs], pa.int32()), pa.array([pack(at[a:b]) for a, b in runs], pa.binary())], ["block", "words"])

    def ask(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                size += batch.num_rows
            if size > 1_000_000:
                yield sent(held)
                held, size = [], 0
        if held:
            yield sent(held)

    def join(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << 22, bool)
        for x in table.column("words"):
            out[(unpack(x)[0] & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return pa.table({"block": table.column("block").slice(0, 1), "words": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    found = np.zeros(max(1 << 16, 1 << bits - 6), np.uint64)
    with common.shuffles_dropped(keys.sparkSession):
        blocks = keys.mapInArrow(ask, "block int, words binary").groupBy("block").applyInArrow(join, "block int, words binary").collect()
    for r in blocks:  # 2 ** (SIEVE_BITS - 22) rows of 512 kB at most
        found[r.block << 16 : r.block + 1 << 16] = np.frombuffer(r.words, np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Sieve(bits, found))


def usable(g: Grams, d: int, often: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """The places of the grams of d + 1 words that round d can use.

    ``often``: which tokens end a frequent gram of d words; ``live``: which end a state of d - 1 words. A gram is of use if the parent of
    its context is a state, or if it may be a context of the next round. Its tail is frequent, and so are both words of a pair and both
    pairs of a trio; of longer ones the head need not have been counted unless it is a context.
    """
    use = (g.at >= d) & often
    if d <= 2:
        use &= np.roll(often, 1)
    if d > 1:
        use &= live | np.roll(live, 1)
    return np.flatnonzero(use)


#: What is found of the tree. A gram after a state: its count and probability, and the state; a gram that may be a state of the next round; a state: its count and that of its kept next words; a state that one of the last round ends with, which may grow on.
GRAM, HEAD, NODE, ALIVE = 0, 1, 2, 3
FOUND = "kind int, bucket long, key long, n long, m long, p double, head long, depth int"


def _found(kind: int, depth: int, bucket, key, n, m=None, p=None, head=None) -> pa.Table:
    size, long = len(key), lambda x: pa.nulls(size, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
    columns = [pa.array(np.full(size, kind, np.int32)), long(bucket), long(key), long(n), long(np.zeros(size, np.int64) if m is None else m), pa.nulls(size, pa.float64()) if p is None else pa.array(p), long(head), pa.array(np.full(size, depth, np.int32))]
    return pa.table(columns, names=[x.split()[0] for x in FOUND.split(", ")])


def gains(of: np.ndarray, context: np.ndarray, n: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which contexts are states, the count of each one's next words, the probability of each next word), from each next word's context, count and probability after the parent.

    The divergence is that between the two distributions over the kept next words and all others together.
    """
    add = lambda x: np.bincount(of, weights=x, minlength=len(context))
    c = context.astype(float)
    seen, share = add(n), n / c[of]
    rest, other = np.maximum(0.0, 1 - seen / np.maximum(c, 1)), np.clip(1 - add(parent), 1e-12, 1.0)
    gain = add(share * np.log(share / parent)) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / other), 0.0)
    base = c[of] + LAMBDA
    return (gain * c >= GAIN) & (seen > 0), seen.astype(np.int64), (base - seen[of]) / base * parent + n / base


def unstepped(context: list[np.ndarray], steps: np.ndarray) -> np.ndarray:
    """The next words' numbers from their steps, which begin anew with each context."""
    total = np.cumsum(steps, dtype=np.uint64)
    new = np.ones(len(steps), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in context])
    first = np.flatnonzero(new)
    return (total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(steps))))).astype(steps.dtype)


def ask_grams(coded: DataFrame, d: int, frequent, states, buckets: int) -> DataFrame:
    """(slice, bucket, sent): counts of the grams that round d can use, as numbers of words, by the last word of the context. In round 1 the words come with their counts."""

    def sent(found, words):
        key, n, *more = found
        if d == 1:
            more = [(key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint32)]
        bucket = bucket_of(code_of(more[d - 1]), buckets)
        # in order of their words they pack well; pairs come so
        order = np.lexsort((more[d], *more[: d - 1], more[d - 1], bucket)) if d > 1 else by_bucket(bucket)
        bucket, n, more = bucket[order], n[order].astype(np.uint64), [m[order] for m in more]
        runs, packed = cuts(bucket), []
        for a, b in runs:
            told = []
            if d == 1:  # head, next word, their counts
                ids = distinct(np.concatenate((more[0][a:b], more[1][a:b])))
                told = [ids, words[1][look(words[0], ids)[0]]]
            last = more[d][a:b].copy()
            same = np.logical_and.reduce([m[a + 1 : b] == m[a : b - 1] for m in more[:d]])
            last[1:][same] -= more[d][a : b - 1][same]  # after equal contexts, the step to the next word's number
            packed.append(pack(*[m[a:b] for m in more[:d]], last, n[a:b], *told))
        return _sent([0] * len(runs), [int(bucket[a]) for a, _ in runs], packed)

    def run(batches):
        sums, words = Sums(1_000_000), None
        for g in each(batches, training=True):
            if d == 1:
                ids, count = (x if words is None else np.concatenate((was, x)) for x, was in zip((g.number, g.count), words or (None, None), strict=True))
                same = Alike(ids)
                words, keys, more = (same.keys, count[same.at]), _pairs(g), []
            else:
                keys, *more = (np.concatenate(x) for x in zip(*_grams(g, d, frequent.value, states.value), strict=True))
            for found in sums.add(keys, *more):
                yield sent(found, words)
        for found in sums.rest():
            yield sent(found, words)

    return coded.mapInArrow(run, SENT)


def _pairs(g: Slice) -> np.ndarray:
    """The pairs of words of the alphabet in a slice, each as one number."""
    number = g.number[g.of_word].astype(np.uint64)
    keys = number[:-1] << np.uint64(32) | number[1:]
    both = (number[:-1] > 0) & (number[1:] > 0)
    both[g.bounds[1:-1] - 1] = False  # every text has a token, its end
    return keys[both]


def _grams(g: Slice, d: int, frequent: Sieve, states: Sieve):
    """(hash, number of each word) of the grams that round d can use, by pieces of a slice."""
    yield [np.zeros(0, np.uint64), *[np.zeros(0, np.uint32)] * (d + 1)]
    rows = distinct(np.searchsorted(g.bounds, np.arange(0, len(g.of_word) + PIECE, PIECE)).clip(0, len(g.bounds) - 1))
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        x = g.of_word[g.bounds[a] : g.bounds[b]]
        p, number = Grams.made(g.code[x], g.bounds[a : b + 1] - g.bounds[a]), g.number[x]
        less, grams = p.of(d - 1)
        at = usable(p, d, frequent.has(grams), states.has(less ^ np.uint64(STATE)))
        for k in range(d + 1):
            at = at[number[at - k] > 0]
        yield [p.longer(d, at, grams[at]), *[number[at - k] for k in range(d, -1, -1)]]


def grow(asks: DataFrame, last: DataFrame | None, d: int, norm: float, buckets: int) -> DataFrame:
    """What round d finds, in buckets: the context's last word has all that belongs together, but for the counts of the contexts, which come from their last word's."""

    def run(sent: pa.Table, prior: pa.Table | None) -> pa.Table:
        parts = [unpack(x) for x in sent.column("sent")]
        for p in parts:
            p[d] = unstepped(p[:d], p[d])
        empty = [_found(kind, d, *[np.zeros(0, np.int64)] * 3) for kind in (GRAM, HEAD, NODE)]
        if not parts:
            return pa.concat_tables(empty)
        *words, n = (np.concatenate(x) for x in zip(*[p[: d + 2] for p in parts], strict=True))
        if d == 1:
            same = Alike(words[0].astype(np.uint64) << np.uint64(32) | words[1])
        else:
            key = code_of(words[d])
            for k in range(1, d + 1):
                key = joined(code_of(words[d - k]), key)
            same = Alike(key)
        # sums over the counts in order of their keys: exact, since they are whole numbers
        n = np.add.reduceat(n[same.order].astype(np.int64), np.cumsum(same.counts) - same.counts) if len(n) else n.astype(np.int64)
        often = np.flatnonzero(n >= NEXT_MIN)
        n, words = n[often], [w[same.at[often]] for w in words]
        key, head = code_of(words[d]), code_of(words[d - 1])
        for k in range(1, d + 1):
            tail, key = key, joined(code_of(words[d - k]), key)
            head = joined(code_of(words[d - k]), head) if k > 1 else head
        order = np.argsort(key)
        key, head, tail, n, words = key[order], head[order], tail[order], n[order], [w[order] for w in words]
        last_word = words[d]
        if d == 1:
            same = Alike(np.concatenate([p[-2] for p in parts]))
            ids, told = same.keys, np.concatenate([p[-1] for p in parts])[same.at].astype(float)
            c, parent = told[look(ids, words[0])[0]], (told[look(ids, last_word)[0]] + 0.1) / norm
            test = np.ones(len(key), bool)
        else:
            kind, facts = prior.column("kind").to_numpy(), [prior.column(x).to_numpy(zero_copy_only=False) for x in ("key", "n", "p")]
            (tails, _, p), (heads, count, _) = ([x[kind == k][np.argsort(facts[0][kind == k].view(np.uint64))] for x in facts] for k in (GRAM, HEAD))
            (t, has_tail), (h, has_head) = look(tails.view(np.uint64), tail), look(heads.view(np.uint64), head)
            test = has_tail & has_head
            c, parent = count[h[test]].astype(float), p[t[test]]
        same = Alike(head[test])
        nodes, at, of = same.keys, same.at, same.of()
        kept, seen, p = gains(of, c[at], n[test], parent)
        on = kept[of]
        out = [_found(GRAM, d, bucket_of(code_of(words[d - 1][test][on]), buckets), key[test][on], n[test][on], p=p[on], head=head[test][on]), _found(NODE, d, None, nodes[kept] ^ np.uint64(STATE), c[at][kept].astype(np.int64), seen[kept])] if kept.any() else []
        return pa.concat_tables([*empty, _found(HEAD, d, bucket_of(code_of(last_word), buckets), key, n), *out]) if len(key) else pa.concat_tables(empty)

    if last is None:
        return asks.groupBy("bucket").applyInArrow(lambda sent: run(sent, None), FOUND)
    return asks.groupBy("bucket").cogroup(last.where("bucket is not null").groupBy("bucket")).applyInArrow(run, FOUND)


def ask_places(coded: DataFrame, d: int, ahead: int, states, buckets: int) -> DataFrame:
    """(slice, bucket, sent): each place after a state of d words, by the state, as the numbers of its word, of the state's and of ``ahead`` more before them; what places share is sent once."""

    def run(batches):
        for g in each(batches, training=True):
            found = [(at, state, room) for k, at, state, _, _, room in states_at(g, d, lambda keys: (None, states.value.has(keys)), False) if k == d]
            if not found:
                continue
            at, state, room = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = bucket_of(state ^ np.uint64(STATE), buckets)
            order = by_bucket(bucket)
            bucket, at = bucket[order], at[order]
            end = at + 1
            room = np.minimum(room[order] - d, ahead)
            start, apart = at - d - room, np.ones(len(at), bool)
            apart[1:] = bucket[1:] != bucket[:-1]
            fresh = end - np.where(apart, start, np.maximum(start, np.concatenate(([0], end[:-1]))))
            ends = np.cumsum(fresh)
            words = g.number[g.of_word[np.arange(ends[-1]) + np.repeat(end - ends, fresh)]]
            runs, packed = cuts(bucket), []
            for a, b in runs:
                before = ends[a - 1] if a else 0
                packed.append(pack(words[before : ends[b - 1]], (ends[a:b] - before).astype(np.uint64), room[a:b].astype(np.uint32)))
            yield _sent([0] * len(runs), [int(bucket[a]) for a, _ in runs], packed)

    return coded.mapInArrow(run, SENT)


def grown(words, at, room, times, context, gram, p, d: int, to: int, left: list):
    """Yields (round, state rows, gram rows) of the rounds from d + 1 to ``to``, from places after states of d words: the words before ``at``, ``room`` of them, how many places are so, the state, and the gram with the place's word (0: not of the alphabet) and its probability. ``left`` gets what is left of the places: which, their states, grams and probabilities."""
    who = np.arange(len(at))
    while len(at) and d < to:
        d += 1
        on = room > 0
        on[on] = words[at[on] - 1] > 0
        at, room, who, context, gram, p = at[on] - 1, room[on] - 1, who[on], context[on], gram[on], p[on]
        first = code_of(words[at])
        same = Alike(joined(first, context))
        nodes, of_node = same.keys, same.of()
        c = np.bincount(of_node, weights=times[who], minlength=len(nodes)).astype(np.int64)
        on = c[of_node] >= NEXT_MIN
        if not on.any():
            return
        at, room, who, first, context, gram, p = at[on], room[on], who[on], first[on], nodes[of_node[on]], gram[on], p[on]
        gram = np.where(gram > 0, joined(first, gram), np.uint64(0))
        same = Alike(gram)
        keys, one, of_key = same.keys, same.at, same.of()
        n = np.bincount(of_key, weights=times[who], minlength=len(keys)).astype(np.int64)
        often = (n >= NEXT_MIN) & (keys > 0)
        nexts = np.flatnonzero(often)
        node = look(nodes, context[one[nexts]])[0]
        kept, seen, after = gains(node, c, n[nexts], p[one[nexts]])
        on = kept[node]
        yield d, (nodes[kept], c[kept], seen[kept]), (keys[nexts][on], n[nexts][on], after[on], nodes[node][on])
        told = np.full(len(keys), np.nan)
        told[nexts[on]] = after[on]
        live = kept[look(nodes, context)[0]]
        at, room, who, context, gram, p = at[live], room[live], who[live], context[live], np.where(np.isnan(told[of_key[live]]), np.uint64(0), gram[live]), told[of_key[live]]
    if len(at):
        left += [who, context, gram, p]


def tails(words: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
    """The distinct states that those of d words from ``at`` on end with, themselves included."""
    found = [context := code_of(words[at + d - 1])]
    for k in range(2, d + 1):
        context = joined(code_of(words[at + d - k]), context)
        found.append(distinct(context))
    return distinct(np.concatenate(found))


def grow_on(asks: DataFrame, last: DataFrame, d: int, to: int, buckets: int) -> DataFrame:
    """What the rounds from d + 1 to ``to`` find, each bucket's subtrees by themselves."""
    own = F.col("head") if not buckets else F.expr(f"shiftrightunsigned(shiftrightunsigned(head, 32) * {buckets}L, 32)")
    last = last.where(f"kind = {GRAM} AND depth = {d}").select(own.alias("bucket"), "key", "p", "head")

    def run(sent: pa.Table, prior: pa.Table) -> pa.Table:
        out = [_found(GRAM, d, *[np.zeros(0, np.int64)] * 3)]
        if sent.num_rows and prior.num_rows:
            parts = [unpack(x) for x in sent.column("sent")]
            sizes = np.cumsum([0, *[len(p[0]) for p in parts]])
            words, room = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
            at = np.concatenate([p[1].astype(np.int64) + s for p, s in zip(parts, sizes[:-1], strict=True)]) - 1
            del parts
            context, gram = code_of(words[at - 1]), joined(code_of(words[at - 1]), code_of(words[at]))
            for k in range(2, d + 1):
                context, gram = (joined(code_of(words[at - k]), x) for x in (context, gram))
            gram = np.where(words[at] > 0, gram, np.uint64(0))
            at = at - d  # the words before it are to come
            key, p, head = (prior.column(x).to_numpy() for x in ("key", "p", "head"))
            order = np.argsort(key.view(np.uint64))
            key, p = key.view(np.uint64)[order], p[order]
            live = look(distinct(head.view(np.uint64)), context)[1]
            at, room, context, gram = at[live], room[live], context[live], gram[live]
            where, has = look(key, gram)
            gram, p, done = np.where(has, gram, np.uint64(0)), np.where(has, p[where], np.nan), d
            while len(at) and done < to:
                # places with the same state, gram and next words before them grow alike in these rounds
                step, left = min(STEP, to - done), []
                same = Alike(joined(joined(context, gram), common.hash_segments(words, at - np.minimum(room, step), at)))
                one = same.at
                for r, (nodes, c, seen), (keys, n, after, of) in grown(words, at[one], room[one], same.counts, context[one], gram[one], p[one], done, done + step, left):
                    out += [_found(NODE, r, None, nodes ^ np.uint64(STATE), c, seen), _found(GRAM, r, None, keys, n, p=after, head=of)]
                where = np.full(len(one), -1)
                if left:
                    where[left[0]] = np.arange(len(left[0]))
                where = where[same.of()]
                on = where >= 0
                at, room, done = at[on] - step, room[on] - step, done + step
                if left:
                    context, gram, p = (x[where[on]] for x in left[1:])
            if len(at):
                ends = tails(words, at[Alike(context).at], to)
                out.append(_found(ALIVE, to, None, ends ^ np.uint64(STATE), np.zeros(len(ends), np.int64)))
        common.trim()
        return pa.concat_tables(out).combine_chunks()

    return asks.groupBy("bucket").cogroup(last.groupBy("bucket")).applyInArrow(run, FOUND)


def fit(coded: DataFrame, total: int, distinct: int, depth: int | None = None) -> tuple[int, DataFrame | None]:
    """(depth reached, (key, n, m) of all grams after states and of all states) of the training rows; the table grows with the input.

    n is the count of a state or of a state's next word; m is the count that a state's next words add up to.
    """
    norm, d, found, last, frequent, states = float(total + 0.1 * (distinct + 1)), 0, [], None, None, None
    buckets = buckets_for(coded.sparkSession, total)
    nodes = lambda tables: sieve(reduce(DataFrame.unionByName, tables).where(f"kind = {NODE}").select("key"))
    while d < NARROW - 1 and (depth is None or d < depth):
        last = written(grow(ask_grams(coded, d + 1, frequent, states, buckets), last, d + 1, norm, buckets))
        found.append(last)
        if not last.where(f"kind = {NODE}").head(1):
            break
        d += 1
        if d < NARROW - 1:
            frequent = sieve(last.where(f"kind = {HEAD}").select("key"))
            states = nodes([last])
    else:
        ahead, states = AHEAD, None
        while d and (depth is None or d < depth):
            to = d + ahead if depth is None else min(depth, d + ahead)
            places = last.where(f"kind = {NODE} AND depth = {d}").agg(F.sum("n")).first()[0] or 0
            shares = min(buckets, max(1, -(-places // PLACES))) if ONE_TASK_TOKENS else 0
            # few states grow on; all that they end with are states, so other places are soon left
            states = sieve(last.where(f"kind = {ALIVE}").select("key")) if states else nodes(found)
            last = written(grow_on(ask_places(coded, d, ahead, states, shares), last, d, to, shares))
            found.append(last)
            reached = last.where(f"kind = {NODE}").agg(F.max("depth")).first()[0]
            d, before = reached or d, d
            if d < to or d == before:
                break
            ahead *= AHEAD
    known = written(reduce(DataFrame.unionByName, found).where(f"kind IN ({GRAM}, {NODE})").select("key", "n", "m")) if d else None
    for table in found:
        common.drop_written(table)
    return d, known


def buckets_for(spark: SparkSession, total: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))


def states_at(g: Slice, depth: int, known, grams: bool = True):
    """(d, places whose d words before them may be a state, those states' hashes, where they are known, the places' grams of d + 1 words, the tokens of its text before each place), while there are any.

    ``known(keys)`` says where states are and which there are; a longer one is looked for only after those that are. A place's rounds
    come in order.
    """
    if not depth:
        return
    state_one, rest = g.code ^ np.uint64(STATE), []
    where_one, one = known(state_one)
    one = one & (g.number > 0)

    def follow(d, to, at, room, context, gram):
        """From places that come after possible states of d words; leaves what is left for later rounds in ``rest``."""
        while len(at) and d <= to:
            state = context ^ np.uint64(STATE)
            where, live = known(state)
            at, room, context, gram, state, where = (None if x is None else x[live] for x in (at, room, context, gram, state, where))
            if not len(at):
                return
            yield d, at, state, where, gram, room
            at, room, context, gram = further(d, at, room, context, gram)
            d += 1
        if len(at):
            rest.append((at, room, context, gram))

    def further(d, at, room, context, gram):
        on = room > d
        at, room, context, gram = (None if x is None else x[on] for x in (at, room, context, gram))
        before = g.lead[g.of_word[at - d - 1]]
        return at, room, _round(context, before), None if gram is None else _round(gram, before)

    for a in range(0, len(g.of_word), PIECE):
        last = g.of_word[max(0, a - 1) : a + PIECE - 1]  # the words before the places
        at = np.flatnonzero(one[last]) + max(1, a)
        room = g.before(at)
        on = room > 0
        at, room = at[on], room[on]
        if not len(at):
            continue
        last = g.of_word[at - 1]
        context = g.code[last]
        gram = _round(g.code[g.of_word[at]], g.lead[last]) if grams else None
        yield 1, at, state_one[last], None if where_one is None else where_one[last], gram, room
        if depth > 1:
            yield from follow(2, min(depth, TOGETHER - 1), *further(1, at, room, context, gram))
    if rest and depth >= TOGETHER:
        parts = [None if x[0] is None else np.concatenate(x) for x in zip(*rest, strict=True)]
        yield from follow(TOGETHER, depth, *parts)


def keys_of(g: Slice, depth: int, states: Sieve) -> np.ndarray:
    """The distinct keys that may be known of the contexts of some texts, round by round as far as any may be a state."""
    one = g.code ^ np.uint64(STATE)
    found = [one[states.has(one)]]
    for d, _, state, _, gram, _ in states_at(g, depth, lambda keys: (None, states.has(keys))):
        if d > 1:
            found.append(distinct(state))
        found.append(distinct(gram[states.has(gram)]))
    return distinct(np.concatenate(found))


def _asked(coded: DataFrame, states, depth: int, buckets: int, bits: int) -> DataFrame:
    """(grp, bucket, sent): the first bits of the distinct keys of each group's slices in order, packed by bucket. All keys that share them come back whole, so the bits lose nothing."""

    def sent(grp, held):
        keys = distinct(np.concatenate(held))
        bucket = bucket_of(keys, buckets)
        runs, short = cuts(bucket), keys >> np.uint64(64 - bits)
        return pa.RecordBatch.from_arrays([pa.array([grp] * len(runs), pa.int64()), pa.array([int(bucket[a]) for a, _ in runs], pa.int64()), pa.array([pack(distinct(short[a:b])) for a, b in runs], pa.binary())], ["grp", "bucket", "sent"])

    def run(batches):
        grp, held = None, []
        for batch in batches:
            for name, body, told in zip(*(batch.column(c) for c in ("grp", "body", "told")), strict=True):
                if held and name.as_py() != grp:
                    yield sent(grp, held)
                    held = []
                grp = name.as_py()
                held.append(keys_of(Slice(body, told), depth, states.value))
            common.trim()
        if held:
            yield sent(grp, held)

    return coded.select("grp", "body", "told").mapInArrow(run, ASKED)


def _answered(asks: DataFrame, known: DataFrame, bits: int) -> DataFrame:
    """(grp, bucket, sent): the keys that are known, of those asked, with their n and m."""

    def answer(asked: pa.Table, facts: pa.Table) -> pa.Table:
        keys = facts.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, n, m = keys[order], *(facts.column(c).to_numpy().view(np.uint64)[order] for c in ("n", "m"))
        short, said = keys >> np.uint64(64 - bits), []
        for sent in asked.column("sent"):
            hit = look(unpack(sent)[0], short)[1]
            said.append(pack(keys[hit], n[hit], m[hit]))
        return pa.table({"grp": asked.column("grp"), "bucket": asked.column("bucket"), "sent": pa.array(said, pa.binary())})

    return asks.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, ASKED)


def probabilities(g: Slice, depth: int, root: np.ndarray, keys: np.ndarray | Facts, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log10 of each token's probability. After hundreds of states one may be below the least double, so powers of ten are kept apart."""
    p, low, facts = root[g.of_word], None, keys if isinstance(keys, Facts) else Facts(keys)
    for _, at, _, s, gram, _ in states_at(g, depth, facts.find):
        x, has = facts.find(gram)
        base = n[s] + LAMBDA
        own, less = np.where(has, n[x], 0) / base, (base - m[s]) / base * p[at]
        deep = (less < 1e-200) & ~has
        if low is None:
            if not deep.any():
                p[at] = less + own
                continue
            low = np.zeros(len(p))
        was = low[at]
        less[deep] *= 1e200
        p[at] = np.where(has & (was < 0), own, less + own)  # what is left of one so low does not count
        low[at] = np.where(has, 0.0, was - 200.0 * deep)
    return np.log10(p) if low is None else np.log10(p) + low


def _scored(coded: DataFrame, answers: DataFrame | None, depth: int, total: int, distinct: int) -> DataFrame:
    """The rows of each group with what its answers make of them."""
    norm = float(total + 0.1 * (distinct + 1))

    def score_of(g: Slice, keys, n, m) -> pa.Table:
        root, add = (g.count + 0.1) / norm, lambda v, kind: np.add.reduceat(v, g.bounds[:-1], dtype=kind)
        done = [add((g.count > 0)[g.of_word], np.int64), np.full(len(g.size), total), add(np.log10(root)[g.of_word], float), add(probabilities(g, depth, root, keys, n, m), float)]
        return pa.table([g.doc_id, pa.array(g.held_out), pa.array(g.size), *map(pa.array, done)], names=RESULT)

    def run(held: pa.Table, told: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in told.sort_by("bucket").column("sent")] or [[np.zeros(0, np.uint64)] * 3]
        facts = []
        for k in range(3):  # a column at a time, since all of a group's facts are held while its slices are scored
            facts.append(np.concatenate([p[k] for p in parts]))
            for p in parts:
                p[k] = None
        if (facts[0][1:] < facts[0][:-1]).any():
            order = np.argsort(facts[0])
            for k in range(3):
                facts[k] = facts[k][order]
            del order
        common.trim()
        facts[0] = Facts(facts[0])
        out = [score_of(Slice(body, said), facts[0], *(x.view(np.int64) for x in facts[1:])) for body, said in zip(held.column("body"), held.column("told"), strict=True)]
        common.trim()
        return pa.concat_tables(out)

    def alone(batches):
        none = np.zeros(0, np.uint64)
        for g in each(batches):
            yield from score_of(g, none, none, none).to_batches()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if answers is None:
        return coded.mapInArrow(alone, schema)
    return coded.select("grp", "body", "told").groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(run, schema)


def score(docs: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Training rows are those whose id's crc32 is not 0 modulo 10 (a null id trains). Null text is the end token alone. Rows with equal
    ids are scored each, and count in training each. Without training rows every token is unknown: N and V are 0. Whole texts are
    read; other columns are not. ``depth`` bounds the words of a context; by default they grow until none diverges from its parent.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    docs, spark = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), docs.sparkSession
    bodies, words = common.written_apart(encoded(docs), "kind", ["body", "words"])
    told = written(counted(words, buckets_for(spark, 0)))
    common.drop_written(words)
    sums = [unpack(pa.scalar(bytes(r.sent)))[0] for r in told.where("slice is null").select("sent").collect()]
    total, distinct = (int(sum(s[k] for s in sums)) for k in (0, 1))
    count = bodies.count()
    coded = written(numbered(bodies, told, max(1, count // GROUP, min(count, 2 * spark.sparkContext.defaultParallelism))))  # two a core at least
    for table in (bodies, told):
        common.drop_written(table)
    reached, known = fit(coded, total, distinct, depth)
    if known is None:
        return _scored(coded, None, 0, total, distinct)
    buckets = buckets_for(spark, total)
    bucket = F.expr(f"shiftrightunsigned(shiftrightunsigned(key, 32) * {buckets}L, 32)").alias("bucket")
    bits = min(64, known.count().bit_length() + 8)
    answers = _answered(_asked(coded, sieve(known.select("key")), reached, buckets, bits), known.select(bucket, "key", "n", "m"), bits)
    return _scored(coded, answers, reached, total, distinct)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

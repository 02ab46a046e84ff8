"""The suffix tree against one grown slowly from all sequences of words."""

import collections
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class SlowTree:
    """All counts of sequences in one process; states round by round, each by its definition."""

    def __init__(self, rows, deepest=17):
        texts = [self.tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
        self.n = collections.Counter(tuple(w[k : k + size]) for w in texts for k in range(len(w)) for size in range(1, deepest + 2) if k + size <= len(w))
        self.total, self.distinct = sum(len(w) for w in texts), sum(len(s) == 1 for s in self.n)
        after = collections.defaultdict(list)
        for s, n in self.n.items():
            if len(s) > 1 and n >= lm.NEXT_MIN and (len(s) > 2 or all(self.n[(x,)] >= lm.SYMBOL_MIN for x in s)) and all(self.n[(x,)] >= lm.SYMBOL_MIN for x in s):
                after[s[:-1]].append(s[-1])
        self.states, d = {(): None}, 1
        while True:
            new = {}
            for s, nexts in after.items():
                if len(s) == d and s[1:] in self.states:
                    c, seen = self.n[s], sum(self.n[(*s, x)] for x in nexts)
                    gain = sum(self.n[(*s, x)] / c * math.log(self.n[(*s, x)] / c / self.p(s[1:], x)) for x in nexts)
                    left, other = max(0, 1 - seen / c), min(1, max(1e-12, 1 - sum(self.p(s[1:], x) for x in nexts)))
                    gain += left * math.log(left / other) if left > 0 else 0
                    if gain * c >= lm.GAIN:
                        new[s] = (c, seen, set(nexts))
            if not new:
                break
            self.states |= new
            d += 1
        self.depth = d - 1

    @staticmethod
    def tokens(text):
        return [*WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})), "\n"]

    def p(self, s, x):
        """Of x after s, whose suffixes are states as far as they are."""
        p = (self.n[(x,)] + 0.1) / (self.total + 0.1 * (self.distinct + 1))
        for k in range(len(s) - 1, -1, -1):
            if s[k:] not in self.states:
                break
            c, seen, nexts = self.states[s[k:]]
            p = (c - seen + lm.LAMBDA) / (c + lm.LAMBDA) * p + (self.n[(*s[k:], x)] if x in nexts else 0) / (c + lm.LAMBDA)
        return p

    def score(self, text):
        w = self.tokens(text)
        return sum(math.log10(self.p(tuple(w[:k]), x)) for k, x in enumerate(w))


def corpus():
    r = random.Random(5)
    rows = []
    for k in range(300):  # the third word of a trio depends on its second and on the text, which only older words tell
        rows.append((k, " ".join(f"a{x} b{x if r.random() < 0.8 else 3} c{(x * x + k % 2) % 7}" for x in (r.randint(0, 9) for _ in range(12)))))
    rows += [(5000 + k, "rare pair here") for k in range(40)] + [(20_000 + k, f"x{k % 2} y y y y y z{k % 2} end") for k in range(900)] + [(6000 + k, "One long Copy that goes on and on and on to its end") for k in range(60)]
    return rows + [(7000, None), (7001, ""), (None, "no id a1 b1 c1"), (5000, "rare pair here"), (7002, "unknown words only")]


@pytest.fixture(scope="module")
def tree():
    return SlowTree(corpus())


@pytest.mark.parametrize("tokens", [0, lm.ONE_TASK_TOKENS])
def test_scores_equal_those_of_a_slow_tree(spark, tree, monkeypatch, tokens):
    common.ship(spark)
    monkeypatch.setattr(lm, "ONE_TASK_TOKENS", tokens)  # all rounds as jobs, or the last ones in a task
    monkeypatch.setattr(lm, "NARROW", 3)
    assert tree.depth >= 5  # deeper than a model of three words, and than the round from which rows are left out
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus()], "doc_id long, text string, slice string, n int").repartition(5)
    got = lm.score(df).collect()
    want = collections.Counter((i, round(tree.score(t), 7)) for i, t in corpus())
    assert collections.Counter((r.doc_id, round(r.score, 7)) for r in got) == want
    shallow = {r.doc_id: r for r in lm.score(df, depth=0).collect()}
    assert all(r.score == pytest.approx(r.base_score, abs=1e-9) for r in shallow.values())


def test_states_sum_to_one(tree):
    words = [s[0] for s in tree.n if len(s) == 1]
    unknown = 1 - sum((tree.n[(x,)] + 0.1) / (tree.total + 0.1 * (tree.distinct + 1)) for x in words)
    for s in tree.states:
        rest = unknown
        for k in range(len(s) - 1, -1, -1):
            c, seen, _ = tree.states[s[k:]]
            rest *= (c - seen + lm.LAMBDA) / (c + lm.LAMBDA)
        assert sum(tree.p(s, x) for x in words) + rest == pytest.approx(1)


def test_states_do_not_depend_on_the_size(spark):
    common.ship(spark)
    # so many other tokens, all distinct, that shares of 5e-6 and 1e-6 would ask for more than 32 and 8 sightings
    far = spark.range(10_000, 10_150).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 70000), j -> concat('z', id, '_', j)))").alias("text"))
    few = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4)
    small = {r.doc_id: r for r in lm.score(few).collect()}
    large = {r.doc_id: r for r in lm.score(few.union(far)).collect()}
    assert large[0].train_tokens > 8_000_000
    for k in (*range(300), *range(6000, 6060)):
        assert large[k].score - large[k].base_score > 0.9 * (small[k].score - small[k].base_score) > 0.9


def test_hashes_are_those_of_spark(spark):
    rows = [(k * 7919 - 10**18, (k << 40) - k) for k in range(-50, 50)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    import numpy as np

    a, b = (np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in (0, 1))
    assert lm.joined(a, b).view(np.int64).tolist() == got


def test_grams_stay_in_their_text():
    g = lm.Grams(pa.array(["a b c", None, "a b c"]))
    less, full = g.of(2)
    on = g.at >= 2
    assert on.sum() == 4 and (full[on][:2] == full[on][2:]).all() and (less == g.of(1)[1]).all()
    assert (g.longer(2, on.nonzero()[0], less[on]) == full[on]).all()


def test_held_out_texts_gain_over_the_base(spark):
    """Text with order is foretold better than by its words alone, on rows that trained nothing."""
    common.ship(spark)
    got = lm.score(spark.createDataFrame(corpus(), "doc_id long, text string")).where("held_out and doc_id < 300").selectExpr("avg(score / n_tokens) AS s", "avg(base_score / n_tokens) AS b").first()
    assert got.s > got.b + 0.3


def test_rounds_share_passes(spark, tree, monkeypatch):
    """The rows are read once, and deep rounds need no pass each."""
    common.ship(spark)
    passes, texts, ask, encoded = [], [], lm.ask_places, lm.encoded
    monkeypatch.setattr(lm, "NARROW", 2)
    monkeypatch.setattr(lm, "ask_places", lambda *a: passes.append(a[1:3]) or ask(*a))
    monkeypatch.setattr(lm, "encoded", lambda df: texts.append(df) or encoded(df))
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)).collect()}
    assert got[6000] == pytest.approx(tree.score("One long Copy that goes on and on and on to its end"), abs=1e-7)
    assert tree.depth >= 5 and passes == [(1, 8)] and len(texts) == 1


def test_deep_states_leave_a_finite_score():
    """A word that none of hundreds of states foretells; its probability is below the least double."""
    import numpy as np

    words, deep = 400, 300
    one = lambda *x: pa.scalar(lm.pack(*x))
    g = lm.Slice(one(np.zeros(1, np.uint64), np.ones(1, np.uint8), np.zeros(1, np.uint8), np.array([words], np.uint64), np.array([0] * (words - 1) + [1], np.uint32)), one(np.array([10**6, 50], np.uint64), np.array([1, 2], np.uint32)))
    state, keys = g.code[:1], []
    for _ in range(deep):
        keys.append(state[0] ^ np.uint64(lm.STATE))
        state = lm.joined(g.code[:1], state)
    keys, n = np.sort(np.array(keys, np.uint64)), np.full(deep, 10**6)
    p = lm.probabilities(g, deep, np.array([0.5, 0.25]), keys, n, n)
    assert p[-1] == pytest.approx(math.log10(0.25) + deep * math.log10(lm.LAMBDA / (10**6 + lm.LAMBDA)), rel=1e-9)
    assert p[0] == pytest.approx(math.log10(0.5)) and np.isfinite(p).all()


def test_packs_are_whole_and_short():
    import numpy as np

    r = np.random.default_rng(1)
    arrays = [np.sort(r.integers(0, 1 << 63, 100_000).astype(np.uint64)), r.integers(0, 200, 50).astype(np.uint64), np.array([2**64 - 1, 0], np.uint64), np.zeros(0, np.uint32), np.array([7], np.uint8), np.array([3, 3, 2**32 - 1], np.uint32)]
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, lm.unpack(pa.scalar(lm.pack(*arrays))), strict=True))
    assert len(lm.pack(arrays[0])) < 6.5 * len(arrays[0])  # keys in order, of 8 bytes each


def test_steps_begin_anew_with_each_context():
    import numpy as np

    context, steps = np.array([1, 1, 1, 2, 3, 3], np.uint32), np.array([5, 2, 0, 4, 9, 1], np.uint32)
    assert lm.unstepped([context], steps).tolist() == [5, 7, 7, 4, 9, 10]


def repeated():
    """The longer the run of a word, the nearer its end, as long contexts tell."""
    return [(k, "y " * 12 + f"z u{k % 3}") for k in range(10_000)]


def test_rounds_beyond_a_pass_and_a_step_count_the_same(spark, monkeypatch):
    """Deep states of a repeated line: passes follow only what may grow on, and equal places count as one."""
    common.ship(spark)
    slow = SlowTree(repeated(), deepest=14)
    passes, ask = [], lm.ask_places
    monkeypatch.setattr(lm, "ask_places", lambda *a: passes.append(a[1]) or ask(*a))
    monkeypatch.setattr(lm, "NARROW", 2)
    monkeypatch.setattr(lm, "STEP", 3)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(repeated(), "doc_id long, text string").repartition(3)).collect()}
    assert slow.depth > 9 and passes == [1, 9]
    assert all(got[i] == pytest.approx(slow.score(t), abs=1e-7) for i, t in repeated()[:30])


def test_places_with_equal_words_before_them_grow_as_one():
    import numpy as np

    words = np.tile(np.array([1, 2, 3], np.uint32), 200)
    at = np.arange(100, 500)  # the word before each is the state
    code = lm.code_of(words)
    one = lambda take, times: [x[:2] for x in lm.grown(words, at[take] - 1, np.full(len(take), 40), times, code[at[take] - 1], lm.joined(code[at[take] - 1], code[at[take]]), np.full(len(take), 0.3), 1, 9, [])]
    all_, few = one(np.arange(400), np.ones(400, np.int64)), one(np.arange(3), np.array([134, 133, 133]))
    assert all_ and all(a[0] == b[0] and all((x == y).all() for x, y in zip(a[1], b[1], strict=True)) for a, b in zip(all_, few, strict=True))


def test_slices_hold_rows_of_many_batches():
    """A slice is filled from several batches, so that its words and deep rounds are paid for once, not for each batch of 2,000 rows."""
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([f"a b c{k}"])], ["doc_id", "text"]) for k in range(40)]

    class Frame:
        def mapInArrow(self, run, schema):
            return [kind for out in run(iter(batches)) for kind in out.column("kind").to_pylist()]

    assert lm.encoded(Frame()) == ["body", "words"]


def test_keys_are_found_whether_or_not_they_are_there():
    import numpy as np

    r = np.random.default_rng(2)
    keys = np.unique(np.concatenate([r.integers(0, 1 << 63, 5000).astype(np.uint64), np.arange(50, dtype=np.uint64), np.array([2**64 - 1], np.uint64)]))
    wanted = np.concatenate([keys, keys + np.uint64(1), r.integers(0, 1 << 63, 5000).astype(np.uint64)])
    at, has = lm.Facts(keys).find(wanted)
    assert (has == np.isin(wanted, keys)).all() and (keys[at[has]] == wanted[has]).all()
    assert not lm.Facts(keys[:0]).find(wanted)[1].any()


def test_few_places_are_dealt_to_few_buckets(spark, monkeypatch):
    """A bucket's rounds cost a call each; tens of buckets with next to no places stood one after another in a task."""
    common.ship(spark)
    dealt, ask = [], lm.ask_places
    monkeypatch.setattr(lm, "ask_places", lambda *a: dealt.append(a[4]) or ask(*a))
    monkeypatch.setattr(lm, "NARROW", 2)
    lm.score(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)).count()
    assert lm.buckets_for(spark, 0) > 1 and dealt == [1]

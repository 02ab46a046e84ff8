"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over hashed unigrams and bigrams are counted over all documents: the target's from those labelled good, the raw
one from every row. A document's score is the mean log ratio of its n-grams; those under one threshold for all go. The target is counted on
one half of the labelled rows, by hash of the id, and the threshold read off the scores of the other half, which the target has not
seen, as the highest that keeps nearly every good one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Words, buffers, crc_mod, hash_segments, mix, runs, shingles, slices, sum_vectors

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Bytes by kind: 0 white space, 1 letters, digits and everything beyond ASCII, 2 the rest.
KINDS = np.full(256, 2, dtype=np.uint8)
KINDS[0x80:] = 1
KINDS[[c for c in range(128) if chr(c).isalnum()]] = 1
KINDS[common.SPACES] = 0

BITS = 14
SLOTS = 16
BINS, LOW, HIGH = 4096, -8.0, 8.0
#: The classifier is fitted on so many labelled rows at most, those with the smallest hash of their id.
MAX_LABELLED = 200_000
#: The share of labelled good rows that the threshold may reject.
SPARE = 0.0005


def base_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The six base columns of a batch; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = Words(texts, lower=False)
    n, data, offsets = len(words.counts), words.raw, words.offsets
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    out = {"n_words": words.counts.astype(np.int64)}
    out["word_chars"] = sums((~common.SPACES)[data] & ((data & 0xC0) != 0x80)).astype(np.int64)
    out["n_symbols"] = sums(SYMBOLS[data]).astype(np.int64)
    starts, ends = runs(data != 0x0A, offsets)  # lines that aren't empty
    lines = hash_segments(data, starts, ends)
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    lines, owner = lines[has_word], (np.searchsorted(offsets, starts, side="right") - 1)[has_word]
    order = np.lexsort((lines, owner))
    same = (lines[order][1:] == lines[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][1:][same], minlength=n).astype(np.int64)
    owner, windows = shingles(words.hashes(), words.bounds)
    long = words.counts[owner] >= 5
    owner, windows = owner[long], windows[long]
    rank = np.where(words.counts >= 5, words.counts - 4, 0)
    at = np.arange(len(windows)) - np.repeat(np.cumsum(rank) - rank, rank) + np.repeat(words.bounds[:-1], rank)
    order = np.lexsort((windows, owner))
    twin = (windows[order][1:] == windows[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.zeros(len(windows), bool)
    again[order[1:][twin]] = True
    again[order[:-1][twin]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + 5, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.diff(np.concatenate(([0], np.cumsum(covered)))[words.bounds]).astype(np.int64)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    return out


def grams(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each hashed unigram and bigram; tokens are runs of letters and digits, or of other signs."""
    data, offsets = buffers(texts)
    starts, ends = runs(KINDS[data], offsets)
    h = hash_segments(data, starts, ends)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    pair = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    two = mix(h[:-1] * np.uint64(3) + h[1:])[pair] if len(h) else h
    shift = np.uint64(64 - bits)
    return np.concatenate((owner, owner[:-1][pair] if len(owner) else owner)), (np.concatenate((h, two)) >> shift).astype(np.int64)


def scores(texts: pa.Array, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Mean log ratio of each text's n-grams; 0 for a text without any."""
    owner, bucket = grams(texts, bits)
    n = np.bincount(owner, minlength=len(texts))
    return np.bincount(owner, weights=table[bucket], minlength=len(texts)) / np.maximum(n, 1)


def labelled_ids(labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of the rows labelled good and bad; an id labelled both ways is bad."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toPandas()
    return np.sort(rows.doc_id[rows.q > 0].to_numpy(np.int64)), np.sort(rows.doc_id[rows.q <= 0].to_numpy(np.int64))


def _member(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, ids), len(of) - 1)] == ids if len(of) else np.zeros(len(ids), bool)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, spare: float = SPARE) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, threshold). Without good labels in the first half, or bad ones in the second, nothing is rejected."""
    good, bad = labelled_ids(labels)
    size = 1 << bits
    shown = crc_mod(good.tolist(), 2) == 0
    if not shown.any():
        return np.zeros(size), float("-inf")
    held_good, held_bad = good[~shown], bad[crc_mod(bad.tolist(), 2) == 1]
    sent = docs.sparkSession.sparkContext.broadcast((good[shown], held_good, held_bad))

    def count(batches):
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                owner, bucket = grams(part.column(1), bits)
                mine = _member(_ids(part.column(0)), sent.value[0])
                total[0] += np.bincount(bucket, minlength=size)
                total[1] += np.bincount(bucket[mine[owner]], minlength=size)
        rows = total.reshape(2 * SLOTS, -1)
        live = [k for k in range(len(rows)) if rows[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([common.task_number()] * len(live), pa.int32()), pa.array([rows[k].tobytes() for k in live], pa.binary())], ["slot", "part", "vec"])

    both = np.zeros((2 * SLOTS, 2 * size // (2 * SLOTS)), np.int64)
    for row in sum_vectors(docs.select("doc_id", "text").mapInArrow(count, "slot int, part int, vec binary")).collect():  # a row per slot
        both[row.slot] = np.frombuffer(row.vec, np.int64)
    raw, target = both.reshape(2, size)
    log = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * size))
    table = log(target) - log(raw)
    told = docs.sparkSession.sparkContext.broadcast(table)

    def spread(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            ids = _ids(batch.column(0))
            kind = np.where(_member(ids, sent.value[1]), 1, np.where(_member(ids, sent.value[2]), 0, -1))
            some = batch.take(pa.array(np.flatnonzero(kind >= 0)))
            kind, done = kind[kind >= 0], 0
            for part in slices(some, 1):
                s = scores(part.column(1), told.value, bits)
                bins = np.clip(((s - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
                for k in (0, 1):
                    total[k] += np.bincount(bins[kind[done : done + len(s)] == k], minlength=BINS)
                done += len(s)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([common.task_number()] * 2, pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["slot", "part", "vec"])

    seen = {row.slot: np.frombuffer(row.vec, np.int64) for row in sum_vectors(docs.select("doc_id", "text").mapInArrow(spread, "slot int, part int, vec binary")).collect()}
    return table, threshold(seen.get(1, np.zeros(BINS, np.int64)), seen.get(0, np.zeros(BINS, np.int64)), spare)


def threshold(good: np.ndarray, bad: np.ndarray, spare: float = SPARE) -> float:
    """The bin edge under which the most bad rows lie, among those under which at most ``spare`` of the good ones do.

    Of a gap between the two the middle is taken, so that a score a little under the labelled good ones is kept too.
    """
    if not bad.sum():
        return float("-inf")
    under_good = np.concatenate(([0], np.cumsum(good)))
    under_bad = np.concatenate(([0], np.cumsum(bad)))
    allowed = np.flatnonzero(under_good <= spare * max(1, good.sum()))
    best = under_bad[allowed].max()
    if not best:
        return float("-inf")
    edges = allowed[under_bad[allowed] == best]
    return LOW + (HIGH - LOW) * float(edges[0] + edges[-1]) / 2 / BINS


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: base columns, kept, and llr, the length-normalised ratio.

    Null or empty text: no words, base_failed. Rows with equal or null ids are judged each. Ties with the threshold are kept. Whole
    texts are read; other columns are not. An empty table gives an empty result.
    """
    table, least = fit(docs, labels)
    told = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                f = base_features(part.column(1))
                s = scores(part.column(1), told.value)
                f["kept"] = ~f["base_failed"] & (s >= least)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, f.values()), pa.array(s)], ["doc_id", *f, "llr"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with all their columns, in one pass over the texts after the fit."""
    table, least = fit(docs, labels)
    told = docs.sparkSession.sparkContext.broadcast(table)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                kept = ~base_features(part.column(at))["base_failed"] & (scores(part.column(at), told.value) >= least)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("llr")

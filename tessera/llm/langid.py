"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each position, a mask with a bit for every language; the masks at an n-gram's positions, AND-ed,
name all languages whose profile contains it. A text's hits are counted by language, corrected for the filter's false positives, and
the largest corrected count decides. Profiles are counted over all training rows; an n-gram is in a language's profile if its rate
there is at least MIN_RATE and not far below its rate elsewhere, so a profile holds 1 / MIN_RATE n-grams at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import buffers, column_or_null, crc_mod, hash_segments, mix, runs, slices

#: n-grams are 2 to 5 bytes of a word with a blank before and after it.
SIZES = (2, 3, 4, 5)
MIN_RATE = 5e-6
#: A language whose rate of an n-gram is under this share of the highest rate does not contain it: strays in mixed texts.
SHARE = 0.2
PROBES = 3
LETTERS = np.zeros(256, dtype=np.uint8)
LETTERS[[c for c in range(128) if chr(c).isalpha()]] = 1
LETTERS[0x80:] = 1
#: A text is in a language if it has so large a share of the hits that all but so large a share of the training rows reach: clean rows hit
#: about 0.95 of their n-grams and 99 of 100 over 0.88 (sf0.1), random letters 0.10 to 0.15, other scripts under 0.01.
KEEP_SHARE, KEEP_OUT = 0.5, 0.01
#: Bytes of text at a time: all n-grams of a piece's distinct words are held at once, at about 80 bytes for each of theirs.
PIECE = 1 << 20


def word_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, distinct word of each word, gram, distinct word of each gram) of a batch, case folded."""
    data, offsets = buffers(pc.utf8_lower(texts.fill_null("")) if len(texts) else texts)
    starts, ends = runs(LETTERS[data], offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    h = hash_segments(data, starts, ends)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    size = e - s + 2
    begin = np.cumsum(size) - size
    total = int(size.sum())
    stream = np.full(total + max(SIZES), 0x20, np.uint64)
    inner = np.arange(total) - np.repeat(begin, size)
    left = np.repeat(size, size) - inner  # bytes up to the word's closing blank
    middle = (inner > 0) & (left > 1)
    stream[:total][middle] = data[(np.repeat(s, size) + inner - 1)[middle]]
    word = np.repeat(np.arange(len(s), dtype=np.int32), size)
    found, of, key = [], [], np.zeros(total, np.uint64)
    for n in range(1, max(SIZES) + 1):
        key = (key << np.uint64(8)) | stream[n - 1 : n - 1 + total]
        if n in SIZES:
            fits = left >= n
            found.append(key[fits] | np.uint64(n << 56))
            of.append(word[fits])
    return owner, which.astype(np.int64), np.concatenate(found) if found else key, np.concatenate(of) if of else word


@dataclass
class Model:
    """langs in order of name; slices has a mask (a row of 64-bit words) for each position; wrong is each language's rate of false hits."""

    langs: list[str]
    slices: np.ndarray
    wrong: np.ndarray
    usual: int

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as rows of mask words."""
        out = None
        for at in positions(keys, len(self.slices)):
            out = self.slices[at] if out is None else out & self.slices[at]
        return out

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, how many of them each language knows, corrected for false hits)."""
        n, langs = len(texts), len(self.langs)
        owner, which, keys, of = word_grams(texts)
        words = int(which.max()) + 1 if len(which) else 0
        masks = self.masks(keys)
        tried = np.bincount(of, minlength=words)
        hits = np.empty((n, langs))
        all_tried = np.bincount(owner, weights=tried[which], minlength=n) if len(owner) else np.zeros(n)
        for k in range(langs):
            bit = (masks[:, k // 64] >> masks.dtype.type(k % 64)) & masks.dtype.type(1)
            by_word = np.bincount(of, weights=bit, minlength=words)
            raw = np.bincount(owner, weights=by_word[which], minlength=n) if len(owner) else np.zeros(n)
            hits[:, k] = np.maximum(0, (raw - all_tried * self.wrong[k]) / (1 - self.wrong[k]))
        return all_tried, hits

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language or und, score) of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        return self.judged(texts, self.hits(texts)[1])

    def judged(self, texts: pa.Array, hits: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        none = np.array([not has_letter(x) for x in texts.to_pylist()], bool) if n else np.zeros(0, bool)
        best, total = hits.argmax(axis=1), hits.sum(axis=1)
        score = np.where(total > 0, hits[np.arange(n), best] / np.where(total > 0, total, 1), 0.0)
        best = np.where(total > 0, best, self.usual)
        return ["und" if x else self.langs[k] for x, k in zip(none, best, strict=True)], np.where(none, 0.0, score)


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(map(str.isalpha, text))


def positions(keys: np.ndarray, m: int):
    """PROBES positions of each key, by double hashing over a power of two."""
    h = mix(keys)
    step = mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(m - 1)).astype(np.int64)


def build(langs: list[str], keys: np.ndarray, lang_of: np.ndarray, usual: int) -> Model:
    """The filter of (n-gram, language) pairs."""
    most = int(np.bincount(lang_of, minlength=max(1, len(langs))).max()) if len(keys) else 0
    m = 1 << max(10, int(np.ceil(np.log2(16 * max(1, most)))))
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    table = np.zeros((m, (len(langs) + 63) // 64 or 1), kind)
    wrong = np.zeros(len(langs))
    for k in range(len(langs)):
        own = np.zeros(m, bool)
        for at in positions(keys[lang_of == k], m):
            own[at] = True
        table[:, k // 64] |= own.astype(kind) << kind(k % 64)
        wrong[k] = min(0.99, own.mean() ** PROBES)
    return Model(langs, table, wrong, usual)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the training rows: those with a language whose crc32 of the id is not 2 modulo 4."""

    def run(batches):
        held: dict[str, list] = {}

        def flush(name):
            keys = np.concatenate([x for x, _ in held[name]])
            n = np.concatenate([x for _, x in held[name]])
            keys, back = np.unique(keys, return_inverse=True)
            return keys, np.bincount(back, weights=n).astype(np.int64)

        def out(name, keys, n):
            return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            learn = (crc_mod(batch.column(0).to_pylist(), 4) != 2) & np.asarray(batch.column(2).is_valid())
            for part in slices(batch.filter(pa.array(learn)), 1, PIECE):
                owner, which, keys, of = word_grams(part.column(1))
                names = np.array(part.column(2).to_pylist(), dtype=object)
                words = int(which.max()) + 1 if len(which) else 0
                for name in sorted(set(names)):
                    mine = (names == name)[owner] if len(owner) else np.zeros(0, bool)
                    times = np.bincount(which[mine], minlength=words)[of]
                    live = times > 0
                    ks, back = np.unique(keys[live], return_inverse=True)
                    held.setdefault(name, []).append((ks, np.bincount(back, weights=times[live], minlength=len(ks)).astype(np.int64)))
                    if sum(len(x) for x, _ in held[name]) > 1_000_000:
                        ks, n = flush(name)
                        if len(ks) > 500_000:
                            yield out(name, ks, n)
                            del held[name]
                        else:
                            held[name] = [(ks, n)]
        for name in held:
            yield out(name, *flush(name))

    rows = docs.select("doc_id", "text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """The model of all training rows. A language none of whose rows has a letter leaves no n-gram and is not learned."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), column_or_null(docs, "lang", "string").alias("lang"))
    counts = common.written(count_grams(docs))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
    langs = sorted(totals)
    if not langs:
        common.drop_written(counts)
        return build([], np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    rate = F.col("n") / F.create_map([F.lit(x) for kv in totals.items() for x in kv])[F.col("lang")]
    frequent = counts.withColumn("rate", rate).where(F.col("rate") >= MIN_RATE)  # 1 / MIN_RATE rows of a language at most
    top = frequent.groupBy("gram").agg(F.max("rate").alias("top"))
    rows = frequent.join(top, "gram").where(F.col("rate") >= SHARE * F.col("top")).select("gram", "lang").toPandas()
    common.drop_written(counts)
    index = {x: k for k, x in enumerate(langs)}
    return build(langs, rows.gram.to_numpy(np.int64).view(np.uint64), rows.lang.map(index).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64), max(range(len(langs)), key=lambda k: (totals[langs[k]], -k)))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; only its text is looked at.

    held_out: the id's crc32 is 2 modulo 4 (false for a null id). und and score 0 for null text or one without a letter, and for every
    row if nothing could be learned. A text none of whose n-grams is known gets the most frequent language with score 0. Ties go to the
    first language by name. Rows with equal ids are judged each.
    """
    model = model or train(docs)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, PIECE):
                lang, score = told.value.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(crc_mod(part.column(0).to_pylist(), 4) == 2), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def hit_bounds(docs: DataFrame, model: Model) -> np.ndarray:
    """For each language the share of its n-grams that a text must have at least: KEEP_SHARE of what all but KEEP_OUT of its training rows have.

    A language without n-grams in its training rows, and every one where no row is labelled, has the bound 0.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = told.value
        place, seen = {x: k for k, x in enumerate(m.langs)}, np.zeros((len(m.langs), 1001), np.int64)
        for batch in batches:
            learn = (crc_mod(batch.column(0).to_pylist(), 4) != 2) & np.asarray(batch.column(2).is_valid())
            for part in slices(batch.filter(pa.array(learn)), 1, PIECE):
                tried, hits = m.hits(part.column(1))
                lang = np.array([place.get(x, -1) for x in part.column(2).to_pylist()])
                on = np.flatnonzero((lang >= 0) & (tried > 0))
                np.add.at(seen, (lang[on], (1000 * hits[on, lang[on]] / tried[on]).astype(np.int64)), 1)
        lang, rate = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(rate, pa.int32()), pa.array(seen[lang, rate])], ["lang", "rate", "n"])

    out = np.zeros(len(model.langs))
    if len(out):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), column_or_null(docs, "lang", "string").alias("lang"))
        found = rows.mapInArrow(run, "lang int, rate int, n long").groupBy("lang", "rate").agg(F.sum("n").alias("n")).toPandas()  # 1,001 rows a language at most
        for k, own in found.sort_values("rate").groupby("lang"):
            out[k] = KEEP_SHARE * own.rate.to_numpy()[np.searchsorted(own.n.cumsum().to_numpy(), KEEP_OUT * own.n.sum())] / 1000
    return out


def keep_known(docs: DataFrame, model: Model | None = None, min_score: float = 0.0, bounds: np.ndarray | None = None) -> DataFrame:
    """The rows whose language is known (not und) with at least min_score, with all their columns.

    A text whose hits stay below the bound of every language is in none of them. ``bounds`` are hit_bounds() of these rows by default;
    as short texts' shares scatter, a text may lie two standard deviations of a binomial count below.
    """
    model = model or train(docs)
    bounds = hit_bounds(docs, model) if bounds is None else bounds
    told = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, at, PIECE):
                if not told.value.langs:
                    continue
                tried, hits = told.value.hits(part.column(at))
                lang, score = told.value.judged(part.column(at), hits)
                least = np.outer(tried, bounds)
                known = (hits >= least - 2 * np.sqrt(least * (1 - bounds))).any(axis=1)
                yield part.filter(pa.array((np.array(lang, dtype=object) != "und") & known & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))

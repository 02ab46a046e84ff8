"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last of its encoding. An automaton gives all tokens that end at a position;
a token is that prefix's last if it is compatible with the last token of the prefix before it: undoing merges of the two from the
right inwards, no merge across the border may come before one that was undone. Back-pointers then give the ids. The vocabulary is
read from a tokenizers file; nothing is trained.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_segments, slices

#: Fixed values of the vocabulary file's format: white space, the words of a text, and the letters that stand for bytes.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + BLANK + r"\p{L}\p{N}]+")
END = "</w>"
MARK = "\ue000"  # ends a word inside the automaton
#: Words kept with their ids by a worker; older ones go by halves.
CACHE = 150_000


def byte_letters() -> list[str]:
    """The letter of each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


#: What a vocabulary file must say of its texts and its model for PIECES, fold() and END to hold.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": False, "ignore_merges": False}


def check(spec: dict) -> None:
    """Raises ValueError for a file that cuts or folds texts in another way than this module does, whose ids would be wrong."""
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    letters = [x for x in cuts[1:] if x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex")]
    wrong = [k for k, v in MODEL.items() if spec.get("model", {}).get(k) != v]
    if spec.get("normalizer") != NORMAL or cuts[:1] != [CUT] or len(cuts) != 2 or len(letters) != 1 or spec.get("decoder") is not None or wrong:
        raise ValueError(f"no vocabulary of this kind: {wrong or 'normalizer, pre_tokenizer or decoder'}")


def load(path: str) -> dict:
    """The file's vocabulary as plain tables, small enough to send to every worker (a row a token); ValueError for a file of another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    check(spec)
    model = spec["model"]
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    # rank of a token: 0 for a single letter, else 1 + the place of the merge that makes it
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    return {"vocab": vocab, "merges": merges, "special": special}


class Bpe:
    """Encoder and decoder of a table from load()."""

    def __init__(self, table: dict, cache: int = CACHE):
        import ahocorasick

        vocab, self.special = table["vocab"], table["special"]
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        top = max(self.text_of, default=-1) + 1
        self.pair = {a << 32 | b: rank for rank, (a, b, _) in enumerate(table["merges"])}
        self.rank, self.left, self.right = [-1] * top, [-1] * top, [-1] * top
        for rank, (a, b, c) in enumerate(table["merges"]):
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = rank, a, b
        self.known: dict[int, bool] = {}
        self.letters = byte_letters()
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            end = token.endswith(END) and token != END
            key = token[: -len(END)] + MARK if end else token
            if self.is_own(i):
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.limit, self.young, self.old = cache, {}, {}
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def is_own(self, token: int) -> bool:
        """Whether the token's own text is encoded as that token: its halves are joined by its merge, not crossed by another."""
        if self.rank[token] < 0:
            return True
        a, b = self.left[token], self.right[token]
        return self.is_own(a) and self.is_own(b) and self.compatible(a, b, self.rank[token])

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether the two stay apart, that is no merge across their border comes earlier than those inside them.

        With ``below`` only merges before that rank count: the two may then be joined by it.
        """
        rank, pair = self.rank, self.pair
        limit = below if below is not None else 1 << 60
        while True:
            if pair.get(left << 32 | right, limit) < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:  # the later of the two last merges is undone: before it the border had these neighbours
                limit = min(limit, a)
                left = self.right[left]
            elif b < 0:
                return True
            else:  # equal merges are made from left to right: the left one's is made first
                limit = min(limit, b + 1)
                right = self.left[right]

    def word(self, piece: str) -> tuple[int, ...]:
        """The ids of one word by dynamic programming over its prefixes."""
        text = "".join(map(self.letters.__getitem__, piece.encode())) + MARK
        n = len(text)
        last, back, known, compatible = [-1] * (n + 1), [0] * (n + 1), self.known, self.compatible
        for stop, (token, size) in self.automaton.iter(text):
            end = stop + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 32 | token
                fits = known.get(key)
                if fits is None:
                    fits = known[key] = compatible(before, token)
                    if len(known) > 400_000:
                        known.clear()
                if not fits:
                    continue
            last[end], back[end] = token, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return tuple(out[::-1])

    def ids_of(self, piece: str) -> tuple[int, ...]:
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self.word(piece)
            if len(self.young) >= self.limit // 2:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; the special tokens' own strings give their ids."""
        if not text:
            return []
        if self.specials is not None and "<" in text and len(parts := self.specials.split(text)) > 1:
            return list(chain.from_iterable([self.special[p]] if k % 2 else self.encode_plain(p) for k, p in enumerate(parts)))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.ids_of, PIECES.findall(fold(text)))))

    def decode(self, ids) -> str:
        """The tokens with a blank between; the file names no decoder, so nothing else is undone."""
        return " ".join(map(self.text_of.__getitem__, ids))


def _kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for every code point."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = 1 if kind == "L" else 2
    for low, high in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[low : high + 1] = 0
    return out


class Batch:
    """Encodes many texts at once: the words of all are found with array operations, and each distinct word is encoded once."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.kinds = bpe, _kinds()
        top = max(bpe.text_of, default=-1) + 1
        self.tokens = pa.array([bpe.text_of.get(i, "") for i in range(top)], pa.string())

    def pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all texts end to end, their code points, starts and ends of the words, the words' text)."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.cumsum([0, *map(len, texts)])
        if not len(points):
            none = np.zeros(0, np.int64)
            return joined, points, none, none, none
        kinds = self.kinds[points]
        change = np.ones(len(points) + 1, bool)
        change[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        change[offsets] = True
        at = np.flatnonzero(change)
        starts, ends = at[:-1], at[1:].copy()
        owner = np.searchsorted(offsets, starts, side="right") - 1
        # an apostrophe alone before s, t, m, d, re, ve or ll takes those letters
        lone = np.flatnonzero((points[starts] == 0x27) & (ends - starts == 1))
        if len(lone):
            starts = starts.copy()
            lone = lone[lone + 1 < len(starts)]
            lone = lone[(owner[lone + 1] == owner[lone]) & (kinds[starts[lone + 1]] == 1)]
            first = points[starts[lone + 1]]
            room = ends[lone + 1] - starts[lone + 1] >= 2
            second = points[np.minimum(starts[lone + 1] + 1, len(points) - 1)]
            one = np.isin(first, [ord(c) for c in "stmd"])
            two = room & (((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l"))))
            take = np.where(one, 1, np.where(two, 2, 0))
            ends[lone] += take
            starts[lone + 1] += take
        live = (kinds[starts.clip(max=len(points) - 1)] != 0) & (ends > starts)
        return joined, points, starts[live], ends[live], owner[live]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets)."""
        bpe = self.bpe
        plain: list[str] = []  # a text with special tokens is cut at them
        cuts: list[tuple[int, int]] = []  # (parts before, special id)
        parts_of = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            text = text or ""
            bits = bpe.specials.split(text) if bpe.specials is not None and "<" in text else [text]
            parts_of[k] = len(bits)
            for i, bit in enumerate(bits):
                if i % 2:
                    cuts.append((len(plain), bpe.special[bit]))
                    bit = ""
                plain.append(fold(bit))
        joined, points, starts, ends, owner = self.pieces(plain)
        h = hash_segments(points, starts, ends)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        known = [bpe.ids_of(joined[s:e]) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        sizes = np.fromiter(map(len, known), np.int64, count=len(known))
        table = np.fromiter(chain.from_iterable(known), np.int32, count=int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        each = sizes[which] if len(which) else np.zeros(0, np.int64)
        total = int(each.sum())
        ids = table[np.repeat((begin[which] if len(which) else each) - (np.cumsum(each) - each), each) + np.arange(total)]
        by_part = np.bincount(owner, weights=each, minlength=len(plain)).astype(np.int64) if len(owner) else np.zeros(len(plain), np.int64)
        if cuts:
            ids = np.insert(ids, np.concatenate(([0], np.cumsum(by_part)))[[p for p, _ in cuts]], [i for _, i in cuts])
            by_part[[p for p, _ in cuts]] = 1
        edges = np.concatenate(([0], np.cumsum(by_part)))[np.concatenate(([0], np.cumsum(parts_of)))]
        return ids.astype(np.int32), edges


def fold(text: str) -> str:
    """NFC and lower case, letter by letter."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))


_LOADED: dict[str, Batch] = {}


def _encoder(key: str, table) -> Batch:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Batch(Bpe(table))
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row's whole text; null text counts as empty: no ids and an empty string.

    Rows with equal or null ids are encoded each; other columns are not read.
    """
    path = path or default_path()
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        batched = _encoder(path, sent.value)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                ids, edges = batched.encode(part.column(1).to_pylist())
                edges, flat = pa.array(edges, pa.int32()), pa.array(ids)
                tokens = pa.ListArray.from_arrays(edges, batched.tokens.take(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edges, flat), pc.binary_join(tokens, " ")], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of tokenize()."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet")))

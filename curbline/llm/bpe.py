"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match.  A token sequence is the one that merging would
give exactly when every adjacent pair is compatible, that is when no merge across the border
would have come before the merges that built either side.  All pairs of a batch of words are tested
together in NumPy, and only words with a failing pair are merged one merge at a time.

The vocabulary is a ``tokenizers`` JSON file of the kind "BPE with word ends" (NFC, white space collapsed,
lower case, byte-level words with a closing ``</w>``, no decoder); its path is a parameter.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

END = "</w>"
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Characters at which str.split() also cuts though they are no white space here.
ODD_SPACES = re.compile("[\x1c-\x1f]")
NEVER = np.int64(1) << 40
CACHE_WORDS = 100_000
SHORT = 32  # letters of a word that is merged in a matrix with others


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return {b: chr(b if b in plain else next(free)) for b in range(256)}


class WordBpe:
    """Encoder and decoder of one vocabulary file; a worker keeps one for each path."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec["decoder"] is not None:
            raise ValueError(f"{path}: only BPE files with word ends and without a decoder are read")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token
        self.left, self.right = np.arange(size), np.arange(size)
        self.made: list[int] = []  # token of each merge, by rank
        self.rank_of: dict[int, int] = {}  # of a pair, as first * size + second
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.made.append(made)
            self.rank_of[x * size + y] = r
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, x, y
        keys = np.fromiter(self.rank_of, np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[order], np.fromiter(self.rank_of.values(), np.int64)[order]
        sound = np.ones(size, bool)  # tokens that merging their own text does give
        made = np.flatnonzero(self.rank >= 0)
        sound[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END) and sound[i]}
        self.closing = {t[: -len(END)]: i for t, i in vocab.items() if t.endswith(END) and sound[i]}
        self.letters = {b: s for b, s in byte_letters().items() if chr(b) != s}
        self.vocab = vocab
        lengths: dict[str, set[int]] = {}  # of inner tokens, by their first three letters
        for t in self.inner:
            if len(t) >= 3:
                lengths.setdefault(t[:3], set()).add(len(t))
        self.lengths = {t: tuple(sorted(n, reverse=True)) for t, n in lengths.items()}
        self.longest_closing = max(map(len, self.closing), default=0)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether neither a's right edge nor b's left edge would ever have merged over the border.

        The merges that built a and b are undone in reverse order.  Of equal merges the left one comes
        first, so undoing b's also forbids a merge over the border of the same rank.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        while live.size:
            bad = self.pair_rank(a, b) < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def greedy(self, word: str) -> list[int] | None:
        """Longest match from the left, the last token with the word's end; None if it gets stuck."""
        out, at, n, inner, lengths = [], 0, len(word), self.inner, self.lengths
        while True:
            if n - at <= self.longest_closing:
                last = self.closing.get(word[at:])
                if last is not None:
                    out.append(last)
                    return out
            for size in lengths.get(word[at : at + 3], ()):
                if at + size < n and (t := inner.get(word[at : at + size])) is not None:
                    break
            else:
                for size in (2, 1):
                    if at + size < n and (t := inner.get(word[at : at + size])) is not None:
                        break
                else:
                    return None
            out.append(t)
            at += size

    def letters_of(self, word: str) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + END]]

    def merged(self, word: str) -> list[int]:
        """Exact merging of one word, lowest rank first and leftmost among equals, in O(n log n).

        Letters are a linked list; a heap holds the rank and place of every pair that has one.  What a merge has changed
        meanwhile is known by its rank no longer being that of the pair.
        """
        parts = self.letters_of(word)
        rank_of, size, n = self.rank_of, self.size, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank = [rank_of.get(a * size + b, -1) for a, b in zip(parts, parts[1:])] + [-1]
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if rank[i] != r:
                continue
            j = after[i]
            parts[i], rank[j] = self.made[r], -1
            k = after[i] = after[j]
            parts[j] = -1
            if k < n:
                before[k] = i
                rank[i] = rank_of.get(parts[i] * size + parts[k], -1)
                if rank[i] >= 0:
                    heapq.heappush(heap, rank[i] * n + i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = rank_of.get(parts[h] * size + parts[i], -1)
                if rank[h] >= 0:
                    heapq.heappush(heap, rank[h] * n + h)
        return [t for t in parts if t >= 0]

    def merged_short(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many short words at once: in every round each row's best pair, the leftmost of equals, is merged."""
        if not words:
            return []
        letters = [self.letters_of(w) for w in words]
        sizes = np.array([len(x) for x in letters])
        width = int(sizes.max()) + 1
        parts = np.full((len(words), width), -1, np.int64)
        parts[np.arange(width) < sizes[:, None]] = np.fromiter((t for x in letters for t in x), np.int64)
        ranks = np.full(parts.shape, NEVER)
        real = parts[:, 1:] >= 0
        ranks[:, :-1][real] = self.pair_rank(parts[:, :-1][real], parts[:, 1:][real])
        made = np.array(self.made, np.int64)
        done = np.full(parts.shape, -1, np.int64)
        live, columns = np.arange(len(words)), np.arange(width)
        while live.size:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            go = best < NEVER
            done[live[~go]] = parts[~go]
            live, parts, ranks, at, best = live[go], parts[go], ranks[go], at[go], best[go]
            if not live.size:
                break
            rows = np.arange(len(live))
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)  # the last column is always empty
            parts, ranks = np.take_along_axis(parts, shift, 1), np.take_along_axis(ranks, shift, 1)
            parts[rows, at] = made[best]
            for place in (at - 1, at):
                a, b = parts[rows, np.maximum(place, 0)], parts[rows, np.minimum(place + 1, width - 1)]
                new = np.where((place >= 0) & (b >= 0), self.pair_rank(np.maximum(a, 0), np.maximum(b, 0)), NEVER)
                ok = place >= 0
                ranks[rows[ok], place[ok]] = new[ok]
        return [row[:n].tolist() for row, n in zip(done, (done >= 0).sum(axis=1).tolist())]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """int32 ids of distinct words, speculated together and verified together."""
        spelled = [w if w.isascii() and w.isprintable() else "".join(self.letters.get(c, chr(c)) for c in w.encode("utf-8", "surrogatepass")) for w in words]
        guess = [self.greedy(w) for w in spelled]
        flat = np.fromiter((t for g in guess if g for t in g), np.int64)
        sizes = np.fromiter((len(g) if g else 0 for g in guess), np.int64, len(guess))
        owner = np.repeat(np.arange(len(guess)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if flat.size else np.zeros(0, np.int64)
        failed = {*owner[inside[~self.compatible(flat[inside], flat[inside + 1])]].tolist(), *(k for k, g in enumerate(guess) if g is None)}
        short = [k for k in failed if len(spelled[k]) <= SHORT]
        for k, ids in zip(short, self.merged_short([spelled[k] for k in short])):
            guess[k] = ids
        for k in failed.difference(short):
            guess[k] = self.merged(spelled[k])
        return {w: array("i", g).tobytes() for w, g in zip(words, guess)}

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii():
            low = chunk.lower()
            return [low] if low.isalpha() else self.pieces.findall(low)
        return self.pieces.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def _learn(self, texts: list[list[str]]) -> None:
        """Make the ids of all chunks (white-space separated strings) that are not yet known.

        A full store keeps what these texts hold again.
        """
        seen = {c for text in texts for c in text}
        for name in ("chunks", "words"):
            if len(store := getattr(self, name)) > CACHE_WORDS:
                setattr(self, name, {c: store[c] for c in seen if c in store})
        new = seen.difference(self.chunks)
        split = {c: self._pieces(c) for c in new}
        if unknown := [*{w for words in split.values() for w in words if w not in self.words}]:
            self.words.update(self.encode_words(unknown))
        for c, words in split.items():
            self.chunks[c] = self.words[words[0]] if len(words) == 1 else b"".join([self.words[w] for w in words])

    def forget(self) -> None:
        self.chunks, self.words = {}, {}

    def _spans(self, text: str) -> list[str]:
        cut = SPACES.split if ODD_SPACES.search(text) else str.split
        if self.at_special is None or not self.at_special.search(text):
            return [c for c in cut(text) if c]
        out: list[str] = []
        for k, part in enumerate(self.at_special.split(text)):
            out += [part] if k % 2 else [c for c in cut(part) if c]
        return out

    def encode(self, texts: list[str], group_chars: int = 2_000_000) -> Iterator[bytes]:
        """int32 ids of each text, in order; texts are taken in groups to bound the memory."""
        group, size = [], 0
        for k, text in enumerate(texts):
            group.append(self._spans(text))
            size += len(text)
            if size >= group_chars or k == len(texts) - 1:
                self._learn(group)
                for t, i in self.special.items():
                    self.chunks[t] = np.array([i], np.int32).tobytes()
                get = self.chunks.__getitem__
                for spans in group:
                    yield b"".join(map(get, spans))
                group, size = [], 0


def decoded(ids: pa.Array, token: pa.Array) -> pa.Array:
    """Texts of a list array of ids: the tokens' texts with a blank between them; unknown ids give nothing."""
    sizes, values = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(), ids.flatten()
    known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(token)))
    if not pc.all(known).as_py():
        rows = np.repeat(np.arange(len(sizes)), sizes)[known.to_numpy(zero_copy_only=False)]
        sizes, values = np.bincount(rows, minlength=len(sizes)), values.filter(known)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, token.take(values)), " ")


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(2)
def load_tokens(path: str) -> pa.Array:
    """Texts of a vocabulary's tokens by id: all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["decoder"] is not None:
        raise ValueError(f"{path}: only files without a decoder are read")
    every = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([every.get(i, "") for i in range(max(every) + 1)], pa.string())


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids (array<int>) of the whole text.  Null and empty texts have no ids.

    ``ids_col`` replaces an input column of that name.
    """
    kept = [c for c in docs.columns if c != ids_col]
    schema = docs.select(*kept).withColumn(ids_col, F.array().cast("array<int>")).schema
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids = list(model.encode([t or "" for t in part.column(at).to_pylist()]))
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, values)], [*kept, ids_col])
        model.forget()

    return docs.select(*kept).mapInArrow(lean(run), schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for.  Null ids give an empty text.

    ``text_col`` replaces an input column of that name.
    """
    kept = [c for c in rows.columns if c != text_col]
    schema = rows.select(*kept).withColumn(text_col, F.lit("").cast("string")).schema
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = load_tokens(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(part.column(at), token)], [*kept, text_col])

    return rows.select(*kept).mapInArrow(lean(run), schema)

"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over the corpus finds the texts that hold an n-gram of the benchmark, writes their words as numbers, and so
counts in how many documents every n-gram stands.  Seeds are the rare
ones: an n-gram is common if it stands in more than 1/64 of the documents and also in 16 times as many as the median
n-gram of its item, so that an item that is copied very often keeps its seeds.  Heavily edited copies keep no
n-gram; they are seeded by the number of neighbouring item words that stand together in the text, or with one word
between, of which an alignment that suffices has a least number.  A second pass, over what was written, joins passages to items on those seeds and aligns the
words around every cluster of hits with the item, so that edited and paraphrased copies score by what they share.
Items are taken in blocks of a stated size; only a block's n-grams are sent to the executors.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stage

WORD = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
COMMON, ABOVE = 64, 16
CANDIDATES = "id long, texts long, words array<int>, grams array<int>"
HITS = "doc_id long, item_id long, score double, start long, end long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Block:
    """The n-grams of a block of items: over word numbers, sorted, each with the places where it stands."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.number = n, {}
        self.items = [(i, np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)], np.int64)) for i, t in items]
        self.base = np.int64(len(self.number) + 1)
        if float(self.base) ** n >= 2**63:
            raise ValueError("too many words in a block of items; lower block_items")
        places = defaultdict(list)
        for at, (_, w) in enumerate(self.items):
            for pos, code in enumerate(self.codes(w).tolist()):
                places[code].append((at, pos))
        self.grams = np.array(sorted(places), np.int64)
        self.places = [places[g] for g in self.grams.tolist()]
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        # Pairs of neighbouring item words by code, each with its (item, position)s in a row.
        self.stride = max((len(w) for _, w in self.items), default=0) + 1
        code = np.concatenate([w[:-1] * self.base + w[1:] for _, w in self.items] or [np.zeros(0, np.int64)])
        spot = np.concatenate([at * self.stride + np.arange(len(w) - 1) for at, (_, w) in enumerate(self.items)] or [np.zeros(0, np.int64)])
        order = np.argsort(code, kind="stable")
        self.spots = spot[order]
        self.pairs, first = np.unique(code[order], return_index=True)
        self.cuts = np.append(first, len(code))
        self.maybe = np.zeros(1 << 17, bool)  # spares most searches: pairs by the low bits of their codes
        self.maybe[self.pairs & (len(self.maybe) - 1)] = True

    def codes(self, w: np.ndarray) -> np.ndarray:
        """Number of the n-gram at each word; -1 where a word is in no item."""
        m = len(w) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(self.n):
            code = code * self.base + w[k : k + m]
            known &= w[k : k + m] > 0
        return np.where(known, code, -1)

    def number_words(self, text: str) -> np.ndarray:
        found = words_of(text)
        return np.fromiter(map(self.number.get, found, repeat(0)), np.int64, len(found))

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, gram index) of the block's n-grams in a text."""
        code = self.codes(w)
        pos = np.flatnonzero(code >= 0)
        if not pos.size or not self.grams.size:
            return pos[:0], pos[:0]
        at = np.minimum(np.searchsorted(self.grams, code[pos]), len(self.grams) - 1)
        found = self.grams[at] == code[pos]
        return pos[found], at[found]

    def edited(self, w: np.ndarray, min_score: float) -> dict[int, list[int]]:
        """Word positions of the pairs of items of which enough stand close together, by item.

        Of an item's L - 1 pairs, each that is not seen costs an alignment a missing or substituted word, which two
        pairs may share, or two additional words.  With s pairs seen the score is at most L / 4 + 3 / 4 + 3 s / 4, and its words
        reach over at most twice the item's length in the text.
        """
        if not self.pairs.size:
            return {}
        pos, spot = [], []
        known = np.flatnonzero(w)
        for step in (1, 2):
            at = known[: np.searchsorted(known, len(w) - step)]
            b = w[at + step]
            at, b = at[b > 0], b[b > 0]
            code = w[at] * self.base + b
            likely = self.maybe[code & (len(self.maybe) - 1)]
            at, code = at[likely], code[likely]
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hit = self.pairs[k] == code
            at, k = at[hit], k[hit]
            n = self.cuts[k + 1] - self.cuts[k]
            pos.append(np.repeat(at, n))
            spot.append(self.spots[np.repeat(self.cuts[k + 1] - np.cumsum(n), n) + np.arange(n.sum())])
        if not pos:
            return {}
        pos, spot = np.concatenate(pos), np.concatenate(spot)
        item = spot // self.stride
        need = np.maximum(1, np.ceil(((min_score - 0.25) * self.sizes - 0.75) / 0.75 - 1e-9))
        out = {}
        if len(item) < need.min():
            return out
        for x in np.flatnonzero(np.bincount(item, minlength=len(need)) >= need).tolist():
            if len(np.unique(spot[item == x])) < need[x]:
                continue
            own = np.sort(pos[item == x])
            reach = 2 * self.sizes[x]
            close = np.searchsorted(own, own + reach, "right") - np.searchsorted(own, own - reach) >= need[x]
            if close.any():
                out[x] = np.unique(own[close]).tolist()
        return out

    def rare(self, df: dict[int, int], documents: int) -> set[tuple[int, int]]:
        """(gram index, item) pairs to seed from."""
        own = defaultdict(list)
        for g, places in enumerate(self.places):
            for item in {at for at, _ in places}:
                own[item].append(g)
        median = {item: sorted(df.get(g, 0) for g in gs)[len(gs) // 2] for item, gs in own.items()}
        return {(g, item) for item, gs in own.items() for g in gs if df.get(g, 0) <= max(documents / COMMON, ABOVE * max(1, median[item]))}


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Best Smith-Waterman score of the item against the window, and the column after its end."""
    steps = np.arange(len(window) + 1) * -GAP
    row, best, end = np.zeros(len(window) + 1), 0.0, 0
    for w in item:
        up = row + GAP
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(window == w, MATCH, MISMATCH))
        # A gap along the row: the best earlier cell less the gaps since, for all cells at once.
        row = np.maximum.accumulate(np.maximum(up, 0) + steps) - steps
        if (top := float(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, min_score: float = 0.5, min_words: int = 6, block_items: int = 5000) -> DataFrame:
    """Aligned copies of benchmark items: (doc_id, item_id, score, start, end), one row for each place.

    ``score`` is the alignment's score as a share of the item's words (a match counts 1, a substituted,
    missing or additional word -0.5); start and end are word positions in the text.  Items of fewer than ``min_words``
    words, null texts and null ids of items match nothing; a null doc_id is returned as null.
    Only ``block_items`` items are on the driver and on an executor at a time.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).dropna()
    blocks = -(-items.count() // block_items)
    found = []
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        block = Block([(r["id"], r["text"]) for r in part.orderBy("id").collect() if len(words_of(r["text"])) >= min_words], n)
        if block.items:
            found.append(_find_block(texts, block, min_score))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], HITS)


def _find_block(texts: DataFrame, block: Block, min_score: float) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(block)  # bounded by block_items

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every text that may hold an item, its word numbers and its n-grams; last, a row with the number of all texts."""
        b, seen = shared.value, 0
        names = [x.split()[0] for x in CANDIDATES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            seen += batch.num_rows
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows: list[tuple] = []
                for doc, text in zip(part.column("id").to_pylist(), part.column("text")):
                    w = b.number_words(text.as_py())
                    grams = np.unique(b.hits(w)[1])
                    if grams.size or b.edited(w, min_score):
                        rows.append((doc, None, w.astype(np.int32), grams.astype(np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, seen, None, None), kinds)], names)

    candidates = stage(texts.mapInArrow(lean(look), CANDIDATES), "benchmark-candidates")
    df = {r["g"]: r["n"] for r in candidates.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()}
    total = candidates.agg(F.sum("texts")).first()[0] or 0
    seeds = texts.sparkSession.sparkContext.broadcast(block.rare(df, total))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, rare = shared.value, seeds.value
        for batch in batches:
            rows = []
            for doc, numbers in zip(batch.column("id").to_pylist(), batch.column("words")):
                w = numbers.values.to_numpy().astype(np.int64)
                by_item = defaultdict(list)
                for pos, g in zip(*(x.tolist() for x in b.hits(w))):
                    for item in {at for at, _ in b.places[g]}:
                        if (g, item) in rare:
                            by_item[item].append(pos)
                edited = b.edited(w, min_score)
                for at in by_item.keys() | edited.keys():
                    item, own = b.items[at]
                    places = sorted({*by_item.get(at, ()), *edited.get(at, ())})
                    reach = 2 * len(own) if at in edited else len(own) + b.n
                    cuts = [0, *(np.flatnonzero(np.diff(places) > reach) + 1).tolist(), len(places)]
                    for lo, hi in zip(cuts, cuts[1:]):
                        open_ = [(max(0, places[lo] - reach), places[hi - 1] + reach)]
                        while open_:  # what an alignment leaves on either side may hold another copy
                            first, last = open_.pop()
                            if not any(first <= p < last for p in places[lo:hi]):
                                continue
                            window = w[first:last]
                            if np.isin(own, window).sum() < min_score * len(own):  # every match needs an item word that is there
                                continue
                            best, end = align(own, window)
                            if best >= min_score * len(own):
                                start = end - align(own[::-1], window[:end][::-1])[1]
                                rows.append((doc, item, best / len(own), first + start, first + end))
                                open_ += [(first, first + start), (first + end, last)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], [x.split()[0] for x in HITS.split(", ")])

    return candidates.filter("words is not null").select("id", "words").mapInArrow(lean(join), HITS)

"""Toxicity by nearest labelled examples under exact TF-IDF cosine, over a block-max inverted index.

Fitting takes a bounded sample of labelled rows (``max_per_class`` of either label, by hash order).  It keeps the
words and word beginnings that go with a label beyond chance, weighs them by TF-IDF times the square of how far beyond, and
files the sampled examples in an inverted index whose postings are cut in blocks with the largest weight of each.  A text's nearest examples
are found by descending block bounds, and stopping is exact: no block is left whose bound could reach the
k-th best cosine.  Votes weigh with the inverse distance and the class's share among all labels; a
monotone map, fitted on the examples' own leave-one-out votes, calibrates them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stage

WORD = re.compile(r"\w+")
PREFIXES = (5, 6, 7, 8)
BLOCK = 64
RESULT = "score double, predicted int, neighbours array<struct<id:long,cosine:double,label:int>>, terms array<string>"


def features(text: str, known: dict[str, int] | None = None, stems: frozenset[str] = frozenset()) -> dict[str, int]:
    """Counts of words, and of beginnings of longer words (with a trailing ~).

    With ``known`` only its terms are counted; ``stems`` are then the first letters of its beginnings.
    """
    found: dict[str, int] = {}
    for word, n in Counter(WORD.findall(text.lower())).items():
        if known is None or word in known:
            found[word] = found.get(word, 0) + n
        if known is None or word[: PREFIXES[0]] in stems:
            for k in PREFIXES:
                if len(word) > k:
                    t = word[:k] + "~"
                    if known is None or t in known:
                        found[t] = found.get(t, 0) + n
    return found


def distinct_terms(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of a word and its beginnings that stand in equally many examples of either label, the shortest form alone."""
    best: dict[tuple, tuple[str, int, int]] = {}
    for t, n0, n1 in rows:
        key = (t[: PREFIXES[0]].rstrip("~"), n0, n1)
        if key not in best or (len(t), t) < (len(best[key][0]), best[key][0]):
            best[key] = (t, n0, n1)
    return [r for r in rows if best[r[0][: PREFIXES[0]].rstrip("~"), r[1], r[2]] == r]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after another."""
    return np.repeat(begin + size - np.cumsum(size), size) + np.arange(size.sum())


@dataclass
class BlockMaxIndex:
    """Examples in blocks of BLOCK.  A term's list has a cell for every block where it stands, with its largest weight
    there and the place of its postings.  A search reads the cells of its terms, and then the postings in those
    blocks alone that may hold one of the nearest."""

    ids: list[int]
    labels: np.ndarray
    prior: np.ndarray  # weight of each example's vote
    terms: list[str]
    weight: np.ndarray  # of each term
    list_cuts: np.ndarray  # where each term's cells begin
    cell_block: np.ndarray
    cell_top: np.ndarray
    cell_cuts: np.ndarray  # where each cell's postings begin
    post_row: np.ndarray
    post_weight: np.ndarray
    base: float  # share of label 1 among texts without any term
    steps: tuple[list[float], list[float]] = ((), ())  # the calibration: from each vote on, a score

    def __post_init__(self):
        self.column = {t: j for j, t in enumerate(self.terms)}
        self.stems = frozenset(t[: PREFIXES[0]] for t in self.terms if t.endswith("~"))
        self.blocks = -(-len(self.ids) // BLOCK)

    @classmethod
    def build(cls, ids, vectors, labels, prior, terms, weight, base) -> BlockMaxIndex:
        """``vectors`` are (columns, weights); examples without a term are left out."""
        # Examples that share their heaviest term stand together, which keeps the blocks' bounds tight.
        order = sorted((i for i, (c, _) in enumerate(vectors) if len(c)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), labels[i], ids[i]))
        blocks = max(1, -(-len(order) // BLOCK))
        row = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        value = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        by_term = np.lexsort((row, term))
        row, term, value = row[by_term], term[by_term], value[by_term]
        cell, first = np.unique(term * blocks + row // BLOCK, return_index=True)
        top = np.maximum.reduceat(value, first) if len(first) else value
        ids, labels, prior = [ids[i] for i in order], np.array([labels[i] for i in order], np.int8), np.array([prior[i] for i in order], float)
        return cls(ids, labels, prior, list(terms), np.asarray(weight, float), np.searchsorted(cell, np.arange(len(terms) + 1) * blocks), cell % blocks, top, np.append(first, len(row)), row, value, base)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of a text over the index's terms, as (columns, weights)."""
        found = features(text, self.column, self.stems)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        columns = np.array([self.column[t] for t in found], np.int64)
        weights = (1 + np.log(np.fromiter(found.values(), float, len(found)))) * self.weight[columns]
        return columns, weights / np.sqrt(weights @ weights)

    def nearest(self, v: tuple[np.ndarray, np.ndarray], k: int, but: tuple[int, ...] = (), lead: int = 4) -> list[tuple[float, int]]:
        """The k examples of highest cosine (ties: first in the index), without the examples ``but``.

        Blocks are opened by descending bound, ``lead`` first and then four times as many each time, until no bound that
        is left reaches the k-th cosine.
        """
        columns, weights = v
        if not len(columns) or not self.ids:
            return []
        sizes = self.list_cuts[columns + 1] - self.list_cuts[columns]
        cells, part = _ranges(self.list_cuts[columns], sizes), np.repeat(weights, sizes)
        block = self.cell_block[cells]
        bound = np.bincount(block, self.cell_top[cells] * part, self.blocks)
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound > 0)]
        cosine, floor, done = np.zeros(len(self.ids)), 0.0, 0
        while done < len(order) and bound[order[done]] >= floor - 1e-12:
            open_ = np.zeros(self.blocks, bool)
            open_[order[done : done + lead]] = True
            open_ &= bound >= floor - 1e-12
            done, lead = done + lead, 4 * lead
            mine = open_[block]
            begin, size = self.cell_cuts[cells[mine]], self.cell_cuts[cells[mine] + 1] - self.cell_cuts[cells[mine]]
            posts = _ranges(begin, size)
            cosine += np.bincount(self.post_row[posts], self.post_weight[posts] * np.repeat(part[mine], size), len(cosine))
            cosine[list(but)] = 0.0
            if len(cosine) > k:
                floor = float(np.partition(cosine, -k)[-k])
        hit = np.flatnonzero(cosine >= max(floor - 1e-12, 1e-12))
        best = hit[np.lexsort((hit, -np.round(cosine[hit], 12)))[:k]]
        return list(zip(cosine[best].tolist(), best.tolist()))

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.base
        yes = total = 0.0
        for cosine, i in near:
            w = self.prior[i] / (1.05 - min(cosine, 1.0))
            total += w
            yes += w * self.labels[i]
        # What is far from all examples leans on the share among texts without a term.
        lean = self.prior.mean() * (1.0 - min(near[0][0], 1.0))
        return (yes + lean * self.base) / (total + lean)

    def score(self, near: list[tuple[float, int]]) -> float:
        vote, (at, values) = self.vote(near), self.steps
        return values[max(0, bisect_right(at, vote) - 1)] if at else vote


def monotone_steps(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, half: float) -> tuple[list[float], list[float]]:
    """Isotonic regression by pooling adjacent violators, with ``half`` a vote either way for every pool."""
    pools: list[list[float]] = []
    for v in np.unique(votes):
        same = votes == v
        pools.append([float(v), float((weights * labels)[same].sum()), float(weights[same].sum())])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, yes, total = pools.pop()
            pools[-1][1] += yes
            pools[-1][2] += total
    return [p[0] for p in pools], [(p[1] + half) / (p[2] + 2 * half) for p in pools]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = 4000, max_terms: int = 16384, min_docs: int = 3, min_z: float = 3.0, k: int = 15) -> BlockMaxIndex:
    """Fit on labelled rows.  Bound: ``max_per_class`` ids of each label; class shares are counted over all labels.

    Terms are those of at least ``min_docs`` examples whose shares among the two labels differ by ``min_z`` standard
    errors, the ``max_terms`` strongest of them; vectors and cosines are over these.
    Ids with several labels take the larger one.  Null ids, labels and texts teach nothing.  Without labels
    the index is empty, and every text scores one half.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    sample = stage(rows.join(F.broadcast(chosen), "id"), "toxicity-examples")  # at most 2 * max_per_class ids of 12 bytes are broadcast

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                n[y].update(features(text).keys())
        keys = list(n[0].keys() | n[1].keys())
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"t": part, "n0": pa.array([n[0][t] for t in part], pa.int64()), "n1": pa.array([n[1][t] for t in part], pa.int64())})

    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    s0, s1 = float(size.get(0, 0)), float(size.get(1, 0))
    if not s0 or not s1:
        return BlockMaxIndex.build([], [], [], [], [], [], 1.0 if s1 else 0.0 if s0 else 0.5)
    p = (F.col("n0") + F.col("n1")) / F.lit(s0 + s1)
    # A term of all examples has no spread: its z is null and it is left out, as it tells nothing.
    z = F.try_divide(F.col("n1") / F.lit(s1) - F.col("n0") / F.lit(s0), F.sqrt(p * (1 - p) * F.lit(1 / s0 + 1 / s1)))
    terms = sample.mapInArrow(lean(counted), "t string, n0 long, n1 long").groupBy("t").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    terms = terms.filter(F.col("n0") + F.col("n1") >= min_docs).withColumn("z", F.abs(z)).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "t").limit(max_terms).collect()
    strength = {r["t"]: r["z"] for r in terms}
    terms = distinct_terms([(r["t"], r["n0"], r["n1"]) for r in terms])
    prior = {y: share[y] / size[y] for y in (0, 1)}
    everything = share[0] + share[1]
    names, weight = [t for t, _, _ in terms], [math.log(1 + everything / (n0 * prior[0] + n1 * prior[1])) * strength[t] ** 2 for t, n0, n1 in terms]
    coder = BlockMaxIndex.build([], [], [], [], names, weight, 0.5)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [coder.vector(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.float64()))], ["id", "y", "c", "w"])

    coded = stage(sample.select("id", "y", "text").mapInArrow(lean(vectors), "id long, y int, c array<long>, w array<double>"), "toxicity-vectors")
    got = coded.orderBy("id", "y").collect()
    blank = {y: sum(1 for r in got if r["y"] == y and not r["c"]) * prior[y] for y in (0, 1)}
    base = (blank[1] + 0.5) / (blank[0] + blank[1] + 1)
    units = [(np.array(r["c"], np.int64), np.array(r["w"], float)) for r in got]
    index = BlockMaxIndex.build([r["id"] for r in got], units, [r["y"] for r in got], [prior[r["y"]] for r in got], names, weight, base)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample and the terms

    def without_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        place: dict[tuple[int, int], tuple[int, ...]] = {}
        for at, key in enumerate(zip(x.ids, x.labels.tolist())):
            place[key] = (*place.get(key, ()), at)
        for batch in batches:
            votes = []
            for i, y, c, w in zip(*(batch.column(k).to_pylist() for k in range(4))):
                votes.append(x.vote(x.nearest((np.array(c, np.int64), np.array(w, float)), k, place.get((i, y), ()))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes, pa.float64())], ["y", "vote"])

    found = coded.mapInArrow(lean(without_own), "y int, vote double").groupBy("y", "vote").agg(F.count("*").alias("n")).orderBy("vote", "y").collect()
    vote, y, n = (np.array(c, float) for c in zip(*((r["vote"], r["y"], r["n"]) for r in found)))
    weights = n * np.where(y == 1, prior[1], prior[0])
    index.steps = monotone_steps(vote, y, weights, 0.5 * weights.sum() / n.sum())
    return index


def score(docs: DataFrame, index: BlockMaxIndex, text_col: str = "text", threshold: float = 0.7, k: int = 15) -> DataFrame:
    """Add ``score``, ``predicted``, the ``neighbours`` and the shared ``terms`` that they rest on.

    Null and empty texts are scored as texts without a term.  The four columns replace input columns of
    the same names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample and the terms
    added = [x.split()[0] for x in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema
    for field in docs.sparkSession.createDataFrame([], RESULT).schema:
        schema = schema.add(field)
    at = kept.index(text_col)
    near_type = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        ids = np.array(x.ids, np.int64)
        for batch in batches:
            scores, rows, cosines, terms, cuts = [], [], [], [], [0]
            for text in batch.column(at):
                v = x.vector(text.as_py() or "")
                found = x.nearest(v, k)
                scores.append(x.score(found))
                cosines += [c for c, _ in found]
                rows += [i for _, i in found]
                cuts.append(len(rows))
                terms.append([x.terms[j] for j in v[0][np.argsort(-v[1], kind="stable")[:8]].tolist()])
            own = np.array(rows, np.int64)
            near = pa.StructArray.from_arrays([pa.array(ids[own]), pa.array(cosines, pa.float64()), pa.array(x.labels[own].astype(np.int32))], fields=list(near_type.value_type))
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), near).cast(near_type), pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, *added])

    return docs.select(*kept).mapInArrow(lean(run), schema)

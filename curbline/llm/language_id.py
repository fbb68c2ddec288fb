"""Language identification with hyperdimensional profiles.

Every letter class has a random bipolar vector.  A letter trigram binds three of them, each rotated by its
place; a text bundles (adds) its trigrams; a language's prototype bundles its training texts.
Texts are compared with the prototypes by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 128  # 0 is "no letter", 1 to 26 are a to z, all other letters share the rest
DIM = 1024
HELD = 1 << 20  # trigram counts that a task holds before it merges them, or gives out its sums
TABLE_ROWS = 24_000  # trigram vectors kept by a worker; the table is begun anew when full


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """Class of every code point."""
    points = np.arange(0x110000, dtype=np.int64)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    classes = np.where(letters, 27 + points * 2654435761 % 4294967296 % (CLASSES - 27), 0).astype(np.uint8)
    classes[97:123] = np.arange(1, 27)
    return classes


class TrigramVectors:
    """Bound trigram vectors, made when first needed."""

    def __init__(self, dim: int = DIM, seed: int = 11):
        rng = np.random.default_rng(seed)
        letters = rng.choice(np.array([-1, 1], np.int8), (CLASSES, dim))
        self.parts = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]
        self.dim = dim
        self._clear()

    def _clear(self) -> None:
        self.row_of = np.full(CLASSES**3, -1, np.int32)
        self.table = np.empty((TABLE_ROWS, self.dim), np.float32)
        self.n = 0

    def bind(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = self.parts
        return a[codes // CLASSES**2] * b[codes // CLASSES % CLASSES] * c[codes % CLASSES]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of distinct trigrams, each as often as counted."""
        total = np.zeros(self.dim, np.float64)
        for at in range(0, len(codes), TABLE_ROWS):
            part, times = codes[at : at + TABLE_ROWS], counts[at : at + TABLE_ROWS]
            rows = self.row_of[part]
            if (new := part[rows < 0]).size:
                if self.n + new.size > TABLE_ROWS:
                    self._clear()
                    new = part
                self.table[self.n : self.n + new.size] = self.bind(new)
                self.row_of[new] = np.arange(self.n, self.n + new.size, dtype=np.int32)
                self.n += new.size
                rows = self.row_of[part]
            total += times.astype(np.float32) @ self.table[rows]
        return total


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a text and their counts; a word's ends count as one blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letter_classes()[points].astype(np.int32)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    return np.unique(code[c[1:-1] != 0], return_counts=True)


class TrigramCounts:
    """Counts of each language's trigrams, kept for those that occur."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, lang: str, codes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.setdefault(lang, []).append((codes, counts))
        self.held += len(codes)

    def merge(self) -> None:
        for lang, parts in self.parts.items():
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, at, np.concatenate([n for _, n in parts]))
            self.parts[lang] = [(codes, counts)]
        self.held = sum(len(p[0][0]) for p in self.parts.values())


@lru_cache(1)
def _vectors(dim: int, seed: int) -> TrigramVectors:
    return TrigramVectors(dim, seed)


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = 11) -> dict[str, np.ndarray]:
    """Prototype of every non-null language, bundled over all rows of docs.

    A task gives a vector for each language whenever it holds many distinct trigrams, and at its end; the vectors
    are added up before they are collected, so the driver gets as many as there are languages.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _vectors(dim, seed)
        sums = TrigramCounts()

        def bundled() -> Iterator[pa.RecordBatch]:
            for lang, [(codes, counts)] in sums.parts.items():
                v = vectors.bundle(codes, counts)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "v": pa.array([v.astype(np.int64)])})

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, counts = trigrams(text)
                if not codes.size:
                    continue
                sums.add(lang, codes, counts)
                if sums.held > HELD:
                    sums.merge()
                    if sums.held > HELD // 2:
                        yield from bundled()
                        sums = TrigramCounts()
        sums.merge()
        yield from bundled()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    parts = rows.mapInArrow(partial, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    summed = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["lang"]: np.array([p["x"] for p in r["v"]], np.float64) for r in summed.collect()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score"), dim: int = DIM, seed: int = 11, temperature: float = 0.05) -> DataFrame:
    """Add the nearest language and its share of a softmax over the cosines.

    Null texts, texts without a letter and a model without languages give ``und`` with score 0.  The two
    added columns replace input columns of the same name.
    """
    langs = sorted(profiles)
    matrix = np.array([profiles[k] / max(np.linalg.norm(profiles[k]), 1e-12) for k in langs]).reshape(len(langs), dim)
    kept = [c for c in docs.columns if c not in out]
    schema = docs.select(*kept).withColumns({out[0]: F.lit("").cast("string"), out[1]: F.lit(0.0)}).schema
    at = kept.index(text_col) if text_col in kept else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _vectors(dim, seed)
        for batch in batches:
            found, scores = [], []
            for text in batch.column(at):
                codes, counts = trigrams(text.as_py() or "")
                if not codes.size or not langs:
                    found.append("und")
                    scores.append(0.0)
                    continue
                v = vectors.bundle(codes, counts)
                cosine = matrix @ v / max(np.linalg.norm(v), 1e-12)
                e = np.exp((cosine - cosine.max()) / temperature)
                found.append(langs[int(cosine.argmax())])
                scores.append(float(e.max() / e.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*kept, *out])

    return docs.select(*kept).mapInArrow(score, schema)

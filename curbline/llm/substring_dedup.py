"""Removal of long byte strings that start at several places, by suffix arrays over shared pieces.

Every string of ``length`` bytes has an anchor: the place of its smallest hashed 32-byte gram.  Runs of starts with one
anchor are pieces; equal strings lie in pieces of equal anchor grams, at the same distance from the anchor.
Only grams that anchor several pieces matter.  Pieces of equal bytes are counted and need no closer look.
Of what is left, pieces whose context on either side of the anchor is found nowhere else are set aside, since a string
reaches far to one side at least.  The others are cut in 16-byte blocks aligned to the anchor, and
the blocks of many grams at once are put in suffix order by linear grouping.  Suffixes that share all the whole blocks
of a string are neighbours there; the bytes before and behind these blocks settle each start exactly.

A gram that anchors more than ``max_pieces`` distinct pieces is not gathered: its strings are counted one by one by a
128-bit hash, over all executors.

Passages are a matter of words, not of bytes: runs of so many words that another text holds too.  They are reported, not
removed, and found by the same cut into pieces, with a gram of 8 words as the anchor.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, drop_stage, lean, shuffle_partitions, stage, unused
from .suffix_array import suffix_array

GRAM = 32
BLOCK = 16
CHUNK = 1 << 20  # texts beyond this are taken in overlapping chunks, each with its own pieces
ODD = np.random.default_rng(17).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_GRAM = 8
BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
BYTES = np.random.default_rng(19).integers(0, 2**64, 256, dtype=np.uint64)
PIECES = "id long, tag long, at long, size int, anchor int, h long, c1 long, c2 long, l long, r long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _window_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from block-wise prefix and suffix minima."""
    n = len(key)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def pieces(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, starts, sizes, anchors, gram hashes, left and right context hashes) of each chunk; starts are within the chunk."""
    reach = (length - GRAM) // 2 // 8 * 8  # a string has so many bytes on one side of its anchor gram at least
    for offset in range(0, max(1, len(data) - length + 1), CHUNK - length + 1):
        part = data[offset : offset + CHUNK]
        if len(part) < length:
            return
        grams = np.ndarray((len(part) - 7,), np.uint64, part, 0, (1,))
        h8 = _mix(grams * ODD[0])
        m = len(part) - GRAM + 1
        full = _mix(h8[:m] * ODD[1] + h8[8 : 8 + m] * ODD[2] + h8[16 : 16 + m] * ODD[3] + h8[24 : 24 + m] * ODD[4])
        low = np.uint64(CHUNK - 1)
        best = (_window_min((full & ~low) | np.arange(m, dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(best[1:] != best[:-1]) + 1))
        last = np.append(first[1:], len(best)) - 1
        anchor = best[first]
        step = np.arange(reach // 8) * 8

        def context(begin: np.ndarray, ok: np.ndarray) -> np.ndarray:
            out = np.zeros(len(begin), np.uint64)
            if ok.any():
                out[ok] = _mix((h8[begin[ok][:, None] + step] * ODD[8 : 8 + len(step)]).sum(axis=1, dtype=np.uint64)) | np.uint64(1)
            return out

        left = context(anchor - reach, anchor - reach >= first)
        right = context(anchor + GRAM, anchor + GRAM + reach <= last + length)
        yield offset, first, last - first + length, anchor - first, full[anchor], left, right


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            for i, tag, text in zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text")):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for offset, at, size, anchor, h, left, right in pieces(data, length):
                    prints = [xxhash.xxh3_128_intdigest(data[a : a + s]) for a, s in zip((offset + at).tolist(), size.tolist())]
                    c1 = np.array([p & (2**64 - 1) for p in prints], np.uint64).view(np.int64)
                    c2 = np.array([p >> 64 for p in prints], np.uint64).view(np.int64)
                    n = len(at)
                    same = [pa.array(np.full(n, i, np.int64)), pa.array(np.full(n, tag, np.int64))]
                    rest = [pa.array(offset + at), pa.array(size.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c1), pa.array(c2), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(same + rest, names)

    return run


OPEN = "h long, copies long, id long, tag long, at long, anchor int, data binary"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted pieces of each text."""
    names = [x.split()[0] for x in OPEN.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            data = batch.column("text")[k].as_py().encode("utf-8", "surrogatepass")
            want = batch.column("want")[k].as_py()
            columns = list(zip(*((w["h"], w["copies"], w["at"], w["anchor"], data[w["at"] : w["at"] + w["size"]]) for w in want)))
            n = len(want)
            ids = [pa.array([batch.column(c)[k].as_py()] * n, pa.int64()) for c in ("id", "tag")]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *ids, pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], names)


def repeated_starts(strings: list[bytes], anchors: list[int], copies: list[int], length: int) -> list[np.ndarray]:
    """Of each string, the starts of its ``length``-byte strings that start anywhere else too.

    Copies count as other places.  ``length`` is a multiple of BLOCK.
    """
    whole = length // BLOCK - 1  # blocks that lie whole in a string at any alignment
    text: list[int] = []
    owner, index, first = [], [], []
    blocks = []
    for k, (s, a) in enumerate(zip(strings, anchors)):
        lead = a % BLOCK
        n = (len(s) - lead) // BLOCK
        first.append(lead)
        blocks.append(np.frombuffer(s, "V16", n, lead))
        owner.append(np.full(n + 1, k))
        index.append(np.arange(-1, n))
    owner, index = np.concatenate(owner), np.concatenate(index)
    real = index >= 0
    _, named = np.unique(np.concatenate(blocks).view("<u8").reshape(-1, 2), axis=0, return_inverse=True)
    symbols = np.empty(len(owner), np.int64)
    symbols[~real] = np.arange(len(strings))  # a separator of its own before every string
    symbols[real] = named.ravel() + len(strings)
    text = symbols.tolist()
    order = np.array(suffix_array(text), np.int64)

    # Neighbours in the order that share `whole` blocks; separators are unlike each other, so no match crosses one.
    near = np.ones(len(order) - 1, bool)
    padded = np.concatenate([symbols, -1 - np.arange(whole)])
    a, b = order[:-1], order[1:]
    alive = np.arange(len(near))
    for k in range(whole):
        alive = alive[padded[a[alive] + k] == padded[b[alive] + k]]
    near[:] = False
    near[alive] = True
    member = np.concatenate(([False], near)) | np.concatenate((near, [False]))
    group = np.concatenate(([0], np.cumsum(~near)))[member]
    at = order[member]
    out: list[list[int]] = [[] for _ in strings]
    if not at.size:
        return [np.array(x, np.int64) for x in out]
    own, begin = owner[at], np.array(first)[owner[at]] + index[at] * BLOCK
    sizes, many = np.array([len(s) for s in strings]), np.array(copies)
    around = np.zeros((len(at), 2 * BLOCK), np.uint8)  # the block before and the block behind, as far as there are bytes
    for row, (k, p) in enumerate(zip(own.tolist(), begin.tolist())):
        s = strings[k]
        before, behind = s[max(0, p - BLOCK) : p], s[p + whole * BLOCK : p + (whole + 1) * BLOCK]
        around[row, BLOCK - len(before) : BLOCK] = np.frombuffer(before, np.uint8)
        around[row, BLOCK : BLOCK + len(behind)] = np.frombuffer(behind, np.uint8)
    for before in range(BLOCK):  # bytes of the string before its whole blocks; the rest stands behind them
        behind = length - whole * BLOCK - before
        fits = np.flatnonzero((begin >= before) & (begin + whole * BLOCK + behind <= sizes[own]))
        if not fits.size:
            continue
        edge = np.zeros((len(fits), 2 * BLOCK + 8), np.uint8)
        edge[:, BLOCK - before : BLOCK + behind] = around[fits, BLOCK - before : BLOCK + behind]
        edge[:, 2 * BLOCK :] = group[fits].astype("<u8").view(np.uint8).reshape(-1, 8)
        _, same = np.unique(edge.view(f"V{2 * BLOCK + 8}").ravel(), return_inverse=True)
        seen = np.bincount(same, weights=many[own[fits]])
        for row in fits[seen[same] > 1].tolist():
            out[own[row]].append(begin[row] - before)
    return [np.unique(np.array(x, np.int64)) for x in out]


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts as maximal runs of covered bytes."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + length


def _match(length: int, batch_bytes: int = 4_000_000):
    def settle(rows: list[tuple]) -> pa.RecordBatch:
        _, copies, ids, tags, ats, anchors, data = zip(*rows)
        out = [[], [], [], []]
        for k, starts in enumerate(repeated_starts(list(data), list(anchors), list(copies), length)):
            if starts.size and copies[k] == 1:
                for lo, hi in zip(*_spans(starts, length)):
                    for column, value in zip(out, (ids[k], tags[k], ats[k] + int(lo), ats[k] + int(hi))):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "tag", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= batch_bytes and row[0] != held[-1][0]:  # all pieces of a gram stay together
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield settle(held)

    return run


def _strings(length: int):
    """One row for each string of a piece: its hash and its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, copies, i, tag, at, _, data in zip(*[c.to_pylist() for c in batch.columns]):
                n = len(data) - length + 1
                prints = [xxhash.xxh3_128_intdigest(data[k : k + length]) for k in range(n)]
                s1 = np.array([p & (2**64 - 1) for p in prints], np.uint64).view(np.int64)
                s2 = np.array([p >> 64 for p in prints], np.uint64).view(np.int64)
                same = [pa.array(np.full(n, x, np.int64)) for x in (copies, i, tag)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at + np.arange(n)), pa.array(s1), pa.array(s2)], ["copies", "id", "tag", "lo", "s1", "s2"])

    return run


def find_repeats(texts: DataFrame, length: int, max_pieces: int = 8192) -> DataFrame:
    """(id, tag, lo, hi): covered byte spans, possibly overlapping, of rows (id, tag, text)."""
    if length % BLOCK or length < 2 * GRAM + 2 * BLOCK:
        raise ValueError(f"length must be a multiple of {BLOCK} and at least {2 * GRAM + 2 * BLOCK}")
    cut = stage(texts.mapInArrow(lean(_cut(length)), PIECES), "pieces")
    # Written first: the join then has exchanges on both sides, and a gram that a third of the pieces hold is split.
    several = stage(cut.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"), "shared-grams")
    shared = stage(cut.join(several, "h", "left_semi"), "shared-pieces")
    drop_stage(cut)
    one = F.struct("id", "tag", "at", "size", "anchor")
    distinct = stage(shared.groupBy("h", "c1", "c2").agg(F.count("*").alias("copies"), F.min(one).alias("one"), F.first("l").alias("l"), F.first("r").alias("r")), "distinct-pieces")
    equal = shared.join(distinct.filter("copies > 1").select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi")
    spans = [equal.select("id", "tag", F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi"))]

    sides = []
    for side in ("l", "r"):
        met = stage(distinct.filter(F.col(side) != 0).groupBy("h", side).agg(F.count("*").alias("k"), F.min("copies").alias("least")).filter("k > 1 and least = 1").select("h", side), "shared-sides")
        sides.append(distinct.join(met, ["h", side], "left_semi").select("h", "copies", "one", "c1", "c2"))
    open_ = stage(sides[0].unionByName(sides[1]).dropDuplicates(["h", "c1", "c2"]), "open-pieces")
    wanted = open_.select("h", "copies", "one.*").groupBy("id", "tag").agg(F.collect_list(F.struct("h", "copies", "at", "size", "anchor")).alias("want"))
    wanted = stage(wanted, "wanted-pieces")
    cutouts = stage(texts.join(wanted, ["id", "tag"]).dropDuplicates(["id", "tag"]).select("id", "tag", "text", "want").mapInArrow(lean(_extract), OPEN), "piece-bytes")
    large = stage(cutouts.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > max_pieces).select("h"), "large-grams")
    n = max(2, shuffle_partitions(texts.sparkSession))
    small = cutouts.join(large, "h", "left_anti").select("h", "copies", "id", "tag", "at", "anchor", "data")
    spans.append(small.repartition(n, "h").sortWithinPartitions("h").mapInArrow(lean(_match(length)), "id long, tag long, lo long, hi long"))
    rest = cutouts.join(large, "h", "left_semi").select("h", "copies", "id", "tag", "at", "anchor", "data")
    strings = stage(rest.mapInArrow(lean(_strings(length)), "copies long, id long, tag long, lo long, s1 long, s2 long"), "single-strings")
    again = strings.groupBy("s1", "s2").agg(F.sum("copies").alias("k")).filter("k > 1").select("s1", "s2")
    spans.append(strings.filter("copies = 1").join(again, ["s1", "s2"], "left_semi").select("id", "tag", "lo", (F.col("lo") + length).alias("hi")))
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


@functools.cache
def _powers() -> np.ndarray:
    powers = np.full(CHUNK + 1, ODD[0], np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words between white space."""
    codes = np.frombuffer(data, np.uint8)
    blank = np.concatenate(([True], BLANK[codes], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, powers, k = np.empty(len(starts), np.uint64), _powers(), 0
    size = len(powers) - 1
    while k < len(starts):
        base = starts[k]
        j = int(np.searchsorted(ends, base + size, "right"))
        if j == k:  # a word longer than a chunk
            out[k] = xxhash.xxh3_64_intdigest(data[base : ends[k]])
            k += 1
            continue
        part = BYTES[codes[base : ends[j - 1]]] * powers[: ends[j - 1] - base]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
        lo, hi = starts[k:j] - base, ends[k:j] - base
        out[k:j] = (sums[hi] - sums[lo]) * powers[size - lo]
        k = j
    return starts, ends, _mix(out)


def word_pieces(hashes: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, sizes, gram hashes, left and right context hashes), counted in words, of the runs of ``words``-word strings with one anchor."""
    reach = (words - WORD_GRAM + 1) // 2  # a string has so many words on one side of its anchor gram at least
    step, powers = np.arange(reach), np.cumprod(np.full(reach, ODD[8]), dtype=np.uint64)
    for offset in range(0, max(1, len(hashes) - words + 1), CHUNK - words + 1):
        part = hashes[offset : offset + CHUNK]
        if len(part) < words:
            return
        m = len(part) - WORD_GRAM + 1
        full = _mix(sum(part[k : k + m] * ODD[k] for k in range(WORD_GRAM)))
        low = np.uint64(CHUNK - 1)
        best = (_window_min((full & ~low) | np.arange(m, dtype=np.uint64), words - WORD_GRAM + 1) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(best[1:] != best[:-1]) + 1))
        last = np.append(first[1:], len(best)) - 1
        anchor = best[first]

        def context(begin: np.ndarray, ok: np.ndarray) -> np.ndarray:
            out = np.zeros(len(begin), np.uint64)
            if ok.any():
                out[ok] = _mix((part[begin[ok][:, None] + step] * powers).sum(axis=1, dtype=np.uint64)) | np.uint64(1)
            return out

        left = context(anchor - reach, anchor - reach >= first)
        right = context(anchor + WORD_GRAM, anchor + WORD_GRAM + reach <= last + words)
        yield offset + first, last - first + words, full[anchor], left, right


def _halves(prints: list[int]) -> list[pa.Array]:
    return [pa.array(np.array(half, np.uint64).view(np.int64)) for half in ([p & (2**64 - 1) for p in prints], [p >> 64 for p in prints])]


WORD_PIECES = "id long, tag long, at long, size int, lo long, hi long, h long, l long, r long, c1 long, c2 long"
WORD_STRINGS = "own boolean, id long, tag long, lo long, hi long, s1 long, s2 long"


def _cut_words(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in WORD_PIECES.split(", ")]
        for batch in batches:
            for i, tag, text in zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text")):
                starts, ends, hashes = word_hashes(text.as_py().encode("utf-8", "surrogatepass"))
                for at, size, h, left, right in word_pieces(hashes, words):
                    prints = [xxhash.xxh3_128_intdigest(hashes[a : a + n]) for a, n in zip(at.tolist(), size.tolist())]
                    same = [pa.array(np.full(len(at), x, np.int64)) for x in (i, tag)]
                    rest = [pa.array(at), pa.array(size.astype(np.int32)), pa.array(starts[at]), pa.array(ends[at + size - 1]), *(pa.array(x.view(np.int64)) for x in (h, left, right))]
                    yield pa.RecordBatch.from_arrays([*same, *rest, *_halves(prints)], names)

    return run


def _word_strings(words: int):
    """One row for each ``words``-word string of the wanted pieces; only ``own`` ones ask for an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in WORD_STRINGS.split(", ")]
        for batch in batches:
            for i, tag, text, want in zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), batch.column("want").to_pylist()):
                starts, ends, hashes = word_hashes(text.as_py().encode("utf-8", "surrogatepass"))
                at = np.concatenate([np.arange(w["at"], w["at"] + w["size"] - words + 1) for w in want])
                own = np.repeat([w["own"] for w in want], [w["size"] - words + 1 for w in want])
                prints = [xxhash.xxh3_128_intdigest(hashes[a : a + words]) for a in at.tolist()]
                same = [pa.array(np.full(len(at), x, np.int64)) for x in (i, tag)]
                yield pa.RecordBatch.from_arrays([pa.array(own), *same, pa.array(starts[at]), pa.array(ends[at + words - 1]), *_halves(prints)], names)

    return run


def find_passages(texts: DataFrame, words: int) -> DataFrame:
    """(id, tag, lo, hi): byte spans, possibly overlapping, of ``words``-word strings that another row (id, tag, text) holds too.

    Words are compared exactly, by 64-bit hashes; white space between them is not.  Rows of one id and text are one row.
    """
    if words < WORD_GRAM:
        raise ValueError(f"words must be at least {WORD_GRAM}")
    row, piece = F.struct("id", "tag"), F.struct("id", "tag", "at", "size")
    least, most = F.min(row).alias("least"), F.max(row).alias("most")
    cut = stage(texts.filter(F.octet_length("text") >= 2 * words - 1).mapInArrow(lean(_cut_words(words)), WORD_PIECES), "word-pieces")
    several = stage(cut.groupBy("h").agg(least, most).filter("least <> most").select("h"), "shared-word-grams")
    shared = stage(cut.join(several, "h", "left_semi"), "shared-word-pieces")
    drop_stage(cut)
    # Equal pieces of several rows are settled.  Others are looked at if a kind of piece has the same context on a side;
    # two pieces stand for a settled kind.
    of = ["h", "c1", "c2"]
    kinds = shared.groupBy(*of).agg(least, most, F.array(F.min(piece), F.max(piece)).alias("ends"), F.first("l").alias("l"), F.first("r").alias("r"))
    kinds = stage(kinds.withColumn("settled", F.expr("least <> most")), "word-piece-kinds")
    spans = [shared.join(kinds.filter("settled").select(*of), of, "left_semi").select("id", "tag", "lo", "hi")]
    sides = []
    for side in ("l", "r"):
        met = kinds.filter(F.col(side) != 0).groupBy("h", side).agg(F.min("least").alias("a"), F.max("most").alias("b"), F.min("settled").alias("all"))
        met = stage(met.filter("a <> b and not all").select("h", side), "shared-word-sides")
        sides.append(kinds.join(met, ["h", side], "left_semi").select(*of, "settled", "ends"))
    open_ = stage(sides[0].unionByName(sides[1]).dropDuplicates(of), "open-word-pieces")
    own = shared.join(open_.filter("not settled").select(*of), of, "left_semi").select("at", "size", F.lit(True).alias("own"), "id", "tag")
    stand = open_.filter("settled").select(F.inline("ends")).select("at", "size", F.lit(False).alias("own"), "id", "tag")
    wanted = own.unionByName(stand).groupBy("id", "tag").agg(F.collect_set(F.struct("at", "size", "own")).alias("want"))
    wanted = stage(wanted, "wanted-word-pieces")
    strings = texts.join(wanted, ["id", "tag"]).dropDuplicates(["id", "tag"]).select("id", "tag", "text", "want")
    strings = stage(strings.mapInArrow(lean(_word_strings(words)), WORD_STRINGS), "word-strings")
    again = strings.groupBy("s1", "s2").agg(least, most).filter("least <> most").select("s1", "s2")
    spans.append(strings.filter("own").join(again, ["s1", "s2"], "left_semi").select("id", "tag", "lo", "hi"))
    return spans[0].unionByName(spans[1])


def _runs(lows: list[int] | None, highs: list[int] | None) -> list[list[int]]:
    runs: list[list[int]] = []
    for lo, hi in sorted(zip(lows or [], highs or [])):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return runs


def _remove(kept: list[str], at: int, lo_col: str, hi_col: str, *passages: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, spans, n_bytes, kind = [], [], [], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for text, lows, highs in zip(batch.column(at), batch.column(lo_col).to_pylist(), batch.column(hi_col).to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs = _runs(lows, highs)
                edges = [0, *(x for r in runs for x in r), len(data)]
                left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in runs])
                n_bytes.append(len(data))
            columns = [batch.column(k) for k in range(len(kept))]
            added = {"n_bytes": pa.array(n_bytes, pa.int64()), "kept_bytes": pa.array(left, pa.binary()), "removed": pa.array(spans, kind)}
            if passages:
                found = zip(*(batch.column(c).to_pylist() for c in passages))
                added["passages"] = pa.array([[{"start": a, "end": b} for a, b in _runs(*x)] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*columns, *added.values()], [*kept, *added])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage_words: int | None = None) -> DataFrame:
    """Add ``n_bytes``, ``kept_bytes`` and ``removed`` (maximal byte spans) to every row.

    A byte goes if a ``length``-byte string that covers it starts anywhere else, in the same text or in another.
    Null and empty texts have no bytes.  Rows with a null id take part like all others, and a row that is
    repeated counts as another place.  The added columns replace input columns of the same names.

    With ``passage_words``, ``passages`` is added too: the maximal byte spans of strings of so many words that
    another text holds as well, whatever their bytes.  They take nothing from ``kept_bytes``.
    """
    added = ("n_bytes", "kept_bytes", "removed") + (("passages",) if passage_words else ())
    kept = [c for c in docs.columns if c not in added]
    tag = F.xxhash64(text_col, F.col(id_col).isNull())
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    texts = docs.select(key.alias("id"), tag.alias("tag"), F.col(text_col).alias("text"))
    spans = find_repeats(texts.filter(F.octet_length("text") >= length), length).withColumn("word", F.lit(False))
    if passage_words:
        spans = spans.unionByName(find_passages(texts, passage_words).withColumn("word", F.lit(True)))
    # Touching pieces of a text are many; runs are merged before they meet the text.
    of = lambda c: F.sort_array(F.collect_set(F.when(c, F.struct("lo", "hi"))))
    gathered = spans.groupBy("id", "tag").agg(of(~F.col("word")).alias("s"), *([of(F.col("word")).alias("p")] if passage_words else []))
    own = unused(docs, "id", "tag", "lo", "hi", *(("p_lo", "p_hi") if passage_words else ()))
    gathered = stage(gathered.select("id", "tag", "s.lo", "s.hi", *(("p.lo", "p.hi") if passage_words else ())).toDF(*own), "repeat-spans")
    rows = docs.select(*kept, key.alias(own[0]), tag.alias(own[1])).join(gathered, own[:2], "left").select(*kept, *own[2:])
    spans_type = F.array().cast("array<struct<start:bigint,end:bigint>>")
    empty = {"n_bytes": F.lit(0).cast("long"), "kept_bytes": F.lit(b""), "removed": spans_type, "passages": spans_type}
    schema = docs.select(*kept).withColumns({c: empty[c] for c in added}).schema
    return rows.mapInArrow(lean(_remove(kept, kept.index(text_col), *own[2:])), schema)

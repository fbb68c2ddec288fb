"""Set-similarity self-join of documents on word n-grams: rare-first prefix filtering.

Shingles are ordered by document frequency.  Two sets of Jaccard similarity t share a shingle among the first
n - ceil(t n) + 1 of either, so only those are joined.  The frequencies are exact and are found with packed
shuffles: six bytes for each (shingle, document) instead of a row.  A shingle of one document only joins
nothing; it takes a place in the prefix and is then forgotten.

Shingles found in more than 1/64 of the documents ("heavy") would gather unbounded groups in one task.  They are found
first, are at most 64 times the mean set size in number, come last in the order and travel with
their documents.

Shingles are 48-bit hashes in the join.  A collision could change a link only between two sets that hold the two shingles
apart, at odds of about n * n / 2**48 for a pair of n shingles each; sizes and equal sets go by 64 and 128 bits.

Equal sets are one node.  Candidates are verified once for each pair, after length, positional and suffix filters.
Pairs are made in rounds: first every member of a shingle's group with one leader, which is linear; what is
then in one component needs no more pairs; the last round joins all remaining pairs between components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, lean, release, shuffle_partitions, stage
from .components import components

HEAVY = 64
GROUP_DOCS, GROUP_SHINGLES = 4096, 750_000
SMALL, BLOCK = 32, 512
BITS = 48  # of a shingle in the join; sets are counted with all 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def _fmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles; bytes.lower() and bytes.split() know only A-Z and ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    if len(w) < words:
        return _fmix(np.array([np.uint64(len(w)) + (w * np.array(MIX[: len(w)])).sum(dtype=np.uint64)], np.uint64))
    m = len(w) - words + 1
    s = np.zeros(m, np.uint64)
    for k in range(words):
        s += w[k : k + m] * MIX[k]
    return np.unique(_fmix(s))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def needed(na, nb, percent: int):
    """Shared shingles that two sets of these sizes need."""
    return -(-percent * (na + nb) // (100 + percent))


def _profile(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP_DOCS):
                part = batch.slice(lo, GROUP_DOCS)
                sets = [shingle_set(t.as_py(), words) for t in part.column("text")]
                prints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                low = np.array([p & (2**64 - 1) for p in prints], np.uint64).view(np.int64)
                high = np.array([p >> 64 for p in prints], np.uint64).view(np.int64)
                zero = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(high), zero, zero], ["id", "n", "f1", "f2", "token", "found"])
                every = np.sort(np.concatenate(sets) & np.uint64(2**BITS - 1)) if sets else np.zeros(0, np.uint64)
                at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if every.size else np.zeros(0, np.int64)
                counts = np.diff(np.append(at, every.size))
                much = counts >= max(4, len(sets) // (2 * HEAVY))
                token, count, none = pa.array(every[at[much]].astype(np.int64)), pa.array(counts[much]), pa.nulls(int(much.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, token, count], ["id", "n", "f1", "f2", "token", "found"])

    return run


def _deal(words: int, heavy, buckets_log: int):
    """Pack the shingles of a group of documents by bucket; the documents themselves go by their own negative bucket."""
    shift = np.uint64(BITS - buckets_log)

    def packed(ids, sets) -> Iterator[tuple[int, int, bytes]]:
        h = heavy.value
        lists, heavies = [], []
        for s in sets:
            t = np.unique(s & np.uint64(2**BITS - 1))
            hot = np.isin(t, h, assume_unique=True) if h.size else np.zeros(t.size, bool)
            lists.append(t[~hot])
            heavies.append(t[hot])
        prints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        f1 = np.array([p & (2**64 - 1) for p in prints], np.uint64).view(np.int64)
        f2 = np.array([p >> 64 for p in prints], np.uint64).view(np.int64)
        ids = np.array(ids, np.int64)
        n = np.array([len(s) for s in sets], np.int64)
        batch = xxhash.xxh64_intdigest(ids.tobytes() + f1.tobytes() + f2.tobytes()) >> 1
        yield -1 - batch % 65536, batch, pickle.dumps((ids, f1, f2, n, np.array([len(x) for x in lists]), heavies))
        token = np.concatenate(lists)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in lists])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        found, first = np.unique(token >> shift, return_index=True)
        for b, lo, hi in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), token.size]):
            step = np.diff(token[lo:hi], prepend=np.uint64(b) << shift)
            wide = bool((step >> np.uint64(32)).any())
            yield b, batch, bytes([wide]) + step.astype(np.uint64 if wide else np.uint32).tobytes() + owner[lo:hi].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            b, batch, payload = zip(*packed(ids, sets))
            for lo in range(0, len(b), 64):
                yield pa.RecordBatch.from_arrays([pa.array(b[lo : lo + 64], pa.int32()), pa.array(batch[lo : lo + 64], pa.int64()), pa.array(payload[lo : lo + 64], pa.binary())], ["bucket", "batch", "payload"])

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                s = shingle_set(text.as_py(), words)
                if s.size:
                    ids.append(i)
                    sets.append(s)
                    size += s.size
                    if len(ids) >= GROUP_DOCS or size >= GROUP_SHINGLES:
                        yield from out()
                        ids, sets, size = [], [], 0
        if ids:
            yield from out()

    return run


def _count(buckets_log: int):
    """Frequencies in one bucket; back to each group of documents go its shingles of two or more documents."""
    shift = np.uint64(BITS - buckets_log)
    names = ["batch", "payload"]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        b = key[0].as_py()
        if b < 0:
            return rows.select(names)
        tokens, owners = [], []
        for p in rows.column("payload").to_pylist():
            kind = np.dtype(np.uint64 if p[0] else np.uint32)
            m = (len(p) - 1) // (kind.itemsize + 2)
            step = np.frombuffer(p, kind, m, 1)
            tokens.append((np.uint64(b) << shift) + np.cumsum(step, dtype=np.uint64))
            owners.append(np.frombuffer(p, np.uint16, m, 1 + m * kind.itemsize))
        every = np.sort(np.concatenate(tokens))
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        counts = np.diff(np.append(first, every.size))
        shared, df = every[first[counts > 1]], np.minimum(counts[counts > 1], 65535).astype(np.uint16)
        del every, first, counts
        batch, payload = [], []
        for t, o, i in zip(tokens, owners, rows.column("batch").to_pylist()):
            at = np.searchsorted(shared, t)
            hit = np.flatnonzero((at < shared.size) & (shared[np.minimum(at, max(shared.size - 1, 0))] == t)) if shared.size else at[:0]
            if hit.size:
                batch.append(i)
                payload.append(b"\x00" + np.uint32(hit.size).tobytes() + t[hit].tobytes() + df[at[hit]].tobytes() + o[hit].tobytes())
        del tokens, owners
        release()
        return pa.table({"batch": pa.array(batch, pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


SETS = "id long, f1 long, f2 long, n long, unique long, k int, tokens array<long>"


def _assemble(percent: int):
    """Sets in rare-first order, of the documents whose prefix reaches beyond the shingles that they alone have."""

    def run(rows: pa.Table) -> pa.Table:
        release()
        docs, parts = None, []
        for p in rows.column("payload").to_pylist():
            if p[:1] == b"\x00":
                m = int(np.frombuffer(p, np.uint32, 1, 1)[0])
                parts.append((np.frombuffer(p, np.uint64, m, 5), np.frombuffer(p, np.uint16, m, 5 + 8 * m), np.frombuffer(p, np.uint16, m, 5 + 10 * m)))
            else:
                docs = pickle.loads(p)
        ids, f1, f2, n, light, heavies = docs
        token, df, owner = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint16))
        order = np.lexsort((token, df, owner))
        token, owner = token[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
        out = []
        for d in range(len(ids)):
            mine = token[cuts[d] : cuts[d + 1]]
            unique = int(n[d]) - mine.size - heavies[d].size
            k = prefix_length(int(n[d]), percent) - unique
            if k > 0:
                tokens = np.concatenate((mine, heavies[d])).astype(np.int64)
                out.append((int(ids[d]), int(f1[d]), int(f2[d]), int(n[d]), unique, k, tokens))
        names = [x.split()[0] for x in SETS.split(", ")]
        types = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int64())]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names=names)

    return run


def suffix_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Least symmetric difference of two sorted suffixes, from where b's middle element parts them."""
    if not a.size or not b.size:
        return a.size + b.size
    mid = b.size // 2
    at = int(np.searchsorted(a, b[mid]))
    return abs(at - mid) + abs((a.size - at) - (b.size - mid))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, na, nb, ta, tb in zip(*[batch.column(k) for k in range(6)]):
                na, nb = na.as_py(), nb.as_py()
                x, y = np.sort(ta.values.to_numpy()), np.sort(tb.values.to_numpy())
                need = needed(na, nb, percent)
                if (x.size + y.size - suffix_bound(x, y)) // 2 < need:
                    continue
                if np.intersect1d(x, y, assume_unique=True).size >= need:
                    a.append(i.as_py())
                    b.append(j.as_py())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def block_links(left: pa.Table, right: pa.Table, percent: int) -> list[tuple[int, int]]:
    """A star (member, smallest) of every component that links between two blocks of (id, c, n, tokens) make."""
    ids, cs, ns = (np.concatenate([t.column(k).to_numpy() for t in (left, right)]) for k in ("id", "c", "n"))
    m = left.num_rows
    na, nb = ns[:m, None], ns[None, m:]
    open_ = (cs[:m, None] != cs[None, m:]) & (100 * na >= percent * nb) & (100 * nb >= percent * na)
    if not open_.any():
        return []
    lists = [x.values.to_numpy() for t in (left, right) for x in t.column("tokens")]
    every = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    known, code = np.unique(every, return_inverse=True)
    both = (np.bincount(code[row < m], minlength=known.size) > 0) & (np.bincount(code[row >= m], minlength=known.size) > 0)
    keep = both[code]
    row, code = row[keep], (np.cumsum(both) - 1)[code[keep]]
    shared = np.zeros((m, len(lists) - m), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for lo in range(0, int(both.sum()), 4096):  # columns in parts, so the incidence matrices stay small
        here = slice(*np.searchsorted(code, (lo, lo + 4096)))
        part = np.zeros((len(lists), 4096), np.float32)
        part[row[here], code[here] - lo] = 1
        shared += part[:m] @ part[m:].T
    link = open_ & (shared >= needed(na, nb, percent))
    best, far = ids.copy(), np.iinfo(np.int64).max
    while True:
        a = np.minimum(best[:m], np.where(link, best[None, m:], far).min(axis=1))
        b = np.minimum(best[m:], np.where(link, a[:, None], far).min(axis=0))
        new = np.concatenate((a, b))
        if (new == best).all():
            return [(int(i), int(j)) for i, j in zip(ids, best) if i != j]
        best = new


def _blocks(percent: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        links = block_links(left, right, percent) if left.num_rows and right.num_rows else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within the groups (token, size) of rows; every unordered pair of a group's blocks is one task's work."""
    full = rows.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    full = full.select("token", "parts", "part", "id", "c").join(sets.select("id", "n", "tokens"), "id")
    behind, before = F.explode(F.sequence(F.col("part"), F.col("parts") - 1)), F.explode(F.sequence(F.lit(0), F.col("part")))
    left = full.select("token", F.col("part").alias("i"), behind.alias("j"), "id", "c", "n", "tokens")
    right = full.select("token", before.alias("i"), F.col("part").alias("j"), "id", "c", "n", "tokens")
    right = right.toDF(*right.columns)  # columns of their own, as both sides come from one table
    return left.groupBy("token", "i", "j").cogroup(right.groupBy("token", "i", "j")).applyInArrow(_blocks(percent), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")
    return both.mapInArrow(lean(_verify(percent)), "a long, b long")


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Length and positional filters on (na, pa, nb, pb), the sizes and the places of a common shingle."""
    t = F.lit(percent)
    lengths = (100 * F.col("na") >= t * F.col("nb")) & (100 * F.col("nb") >= t * F.col("na"))
    # A common shingle at places pa and pb leaves room for so many more behind it, and for so many before.
    room = F.least("pa", "pb") + 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    return pairs.filter(lengths & (room * (100 + percent) >= t * (F.col("na") + F.col("nb")))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90, leader_rounds: int = 2) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row.

    A set is the distinct ``words``-word shingles of the text, A-Z lower-cased, words parted by ASCII white
    space; a shorter text is one shingle, a null or blank text has none and links with nothing.  Sets link when
    100 * intersection >= percent * union.  ``component_id`` is the smallest id that links reach.
    Rows with a null id are returned with a null component and link with nothing.  Rows of equal id are
    separate documents of the same number.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = stage(rows.mapInArrow(lean(_profile(words)), "id long, n long, f1 long, f2 long, token long, found long"), "shingle-profile")
    known = profile.filter("n is not null").select("id", "n", "f1", "f2")
    reps = stage(known.filter("n > 0 and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("rep")), "equal-sets")
    total = known.count()
    often = profile.filter("token is not null").groupBy("token").agg(F.sum("found").alias("found")).filter(F.col("found") * HEAVY >= max(total, 4 * HEAVY))
    heavy = spark.sparkContext.broadcast(np.sort(np.array([r["token"] for r in often.select("token").collect()], np.uint64)))

    size = int(str(docs.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets_log = min(30, max(6, (size >> 21).bit_length()))  # about a million shingles to a bucket, at any size (2**30 buckets: 2 PB)
    dealt = rows.filter("id is not null").mapInArrow(lean(_deal(words, heavy, buckets_log)), "bucket int, batch long, payload binary")
    back = dealt.groupBy("bucket").applyInArrow(_count(buckets_log), "batch long, payload binary")
    sets = stage(back.groupBy("batch").applyInArrow(_assemble(percent), SETS), "rare-first")
    sets_of = stage(sets.join(reps.withColumnRenamed("rep", "id"), ["f1", "f2", "id"]).dropDuplicates(["id", "f1", "f2"]).select("id", "n", "unique", "k", "tokens"), "rare-first-sets")
    drop_stage(sets)

    prefix = stage(sets_of.select("id", F.col("id").alias("c"), "n", "unique", F.posexplode(F.slice("tokens", F.lit(1), F.col("k"))).alias("i", "token")).select("id", "c", "n", (F.col("unique") + F.col("i")).alias("p"), "token"), "prefixes")
    links = spark.createDataFrame([], "a long, b long")
    classes = None

    def still_open(rows: DataFrame) -> DataFrame:
        mixed = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
        return rows.join(mixed, "token", "left_semi")

    for step in range(leader_rounds + 1):
        prefix = stage(still_open(prefix), "prefixes-open")
        if prefix.isEmpty():
            break
        a = prefix.select("token", *[F.col(x).alias(y) for x, y in (("id", "a"), ("c", "ca"), ("n", "na"), ("p", "pa"))])
        if step < leader_rounds:
            lead = prefix.groupBy("token").agg(F.min_by(F.struct("id", "c", "n", "p"), F.xxhash64(F.lit(step), "id")).alias("l"))
            b = lead.select("token", *[F.col(f"l.{x}").alias(y) for x, y in (("id", "b"), ("c", "cb"), ("n", "nb"), ("p", "pb"))])
            pairs = a.join(b, "token").filter("a <> b and ca <> cb")
            found = stage(_verified(_plausible(pairs, percent), sets_of, percent), "links")
        else:
            size = stage(prefix.groupBy("token").agg(F.count("*").alias("size")), "group-sizes")
            few = size.filter(F.col("size") <= SMALL).select("token")
            b = prefix.join(few, "token", "left_semi").select("token", *[F.col(x).alias(y) for x, y in (("id", "b"), ("c", "cb"), ("n", "nb"), ("p", "pb"))])
            pairs = a.join(b, "token").filter("a < b and ca <> cb")
            large = prefix.join(size.filter(F.col("size") > SMALL), "token")
            found = stage(_verified(_plausible(pairs, percent), sets_of, percent).unionByName(_in_blocks(large, sets_of, percent)), "links")
        classes = stage(components(links.unionByName(found)), "classes")
        links = classes.select(F.col("id").alias("a"), F.col("component").alias("b"))  # all that earlier links say
        prefix = prefix.drop("c").join(classes.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    out = known.join(reps, ["f1", "f2"], "left")
    out = out.join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left") if classes is not None else out.withColumn("component", F.lit(None).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))

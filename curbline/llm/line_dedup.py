"""Line deduplication over levelled sorted runs of line hashes.

Every line is hashed once, into a written table with a folder for each batch of ascending ids.  A batch's distinct
hashes are merge-anti-joined with the sorted runs of all earlier batches: what a run holds belongs to an earlier
document, what none holds is the batch's own new run.  Runs are bucketed and sorted on the hash, so that the
merge reads them in place, without a shuffle.  Once ``fanout`` runs stand at a level they are compacted into
one of the next level, so a batch meets a number of runs that grows with the logarithm of the corpus.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, drop_path, drop_stage, scratch_path, shuffle_partitions, stage, unused

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Sorted, bucketed runs of the line hashes seen so far, by level."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.tables: dict[str, str] = {}  # path of each table written

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame) -> tuple[DataFrame, str]:
        name, path = f"curbline_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        self.tables[name] = path
        df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", path).saveAsTable(name)
        return self.spark.table(name), path

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge a batch of (h1, h2, id); add its new hashes as a run; return (h1, h2, owner) of the hashes that several
        documents hold, the owner being null where an earlier batch has it."""
        keys = lines.groupBy(*KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"))
        known = F.lit(False)
        for k, run in enumerate(self.runs()):
            keys = keys.join(run.select(*KEY, F.lit(True).alias(f"in{k}")), KEY, "left")
            known |= F.coalesce(f"in{k}", F.lit(False))
        met, path = self._write(keys.select(*KEY, F.when(~known, F.col("first")).alias("owner"), (known | (F.col("first") != F.col("last"))).alias("shared")))
        self._push(met.filter("owner is not null").select(*KEY), 0)
        # Read as plain files: the join with the lines then has exchanges on both sides, and a line that a third of the
        # documents hold is split over many tasks.
        return self.spark.read.schema(met.schema).parquet(path).filter("shared").select(*KEY, "owner")

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._push(self._write(merged.repartition(self.buckets, *KEY))[0], level + 1)

    def close(self) -> None:
        """Drop the runs' tables and files."""
        for name, path in self.tables.items():
            self.spark.sql(f"drop table if exists {name}")
            drop_path(self.spark, path)
        self.tables, self.levels = {}, []


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 5, fanout: int = 4) -> DataFrame:
    """Drop every line that an earlier document holds, and return the rows with their kept text.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.  Keys of
    at least ``min_chars`` code points that occur in several documents stay in the smallest id alone,
    with all their lines there.  Keys are held by 128 bits of hash.  Added columns, which replace input
    columns of the same name: ``n_lines`` and ``n_dropped``.  All other columns come back as they were.

    Null or empty text is one empty line.  Rows with a null id keep all their lines and own none.
    Rows of equal id are one document: they never take lines from one another, and all are returned.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    quantiles = docs.select(F.col(id_col).cast("double").alias("d")).dropna().approxQuantile("d", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(b) for b in quantiles})
    batch = reduce(lambda c, e: c + (F.col("id") > e).cast("int"), edges, F.lit(0))
    part = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter("id is not null")
    part = part.select("id", "t", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    lines = stage(part.select("id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), batch.alias("batch")), "lines", by="batch")

    runs = LineRuns(spark, fanout)
    try:
        shared = [runs.add(lines.filter(F.col("batch") == k).select(*KEY, "id")).withColumn("batch", F.lit(k)) for k in range(len(edges) + 1)]
        hits = lines.join(reduce(DataFrame.unionByName, shared), [*KEY, "batch"]).filter("owner is null or id <> owner")
        dropped = stage(hits.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("pos")), "line-drops")
    finally:
        runs.close()
    drop_stage(lines)

    own_id, own_t, own_drop = unused(docs, "id", "t", "pos")
    rows = docs.withColumns({own_id: F.col(id_col).cast("long"), own_t: F.xxhash64(text)})
    out = rows.join(dropped.toDF(own_id, own_t, own_drop), [own_id, own_t], "left")
    each, at = F.split(text, "\n"), F.coalesce(own_drop, F.array().cast("array<int>"))
    kept = F.when(F.col(own_drop).isNull(), text).otherwise(F.array_join(_kept(each, at), "\n"))
    new = {text_col: kept, "n_lines": F.size(each).cast("long"), "n_dropped": F.size(at).cast("long")}
    return out.withColumns(new).select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def _kept(each: Column, at: Column) -> Column:
    """Lines between the dropped positions, as slices, so that a document of n lines costs O(n)."""

    def cut(bound: Column) -> Column:  # bound: struct of the lines split once and the positions
        lines, gone = bound["lines"], bound["gone"]
        n = F.size(gone)
        begin = lambda k: F.when(k == 0, 0).otherwise(F.get(gone, k - 1) + 1)
        end = lambda k: F.when(k == n, F.size(lines)).otherwise(F.get(gone, k))
        return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(lines, begin(k) + 1, end(k) - begin(k))))

    return F.transform(F.array(F.struct(each.alias("lines"), at.alias("gone"))), cut)[0]

"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest: one row per distinct text
with the row that stays and the number of copies of the batch that brought it.
New data is pre-aggregated to one row per digest, deduplicated by a sort-merge
anti-join with the index, and appended. All of it is DataFrame code. A batch that
is run again after it was appended gives the same rows: the index names the row
that stays.

Edge cases: null text counts as empty; of equal texts the largest doc_id of the
first batch that holds the text stays; rows that repeat a doc_id and its text
are copies too, of which one stays; a null doc_id stays only where its group has
no other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, file_system, keep_only, new_path, passing, remove, stored


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of the normalised text: A-Z lower-cased, nothing else."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))


def digest() -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """A persistent table (digest, keep_id, group_size) at ``path``, bucketed and sorted by digest.

    ``path`` is a folder that driver and executors share: ``data`` holds the
    buckets, ``manifest`` their number. Any later session opens it by its path;
    each one names the table in its own catalog.
    """

    SCHEMA = "digest binary, keep_id long, group_size long"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        system, manifest = file_system(spark, f"{self.path}/manifest/_SUCCESS")
        if system.exists(manifest):
            self.buckets = spark.read.schema("buckets int").json(f"{self.path}/manifest").first()["buckets"]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # another session may have appended
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add those of ``groups`` (one row per digest) that the index doesn't hold."""
        # The bucketed side needs no shuffle; the batch is dealt as the buckets are.
        new = groups.repartition(self.buckets, "digest").join(self.read().hint("merge"), "digest", "left_anti")
        new = new.select("digest", "keep_id", "group_size")
        new.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", f"{self.path}/data").saveAsTable(self.name)

    def lookup(self, groups: DataFrame) -> DataFrame:
        """The index's rows for the digests of ``groups``."""
        asked = groups.select("digest").repartition(self.buckets, "digest")
        return self.read().hint("merge").join(asked, "digest", "left_semi")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def exact_duplicates(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Append ``docs`` to ``index``; one row per row of ``docs``:
    doc_id, keep_id, group_size, kept, text_sha256."""
    # One row per text and doc_id; copies of one text never meet in one task.
    marked = stored(digests(docs).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), "digests")
    groups = stored(marked.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    index.append(groups)
    of = stored(index.lookup(groups).withColumnRenamed("digest", "of"), "kept")
    joined = marked.join(of, marked["digest"] == of["of"])
    return joined.select("*", F.posexplode(F.sequence(F.lit(1).cast("long"), "n")).alias("at", "nth")).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("at") == 0)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder that goes with the application."""
    return DigestIndex(spark, passing(spark, new_path(spark, "digest-index")))


def without_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """``docs`` with one row of each text that ``index`` didn't hold before."""
    keep = exact_duplicates(docs, index).where("kept").select("doc_id", F.unhex("text_sha256"))
    return keep_only(docs, keep, digest())

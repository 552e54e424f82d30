"""What the corpus operators share: the shared folder, written tables, batches."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewright.workers import ship

_OWN: dict[str, str] = {}
#: Where the tables that ``stored`` has written lie.
_AT: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and all runs on one machine (tests), a temporary folder is
    made once per application; on a cluster it has to be set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="cubewright-")
    return at.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> str:
    """``path``, a folder (made if need be) that goes when the application ends."""
    system, at = file_system(spark, path)
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    system, at = file_system(spark, path)
    system.delete(at, True)


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    It cuts the lineage, survives lost executors, and puts a plain scan below
    later joins, so that adaptive execution can split a hot key's partition.
    ``instead_of``: a stored table of which nothing is read any more; its files go.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(passing(spark, path))
    _AT[out] = path
    if instead_of is not None and instead_of in _AT:
        remove(spark, _AT.pop(instead_of))
    return out


def forget(*tables: DataFrame) -> None:
    """Remove the files of stored tables of which nothing is read any more."""
    for df in tables:
        if df in _AT:
            remove(df.sparkSession, _AT.pop(df))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Send this package to the executors. Batches that reach Python are bounded by
    Spark (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB), so very long texts come in small ones."""
    ship(spark)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the byte-wise path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def within(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than needed."""
    return df.limit(most + 1).count() <= most


def text_digest() -> Column:
    """SHA-256 of the column ``text``: with doc_id it names a row, also where ids are null or repeated."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def without_rows(docs: DataFrame, keys: DataFrame, digest: Column) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``digest`` are a row of ``keys``
    (doc_id, digest); null ids equal each other."""
    tag = uuid.uuid4().hex
    theirs = (f"__ki{tag}", f"__kd{tag}")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(theirs[0])) & (digest == F.col(theirs[1]))
    return docs.join(keys.toDF(*theirs), same, "left_anti")


def keep_only(docs: DataFrame, keys: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` whose doc_id and ``digest`` (of a row's text) are a row
    of ``keys`` (doc_id, digest), one row for each; null ids equal each other.

    Whole texts are shuffled only for keys that more than one row has.
    """
    tag = uuid.uuid4().hex
    own, theirs = (f"__i{tag}", f"__d{tag}"), (f"__ki{tag}", f"__kd{tag}")
    keyed = docs.withColumns({own[0]: F.col("doc_id").cast("long"), own[1]: digest})

    def among(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
        return rows.join(of.toDF(*theirs), F.col(own[0]).eqNullSafe(F.col(theirs[0])) & (F.col(own[1]) == F.col(theirs[1])), how)

    kept = among(keyed, keys, "left_semi")
    repeated = keyed.groupBy(*own).count().where("count > 1").select(*own)
    if not repeated.isEmpty():
        kept = among(kept, repeated, "left_anti").unionByName(among(kept, repeated, "left_semi").dropDuplicates(list(own)))
    return kept.drop(*own)

"""What the corpus operators share: the word rule, table reading and places for intermediate results."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words, as a Java character class and as plain characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bits of a bitmap of keys, as a power of two.
MARKS = 25
#: Keys of more rows than HOT are spread over SALTS tasks; at most HOT_KEYS of them, the largest.
HOT, HOT_KEYS, SALTS = 1000, 1000, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_value(module: str) -> None:
    """Workers get this module's functions with the task, so that they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def trimmed(text: Column) -> Column:
    """The text without white space at its ends; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def word_array(text: Column) -> Column:
    """The words of a text; no words give an array of no elements."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+", -1))


def squeezed(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave that unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the cluster has to name a folder that driver and executors share")
        where = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="emberframe-")
        shared_dir.own = where
    return where.rstrip("/")


_HELD: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, which cuts the lineage; ``released`` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emberframe-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _HELD:
        atexit.register(_release_all)
    _HELD[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes tables that written gave, as soon as what was made from them is written itself."""
    for t in tables:
        path = t._written_to
        if path in _HELD:
            _remove(_HELD.pop(path), path)


def _release_all() -> None:
    while _HELD:
        path, spark = _HELD.popitem()
        _remove(spark, path)


def narrowed(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key may be among ids (one column); an inner join with distinct ids must follow, as others may pass too.

    Keys are looked up in a bitmap of 2^MARKS bits, at most 4 MB however many ids there are, so it may be broadcast. With
    few ids almost all other rows are dropped before they are shuffled; with very many ids all pass.
    """
    place = lambda c: F.xxhash64(c).bitwiseAND((1 << MARKS) - 1)
    marks = ids.select(place(ids[ids.columns[0]]).alias("__at")).withColumn("__part", F.shiftright("__at", 15)).repartition("__part")
    marks = marks.groupBy("__part").agg(F.bitmap_construct_agg(F.col("__at").bitwiseAND(32767)).alias("__bits"))
    found = rows.withColumn("__at", place(rows[key])).withColumn("__part", F.shiftright("__at", 15)).join(F.broadcast(marks), "__part")
    byte = F.conv(F.hex(F.expr("substring(__bits, int((__at & 32767) div 8) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftleft(1, int(__at & 7))")
    return found.where(byte.bitwiseAND(bit) != 0).select(*rows.columns)


def hot_join(rows: DataFrame, found: DataFrame, key: str, counts: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """rows joined with found by key, where the rows of a hot key go to SALTS tasks instead of one.

    counts(key, n_rows): how many rows a key has. Hot are the HOT_KEYS keys of most rows, if these are more than HOT; only
    they are broadcast, so there is a bound whatever the input. A key beyond them has less than 1 / HOT_KEYS of all rows.
    salt: a number that differs among the rows of a key, and is the same if a lost task is done again.
    """
    hot = counts.where(F.col("n_rows") > HOT).orderBy(F.desc("n_rows"), key).limit(HOT_KEYS).select(key, F.lit(True).alias("__hot"))
    hot = F.broadcast(hot)
    rows = rows.withColumn("__any", F.pmod(salt, F.lit(SALTS)).cast("int")).join(hot, key, "left")
    rows = rows.withColumn("__salt", F.when(F.col("__hot"), F.col("__any")).otherwise(0)).drop("__hot", "__any")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = found.join(hot, key, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return rows.join(found, [key, "__salt"], how).drop("__salt")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the shared folder is the cluster's to clean
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

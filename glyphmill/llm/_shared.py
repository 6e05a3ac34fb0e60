"""What several operators of this subpackage need: shared files, ranks, components."""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: The white space of every word contract: space and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_RUN = r"[\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_dir: list[str] = []
#: Paths of tables that are cut, by their DataFrame, and the lists that open scopes add them to.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset, as in tests, a temporary one.

    A temporary folder is on one machine, so it is made only where driver and
    executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="glyphmill-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def _place(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends, and a lost executor costs nothing.

    The table goes when the session ends, with free(), or with the scope it
    was cut in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for s in _scopes:
        s.append(path)
    return out


def free(*dfs: DataFrame) -> None:
    """Deletes tables that were cut and that nothing will read again."""
    for df in dfs:
        if path := _paths.pop(df, None):
            place, files = _place(df.sparkSession, path)
            files.delete(place, True)


@contextlib.contextmanager
def scope(paths: list[str]) -> Iterator[None]:
    """Adds the paths of tables cut within it to paths, for free_paths()."""
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()


def free_paths(spark: SparkSession, paths: list[str], but_for: DataFrame) -> None:
    """Deletes these tables, except any that but_for still reads; takes what it deletes from paths."""
    read = but_for.inputFiles() if paths else []
    for path in list(paths):
        if not any(path.rpartition("/")[2] in f for f in read):
            place, files = _place(spark, path)
            files.delete(place, True)
            paths.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body uses it within lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda x: x != "")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def hex_digits(n_rows: int, per_bucket: int) -> int:
    """Leading hex digits of a uniform hash that cut n_rows into buckets of about per_bucket rows."""
    digits = 0
    while n_rows > per_bucket * 16**digits:
        digits += 1
    return digits


def ranked(df: DataFrame, group: list[str], shuffled: str, ties: list[str], n_rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Adds rank (from 0, by shuffled then ties) and group_rows within each group of df.

    shuffled is a column of uniform hex strings; its leading digits cut every
    group into buckets in the same order, so a group that holds a third of all
    rows is ranked by many tasks. Only bucket counts are added up in order.
    Group columns must not be null.
    """
    digits = hex_digits(n_rows, per_bucket)
    df = df.withColumn("_bucket", F.substring(shuffled, 1, digits) if digits else F.lit(""))
    keys = [*group, "_bucket"]
    within = W.Window.partitionBy(*group)
    before = within.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(within).alias("group_rows"))
    order = W.Window.partitionBy(*keys).orderBy(shuffled, *ties)
    return df.join(counts, keys).withColumn("rank", F.col("_before") + F.row_number().over(order) - 1).drop("_bucket", "_before")


#: Blocks of 64 bits of a Bloom filter at most: 2**20 rows of 16 bytes, however many values. Over 4 million values it is fuller and only passes more on.
MOST_BLOCKS = 1 << 20
BITS_A_VALUE, PROBES = 16, 5


def bloom_block(value: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n_blocks))


def bloom_mask(value: Column) -> Column:
    """PROBES bits of a 64-bit block, six bits of another hash each."""
    h, mask = F.xxhash64(F.lit("block"), value), F.lit(0).cast("long")
    for k in range(PROBES):
        place = F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom_blocks(values: DataFrame, n_values: int) -> tuple[DataFrame, int]:
    """(block, bits) of the only column of values, and the number of blocks; at most MOST_BLOCKS rows for any list."""
    n_blocks = min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, n_values * BITS_A_VALUE / 64)))))
    v = F.col(values.columns[0])
    return values.select(bloom_block(v, n_blocks).alias("block"), bloom_mask(v).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits")), n_blocks


def marked(df: DataFrame, value: Column, wanted: DataFrame) -> DataFrame:
    """df with `_maybe`: whether value may be among the values of wanted's only column; never false for one that is.

    wanted is read twice; pass it cut.
    """
    blocks, n_blocks = bloom_blocks(wanted, wanted.count())
    tested = df.withColumn("_block", bloom_block(value, n_blocks)).join(F.broadcast(blocks.withColumnsRenamed({"block": "_block", "bits": "_bits"})), "_block", "left")  # at most MOST_BLOCKS rows
    return tested.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bloom_mask(value)) == bloom_mask(value), F.lit(False))).drop("_block", "_bits")


def likely(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of df whose column may be among the values of wanted's only column; none that is is lost.

    Goes ahead of an exact join, so that what can't match is never shuffled.
    wanted is read twice; pass it cut.
    """
    return marked(df, F.col(column), wanted).filter("_maybe").select(*df.columns)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star: each node's neighbours are joined to
    its smallest one. A star of any size settles within two rounds, a path of
    n nodes in O(log n). Every round's edges are cut to the shared folder, and
    the last round's are deleted.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        small = cut(small)
        state = small.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        free(now, large)
        now = small
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def agreed_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with label 0 or 1; doc_ids that are null or labelled both ways are left out."""
    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_top")).filter("label = _top").drop("_top")


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, those whose doc_id has the smallest md5; the same rows on every run."""
    return rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)


LONG = T.LongType()

"""Sharding: proportional stratified interleaving of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from glyphmill.llm._shared import cut, ranked, table

SHARDS, SEED = 16, "interleave-1"


def interleave(documents: DataFrame, shards: int = SHARDS, seed: str = SEED, per_bucket: int = 50_000) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot and grown_shard of every row of documents (doc_id, text, source).

    Rows of a source are shuffled by a seeded hash and ranked; row r of n gets
    the place (2r + 1) / 2n. Sorted by that place all sources are spread
    evenly, so cutting the order into runs of equal length gives every shard
    the mixture, with row counts at most one apart (law `rows`).

    Equal texts go to whatever shards their rows' places fall into, as this
    law allows. A null source is a source of its own; a null text has size 1.
    The hash is of doc_id and text, so rows without doc_id are dealt out as
    well. Its ties go by text checksum, then size; rows equal in all of these
    may swap places, which changes nothing in the result. Ranks come from
    bucket counts, so neither a hot source nor the whole order is ever sorted
    in one task.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.crc32(text.cast("binary"))).cast("binary")).alias("h"),
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("stratum"),
    )
    rows = cut(rows)
    n = rows.count()
    placed = ranked(rows, ["stratum"], "h", ["text_crc32", "size"], n, per_bucket)
    runs = max(1, -(-n // per_bucket))
    placed = placed.withColumn("place", (2 * F.col("rank") + 1) / (2.0 * F.col("group_rows")))
    placed = placed.withColumn("run", F.least(F.floor(F.col("place") * runs), F.lit(runs - 1)).cast("long"))
    placed = cut(placed.drop("rank", "group_rows"))
    whole = W.Window.orderBy("run").rowsBetween(W.Window.unboundedPreceding, -1)
    before = placed.groupBy("run").agg(F.count(F.lit(1)).alias("_n")).select("run", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before"))  # a row for each per_bucket rows of input
    order = W.Window.partitionBy("run").orderBy("place", "stratum", "h", "text_crc32", "size")
    out = placed.join(before, "run").withColumn("g", F.col("_before") + F.row_number().over(order) - 1)
    shard = F.expr(f"(g * {shards}L) div {max(1, n)}L")
    out = out.withColumn("_shard", shard)
    start = F.expr(f"(_shard * {n}L + {shards - 1}L) div {shards}L")
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), (F.col("g") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(str(n))
    return "[" + ",".join(out) + "]"


SQL = f"""
with bytes as (
  select doc_id, source, coalesce(text, '') as t,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint)) as b
  from documents),
summed as (
  select doc_id, source, t,
    xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda c, x: xor(c >> 8, list_extract(cast({_crc_table()} as bigint[]), cast(xor(c, x) & 255 as bigint) + 1))), cast(4294967295 as bigint)) as text_crc32
  from bytes),
rows_ as (
  select doc_id, source, cast(strlen(t) + 1 as bigint) as size, text_crc32,
    md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || text_crc32) as h,
    case when source is null then '0' else '1' || source end as stratum
  from summed),
placed as (
  select *, (2 * (row_number() over (partition by stratum order by h, text_crc32, size) - 1) + 1) / (2.0::double * count(*) over (partition by stratum)) as place
  from rows_),
ordered as (
  select *, row_number() over (order by place, stratum, h, text_crc32, size) - 1 as g, count(*) over () as n from placed)
select doc_id, source, size, text_crc32, 'rows' as law, cast(g * {SHARDS} // n as integer) as shard,
  cast(g - ((g * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} as bigint) as slot, cast(null as integer) as grown_shard
from ordered
"""

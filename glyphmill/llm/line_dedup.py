"""Line dedup: exact reference counts of line keys, with sharded cuckoo filters of the frequent ones in front.

Both take insertions and deletions of documents, so incremental dedup can be undone.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm._shared import cut, likely, marked, table

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
#: Keys a shard's filter is meant for, and bytes of all filters beyond which they aren't broadcast and every key goes to the exact join.
KEYS_A_SHARD, MOST_FILTER_BYTES = 50_000, 64 << 20
SLOTS, MOST_KICKS = 4, 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports deletion. Keys are pairs of 64-bit numbers.

    A key that finds no room after MOST_KICKS moves doubles the table from the
    exact keys given to build(), so no key is ever lost.
    """

    def __init__(self, buckets: int = 16, cells: np.ndarray | None = None):
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells
        self.mask = len(self.cells) - 1

    @staticmethod
    def _print(k2: int) -> int:
        return ((k2 >> 13) & 0xFFFF) or 1

    def _other(self, i: int, f: int) -> int:
        return (i ^ (f * 0x5BD1E995)) & self.mask

    def insert(self, k1: int, k2: int) -> bool:
        """False if the table is too full; it is then left as it was."""
        f = self._print(k2)
        i = k1 & self.mask
        for b in (i, self._other(i, f)):
            for s in range(SLOTS):
                if not self.cells[b, s]:
                    self.cells[b, s] = f
                    return True
        undo = []
        for n in range(MOST_KICKS):
            s = (k2 + n) % SLOTS
            undo.append((i, s, self.cells[i, s]))
            f, self.cells[i, s] = int(self.cells[i, s]), f
            i = self._other(i, f)
            for s in range(SLOTS):
                if not self.cells[i, s]:
                    self.cells[i, s] = f
                    return True
        for i, s, old in reversed(undo):
            self.cells[i, s] = old
        return False

    def delete(self, k1: int, k2: int) -> bool:
        """Takes out one copy of a key that was inserted."""
        f = self._print(k2)
        i = k1 & self.mask
        for b in (i, self._other(i, f)):
            for s in range(SLOTS):
                if self.cells[b, s] == f:
                    self.cells[b, s] = 0
                    return True
        return False

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Per key, whether it may be present; never False for one that is."""
        a, f = k1.astype(np.int64), (k2.astype(np.int64) >> 13) & 0xFFFF
        f = np.where(f == 0, 1, f)
        i = a & self.mask
        j = (i ^ (f * 0x5BD1E995)) & self.mask
        f = f.astype(np.uint16)[:, None]
        return (self.cells[i] == f).any(axis=1) | (self.cells[j] == f).any(axis=1)

    @classmethod
    def build(cls, keys: list[tuple[int, int]]) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * 0.9 < len(keys):
            buckets *= 2
        while True:
            out = cls(buckets)
            if all(out.insert(a, b) for a, b in keys):
                return out
            buckets *= 2

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(cells=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def line_key(line: bytes) -> bytes:
    """A line (UTF-8) with white space stripped at both ends and A-Z lower-cased."""
    return line.strip().lower()


def key_hash(line: bytes, least_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key has fewer than least_chars code points."""
    key = line_key(line)
    if len(key) < least_chars or (len(key) < 4 * least_chars and len(key.decode()) < least_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _postings(least_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = {h for line in (text or "").encode().split(b"\n") if (h := key_hash(line, least_chars))}
                ids += [doc_id] * len(found)
                keys += found
        k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])], ["doc_id", "k1", "k2"])


def line_postings(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, k1, k2): the keys of each text's lines, once a row of documents (doc_id, text). Rows without doc_id count nowhere."""
    rows = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(functools.partial(_postings, least_chars), "doc_id long, k1 long, k2 long")


def reference_counts(postings: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, last_doc): how many documents hold each key, and the largest doc_id of them.

    First a (key, document) is counted once, then keys are: a key that every
    document holds is pre-aggregated by each task.
    """
    once = postings.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("_one"))
    return once.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _shard(n_shards: int) -> Column:
    return F.pmod(F.shiftright("k1", 32), F.lit(n_shards)).cast("int")


def build_filters(frequent: DataFrame, n_shards: int) -> DataFrame:
    """(shard, cells): a cuckoo filter of each shard's frequent keys (k1, k2)."""

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(keys["k1"].tolist(), keys["k2"].tolist(), strict=True))
        return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "cells": [CuckooFilter.build(pairs).to_bytes()]})

    return frequent.select(_shard(n_shards).alias("shard"), "k1", "k2").groupBy("shard").applyInPandas(build, "shard int, cells binary")


def _may_hold(filters, n_shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_shard = {s: CuckooFilter.from_bytes(c) for s, c in filters.value.items()}
    for batch in batches:
        k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        shard, keep = (k1 >> 32) % n_shards, np.zeros(len(k1), bool)
        for s in np.unique(shard):
            if (f := by_shard.get(int(s))) is not None:
                at = np.flatnonzero(shard == s)
                keep[at] = f.holds(k1[at], k2[at])
        yield batch.filter(pa.array(keep))


def pass_filters(postings: DataFrame, filters: DataFrame, n_shards: int, most_bytes: int = MOST_FILTER_BYTES) -> DataFrame:
    """The postings whose key may be frequent. Filters of more than most_bytes in all aren't broadcast: then all postings pass."""
    total = filters.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0]
    if total > most_bytes:
        return postings
    shared = postings.sparkSession.sparkContext.broadcast({r.shard: bytes(r.cells) for r in filters.collect()})  # at most most_bytes
    return postings.select("doc_id", "k1", "k2").mapInArrow(functools.partial(_may_hold, shared, n_shards), "doc_id long, k1 long, k2 long")


def dropped_keys(postings: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, drops): the frequent keys (k1, k2, last_doc) each document loses, as little-endian bytes of 16 a key."""
    lost = postings.join(frequent.select("k1", "k2", "last_doc"), ["k1", "k2"]).filter("doc_id <> last_doc").select("doc_id", "k1", "k2")
    return lost.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("drops"))


def _without(text: str | None, drops: list[dict], least_chars: int) -> tuple[int, str]:
    """How many lines of text have one of these keys, and the text without them."""
    gone = {d["k1"].to_bytes(8, "little", signed=True) + d["k2"].to_bytes(8, "little", signed=True) for d in drops}
    lines = (text or "").encode().split(b"\n")
    kept = [x for x in lines if key_hash(x, least_chars) not in gone]
    return len(lines) - len(kept), b"\n".join(kept).decode()


def _cleaner(least_chars: int):
    """An Arrow function (text, drops) -> (n_dropped, kept) of rows that lose lines."""

    def clean(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = [_without(t, d, least_chars) for t, d in zip(texts.to_pylist(), drops.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([t for _, t in out], pa.string())], ["n_dropped", "kept"])

    return F.arrow_udf(clean, "n_dropped long, kept string")


def _cleaned(packed: DataFrame, drops: DataFrame, least_chars: int) -> DataFrame:
    """packed (row, a struct with doc_id and text) with `out`: (n_dropped, kept), or null for a row that loses nothing.

    A Bloom filter of the doc_ids in drops tells most rows that lose nothing
    apart: these are neither joined nor shuffled, nor read by Python. drops
    (doc_id, drops) grows with the documents and is never broadcast.
    """
    drops = cut(drops)
    tested = marked(packed.withColumn("_id", F.col("row.doc_id").cast("long")), F.col("_id"), drops.select("doc_id"))
    nothing = F.lit(None).cast("struct<n_dropped:bigint,kept:string>")
    same = tested.filter(~F.col("_maybe")).select("row", nothing.alias("out"))
    lost = drops.select(F.col("doc_id").alias("_id"), "drops").hint("merge")
    joined = tested.filter("_maybe").join(lost, "_id", "left").select("row", "drops")
    text = F.col("row.text").cast("string")
    out = F.when(F.col("drops").isNotNull(), _cleaner(least_chars)(text, F.coalesce("drops", F.array().cast("array<struct<k1:bigint,k2:bigint>>"))))
    return same.unionByName(joined.select("row", out.alias("out")))


def _packed(documents: DataFrame) -> DataFrame:
    """Each row as one struct: no column of documents can clash with those made here."""
    return documents.select(F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("row"))


def restore(documents: DataFrame, drops: DataFrame, least_chars: int = LEAST_CHARS, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text (if asked for) and kept_sha256 of every row of documents, without its lost keys' lines."""
    done = _cleaned(_packed(documents.select("doc_id", "text")), drops, least_chars)
    text = F.col("row.text").cast("string")
    kept = F.coalesce("out.kept", text, F.lit(""))
    return done.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce("out.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        (F.when(text.isNotNull(), kept) if with_text else F.lit(None).cast("string")).alias("kept_text"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


def find_drops(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, drops) of documents (doc_id, text): keys found in least_documents or more go from all but the largest doc_id."""
    postings = cut(line_postings(documents, least_chars))
    frequent = cut(reference_counts(postings).filter(F.col("n_docs") >= least_documents))
    n_shards = 1 + frequent.count() // KEYS_A_SHARD
    filters = cut(build_filters(frequent, n_shards))
    return dropped_keys(pass_filters(postings, filters, n_shards), frequent)


def dedup_lines(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, with_text: bool = False) -> DataFrame:
    """restore() of documents with the keys that find_drops() finds.

    A null or empty text is one empty line. A row without doc_id counts as no
    document and keeps all lines. Rows that share a doc_id count as one
    document and lose or keep lines alike. In the largest doc_id all lines of
    a key stay.
    """
    return restore(documents, find_drops(documents, least_chars, least_documents), least_chars, with_text)


def rewrite(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """documents, all columns, with the lines dropped that dedup_lines() drops; n_chars is set to the new length where a text changed.

    Rows that lose nothing, null texts among them, come back as they are.
    Columns of any name pass through.
    """
    done = _cleaned(_packed(documents), find_drops(documents.select("doc_id", "text"), least_chars, least_documents), least_chars)
    kinds, row, changed = dict(documents.dtypes), F.col("row"), F.col("out.kept")
    new = row.withField("text", changed.cast(kinds["text"]))
    if "n_chars" in kinds:
        new = new.withField("n_chars", F.length(changed).cast(kinds["n_chars"]))
    return done.select(F.when(F.col("out").isNotNull(), new).otherwise(row).alias("row")).select("row.*")


POSTINGS, COUNTS, FILTERS = "doc_id long, k1 long, k2 long, shard int", "k1 long, k2 long, n_docs long, last_doc long, shard int", "shard int, cells binary"


def _follow(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after some keys left it (turn -1) and others came (1); rows of turn 0 are all keys it then holds."""
    if not len(rows):
        return pd.DataFrame({"shard": pd.Series([], dtype="int32"), "cells": pd.Series([], dtype="object")})
    f = CuckooFilter.from_bytes(before["cells"].iloc[0]) if len(before) else CuckooFilter()
    of = lambda turn: sorted(zip(rows["k1"][rows["turn"] == turn].tolist(), rows["k2"][rows["turn"] == turn].tolist(), strict=True))
    for a, b in of(-1):
        f.delete(a, b)
    if not all(f.insert(a, b) for a, b in of(1)):
        f = CuckooFilter.build(of(0))
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "cells": [f.to_bytes()]})


class LineStore:
    """Incremental state in a folder: postings, exact reference counts and cuckoo filters, by shard of the keys.

    The folder has the state; an object of this class opens it, and what
    another has inserted or deleted is there. insert() and delete() write a
    generation with the touched shards alone (insert() only adds postings),
    then a manifest that says where each shard is now, and then remove what no
    shard uses. A run that dies before the manifest is whole leaves the last
    one in force. One writer at a time. Deleting what was inserted restores
    every count.

    Filters have shards of their own, of about KEYS_A_SHARD keys; when these
    are twice as full there are made to be more. So no task holds more than
    some 2 * KEYS_A_SHARD keys, however many the store has. n_shards, for a
    new store, should leave shards of a size that a task can rewrite.
    """

    def __init__(self, spark: SparkSession, path: str, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, n_shards: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.least_chars, self.least_documents = least_chars, least_documents
        self.state = self._load() or {"turn": 0, "n_shards": n_shards, "filter_shards": 1, "frequent": 0, "settings": [least_chars, least_documents], "postings": {}, "counts": {}, "filters": {}}
        if self.state["settings"] != [least_chars, least_documents]:
            raise ValueError(f"this store was made with least_chars, least_documents = {self.state['settings']}")

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        place, files = self._files(self.path)
        return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []

    def _load(self) -> dict | None:
        """The last manifest that is whole."""
        for name in reversed([n for n in self._names() if n.startswith("manifest-")]):
            place, files = self._files(f"{self.path}/{name}/_SUCCESS")
            if files.exists(place):
                return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0])
        return None

    def _commit(self, state: dict) -> None:
        """Puts a state in force and removes what it doesn't use."""
        name = f"manifest-{state['turn']:09d}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}")
        self.state = state
        used = {name, *(g for gs in state["postings"].values() for g in gs), *state["counts"].values(), *state["filters"].values()}
        for other in self._names():
            if other not in used:
                place, files = self._files(f"{self.path}/{other}")
                files.delete(place, True)

    def _read(self, name: str, shards: list[str] | None = None, state: dict | None = None) -> DataFrame:
        """A table, or these shards of it."""
        held = (state or self.state)[name]
        at = [(k, g) for k in (held if shards is None else shards) if k in held for g in (held[k] if name == "postings" else [held[k]])]
        schema = {"postings": POSTINGS, "counts": COUNTS, "filters": FILTERS}[name]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{g}/{name}/part={k}" for k, g in at)) if at else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, generation: str, name: str) -> list[str]:
        """Writes rows (shard, ...) and returns which shards they are of."""
        to = f"{self.path}/{generation}/{name}"
        rows.withColumn("part", F.col("shard")).repartition("part").write.partitionBy("part").parquet(to)
        place, files = self._files(to)
        return [n[len("part=") :] for n in (f.getPath().getName() for f in files.listStatus(place)) if n.startswith("part=")]

    @property
    def postings(self) -> DataFrame:
        return self._read("postings")

    @property
    def counts(self) -> DataFrame:
        return self._read("counts")

    @property
    def filters(self) -> DataFrame:
        return self._read("filters")

    def _next(self) -> tuple[dict, str]:
        state = json.loads(json.dumps(self.state)) | {"turn": self.state["turn"] + 1}
        return state, f"generation-{state['turn']:09d}-{uuid.uuid4().hex[:8]}"

    def _advance(self, state: dict, generation: str, touched: DataFrame, shards: list[str]) -> None:
        """Counts the keys of touched (k1, k2) anew from state's postings; counts of these shards and the filters follow."""
        keys, least = ["k1", "k2"], F.col("n_docs") >= self.least_documents
        touched = cut(touched.select(*keys).distinct())
        fresh = reference_counts(self._read("postings", shards, state).join(touched, keys, "left_semi")).withColumn("shard", _shard(state["n_shards"]))
        old = self._read("counts", shards)
        new = old.join(touched, keys, "left_anti").select("k1", "k2", "n_docs", "last_doc", "shard").unionByName(fresh)
        written = set(self._write(new, generation, "counts"))
        state["counts"] = {k: g for k, g in state["counts"].items() if k not in shards} | dict.fromkeys(sorted(written), generation)
        now = self._read("counts", shards, state)
        turn = lambda df, n: df.join(touched, keys, "left_semi").filter(least).select(*keys, F.lit(n).alias("turn"))
        turns = cut(turn(old, -1).unionByName(turn(now, 1)).groupBy(*keys).agg(F.sum("turn").alias("turn")).filter("turn <> 0"))
        state["frequent"] += turns.agg(F.coalesce(F.sum("turn"), F.lit(0))).first()[0]
        every = self._read("counts", None, state).filter(least).select(*keys)
        if state["frequent"] > 2 * KEYS_A_SHARD * state["filter_shards"]:
            state["filter_shards"] = 1 + state["frequent"] // KEYS_A_SHARD
            state["filters"] = dict.fromkeys(self._write(build_filters(every, state["filter_shards"]), generation, "filters"), generation)
            return
        place = _shard(state["filter_shards"]).alias("shard")
        moved = [str(r.shard) for r in turns.select(place).distinct().collect()]  # at most a row for each KEYS_A_SHARD frequent keys
        changed = turns.select(place, *keys, "turn").unionByName(every.select(place, *keys, F.lit(0).alias("turn")).filter(F.col("shard").isin([int(k) for k in moved])))
        cells = self._read("filters", moved)
        filters = changed.groupBy("shard").cogroup(cells.groupBy("shard")).applyInPandas(_follow, FILTERS)
        if moved:
            state["filters"] |= dict.fromkeys(self._write(filters, generation, "filters"), generation)

    def insert(self, documents: DataFrame) -> None:
        """Adds documents (doc_id, text). A doc_id that is already held gets these keys besides its own."""
        state, generation = self._next()
        added = cut(line_postings(documents, self.least_chars).withColumn("shard", _shard(state["n_shards"])).distinct())
        shards = self._write(added, generation, "postings")
        state["postings"] |= {k: [*state["postings"].get(k, []), generation] for k in shards}
        self._advance(state, generation, added, shards)
        self._commit(state)

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes out documents named in doc_ids (doc_id); unknown ones change nothing."""
        state, generation = self._next()
        gone = cut(doc_ids.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct())
        touched = cut(likely(self.postings, "doc_id", gone).join(gone, "doc_id", "left_semi"))
        shards = [str(r.shard) for r in touched.select("shard").distinct().collect()]  # at most n_shards
        left = self._read("postings", shards).join(gone, "doc_id", "left_anti").select("doc_id", "k1", "k2", "shard")
        written = self._write(left, generation, "postings")
        state["postings"] = {k: g for k, g in state["postings"].items() if k not in shards} | {k: [generation] for k in written}
        self._advance(state, generation, touched, shards)
        self._commit(state)

    def apply(self, documents: DataFrame, with_text: bool = False) -> DataFrame:
        """restore() of documents by the counts of all documents now held."""
        postings = cut(line_postings(documents, self.least_chars))
        drops = dropped_keys(pass_filters(postings, self.filters, self.state["filter_shards"]), self.counts.filter(F.col("n_docs") >= self.least_documents))
        return restore(documents, drops, self.least_chars, with_text)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = rf"""
with lines as (
  select rowid_ as r, doc_id, i, line,
    translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select rowid_, doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i
        from (select row_number() over () as rowid_, doc_id, coalesce(text, '') as t from documents))),
frequent as (
  select key, max(doc_id) as last_doc from lines where length(key) >= {LEAST_CHARS} and doc_id is not null
  group by key having count(distinct doc_id) >= {LEAST_DOCUMENTS}),
marked as (select l.*, f.key is not null and l.doc_id is not null and l.doc_id <> f.last_doc as gone from lines l left join frequent f on f.key = l.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by r
"""

"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, connected components."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from glyphmill.llm._shared import components, cut, free, likely, table

#: Places of the permutations. A shingle's 64-bit hash is first taken to a place; two shingles of a text share one now and then, which only blurs the estimate.
PLACES = 1 << 22
#: Members of a band key up to which those outside its hub's component are held against all others one by one, whatever their size.
FEW = 8
#: Comparisons of two members that a key with more may take for each shingle of its members. More or fewer change the work, never the result.
COMPARISONS = 1
#: Hubs of a group at most; it takes further ones only while they link something. More or fewer change the work, never the result.
HUBS = 3


@dataclass(frozen=True)
class Settings:
    """Words a shingle, least similarity in percent, and bands of rows.

    A pair at the least similarity s misses every band with probability
    (1 - s**rows)**bands: 3e-7 at 85 % with 32 bands of 6, 3e-6 at 80 % with
    32 of 5; pairs above it far less. Signatures have bands * rows coordinates.
    """

    shingle: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 6


CONTRACT = Settings()
#: Stages on word shingles: five words, a similarity of 0.8.
STAGE = Settings(shingle=5, percent=80, rows=5)


@functools.cache
def _permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, which scatters places before the shifts, and pi followed by its own first places, so that every shift is one slice."""
    rng = np.random.default_rng(20_240_229)
    sigma = rng.permutation(PLACES).astype(np.int32)
    pi = rng.permutation(PLACES).astype(np.int32)
    return sigma, np.concatenate([pi, pi[:width]])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles; a shorter text is one shingle, one without words has none.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased: as bytes of UTF-8
    that is what bytes.lower() and bytes.split() do.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - n + 1 + k])
    return np.unique(out)


def signature(hashes: np.ndarray, width: int) -> np.ndarray:
    """Coordinate k is the smallest pi(sigma(x) + k) over the set: one permutation, shifted by one place for each coordinate."""
    sigma, pi = _permutations(width)
    at = sigma[(hashes >> np.uint64(20)).astype(np.int64) & (PLACES - 1)]
    shifts = np.lib.stride_tricks.sliding_window_view(pi, width)
    out = np.full(width, PLACES, np.int32)
    for lo in range(0, len(at), 4096):
        np.minimum(out, shifts[at[lo : lo + 4096]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band's coordinates and the band's number."""
    h = np.arange(bands, dtype=np.uint64)
    for row in sig.reshape(bands, rows).T:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
    return h.view(np.int64)


#: Buckets of shingles of which it is kept whether a set has an odd number in them, 64 to a number.
PARITIES = 512


def parities(hashes: np.ndarray) -> list[int]:
    """Whether a set has an odd number of its hashes in each of PARITIES buckets, as signed 64-bit numbers.

    Two sets differ in parity only where they differ in a shingle, so the
    places where they do are no more than the shingles that one of them lacks.
    """
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _print(hashes: np.ndarray) -> bytes:
    """Stands for a whole set; equal sets alone have equal ones."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _tag(print_: bytes) -> int:
    return int.from_bytes(print_[:8], "little", signed=True)


def _sketch(s: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            sizes, keys, prints, tags, odd = [], [], [], [], []
            for text in part.column(1).to_pylist():
                hashes = shingle_set(text, s.shingle)
                sizes.append(len(hashes))
                keys.append(band_keys(signature(hashes, s.bands * s.rows), s.bands, s.rows) if len(hashes) else np.array([], np.int64))
                prints.append(_print(hashes) if len(hashes) else None)
                tags.append(_tag(prints[-1]) if len(hashes) else None)
                odd.append(parities(hashes))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(tags, pa.int64()), pa.array(odd, pa.list_(pa.int64())), lists], ["doc_id", "n_shingles", "print", "tag", "odd", "keys"])


def sketches(documents: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set), tag (its first bytes), odd (parities) and keys (of bands) of every row of documents (doc_id, text)."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(functools.partial(_sketch, s), "doc_id long, n_shingles long, print binary, tag long, odd array<long>, keys array<long>")


def _sets(s: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            sets = [shingle_set(text, s.shingle) for text in part.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_tag(_print(x)) for x in sets], pa.int64()), lists], ["rep", "tag", "shingles"])


def full_sets(documents: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """(x, shingles) of nodes, made anew from the texts: only those that share a band are ever needed.

    A node x is a class of equal sets: its smallest doc_id and a tag of the
    set, for doc_ids that have several texts. A Bloom filter of nodes keeps the other texts from Python and from the shuffle.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
    made = likely(rows, "rep", cut(nodes.select("x.rep"))).mapInArrow(functools.partial(_sets, s), "rep long, tag long, shingles array<long>")
    return made.select(F.struct("rep", "tag").alias("x"), "shingles").join(nodes, "x", "left_semi").dropDuplicates(["x"])


def _may_link(n: str, m: str, odd: str, other: str, percent: int) -> Column:
    """Whether sets of n and m shingles with these parities can be similar enough: false for none that are.

    They are if no more than t (n + m) shingles, t as in _differences(), are
    in one of them alone; parities differ in no more places than that.
    """
    apart = sum((F.bit_count(F.col(odd)[k].bitwiseXOR(F.col(other)[k])) for k in range(PARITIES // 64)), F.lit(0))
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & ((100 + percent) * apart <= (100 - percent) * (F.col(n) + F.col(m)))


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    met = cut(pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct())
    sets = likely(sets, "x", met)
    left = sets.select(F.col("x").alias("a"), F.col("shingles").alias("_left"))
    right = sets.select(F.col("x").alias("b"), F.col("shingles").alias("_right"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_left", "_right"))
    return both.filter(100 * common >= percent * (F.size("_left") + F.size("_right") - common)).select("a", "b")


def _in_component(members: DataFrame, comps: DataFrame, x: str = "x", c: str = "c") -> DataFrame:
    """members with their component; a node without links is its own."""
    named = comps.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return members.join(named, F.col(f"{x}.rep") == F.col("_node"), "left").withColumn(c, F.coalesce("_component", f"{x}.rep")).drop("_node", "_component")


def _differences(roles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For rows (hub, x, n, c, far): (hub, token, x, n, c, far, first) for the tokens that may decide.

    A token is a shingle that x has and its hub hasn't, or the other way
    round. With D(x) for x's tokens, sets X and Y are similar enough if and
    only if |D(x)| + |D(y)| - 2 |D(x) & D(y)| <= t (|X| + |Y|), where
    t = (100 - percent) / (100 + percent). A far x isn't linked to the hub H:
    |D(x)| > t (|X| + |H|). So a far x and any y that are linked share at
    least (|D(x)| - t (|X| + |H|)) / 2 > 0 tokens, and more than
    (|D(y)| - t (|Y| - |H|)) / 2. In any fixed order of tokens, those at the
    head of both that are |D| + 1 less as many hold a common one. Rows of the
    second, shorter kind are marked `first`: two far ones share a token that
    is first in both, a far and a near one a token that is first in the near
    one and among the far one's rows.

    The order is by how many of the hub's members have a token, rarest first,
    so what is common to a group brings no one together; a token that only one
    has is counted and left out.
    """
    hubs = sets.select(F.col("x").alias("hub"), F.col("shingles").alias("_hub"))
    both = roles.join(sets, "x").join(hubs, "hub")
    tokens = F.concat(F.array_except("shingles", "_hub"), F.array_except("_hub", "shingles"))
    d, h, t, total = F.size("tokens"), F.size("_hub"), F.lit(100 - percent), 100 + percent
    head = lambda shared: d + 1 - F.greatest(shared, F.lit(1))
    few = head(F.floor((total * d - t * (F.col("n") - h)) / (2 * total)) + 1)
    many = F.when(F.col("far"), head(F.ceil((total * d - t * (F.col("n") + h)) / (2 * total)))).otherwise(0)
    sized = both.withColumn("tokens", tokens).select("hub", "x", "n", "c", "far", d.alias("d"), few.alias("few"), F.greatest(few, many).alias("many"), "tokens")
    every = cut(sized.select("hub", "x", "n", "c", "far", "d", "few", "many", F.explode("tokens").alias("token")))
    common = every.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    own = W.Window.partitionBy("hub", "x")
    ranked = every.join(common, ["hub", "token"]).withColumns({"place": F.row_number().over(own.orderBy("m", "token")), "met": F.count(F.lit(1)).over(own)})
    ranked = ranked.withColumn("place", F.col("place") + F.col("d") - F.col("met"))
    return ranked.filter("place <= many").select("hub", "token", "x", "n", "c", "far", (F.col("place") <= F.col("few")).alias("first"))


def link_classes(members: DataFrame, sets: DataFrame, also: DataFrame, s: Settings) -> DataFrame:
    """(node, component) of doc_ids, from classes that share a band.

    members has (key, m, x, n, w, odd): a class in a band key of m classes, its
    number of shingles, the classes it meets in all of its keys, and its
    parities, which rule most candidates out before they become pairs. sets has
    (x, shingles); also has links (a, b) of doc_ids that hold anyway.

    Pairs of a key are never all made. The member with most company (near the
    middle of a group of copies) is the key's hub, and each member is verified
    against it. Who is then outside the hub's component may still be linked to
    others. They are held against all, by sizes and parities, in keys of FEW
    members or less and wherever that takes no more comparisons than the
    members have shingles (COMPARISONS times as many). A class is in one key a
    band at most, so comparisons stay in proportion to all shingles however
    large the table, while differences shuffle and sort a row for each. Other
    keys whose hubs are of one component form a group, with the hub of most
    company for its first; those outside take further hubs while that links
    something. Who is still outside the first hub's component meets those
    members alone that share one of the differences from this hub that decide
    (see _differences()). Candidates are verified on full sets.
    """
    best = members.groupBy("key").agg(F.max(F.struct("w", "x", "n", "odd")).alias("h")).select("key", F.col("h.x").alias("hub"), F.col("h.n").alias("hn"), F.col("h.w").alias("hw"), F.col("h.odd").alias("hodd"))
    held = cut(members.join(best, "key"))
    fits = _may_link("n", "hn", "odd", "hodd", s.percent)
    pairs = cut(held.filter((F.col("x") != F.col("hub")) & fits).select(*_ordered(F.col("x"), F.col("hub"))).distinct())
    tried = pairs
    links = cut(also.unionByName(_verified(pairs, sets, s.percent).select("a.rep", "b.rep").toDF("a", "b")))
    comps = components(links)

    def linked(pairs: DataFrame) -> bool:
        """Verifies pairs that are new; whether any of them is linked. Components follow."""
        nonlocal tried, links, comps
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            free(pairs)
            return False
        tried = tried.unionByName(pairs)
        found = cut(_verified(pairs, sets, s.percent).select("a.rep", "b.rep").toDF("a", "b"))
        if found.isEmpty():
            return False
        links = links.unionByName(found)
        comps = components(links)
        return True

    placed = cut(_in_component(_in_component(held, comps), comps, "hub", "hc").select("key", "m", "x", "n", "odd", "c", "hc"))
    mixed = placed.filter("c <> hc").select("key", F.col("x").alias("x2"), F.col("n").alias("n2"), F.col("odd").alias("odd2"), F.col("c").alias("c2"))
    outside = placed.groupBy("key", "m").agg(F.count_if(F.expr("c <> hc")).alias("outside"), F.sum("n").alias("shingles")).filter("outside > 0")
    costs = cut(outside.select("key", ((F.col("m") <= FEW) | (F.col("m") * F.col("outside") <= COMPARISONS * F.col("shingles"))).alias("direct")))
    small = placed.join(costs.filter("direct"), "key", "left_semi")
    met = small.join(mixed, "key").filter((F.col("c") != F.col("c2")) & ((F.col("c") == F.col("hc")) | (F.col("x") < F.col("x2"))) & _may_link("n", "n2", "odd", "odd2", s.percent))
    linked(met.select(*_ordered(F.col("x"), F.col("x2"))).distinct())

    large = _in_component(held.join(costs.filter("not direct"), "key", "left_semi"), comps, "hub", "hc")
    large = cut(large.groupBy("hub", "hw", "hc", "x").agg(F.max("n").alias("n"), F.max("w").alias("w"), F.max("odd").alias("odd")))
    firsts = large.groupBy("hc").agg(F.max(F.struct("hw", "hub")).getField("hub").alias("g"))
    groups = cut(large.join(firsts, "hc").groupBy("g", "x").agg(F.max("n").alias("n"), F.max("w").alias("w"), F.max("odd").alias("odd")))
    if groups.isEmpty():
        return comps
    hubs = cut(groups.select("g", F.col("g").alias("hub")).distinct())
    for _ in range(1, HUBS):
        left = _in_component(groups, comps).join(_in_component(hubs, comps, "hub", "c").select("g", "c"), ["g", "c"], "left_anti")
        more = cut(left.groupBy("g").agg(F.max(F.struct("w", "x", "n", "odd")).alias("h")).select("g", F.col("h.x").alias("hub"), F.col("h.n").alias("hn"), F.col("h.odd").alias("hodd")))
        met = left.join(more, "g").filter((F.col("x") != F.col("hub")) & _may_link("n", "hn", "odd", "hodd", s.percent))
        found = linked(met.select(*_ordered(F.col("x"), F.col("hub"))).distinct())
        hubs = hubs.unionByName(more.select("g", "hub"))
        if not found:
            break

    roles = _in_component(_in_component(groups.withColumnRenamed("g", "hub"), comps), comps, "hub", "hc").select("hub", "x", "n", "c", (F.col("c") != F.col("hc")).alias("far"))
    odds = groups.select("x", "odd").dropDuplicates(["x"])
    tokens = cut(_differences(roles, sets, s.percent).join(odds, "x"))
    far = tokens.filter("far").select("hub", "token", F.col("x").alias("x2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("first").alias("first2"), F.col("odd").alias("odd2"))
    once = ~F.col("far") | (F.col("first2") & (F.col("x") < F.col("x2")))
    met = tokens.filter("first").join(far, ["hub", "token"]).filter((F.col("c") != F.col("c2")) & once & _may_link("n", "n2", "odd", "odd2", s.percent))
    linked(met.select(*_ordered(F.col("x"), F.col("x2"))).distinct())
    return comps


def near_duplicates(documents: DataFrame, s: Settings = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents (doc_id, text).

    Rows with the same set form a class at once; classes are linked where
    their full sets are similar enough. component_id is the smallest doc_id
    reachable and kept says whether it is the row's own. A text without words
    (or null) has an empty set and is linked with nothing. A row without
    doc_id is linked with nothing either; its component_id is null and it is
    kept. Rows that share a doc_id are one document: whatever any of their
    texts is linked with, all of them are, so they have one component_id.
    """
    rows = cut(sketches(documents, s))
    named = rows.filter("doc_id is not null and n_shingles > 0")
    classes = cut(named.groupBy("print").agg(F.min("doc_id").alias("rep")))
    in_class = named.select("doc_id", "n_shingles", "print").join(classes, "print")
    first = classes.select(F.col("rep").alias("doc_id"), "print")
    sketched = named.join(first, ["doc_id", "print"], "left_semi").select(F.struct(F.col("doc_id").alias("rep"), "tag").alias("x"), F.col("n_shingles").alias("n"), "odd", "keys")
    banded = sketched.select(F.explode("keys").alias("key"), "x", "n")
    shared = banded.groupBy("key").agg(F.min(F.xxhash64("x")).alias("_low"), F.max(F.xxhash64("x")).alias("_high"), F.count(F.lit(1)).alias("m")).filter("_low < _high").select("key", "m")
    members = cut(banded.join(shared, "key").distinct())
    company = members.groupBy("x").agg(F.sum("m").alias("w"))
    some = cut(company)
    odds = likely(sketched.select("x", "odd"), "x", some.select("x")).dropDuplicates(["x"])
    members = members.join(some.join(odds, "x"), "x")
    some = some.select("x")
    linked = cut(full_sets(documents, some, s))
    twice = named.groupBy("doc_id").agg(F.min(F.xxhash64("print")).alias("_low"), F.max(F.xxhash64("print")).alias("_high")).filter("_low < _high").select("doc_id")
    also = in_class.join(twice, "doc_id", "left_semi").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    comps = link_classes(members, linked, also, s)
    placed = in_class.join(comps, F.col("rep") == F.col("node"), "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = rows.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive tokens as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s
  from tokens),
grams as (select doc_id, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
both_ways as (select a, b from links union select b, a from links),
reach(node, label) as (
  select doc_id, doc_id from sets
  union
  select b, label from reach join both_ways on a = node where label < b)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.label) as component_id, min(r.label) = s.doc_id as kept
from sets s join reach r on r.node = s.doc_id group by s.doc_id, s.s
"""

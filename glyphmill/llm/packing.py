"""Best-fit packing after Martello-Toth dominance reduction, over a histogram of lengths."""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import cut, ranked, table

CAPACITY, END = 2048, 0
#: How a byte-level vocabulary's pre-tokenizer cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible Latin-1 for itself, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@functools.cache
def _encoding(path: str):
    """tiktoken's encoder of the vocabulary in a tokenizers JSON file; a token's id is its rank, as its merges must have it."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, byte = spec["model"]["vocab"], _byte_of()
    special = {t["content"] for t in spec["added_tokens"]}  # their strings in a text are ordinary text
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    if [vocab[m] for m in merged] != sorted(vocab[m] for m in merged) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"].get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path} is no byte-level vocabulary whose ids follow its merges")
    ranks = {bytes(byte[c] for c in t): k for t, k in vocab.items() if t not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers, END last.

    The ids are those that the tokenizers library gives for the file at path,
    without special tokens; tiktoken makes the same ones in less time and
    keeps nothing between texts.
    """
    encoding, end = _encoding(path), END.to_bytes(4, "little")
    for text in texts:
        yield encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes() + end


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """n itself if it fits, else pieces of capacity after a first one that may be shorter."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def _pieces(path: str, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()], path), strict=True):
                at = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])), strict=True):
                        column.append(value)
                    at += n
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def tokenized_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every row of documents (doc_id, text); null and empty texts have the one id END."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(functools.partial(_pieces, path, capacity), PIECES)


@dataclass
class Plan:
    """Kinds of sequence: the lengths each holds, in order, and how many there are of it."""

    kinds: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    fixed: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.kinds)


def _reduce(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes from counts the sets that Martello and Toth's dominance test fixes, of one and two lengths.

    For each length w, longest first: alone, if the shortest other piece
    doesn't fit beside it; with the longest b that fits, if w + b fills the
    sequence or no two others fit beside w. Every other sequence that holds w
    could then be exchanged for this one without needing more sequences.
    """
    kinds = []
    sizes = sorted(counts)

    def take(size: int, n: int) -> None:
        counts[size] -= n
        if not counts[size]:
            del counts[size]
            del sizes[bisect_left(sizes, size)]

    skipped: list[int] = []
    while sizes and (i := len(sizes) - 1 - len(skipped)) >= 0:
        w = sizes[i]
        room = capacity - w
        n = counts[w]
        others = [s for s in sizes[:2] if s != w or counts[w] > 1]
        if not others or others[0] > room:
            kinds.append(((w,), n))
            take(w, n)
            continue
        k = bisect_left(sizes, room + 1) - 1
        b = sizes[k]
        if b == w and n == 1:
            b = sizes[k - 1] if k else 0
        low = others[0]
        left_of_low = counts[low] - (low == w)
        second = low if left_of_low > 1 else next((s for s in sizes if s > low), capacity + 1)
        if b and (b == room or low + second > room):
            m = n // 2 if b == w else min(n, counts[b])
            kinds.append(((w, b), m))
            take(w, m)
            take(b, m)
            continue
        skipped.append(w)
        if len(skipped) >= len(sizes):
            break
    return kinds


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """How to pack counts (length: pieces) into few sequences of capacity.

    Full and dominated sets are fixed first; the rest is packed longest first,
    each piece where it leaves least room. Pieces of one length are placed
    together, so time and result grow with the number of lengths, never with
    the number of pieces.
    """
    left = {s: n for s, n in counts.items() if n}
    if any(s > capacity or s < 1 for s in left):
        raise ValueError("a piece is longer than a sequence, or empty")
    kinds = _reduce(left, capacity)
    out = Plan(kinds=list(kinds), fixed=sum(n for _, n in kinds))
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []  # rooms with open sequences, sorted

    def put(room: int, kind: tuple[int, ...], n: int) -> None:
        if n and room not in rooms:
            insort(order, room)
        if n:
            rooms.setdefault(room, []).append((kind, n))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            k = bisect_left(order, size)
            room, (kind, open_) = (order[k], rooms[order[k]].pop()) if k < len(order) else (capacity, ((), -(-n // (capacity // size))))
            if k < len(order) and not rooms[room]:
                del rooms[room]
                del order[k]
            each = room // size
            whole = min(open_, n // each)
            put(room - each * size, kind + (size,) * each, whole)
            n -= whole * each
            if n and whole < open_:
                put(room - n * size, kind + (size,) * n, 1)
                n, whole = 0, whole + 1
            put(room, kind, open_ - whole if kind else 0)
    out.kinds += [x for group in rooms.values() for x in group]
    return out


def _places(p: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence_id, offset): where the pieces of each length go by their rank."""
    out, next_rank, next_sequence = [], {}, 0
    for kind, n in p.kinds:
        offset = 0
        for size in kind:
            first = next_rank.get(size, 0)
            out.append((size, first, n, next_sequence, offset))
            next_rank[size] = first + n
            offset += size
        next_sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (PIECES).

    Only the histogram of lengths, at most `capacity` rows, reaches the driver.
    Its plan says which ranks of each length go to which sequences; it has a
    few rows for each length. Pieces of one length are ranked by a hash in
    buckets, so a length that a third of all pieces share is no one's burden.
    Repeated rows are pieces of their own; a null doc_id is carried along.
    """
    pieces = cut(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    n = sum(counts.values())
    at = _places(plan(counts, capacity))
    places = pieces.sparkSession.createDataFrame(at, "length long, first long, many long, sequence long, offset long")
    places = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "sequence", "offset"))).alias("spans"))
    pieces = pieces.withColumn("_h", F.md5(F.concat_ws(":", "doc_id", "piece", "ids_crc32").cast("binary")))
    r = ranked(pieces, ["length"], "_h", ["doc_id", "piece", "start", "ids_crc32"], n).join(F.broadcast(places), "length")
    span = F.filter("spans", lambda s: s.getField("first") <= F.col("rank"))
    r = r.withColumn("span", F.element_at(span, -1))
    return r.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("span.sequence") + F.col("rank") - F.col("span.first")).alias("sequence_id"), F.col("span.offset").alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(tokenized_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))

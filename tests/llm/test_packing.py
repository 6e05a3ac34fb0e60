"""Packing: ids as the tokenizers library has them, plans that fit and waste little, gapless places."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import packing as p

PATH = p.tokenizer_path()


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizers_library(spark, small):
    r = random.Random(5)
    texts = ["", " ", "a  b", "<|endoftext|> a", "\0 a", "日本 語\n 語", "I'm 's I'LL", "a\x1c b", "a" * 3000, " " * 2000]
    texts += ["".join(r.choice("ab \n\t\r1.'sé  \x1c日٣²") for _ in range(r.randint(1, 30))) for _ in range(500)]
    texts += [x.text or "" for x in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for got, want in zip(p.encode(texts, PATH), library_ids(texts), strict=True):
        assert got == b"".join(i.to_bytes(4, "little") for i in want)


def test_cut_lengths():
    assert p.cut_lengths(10, 10) == [10] and p.cut_lengths(21, 10) == [1, 10, 10] and p.cut_lengths(20, 10) == [10, 10]


def best(sizes, capacity):
    """Fewest sequences, by trying everything."""
    if not sizes:
        return 0
    low = len(sizes)

    def place(k, rooms):
        nonlocal low
        if len(rooms) >= low:
            return
        if k == len(sizes):
            low = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return low


@pytest.mark.parametrize("seed", range(40))
def test_dominance_reduction_never_costs_a_sequence(seed):
    r = random.Random(seed)
    capacity = 20
    sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
    left = {s: sizes.count(s) for s in sizes}
    fixed = p._reduce(left, capacity)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + best(sorted(rest, reverse=True), capacity) == best(sizes, capacity)
    assert sorted([*rest, *(s for kind, n in fixed for s in kind * n)]) == sorted(sizes)
    assert all(sum(kind) <= capacity for kind, _ in fixed)


@pytest.mark.parametrize("seed", range(10))
def test_plan_holds_every_piece_once(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 2048): r.randint(1, 50) for _ in range(60)}
    plan = p.plan(counts)
    held = {}
    for kind, n in plan.kinds:
        assert sum(kind) <= 2048
        for s in kind:
            held[s] = held.get(s, 0) + n
    assert held == counts
    assert plan.sequences <= 1.25 * -(-sum(s * n for s, n in counts.items()) // 2048) + 1


def test_plan_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        p.plan({11: 1}, 10)
    assert p.plan({}).sequences == 0


def packed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id string")  # clashing names
    return p.pack(p.tokenized_pieces(docs, PATH)).collect()


def test_places_are_gapless_and_every_id_is_there(spark):
    r = random.Random(1)
    texts = [None, "", "x", "x", *(" ".join(str(r.randint(0, 999)) for _ in range(r.randint(1, 3000))) for _ in range(40))]
    rows = packed(spark, [(k if k else None, t, "z", "z") for k, t in enumerate(texts)])
    ids = {k if k else None: i for k, i in enumerate(library_ids([t or "" for t in texts]))}
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row.doc_id, []).append(row)
        by_sequence.setdefault(row.sequence_id, []).append(row)
    assert by_doc.keys() == ids.keys()
    for k, pieces in by_doc.items():
        at = 0
        for j, row in enumerate(sorted(pieces, key=lambda x: x.piece)):
            assert (row.piece, row.start) == (j, at)
            part = ids[k][at : at + row.length]
            assert row.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += row.length
        assert at == len(ids[k])
    for rows_ in by_sequence.values():
        at = 0
        for row in sorted(rows_, key=lambda x: x.offset):
            assert row.offset == at
            at += row.length
        assert at <= 2048


def test_empty_table_and_repeated_rows(spark):
    assert packed(spark, []) == []
    rows = packed(spark, [(1, "same", "a", "b")] * 3)
    assert sorted(r.offset for r in rows) == [0, 2, 4] and len({r.sequence_id for r in rows}) == 1

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import mixing, packing, sstable
from quarry.llm.mixing import mix, mixed_documents
from quarry.llm.packing import pack, packed_sequences
from quarry.llm.queries import op6_best_fit_packing, op8_token_output
from quarry.llm.ranges import range_of, splitters, weighted_sample
from quarry.llm.sharding import shard_by_bytes, water_level
from quarry.llm.sstable import look_up, read_tokens, write_tokens
from quarry.llm.storage import scratch
from quarry.llm.tokens import Pieces, pieces_for, read_tokenizer
from tests.llm.common import HARD, prose, table, words_of

BYTE, WORD = (read_tokenizer(public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))


def test_shards_are_even_and_slots_have_no_gaps(spark):
    texts = HARD + [prose(i, 20 + i % 50) for i in range(400)] + ["hot copy " * 9] * 150
    got = shard_by_bytes(table(spark, texts), shards=8, ranges=16, sample=256).collect()
    assert len(got) == len(texts)
    sizes, slots = Counter(), {}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes"
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    light = [v for s, v in sizes.items() if v < 50_000]
    assert len(sizes) == 8 and max(light) - min(light) < 0.05 * max(light)


def test_equal_texts_share_a_shard_unless_they_are_many(spark):
    texts = [prose(i % 40, 30) for i in range(400)]
    got = shard_by_bytes(table(spark, texts), shards=4).collect()
    assert all(len({r.shard for r in got if texts[r.doc_id] == t}) == 1 for t in set(texts))


def test_shards_of_nothing_nulls_and_repeats(spark):
    assert shard_by_bytes(table(spark, [])).count() == 0
    docs = table(spark, [None, "", "a"]).withColumn("doc_id", F.lit(None).cast("long"))
    got = shard_by_bytes(docs.unionByName(docs), shards=2).collect()
    assert len(got) == 6 and len({(r.shard, r.slot) for r in got}) == 6


def test_ranges(spark):
    sample = sorted(((i,), 1.0) for i in range(100))
    assert splitters(sample, 4) == [(25,), (50,), (75,)] and splitters([], 4) == []
    assert splitters([((1,), 100.0), ((2,), 1.0)], 4) == [(2,)]
    df = spark.range(10).withColumn("one", F.lit(1))
    assert weighted_sample(df, ["id"], "one", 100) == [((i,), 1.0) for i in range(10)]
    got = df.select("id", range_of([F.col("id"), F.col("one")], [(2, 0), (5, 1), (5, 2)]).alias("r")).collect()
    assert [r.r for r in got] == [0, 0, 1, 1, 1, 2, 3, 3, 3, 3]
    assert water_level([0, 10, 4], 6) == 5 and water_level([], 1) == 0


@pytest.mark.parametrize("source", [BYTE, WORD], ids=["byte", "word"])
def test_piece_encoding_is_the_library_s(source):
    pieces, plain = Pieces(source), Tokenizer.from_str(source)
    plain.encode_special_tokens = True
    r = random.Random(4)
    alphabet = ["a", "The", " ", "  ", "\n", ".", ",", "'s", "é", "1", "\t", "!", "ß", "́", "<|endoftext|>", "_", "²", "\xa0", "%%%"]
    texts = [t or "" for t in HARD] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 16))) for _ in range(1500)]
    for _ in range(2):  # the second time from the cache
        got = pieces.encode([t.encode() for t in texts])
        for t, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert pieces_for(source) is pieces_for(source)


SPECIAL = [
    "a <|endoftext|> b",
    "<|endoftext|>",
    "x<|startoftext|>y <|endoftext|><|endoftext|>",
    "A <|ENDOFTEXT|> <|EndOfText|>b",
    " <|endoftext|>\n the end  ",
    "<|endoftext|",
]


@pytest.mark.parametrize("source", [BYTE, WORD], ids=["byte", "word"])
def test_special_tokens_are_the_unmodified_library_s(source):
    pieces, plain = Pieces(source, special_tokens=True), Tokenizer.from_str(source)
    r = random.Random(6)
    alphabet = ["a", "The", " ", "  ", "\n", ".", "é", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "endoftext"]
    texts = SPECIAL + [t or "" for t in HARD] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    for _ in range(2):
        got = pieces.encode([t.encode() for t in texts])
        for t, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_queries_give_the_ids_of_the_unmodified_tokenizer(spark, tmp_path):
    texts = SPECIAL + ["plain words", None]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")

    def plain(source, text):
        return [*Tokenizer.from_str(source).encode(text or "", add_special_tokens=False).ids, 2]

    at = 0
    for r in sorted(op8_token_output(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = plain(WORD, texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r.doc_id]
        at += len(ids)
    packing_stage = dict(corpus_pipeline.STAGES)["packing"](spark, table(spark, texts), str(tmp_path))
    for packed in (op6_best_fit_packing(spark, str(tmp_path)), packing_stage):
        got = {r.doc_id: (r.length, r.ids_crc32) for r in packed.collect()}
        want = {i: plain(BYTE, t) for i, t in enumerate(texts)}
        assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}


def ids_of(source, text):
    t = Tokenizer.from_str(source)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_packed_pieces(spark):
    texts = HARD + [prose(i, 30 + 7 * i) for i in range(60)]
    got = pack(table(spark, texts), BYTE).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, parts in by_doc.items():
        ids, parts = ids_of(BYTE, texts[i]), sorted(parts, key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 1024 for r in parts[1:]) and 0 < parts[0].length <= 1024
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 1024) + 1
    whole = {r.sequence_id: r.ids for r in packed_sequences(table(spark, texts), BYTE).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in got) and max(map(len, whole.values())) <= 1024


def test_packing_of_nothing_and_of_repeats(spark):
    assert pack(table(spark, []), BYTE).count() == 0
    docs = table(spark, [None, "a b"])
    got = pack(docs.unionByName(docs), BYTE).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4


def fewest_bins(sizes, capacity):
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [r - sizes[i] if j == k else r for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=9))
def test_dominance_keeps_the_optimum(sizes):
    """Fixed sets plus an optimal packing of what is left are optimal for the whole."""
    fixed, left = packing.reduce_by_dominance(Counter(sizes), 20)
    used = Counter()
    for p in fixed:
        assert sum(s * k for s, k in p.items) <= 20
        used.update({s: p.bins * k for s, k in p.items})
    assert used + Counter(left) == Counter(sizes)
    rest = sorted(Counter(left).elements(), reverse=True)
    assert sum(p.bins for p in fixed) + fewest_bins(rest, 20) == fewest_bins(sorted(sizes, reverse=True), 20)
    done = packing.plan(Counter(sizes), 20)
    assert sum((Counter({s: p.bins * k for s, k in p.items}) for p in done), Counter()) == Counter(sizes)


def test_mix_meets_its_targets(spark):
    r = random.Random(3)
    texts = [prose(i, r.randint(1, 120)) for i in range(900)] + [None, "", "  "]
    sources = [r.choice(["b", "a", "é", None, "a"]) if i % 3 else "hot" for i in range(len(texts))]
    sources[5:9] = ["tiny"] * 4
    docs = table(spark, texts, sources)
    got = mix(docs, weights=(1, 2, 40)).collect()
    sizes, weights, total = Counter(), {}, 0
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(words_of(t))
        total += len(words_of(t))
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (1, 2, 40)[k % 3]
    target, free, left = {}, set(sizes), float(total)
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
        free -= over
    target |= {s: weights[s] * level for s in free}
    taken, largest = Counter(), {}
    for row in got:
        s = sources[row.doc_id]
        assert row.size == len(words_of(texts[row.doc_id])) and row.taken <= 3 * row.size and row.source_size == sizes[s]
        assert row.target == pytest.approx(target[s])
        taken[s] += row.taken
        largest[s] = max(largest.get(s, 0), row.size)
    assert all(-largest[s] <= taken[s] - target[s] <= 1e-6 for s in sizes)
    again = mix(docs.repartition(7), weights=(1, 2, 40)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}
    copies = Counter(r.doc_id for r in mixed_documents(docs, weights=(1, 2, 40)).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in got)


def test_small_sources_fill_up_beside_a_hot_one(spark, monkeypatch):
    """The rest of a source is filled by all its documents if they fit one bucket, whatever another source holds."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    r = random.Random(8)
    sources = [*[f"s{k:02d}" for k in range(20) for _ in range(40)], *["hot"] * 6000]
    docs = table(spark, [prose(i, r.randint(1, 40)) for i in range(len(sources))], sources)
    rows = {}
    weights = (3000, *range(10, 30))  # small sources get 0.5 to 1.5 times their size
    for row in mix(docs, weights=weights).collect():
        rows.setdefault(row.source, []).append(row)
    parts = []
    for name, of in rows.items():
        room = of[0].target - sum(x.taken for x in of)
        whole = min(x.taken // x.size for x in of)
        left_out = [x.size for x in of if x.taken == whole * x.size]
        assert -1e-6 <= room
        if name != "hot":
            assert not left_out or room < min(left_out), (name, room)
            parts.append(room / of[0].source_size)
    assert len(parts) == 20 and max(parts) < 0.01


def test_mix_of_nothing(spark):
    assert mix(table(spark, [])).count() == 0
    blank = mix(table(spark, [None, " "])).collect()
    assert [(r.size, r.taken, r.target) for r in blank] == [(0, 0, 0.0)] * 2
    docs = table(spark, ["a b c"])
    assert mixed_documents(docs).columns == docs.columns


def test_token_files_round_trip(spark):
    texts = HARD + [prose(i, 40) for i in range(100)]
    docs = table(spark, texts).withColumn("doc_id", F.col("doc_id") * 7 - 50)
    folder = scratch(spark, "round")
    listed = write_tokens(docs, WORD, folder, shard_bytes=40_000)
    assert listed.count() > 2
    got = sorted(read_tokens(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [7 * i - 50 for i in range(len(texts))]
    at = 0
    for i, r in enumerate(got):
        ids = ids_of(WORD, texts[i])
        assert (r.ids, r.start, r.n_tokens) == (ids, at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert look_up(spark, folder, -50 + 7 * 14) == [ids_of(WORD, texts[14])] and look_up(spark, folder, 1) == []


def test_token_files_of_nothing_nulls_and_repeats(spark):
    folder = scratch(spark, "none")
    write_tokens(table(spark, []), WORD, folder)
    assert read_tokens(spark, folder).count() == 0
    docs = table(spark, ["b", None]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    folder = scratch(spark, "repeats")
    write_tokens(docs.unionByName(docs), WORD, folder)
    assert [r.doc_id for r in sorted(read_tokens(spark, folder).collect(), key=lambda r: r.start)] == [None, None, 1, 1]
    assert look_up(spark, folder, 1) == [[2], [2]]


def test_shard_reader_uses_index_and_filter(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    path = tmp_path / "x.sst"
    keys = [None, -(1 << 63), -5, -5, 0, 3, 300, (1 << 63) - 1]
    with path.open("wb") as f:
        w = sstable.Writer(f, 4)
        for n, k in enumerate(keys):
            w.add(sstable.key_of(k), np.arange(n * 5, dtype="<u4"))
        w.close()
    from pyarrow import OSFile

    r = sstable.Reader(OSFile(str(path)))
    assert len(r.index) > 2 and [sstable.id_of(k) for k, _ in r] == keys and r.n_docs == len(keys)
    assert [len(x) for x in r.get(-5)] == [10, 15] and [len(x) for x in r.get(None)] == [0] and r.get(4) == []
    for n in (0, 1, 127, 128, 1 << 20):
        assert sstable.read_varint(sstable.varint(n), 0)[0] == n
    (tmp_path / "bad").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        sstable.Reader(OSFile(str(tmp_path / "bad")))

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import near_dedup
from quarry.llm.components import components
from quarry.llm.exact_dedup import directory, drop_exact_copies, exact_groups
from quarry.llm.near_dedup import drop_near_copies, links_in_block, near_groups
from quarry.llm.shingles import shingle_set, word_hashes
from tests.llm.common import HARD, components_by_force, near_copy, prose, shingles, table


def expected_groups(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3)), lambda c: F.lit(7)])
def test_exact_groups_match_brute_force(spark, key):
    texts = [*HARD, *[f"copy {i % 4}" for i in range(20)], "copy  0 ", "copy0"]
    got = exact_groups(table(spark, texts), bucket_entries=4, max_depth=5, key=key).collect()
    want = expected_groups(enumerate(texts))
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(texts)


def test_exact_groups_of_nothing_and_of_repeats(spark):
    assert exact_groups(table(spark, [])).count() == 0
    docs = table(spark, ["a b", "ab", "c"])
    got = exact_groups(docs.unionByName(docs)).collect()
    assert len(got) == 6 and {r.group_size for r in got if r.doc_id < 2} == {4}
    left = drop_exact_copies(docs.unionByName(docs))
    assert sorted(r.doc_id for r in left.collect()) == [0, 2] and left.columns == docs.columns
    null_id = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert {r.doc_id: r.keep_id for r in exact_groups(null_id).collect()} == {None: None, 1: None, 2: 2}


def test_directory_doubles_only_where_it_is_full():
    slots = directory({0: 50, 1: 50, 7: 1}, 3, 60)
    assert len(slots) == 8 and slots[0] != slots[1] and slots[4] == slots[7]
    assert directory({0: 1000}, 2, 10)[0] != directory({0: 1000}, 2, 10)[1]
    assert directory({}, 3, 10) == [0] * 8


def corpus():
    base, other = prose(10, 200), prose(11, 60)
    texts = [*HARD, base, base.upper(), base.replace(" ", "\n")]
    texts += [near_copy(base, s, s % 9) for s in range(40)]
    texts += [near_copy(base, 100 + s, 12 + s) for s in range(15)]
    texts += [near_copy(other, s, s % 4) for s in range(12)]
    texts += [prose(20 + s, 4 + s) for s in range(10)] + ["a b c d", "a b c d", "A B c d"]
    return texts


def test_near_groups_match_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r for r in near_groups(table(spark, texts).repartition(3)).collect()}
    want = components_by_force(dict(enumerate(texts)))
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(texts[i])) and r.kept == (want[i] == i) for i, r in got.items())


def test_blocks_and_probes_lose_no_link(spark, monkeypatch):
    """With blocks of four documents the probes of large components take many tasks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    texts = corpus()
    got = {r.doc_id: r.component_id for r in near_groups(table(spark, texts)).collect()}
    assert got == components_by_force(dict(enumerate(texts)))


def test_component_probes_find_planted_links(spark):
    base = prose(5, 150)
    texts = {i: near_copy(base, i, 2) for i in range(6)} | {9: near_copy(base, 77, 3), 10: prose(6, 150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(6)], "node long, component long")
    probes = spark.createDataFrame([(9, 0), (10, 0)], "rep long, component long")
    found = near_dedup.component_links(probes, labels, docs, "doc_id", "text", 75).collect()
    assert {r.a for r in found} == {9} and {r.b for r in found} <= set(range(6))


def test_links_in_block_are_exact():
    texts = [near_copy(prose(3, 120), s, s) for s in range(12)]
    sets = [shingle_set(w) for w in word_hashes([t.encode() for t in texts])]
    found = dict(links_in_block(sets[:4], sets[4:], 75))
    for i in range(4):
        linked = [k for k in range(8) if 100 * len(shingles(texts[i]) & shingles(texts[4 + k])) >= 75 * len(shingles(texts[i]) | shingles(texts[4 + k]))]
        assert (i in found) == bool(linked) and (not linked or found[i] in linked)


def test_near_groups_of_nothing_and_of_repeats(spark):
    assert near_groups(table(spark, [])).count() == 0
    docs = table(spark, [None, "", prose(1, 50), near_copy(prose(1, 50), 1, 1)])
    twice = near_groups(docs.unionByName(docs)).collect()
    assert len(twice) == 8 and {r.component_id for r in twice if r.doc_id >= 2} == {2}
    left = drop_near_copies(docs.unionByName(docs))
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2] and left.columns == docs.columns
    no_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {(r.component_id, r.kept) for r in near_groups(no_id).collect()} == {(None, False)}


def test_shingle_hashes_are_like_word_tuples():
    texts = [t or "" for t in HARD] + ["A b C d E f", "a b c d e f", "one two", "one  TWO"]
    sets = [shingle_set(w) for w in word_hashes([t.encode() for t in texts])]
    for i, a in enumerate(texts):
        assert len(sets[i]) == len(shingles(a))
        for j, b in enumerate(texts[:i]):
            assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == len(shingles(a) & shingles(b))


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    from quarry.llm import shingles as module

    text = prose(9, 5000).encode()
    whole = next(module.word_hashes([text]))
    monkeypatch.setattr(module, "CHUNK", 1000)
    assert (next(module.word_hashes([text])) == whole).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (7, 7), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dropping_copies_judges_rows_without_ids_and_with_shared_ids(spark):
    one, two, three, four, five = (prose(60 + i, 80) for i in range(5))
    near = near_copy(one, 1, 1)
    rows = [(None, one), (None, one), (None, two), (None, None), (7, three), (7, four), (7, four), (8, four + " "), (9, near), (5, five)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("nth", F.lit(1)).withColumn("part", F.lit("p"))
    exact = drop_exact_copies(docs.repartition(4))
    assert exact.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(5, five), (7, three), (8, four + " "), (9, near), (None, None), (None, one), (None, two)]
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=key) == sorted(want, key=key)
    left = drop_near_copies(docs.repartition(4))
    want = [(5, five), (7, three), (7, four), (9, near), (None, None), (None, two)]  # an id stays before none
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted(want, key=key)


def test_lone_documents_of_large_buckets_meet_as_groups(spark, monkeypatch):
    """With two documents as many, lone documents of a bucket probe groups, in blocks of three."""
    monkeypatch.setattr(near_dedup, "FEW", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    texts = corpus()
    got = {r.doc_id: r.component_id for r in near_groups(table(spark, texts)).collect()}
    assert got == components_by_force(dict(enumerate(texts)))


def test_joining_links_join_what_is_similar():
    texts = [near_copy(prose(3, 120), s, s % 7) for s in range(14)] + [prose(4, 120)]
    sets = [shingle_set(w) for w in word_hashes([t.encode() for t in texts])]
    names = [list(range(15)), list(range(15))]
    found = near_dedup.joining_links(sets, sets, 75, names)
    want = components_by_force(dict(enumerate(texts)))
    label = {i: i for i in range(15)}
    for _ in range(15):
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert label == want and len(found) == 15 - len(set(want.values()))


@pytest.mark.parametrize("room", [0, 1 << 20])
def test_hubs_of_components_meet_by_broadcast(spark, monkeypatch, room):
    from quarry.llm import components as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", room)
    monkeypatch.setattr(module, "HUB_LINKS", 3)
    links = [(i, 1000) for i in range(1, 40)] + [(i, i + 1) for i in range(50, 70)] + [(60, 1000), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [*range(1, 40), *range(50, 71), 1000]}, 200: 200, 201: 200}


def test_documents_of_many_components_go_to_few_cells(spark, monkeypatch):
    """Triples of near copies that share a passage: no row for each document and each component that it meets."""
    passage = prose(70, 90)
    bodies = [f"{passage} {prose(100 + s, 60)}" for s in range(30)]
    texts = [near_copy(b, k, k % 3) for b in bodies for k in range(3)]
    rows, kept = {}, near_dedup.materialize

    def counted(df, name):
        out = kept(df, name)
        rows[name] = rows.get(name, 0) + (out.count() if name == "met" else 0)
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    monkeypatch.setattr(near_dedup, "FEW", 4)
    got = {r.doc_id: r.component_id for r in near_groups(table(spark, texts)).collect()}
    assert got == components_by_force(dict(enumerate(texts)))
    assert 0 < rows["met"] <= 5 * len(texts)


def test_documents_of_a_bucket_share_a_cell(spark):
    buckets = {1: range(40), 2: range(20, 44), 3: range(38, 80), 4: [0, 79, 90, 91], 5: [90, 91], 6: range(5, 12)}
    crowded = [(k, d, d % 7, len(held)) for k, held in buckets.items() for d in held]
    places = near_dedup.meeting_cells(spark.createDataFrame(crowded, "key long, rep long, of long, held long")).collect()
    cells = defaultdict(set)
    for r in places:
        cells[r.cell].add(r.rep)
        assert r.of == r.rep % 7
    assert all(any(set(held) <= cell for cell in cells.values()) for held in buckets.values())
    assert sum(map(len, cells.values())) == len(places) and set(cells) < set(buckets)


@pytest.mark.parametrize("n", [1, 2, 14])
def test_joining_links_heed_known_components(n):
    texts = [near_copy(prose(3, 120), s, s % 3) for s in range(14)]
    sets = [shingle_set(w) for w in word_hashes([t.encode() for t in texts])]
    known = [i % n for i in range(14)]
    found = near_dedup.joining_links(sets, sets, 75, [list(range(14))] * 2, [known, known])
    label = known[:]
    for a, b in found:
        label = [label[a] if x == label[b] else x for x in label]
    assert len(found) == n - 1 and len(set(label)) == 1

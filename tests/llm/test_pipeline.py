from __future__ import annotations

import zlib

import corpus_pipeline
from quarry.llm import near_dedup
from quarry.llm.mixing import mix
from quarry.llm.toxicity import score_toxicity
from tests.llm.common import components_by_force, near_copy, prose, table
from tests.llm.test_dedup import expected_groups
from tests.llm.test_text import labelled


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = labelled(spark, 120)
    more = [prose(900, 90), prose(900, 90) + " ", near_copy(prose(900, 90), 1, 1), prose(901, 90), None, ""]
    extra = table(spark, more).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "'other' AS source", "n_chars")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, str(tmp_path))
    rejected = {r.doc_id for r in score_toxicity(docs, labels).collect() if r.predicted}
    rows = clean.collect()
    assert rejected and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - rejected

    exact = stages["exact_dedup"](spark, clean, str(tmp_path))
    want = expected_groups([(r.doc_id, r.text) for r in rows])
    rows = exact.collect()
    assert {r.doc_id for r in rows} == {i for i, g in want.items() if g[2]} and len({r.doc_id for r in rows}) == len(rows)

    near = stages["near_dedup"](spark, exact, str(tmp_path))
    want = components_by_force({r.doc_id: r.text for r in rows})
    assert {r.doc_id for r in near.collect()} == {i for i, c in want.items() if i == c}

    mixed = stages["mixing"](spark, near, str(tmp_path))
    want = {r.doc_id: r.repeats for r in mix(near).collect()}
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, n in want.items() if n}
    for df in (clean, exact, near, mixed):
        assert df.columns == docs.columns and df.schema == docs.schema

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(copies)
    assert sum(r.piece == 0 for r in packed) == sum(copies.values())
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and all(zlib.crc32(b"") <= r.ids_crc32 for r in packed)


def test_pipeline_of_nothing(spark, tmp_path):
    docs, labels = labelled(spark, 4)
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_of_rows_without_ids_and_with_clashing_columns(spark, tmp_path):
    """Rows without ids, or that share one, are documents of their own; columns of any name pass through."""
    texts = [prose(700 + i, 60) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0] + " "), (5, texts[2]), (5, texts[3]), (6, None), (7, near_copy(texts[4], 1, 1)), (8, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "CAST(NULL AS STRING) AS source", "0L AS n_chars", "1 AS part", "'x' AS nth", "2 AS h", "true AS kept", "0.5D AS size", "3 AS rep"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    _, labels = labelled(spark, 4)
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").strip()) for r in left.collect())
    # Of the equal texts without an id the longer stays; of the near copies, the smaller id.
    want = [(True, 0, texts[0]), (True, 0, texts[1]), (False, 5, texts[2]), (False, 5, texts[3]), (False, 6, ""), (False, 7, near_copy(texts[4], 1, 1))]
    assert got == sorted(want)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 5, 6, 7}


def test_near_dedup_stage_places_documents_of_many_components_few_times(spark, monkeypatch):
    """Pairs of near copies that share a passage; the rows with texts that go to tasks are counted."""
    passage = prose(71, 90)
    texts = [near_copy(f"{passage} {prose(300 + s, 60)}", k, k) for s in range(40) for k in range(2)]
    rows, kept = {}, near_dedup.materialize

    def counted(df, name):
        out = kept(df, name)
        rows[name] = rows.get(name, 0) + (out.count() if name == "met" else 0)
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    monkeypatch.setattr(near_dedup, "FEW", 4)
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table(spark, texts), "").collect()}
    assert left == {i for i, c in components_by_force(dict(enumerate(texts))).items() if i == c}
    assert 0 < rows["met"] <= 5 * len(texts)

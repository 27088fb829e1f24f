"""The whole pipeline on nulls, empty and very long texts, ties, repeated rows and an empty table; each stage with columns of its own names."""

import numpy as np
import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = np.random.default_rng(4)
    vocabulary = [f"wort{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    a, b = say(90), say(70)
    made = [(1, a), (2, a), (3, b + "\nand a line of its own"), (4, None), (5, ""), (6, "   \n\n "), (7, say(25_000)), (8, "one"), (8, "one"), (None, say(60)), (None, None), (9, "?!\n" * 40)]
    return [(i, t, None if k % 3 == 0 else "en", "x", len(t or "")) for k, (i, t) in enumerate(made)]


@pytest.fixture
def folder(spark, tmp_path):
    def make(data, labels=()):
        spark.createDataFrame(data, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return make


def test_edges_go_through_all_stages(spark, folder):
    sf = folder(rows(), [(1, 1, 0), (3, None, 1), (None, 0, 1), (7, 1, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 3, 7} <= set(ids) and ids.count(8) <= 1 and len(ids) == len(set(ids))
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert not texts.get(2) and sum(not (t or "").strip() for t in texts.values()) <= 1  # its one line stays in document 1; texts without words are copies of each other
    source = {r[0]: r[1] for r in rows()}
    assert texts[1] == source[1] and texts[7] == source[7] and texts[3] == source[3]
    packed = corpus_pipeline.run(spark, sf)
    assert {1, 3, 7} <= {r.doc_id for r in packed.collect()}


def test_an_empty_table_goes_through_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_stages_keep_columns_whose_names_clash(spark, folder):
    sf = folder(rows())
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS fp", "2 AS k", "3 AS key", "4 AS rid", "5 AS root", "'s' AS spans", "6 AS n_removed", "7 AS words", "8 AS score", "9 AS sh")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert {(r.fp, r.k, r.key, r.rid, r.root, r.spans, r.n_removed, r.words, r.score, r.sh) for r in out.collect()} == {(1, 2, 3, 4, 5, "s", 6, 7, 8, 9)}, name


def test_line_dedup_links_every_pair_of_the_similarity(spark):
    """Short lines with a letter changed in all words but one have hardly a word in common, yet over 0.8 of their letters."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(12):
        w = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(7)]
        rows += [" ".join(w), " ".join([x[:2] + "q" + x[3:] for x in w[:-1]] + w[-1:])]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: ("", 0) if i % 2 else (x, len(x)) for i, x in enumerate(rows)}


def test_training_gives_its_memory_back(spark):
    """What the driver's Python has freed when the tagger is fitted does not stay with it through all later stages."""
    import re

    from tessera.llm import toxicity

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    before = held()
    parts = [bytearray(b"x" * 50_000) for _ in range(2_000)]
    last = parts[::100]  # the freed blocks lie between some that are in use
    del parts
    toxicity.fit(docs, labels)
    assert len(last) == 20 and held() - before < 40


def test_a_worker_keeps_the_tables_of_one_stage_only():
    """Python workers outlive stages: what packing remembers goes when toxicity begins, and of a batch only one slice's texts are held."""
    import gc
    import weakref

    import pyarrow as pa

    from tessera.llm import bpe, common, toxicity

    spec = bpe.vocabulary()
    packing = weakref.ref(bpe.Bpe.shared(spec))
    assert bpe.Bpe.shared(spec) is packing()
    tag = common.kept_by_worker(("tagger", "x"), lambda: toxicity.Tagger(toxicity.Model()))
    gc.collect()
    assert packing() is None and common.kept_by_worker(("tagger", "x"), list) is tag
    texts = ["a" * 100_000, None, "", "b" * 700_000, "c" * 300_000, "d"] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [(part.column(0).to_pylist(), got) for part, got in toxicity._bounded(batch, 0)]
    assert all([t or "" for t in part] == got for part, got in parts) and [t for part, _ in parts for t in part] == texts
    assert max(sum(map(len, got)) for _, got in parts) <= 1_200_000

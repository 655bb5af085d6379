"""The pipeline's stages, each against a model on its own input, and the whole."""

import random
import re
from collections import Counter

import pytest
from cases import words
from test_dedup import key, near_model, string_model
from test_native import exact_model
from test_tokens import word_model  # noqa: F401

import __spark_entry__
import corpus_pipeline
from quadrille.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, over the smallest documents."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(stages):
    assert list(stages) == ["language ID", "exact dedup", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    for _, after in list(stages.values())[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_clean_documents_stay(stages):
    before, after = stages["language ID"]
    dropped = set(texts(before)) - set(texts(after))
    assert not [t for _, t in dropped if re.search("[a-z]", t or "")]


def test_one_of_each_group_stays(stages):
    before, after = stages["exact dedup"]
    assert sorted(i for i, _ in texts(after)) == sorted(i for i, _, _, kept in exact_model(texts(before)) if kept)
    before, after = stages["MinHash near-dedup"]
    assert sorted(i for i, _ in texts(after)) == sorted(i for i, _, c in near_model(texts(before), 5, 80) if i == c)


def test_repeats_leave_the_texts(stages):
    before, after = stages["suffix-array dedup"]
    want = {i: (n, r) for i, n, r, _, _ in string_model(texts(before), 50)}
    rows = after.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    whole = dict(texts(before))
    for r in rows:
        n, removed = want[r["doc_id"]]
        kept = len(r["text"].encode())
        assert n - removed - 6 * 20 <= kept <= n - removed and (removed or r["text"] == whole[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])


def test_all_tokens_are_packed(stages, word_model):  # noqa: F811
    before, after = stages["best-fit packing"]
    got = Counter()
    for r in after.collect():
        got[r["doc_id"]] += r["length"]
    assert got == {i: len(word_model.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(before)}


def test_run_and_registration(spark, stages):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.drop("sequence_id", "offset").exceptAll(stages["best-fit packing"][1].drop("sequence_id", "offset")).count() == 0
    assert got.count() == stages["best-fit packing"][1].count()


def test_stages_take_edge_rows(spark, edge, nothing):
    for _, stage in corpus_pipeline.STAGES:
        for docs in (edge, nothing):
            out = stage(spark, docs, "/root/testdata/sf0.001").collect()
            assert docs is edge or out == []


def test_only_deal_with_null_and_repeated_ids(spark, edge):
    from quadrille.llm import exact_dedup

    kept = corpus_pipeline._only(edge, exact_dedup.exact_groups(edge))
    ids = {key(i) for i, _, _, k in exact_model(texts(edge)) if k}
    assert sorted(key(i) for i, _ in texts(kept)) == sorted(key(i) for i, _ in texts(edge) if key(i) in ids)


def test_rows_of_one_id_are_documents_of_their_own(spark, edge):
    """Repeated and null ids: every stage decides for each row."""
    rng = random.Random(4)
    base, other, passage = (words(rng, n, 5000) for n in (60, 60, 40))
    near = base.split(" ")
    near[30] = "changed"
    rows = [
        (7, "x y"), (7, "x y"), (1, base), (24, base), (24, " ".join(near)), (24, other), (None, other), (None, other + " "),
        (None, passage + " " + words(rng, 20, 5000)), (None, words(rng, 30, 5000) + " " + passage), (9, ""), (9, None),
    ]
    docs = edge.limit(0).select(edge.columns[:5]).unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], edge.select(edge.columns[:5]).schema)).repartition(3)

    got = texts(exact := written(corpus_pipeline.exact_dedup_stage(spark, docs, "")))
    want = [(7, "x y"), (1, base), (24, " ".join(near)), (None, other + " "), *rows[8:10]]
    assert sorted((key(i), t or "") for i, t in got) == sorted((key(i), t) for i, t in [*want, (9, "")])

    got = texts(similar := written(corpus_pipeline.minhash_near_dedup(spark, exact, "")))
    assert sorted(t for _, t in got if t) == sorted(t for _, t in want if t != " ".join(near))

    got = texts(corpus_pipeline.suffix_array_dedup(spark, similar, ""))
    assert len(got) == similar.count()
    assert sum(passage in (t or "") for _, t in got) == 1

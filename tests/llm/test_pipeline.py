"""The corpus pipeline, stage by stage, and the registration of its queries."""

from collections import Counter

import corpus_pipeline
import pytest
import tiktoken

import __spark_entry__ as contract
from armlift.llm import mixing, pii, quality
from armlift.session import stored
from tests.conftest import SMALL
from tests.llm.test_dedup_and_search import plain_groups
from tests.llm.test_text_operators import library  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = stored(stage(spark, docs, SMALL))
    return [*kept, docs]


def rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_classifier_keeps_what_it_accepts(spark, stages):
    found = quality.with_quality(stages[0], quality.training_model(spark, SMALL)).collect()
    assert rows(stages[1]) == Counter(tuple(r[c] for c in COLUMNS) for r in found if r.predicted)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    left = {r.doc_id for r in stages[1].collect()}
    assert sum(d in left for d, q in labels.items() if q == 1) >= 0.95 * sum(labels.values())


def test_one_document_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    _, groups = plain_groups(before, 5)
    assert {r.doc_id for r in stages[2].collect()} == set(groups.values())
    assert not rows(stages[2]) - rows(stages[1])


def test_personal_data_is_gone(stages):
    finder = pii.Finder()
    texts = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        assert r.text == pii.redacted(texts[r.doc_id], finder.spans(texts[r.doc_id])) and r.n_chars == len(r.text)


def test_mix_repeats_documents_as_taken(stages):
    taken = {r.doc_id: r.copies for r in mixing.mix(mixing.word_counts(stages[3].selectExpr(
        "concat(doc_id, ' ', xxhash64(text)) as doc_id", "source", "text"))).collect()}
    found = Counter(r.doc_id for r in stages[4].collect())
    assert found == Counter({int(k.split()[0]): n for k, n in taken.items() if n})


def test_texts_survive_encoding(stages, library):  # noqa: F811
    assert isinstance(library, tiktoken.Encoding)
    before = Counter((r.doc_id, r.text) for r in stages[4].collect())
    after = stages[5].collect()
    assert Counter((r.doc_id, r.text) for r in after) == before
    assert all(list(r.ids) == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in after)


def test_stages_take_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, _extra array<int>"
    odd = [(1, None, None, None, None, [1]), (2, "", "en", "a", 0, None), (3, "a b c", "en", "a", 5, [1]), (3, "a b c", "en", "a", 5, [1])]
    odd += [(None, "mail x@y.zz now", "en", None, 15, [2]), (4, "w " * 20_000, "en", "b", 40_000, [3])]
    for some in (odd, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, SMALL)
            assert found.columns == docs.columns and found.count() <= 3 * len(some), name
        assert corpus_pipeline.encode_texts(spark, docs, SMALL).count() == len(some)
    copies = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(odd, schema), SMALL)
    assert Counter(r.doc_id for r in copies.collect()) == {1: 1, 2: 1, 3: 1, None: 1, 4: 1}


def test_queries_are_registered():
    names = set(contract.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(contract.oracle_sql()) <= names


CLASHING = (
    "score", "predicted", "ids", "n_tokens", "decoded", "kept_ids", "_doc", "_text", "_place", "_key", "_copies", "_times", "_copy",
    "_c0", "quality", "text_key", "group_no", "kept", "copies", "size", "class", "band",
)


def test_stages_carry_columns_of_any_name_and_type(spark):
    extra = [f"concat('{c}', doc_id) as `{c}`" for c in CLASHING] + ["map('k', doc_id) as m", "array(map(1, 'x')) as deep"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", *extra)
    plain, with_extra = (d for d in (docs.select(*COLUMNS), docs))
    for name, stage in corpus_pipeline.STAGES:
        plain, with_extra = (stored(stage(spark, d, SMALL)) for d in (plain, with_extra))
        assert rows(with_extra) == rows(plain), name
        shown = {c: f"input_{c}" if name == corpus_pipeline.STAGES[-1][0] and c in corpus_pipeline.RESULTS else c for c in CLASHING}
        assert sorted(with_extra.columns) == sorted([*plain.columns, *shown.values(), "m", "deep"])
        for r in with_extra.limit(20).collect():
            assert all(r[shown[c]] == f"{c}{r.doc_id}" for c in CLASHING) and r.m == {"k": r.doc_id}

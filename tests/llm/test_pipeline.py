"""The pipeline's stages against brute force and against what their operators say, and its query."""

import hashlib
import re

import corpus_pipeline as P
import public_tokenizers
import pytest
from test_texts import plain_classes, plain_contamination, plain_fingerprint, plain_quality, plain_spans
from tokenizers import Tokenizer

from chartmill.llm import pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    """What is tested here holds with any tagger."""
    monkeypatch.setattr(pii, "STEPS", 40)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    extra = rows.limit(3).union(spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6 + 1, None, "en", "s", None), (10**6 + 2, "long text " * 50_000, "en", "s", 500_000)], rows.schema))
    return rows.union(extra).cache()


def key(row):
    return (row.doc_id is None, row.doc_id or 0, row.text or "")


def sorted_rows(df):
    return sorted(df.collect(), key=key)


def test_quality_rules_by_brute_force(spark, docs):
    rows = docs.collect()
    kept = P.quality_rules(spark, docs, SF)
    want = [r for r, (_, keep) in zip(rows, plain_quality([(r.doc_id, r.text, r.lang) for r in rows]), strict=True) if keep]
    assert kept.columns == docs.columns and sorted_rows(kept) == sorted(want, key=key)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_dedup_by_brute_force(spark, docs, kind):
    typed = docs.withColumn("doc_id", docs.doc_id.cast(kind)).withColumnRenamed("source", "_NEAR")
    order = lambda r: (r.doc_id is None, r.doc_id or ("" if kind == "string" else 0))
    rows = sorted(typed.collect(), key=order)
    groups = plain_classes([plain_fingerprint(r.text) for r in rows])
    first = {g: r for r, g in reversed(list(zip(rows, groups, strict=True)))}
    one = P.near_dedup(spark, typed, SF)
    assert one.columns == typed.columns
    assert sorted(map(order, one.collect())) == sorted(map(order, first.values()))


def test_decontaminate_by_brute_force(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = docs.limit(60)
    want = [r for r in some.collect() if not plain_contamination(r.text, items)[4]]
    clean = P.decontaminate(spark, some, SF)
    assert clean.columns == docs.columns and sorted_rows(clean) == sorted(want, key=key)


def test_personal_data_by_brute_force(spark, docs):
    found = sorted_rows(pii.find(docs))
    masked = sorted_rows(P.personal_data(spark, docs, SF).withColumnRenamed("text", "masked").join(docs.select("doc_id", "text").distinct(), "doc_id", "left"))
    assert len([r for r in masked if r.doc_id is not None]) == sum(r.doc_id is not None for r in found)
    told = {r.doc_id: r for r in masked}
    for r in found:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        spans = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in spans]
        assert set(plain_spans(r.text or "")) <= set(spans)
        want, done = [], 0
        for a, b, k in sorted((a, -b, k) for k, a, b in spans):
            if a >= done:
                want += [r.text[done:a], f"[{pii.KINDS[k].upper()}]"]
            done = max(done, -b)
        if r.doc_id is not None:
            assert told[r.doc_id].masked == (None if r.text is None else "".join(want) + r.text[done:])
            assert not spans or told[r.doc_id].n_chars == len(told[r.doc_id].masked)
    assert "text" in P.personal_data(spark, docs.drop("n_chars"), SF).columns


def test_tokens_by_library(spark, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in P.tokens(spark, docs, SF).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_on_an_empty_table(spark, docs):
    none = docs.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert out.where("size(ids) != n_tokens").count() == 0


def test_registered_names():
    names = set(queries.queries())
    assert all(re.fullmatch(r"op[0-9]+_[a-z_]+", n) and not n.endswith("_sql") for n in names)
    assert sorted(int(n[2 : n.index("_")]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) < names

"""Operators and stages keep columns of any name, and read tables without rows."""

import pytest

import corpus_pipeline
from chartmill.llm import bpe, centroids, decontam, ftrl, hmm, html_text, langid, licenses, pii, quality, simhash, urls, vector_codes
from chartmill.llm.queries import BPE_FILE, URL_RULES

TEXT = "Some words of the text, a@b.org and 10.0.0.1, all rights reserved. " * 6
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(i, TEXT + f"word{i} other{i * i} " * 20, "en", "s", 9) for i in range(6)] + [(None, None, None, None, None)]
VECTOR = [float(i) for i in range(64)]


def rules(spark):
    return spark.createDataFrame(URL_RULES, "host string, path string, verdict string")


def items(spark):
    return spark.createDataFrame([("q", "some words that no text has in this order")], "item_id string, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")


def path():
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


OPERATORS = {
    "urls": (lambda s, df: urls.judge_urls(df, rules(s)), "url string", [("http://a.example.org/es/x",), (None,)]),
    "bpe": (lambda s, df: bpe.encode(df, path()), DOCS, ROWS),
    "decode": (lambda s, df: bpe.decode(df, path()), "ids array<int>", [([1, 2],), (None,)]),
    "quality": (lambda s, df: quality.quality(df), DOCS, ROWS),
    "decontam": (lambda s, df: decontam.contamination(df, items(s)), DOCS, ROWS),
    "licenses": (lambda s, df: licenses.scan(df), DOCS, ROWS),
    "pii": (lambda s, df: pii.find(df), DOCS, ROWS),
    "language": (lambda s, df: langid.identify(df), DOCS, ROWS),
    "html": (lambda s, df: html_text.extract(df), "html string", [("<article><p>text</p></article>",), (None,)]),
    "ftrl": (lambda s, df: ftrl.score(df, labels(s)), DOCS, ROWS),
    "centroids": (lambda s, df: centroids.cluster(df), "vec_id long, embedding array<double>", [(1, VECTOR), (2, VECTOR[::-1])]),
    "codes": (lambda s, df: vector_codes.compress(df), "vec_id long, embedding array<double>, label string", [(1, VECTOR, "x"), (2, VECTOR[::-1], None)]),
}
#: Operators that return results by key alone.
ALONE = {"hmm": lambda s, df: hmm.score(df), "simhash": lambda s, df: simhash.near_duplicates(df)}


@pytest.fixture(autouse=True)
def untrained(monkeypatch):
    monkeypatch.setattr(pii, "trained", lambda *_: None)


def widened(spark, schema, rows, taken):
    """The rows with columns of many names: those of the results in capitals, some like them, some with dots."""
    base = spark.createDataFrame(rows, schema)
    have = {c.lower() for c in base.columns}
    own = [c for c in taken if c.lower() not in have]
    more = [c.upper() for c in own] + [f"_{c}" for c in taken] + [f"{c}_" for c in taken] + [f"a.{c}" for c in taken] + ["c0", "n0", "d0", "x`y", "key", "body", "near", "state", "chunk", "h", "block"]
    more = list({c.lower(): c for c in more if c.lower() not in have}.values())
    names = [*base.columns, *more]
    wide = spark.createDataFrame([(*r, *[f"{c}!" for c in more]) for r in rows], schema + "".join(f", `{c.replace('`', '``')}` string" for c in more))
    assert wide.columns == names
    return wide, more, {c.lower() for c in own}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_other_columns(spark, name):
    apply, schema, rows = OPERATORS[name]
    taken = [c for c in apply(spark, spark.createDataFrame(rows, schema)).columns if c not in spark.createDataFrame([], schema).columns]
    assert taken
    wide, more, replaced = widened(spark, schema, rows, taken)
    out = apply(spark, wide)
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(rows) and len(set(c.lower() for c in out.columns)) == len(out.columns)
    for c in more:
        if c.lower() not in replaced:
            assert {r[c] for r in got} == {f"{c}!"}
    assert all(c in out.columns and got[0][c] != f"{c.upper()}!" for c in taken)
    assert apply(spark, wide.limit(0)).collect() == []


@pytest.mark.parametrize("name", ALONE)
def test_operators_by_key(spark, name):
    wide, _, _ = widened(spark, DOCS, ROWS, ["fingerprint", "score", "held"])
    assert len(ALONE[name](spark, wide).collect()) == len(ROWS)
    assert ALONE[name](spark, wide.limit(0)).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_all_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    taken = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed class_distance word_distance kept fingerprint component_id root contaminated n_hit items spans n_email redacted base_sha256".split()
    folder = "/root/testdata/sf0.001"
    rows = [(i, TEXT + " ".join(f"w{i}x{k}" for k in range(80 + 40 * i)), "en", "s", 9) for i in range(6)]
    wide, more, _ = widened(spark, DOCS, rows, taken)
    out = stage(spark, wide, folder)
    assert out.columns == wide.columns
    got = [r.asDict() for r in out.collect()]
    assert got and all(r[c] == f"{c}!" for r in got for c in more)
    empty = stage(spark, wide.limit(0), folder)
    assert empty.columns == wide.columns and empty.collect() == []
    last = corpus_pipeline.tokens(spark, wide, folder)
    assert len(last.columns) == 7 and last.count() == len(rows)


def test_kept_duplicate_does_not_depend_on_the_order(spark):
    rows = [(1, "one text", lang, source, 8) for lang in ("en", "de", None) for source in ("a", "b")]
    seen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        seen |= {tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(order, DOCS).coalesce(1), "").collect()}
    assert len(seen) == 1

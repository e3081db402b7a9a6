"""Quality scores: features against a plain version, held-out accuracy, odd tables."""

import re
import zlib

import numpy as np
import pyarrow as pa

from chartmill.llm import ftrl
from chartmill.llm.queries import op11_quality_score, table

ALL = (1 << 64) - 1


def mixed(h):
    h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & ALL
    return h ^ h >> 29


def plain(text):
    """Bucket -> count."""
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s\x0b]+", (text or "").encode())
    out, last = {}, None
    for t in tokens:
        h = mixed(sum(((b + 32 if 65 <= b < 91 else b) + 1) * pow(ftrl.P, i, 1 << 64) for i, b in enumerate(t)) & ALL)
        got = [h] + ([mixed((last * 31 + h) & ALL)] if last is not None else [])
        got += [7] * (len(re.findall(rb"[A-Z]", t)) > 1 and not re.search(rb"[a-z\x80-\xff]", t)) + [8] * (last == h)
        for g in got:
            out[g % ftrl.BUCKETS] = out.get(g % ftrl.BUCKETS, 0) + 1
        last = h
    return out


def check(texts):
    owner, bucket, value = ftrl.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = plain(t)
        own = owner == i
        assert bucket[own].tolist() == sorted(want)
        norm = np.sqrt(sum(want.values()))
        assert np.allclose(value[own], [np.sqrt(want[b]) / norm for b in sorted(want)])


def test_features_equal_a_plain_version(monkeypatch):
    texts = [None, "", " \n", "One TWO two", "two", "***", "a*** b$$$ A*** È è", "x", "AB\tAB AB!! ab", "\x01\x7f\x1c .", "end", "wide　space"]
    check(texts)
    monkeypatch.setattr(ftrl, "STRETCH", 7)
    check([t for t in texts if t and max(map(len, re.split(r"\s", t))) < 4] * 2)
    check(["one two " * 40 + "end"])


def test_updates_follow_the_formula():
    leader, z, n, w = ftrl.Leader(), np.zeros(4), np.zeros(4), np.zeros(4)
    at = [0, 5, ftrl.BUCKETS]
    for bucket, value, y in ([[0], [1.0], 1], [[0, 5], [0.6, 0.8], 0], [[5], [1.0], 0]) * 5:
        leader.learn(np.array(bucket), np.array(value), y)
        x = np.array([dict(zip(bucket, value, strict=True)).get(b, 0.0) for b in at[:2]] + [1.0])
        w = np.where(np.abs(z[:3]) <= ftrl.L1, 0, -(z[:3] - np.sign(z[:3]) * ftrl.L1) / ((ftrl.BETA + np.sqrt(n[:3])) / ftrl.ALPHA + ftrl.L2))
        g = (1 / (1 + np.exp(-w @ x)) - y) * x
        z[:3] += g - (np.sqrt(n[:3] + g * g) - np.sqrt(n[:3])) / ftrl.ALPHA * w
        n[:3] += g * g
    assert np.allclose(leader.z[at], z[:3]) and np.allclose(leader.n[at], n[:3])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op11_quality_score(spark, folder).collect()}
    docs = table(spark, folder, "documents").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    known = [(r.quality, got[r.doc_id]) for r in table(spark, folder, "labels").collect() if got[r.doc_id].held_out]
    assert len(known) > 50 and sum(y == r.predicted for y, r in known) >= 0.95 * len(known)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"good word{i}" if i % 2 else f"bad *** word{i}") for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    turned = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    a, b = (ftrl.trained(docs, spark.createDataFrame(rows, "doc_id long, quality int")) for rows in (labels, turned))
    assert (a == b).all() and a.any()


def test_odd_tables(spark, monkeypatch):
    kind = "doc_id long, text string, Score string, `a.b` int, n0 int"
    rows = [(i, "fine words here" if i % 2 else "junk ### here ###", "s", 1, 2) for i in range(40)]
    rows += [(None, "fine", "s", 1, 2), (50, None, "s", 1, 2), (51, "", "s", 1, 2), (1, "fine words here", "s", 1, 2), (2, "other", "s", 1, 2), (52, "word " * 50_000, "s", 1, 2)]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(None, 1, "x"), (1, None, "x"), (3, 0, "x"), (3, 1, "x"), (999, 0, "x")], "doc_id long, quality int, text string")
    docs = spark.createDataFrame(rows, kind)
    got = ftrl.score(docs, labels).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "a.b", "n0", "held_out", "score", "predicted"}
    blank = {r.score for r in got if not r.text}
    assert len(blank) == 1 and min(r.score for r in got if r.text == rows[1][1]) > max(r.score for r in got if r.text == rows[0][1])
    assert ftrl.score(spark.createDataFrame([], kind), labels).collect() == []
    assert {r.score for r in ftrl.score(docs, labels.limit(0)).collect()} == {0.5}
    monkeypatch.setattr(ftrl, "TRAIN", 5)
    assert ftrl.examples(docs, labels, "doc_id", "text", "quality").count() == 5

import zlib

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import quality, sparse_ftrl, toxicity
from clickloom.llm.quality import QualityClassifier
from clickloom.llm.tables import read
from clickloom.llm.toxicity import ToxicityClassifier
from clickloom.llm.words import pieces

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("classifier", "label", "folds", "held", "cut"),
    [(QualityClassifier(), "quality", 4, 2, 0.7), (ToxicityClassifier(), "toxic", 5, 0, 0.5)],
)
def test_held_out_accuracy(spark, classifier, label, folds, held, cut):
    docs, labels = read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "labels")
    rows = {r["doc_id"]: r for r in classifier.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in rows.values())
    truth = {r["doc_id"]: r[label] for r in labels.collect() if rows[r["doc_id"]]["held_out"]}
    right = np.mean([rows[i]["predicted"] == y for i, y in truth.items()])
    assert right >= max(0.93, np.mean(list(truth.values())))


@pytest.mark.parametrize("classifier", [QualityClassifier(), ToxicityClassifier()])
def test_odd_rows(spark, docs_of, classifier):
    docs = docs_of([(1, None), (2, ""), (None, "one"), (4, " \n"), (4, "word " * 30_000), (4, "\0é!!")])
    columns = "doc_id bigint, quality int, toxic int, text string, y int"
    none = spark.createDataFrame([], columns)
    some = spark.createDataFrame([(1, 1, 1, "x", 0), (None, 1, 0, "x", 0), (4, None, None, "", 1), (4, 0, 0, "", 1)], columns)
    for labels in (none, some):
        rows = classifier.classify(docs, labels).collect()
        assert len(rows) == 6
        assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert {r["score"] for r in classifier.classify(docs, none).collect()} == {0.5}
    assert classifier.classify(docs.limit(0), some).count() == 0


def test_all_documents_are_kept_where_nothing_was_learned(spark, docs_of):
    rows = [(1, "good words of some kind"), (2, None), (None, ""), (2, "THE!! END!!")]
    docs = docs_of(rows)
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 4 == 2)
    for labels in ([], [(1, None), (None, 1)], [(held, 1)], [(99_999, 1)]):
        kept = QualityClassifier().keep(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        assert kept.schema == docs.schema
        assert [(r["doc_id"], r["text"]) for r in kept.collect()] == rows


def test_labels_of_held_out_rows_are_not_learned(spark, docs_of):
    docs = docs_of([(k, "good words" if k % 2 else "bad junk") for k in range(60)])
    flip = [(k, (k % 2) ^ (zlib.crc32(str(k).encode()) % 4 == 2)) for k in range(60)]
    plain = [(k, k % 2) for k in range(60)]
    scores = [
        sorted(map(tuple, QualityClassifier().classify(docs, spark.createDataFrame(rows, "doc_id bigint, quality int")).collect()))
        for rows in (flip, plain)
    ]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_are_dot_products(module):
    texts = ["a b a b c", "", "THE!! END!! the the", "x"]
    bits = 12
    w = np.random.default_rng(1).normal(size=1 << bits)
    (_, _, data, offsets), = pieces(pa.array(texts))
    text, at, x = sparse_ftrl.counted(module.features, module.damp, bits, data, offsets)
    for k, one in enumerate(texts):
        (_, _, d, o), = pieces(pa.array([one]))
        hashes, _ = module.features(d, o)
        slots, counts = np.unique(sparse_ftrl.slots(hashes, bits), return_counts=True)
        want = w[slots] @ module.damp(counts, np.full(len(counts), len(hashes)))
        assert np.isclose(w[at[text == k]] @ x[text == k], want)


def test_one_update_is_ftrl_proximal():
    f = sparse_ftrl.Ftrl(alpha=0.5, beta=1.0, l1=0.1, l2=0.01)
    z, n = np.zeros(4), np.zeros(4)
    for _ in range(3):
        sparse_ftrl.update(z, n, np.array([0, 2]), np.array([1.0, 2.0]), 1, f)
    zs, ns, ws = [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]
    for _ in range(3):
        for k in range(2):
            if abs(zs[k]) <= 0.1:
                ws[k] = 0.0
            else:
                sign = 1 if zs[k] > 0 else -1
                ws[k] = -(zs[k] - sign * 0.1) / ((1 + ns[k] ** 0.5) / 0.5 + 0.01)
        p = 1 / (1 + np.exp(-(ws[0] + 2 * ws[1])))
        for k, x in enumerate((1.0, 2.0)):
            g = (p - 1) * x
            sigma = ((ns[k] + g * g) ** 0.5 - ns[k] ** 0.5) / 0.5
            zs[k] += g - sigma * ws[k]
            ns[k] += g * g
    assert np.allclose(z[[0, 2]], zs) and np.allclose(n[[0, 2]], ns) and z[1] == z[3] == 0


def test_the_bound_of_the_sample_binds(spark, docs_of, monkeypatch):
    updates = []
    plain = sparse_ftrl.update
    monkeypatch.setattr(sparse_ftrl, "update", lambda *a: (updates.append(1), plain(*a)))
    docs = docs_of([(7, f"text number {k}") for k in range(300)] + [(8, "long " * 40_000)])
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id bigint, quality int")
    f = sparse_ftrl.Ftrl(epochs=1, bits=10)
    for rows, want in ((1, 1), (5, 5)):
        updates.clear()
        sparse_ftrl.fit(docs.where("doc_id = 7"), labels, "quality", quality.features, quality.damp, f, sparse_ftrl.Sample(rows=rows))
        assert len(updates) == want
    updates.clear()
    sparse_ftrl.fit(docs, labels.where("doc_id = 8"), "quality", quality.features, quality.damp, f, sparse_ftrl.Sample())
    assert not updates


@pytest.mark.parametrize(("module", "classifier", "label", "cut"), [
    (quality, quality.QualityClassifier, "quality", 0.7), (toxicity, toxicity.ToxicityClassifier, "toxic", 0.5),
])
def test_whole_result_like_plain_learning(spark, docs_of, module, classifier, label, cut):
    import math
    import random
    import zlib

    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["good", "bad", "THE", "of!", "x1"] if k % 2 else ["good", "so", "well"]) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    rows += [(60, None), (None, "bad bad"), (61, "")]
    labels = [(k, k % 2) for k in range(0, 60, 2)] + [(k, k % 2) for k in range(1, 60, 4)] + [(5, None), (None, 1)]
    one = classifier()
    f, bits = one.ftrl, one.ftrl.bits

    def cells(text):
        (_, _, data, offsets), = pieces(pa.array([text or ""]))
        hashes, _ = module.features(data, offsets)
        at, counts = np.unique(sparse_ftrl.slots(hashes, bits), return_counts=True)
        x = module.damp(counts, np.full(len(counts), len(hashes))).astype(np.float32)
        return list(zip(at.tolist(), [float(v) for v in x], strict=True))

    left_out = {i: zlib.crc32(str(i).encode()) % module.FOLDS == module.HELD_OUT for i, _ in rows if i is not None}
    texts = dict(rows)
    known = sorted(((i, y) for i, y in labels if i is not None and y is not None and not left_out[i]), key=lambda e: hash((e[0], bits, one.sample.seed)))
    z, n = {}, {}

    def weight(k):
        a, b = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(a) <= f.l1 else ((f.l1 if a > 0 else -f.l1) - a) / ((f.beta + math.sqrt(b)) / f.alpha + f.l2)

    def margin(row, w):
        return sum(w(k) * x for k, x in row)

    for _ in range(f.epochs):
        for i, y in known:
            row = [*cells(texts[i]), (0, 1.0)]
            p = 1 / (1 + math.exp(-margin(row, weight)))
            old = {k: weight(k) for k, _ in row}
            for k, x in row:
                g = (p - y) * x
                b = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(b + g * g) - math.sqrt(b)) / f.alpha * old[k]
                n[k] = b + g * g
    got = one.classify(docs_of(rows), spark.createDataFrame(labels, f"doc_id bigint, {label} int")).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r["doc_id"], texts[r["doc_id"]]))), strict=True):
        want = 1 / (1 + math.exp(-margin([*cells(text), (0, 1.0)], weight)))
        assert r["doc_id"] == i and abs(r["score"] - want) < 1e-4
        assert r["held_out"] == left_out.get(i, False) and r["predicted"] == int(r["score"] >= cut)

import math
import random
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm.backoff_lm import BackoffScorer
from clickloom.llm.fixity import FixityAudit, warc_records
from clickloom.llm.topk import SortedLists, ThresholdSearch, quantized
from clickloom.operators import running

# ---- language model


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_scores(rows, order, least, discount):
    counts, total = Counter(), 0
    for _, text in rows:
        ws = words(text)
        total += len(ws)
        for n in range(1, order + 1):
            counts.update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    known = {g: c for g, c in counts.items() if c >= least}

    def one(ws, i):
        factor = 1.0
        for n in range(order, 1, -1):
            if i >= n - 1:
                gram = tuple(ws[i - n + 1 : i + 1])
                if gram in known:
                    return math.log(factor * known[gram] / known[gram[:-1]])
                factor *= discount
        return math.log(factor * max(known.get((ws[i],), 0), 1) / total)

    return [(i, len(words(t)), sum(one(words(t), k) for k in range(len(words(t))))) for i, t in rows]


@pytest.mark.parametrize(
    "scorer", [BackoffScorer(), BackoffScorer(block_bytes=300, partition_bytes=500), BackoffScorer(order=2, min_count=1), BackoffScorer(order=1)]
)
def test_scores_like_brute_force(docs_of, scorer):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["a", "b", "The", "é", "x,"]) for _ in range(rng.randint(0, 30)))) for k in range(40)]
    rows += [(None, "the a b"), (90, None), (91, ""), (92, "\t\n"), (3, "a b a b"), (3, "a b a b"), (95, "a " * 4_000)]
    got = scorer.score(docs_of(rows)).collect()
    want = brute_scores(rows, scorer.order, scorer.min_count, scorer.discount)
    key = lambda r: (str(r[0]), r[1], round(r[2], 5))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-6)
        assert g[3] is None if w[1] == 0 else g[3] == pytest.approx(w[2] / w[1])


def test_documents_of_one_id_are_dealt_to_many_blocks(spark, docs_of):
    rng = random.Random(4)
    rows = [(key, " ".join(rng.choice("abcdefg") for _ in range(40))) for key in (None, 7) for _ in range(60)]
    scorer = BackoffScorer(block_bytes=800, partition_bytes=2_000)
    got = sorted((r["n_words"], round(r["log_score"], 9)) for r in scorer.score(docs_of(rows)).collect())
    own_ids = docs_of([(k, t) for k, (_, t) in enumerate(rows)])
    assert got == sorted((r["n_words"], round(r["log_score"], 9)) for r in BackoffScorer().score(own_ids).collect())


def test_no_documents(docs_of):
    assert BackoffScorer().score(docs_of([])).count() == 0


# ---- top k


def test_threshold_walk_is_exact():
    rng = np.random.default_rng(1)
    for t in range(300):
        n, d = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        v, ids, k, q = rng.integers(-3, 4, (n, d)), rng.permutation(200)[:n], int(rng.integers(1, 7)), rng.integers(-3, 4, d)
        key = int(ids[0]) if t % 2 else -5
        found, scores, _ = SortedLists(ids, v).top(key, q, k)
        want = sorted((-int(v[i] @ q), int(ids[i])) for i in range(n) if ids[i] != key)[:k]
        assert [(-s, i) for i, s in zip(found, scores, strict=True)] == want


def test_the_walk_stops_early():
    v = np.stack([np.arange(5_000), np.zeros(5_000, int)], axis=1)
    found, _, scored = SortedLists(np.arange(5_000), v).top(-1, np.array([2, 0]), 3)
    assert found == [4_999, 4_998, 4_997] and scored < 100


def test_search_over_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.normal(size=6)], 0, 0.0) for k in range(300)]
    rows += [(k, [0.5] * 6, 0, 0.0) for k in range(400, 460)]
    rows += [(None, [1.0] * 6, 0, 0.0), (500, None, 0, 0.0), (550, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, 0.0), (600, [float("nan")] * 6, 0, 0.0), (650, [float("-inf")] * 6, 0, 0.0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int, score double")
    vectors = quantized(table)
    got = ThresholdSearch(k=5, block_rows=70, query_rows=3).search(vectors, F.expr("vec_id % 50 = 0")).collect()
    kept = {r["vec_id"]: r["vector"] for r in vectors.collect() if r["vec_id"] is not None and r["vector"] is not None}
    want = []
    for q in [i for i in kept if i % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(kept[q], v, strict=True)), i) for i, v in kept.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_small_searches(spark):
    schema = "vec_id bigint, vector array<bigint>"
    search = ThresholdSearch(k=5).search
    one = spark.createDataFrame([(0, [1, 2])], schema)
    assert search(one, F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1, 2]), (1, [0, 0]), (2, [7])], schema)
    assert sorted(map(tuple, search(two, F.lit(True)).collect())) == [(0, 1, 1, 0), (1, 1, 0, 0)]
    assert search(one.limit(0), F.lit(True)).count() == 0
    # rows with one id are queries and candidates one by one
    same = spark.createDataFrame([(0, [1, 2]), (0, [3, 1]), (1, [1, 0])], schema)
    want = [(0, 1, 0, 5), (0, 1, 0, 5), (0, 2, 1, 1), (0, 2, 1, 3)]
    assert sorted(map(tuple, search(same, F.expr("vec_id = 0")).collect())) == want
    empty = spark.createDataFrame([(0, []), (1, []), (2, [])], schema)
    assert sorted(map(tuple, search(empty, F.expr("vec_id = 0")).collect())) == [(0, 1, 1, 0), (0, 2, 2, 0)]


# ---- fixity


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, file int, digest string")


def test_audit_finds_every_difference(spark):
    rng = random.Random(6)
    base = [(k, f"http://h/{k}", "é" * rng.randint(0, 20)) for k in range(0, 9_000, 3)]
    base += [(None, "u", "n1"), (None, None, None), (6, "http://h/6", "second copy"), (-5, "u", "")]
    other = []
    for k, u, h in base:
        if k is not None and k % 501 == 0:
            continue
        other.append((k, u, (h or "") + "!" if k is not None and k % 700 == 6 else h))
    other.append((4, "u", "surplus"))
    got = FixityAudit().audit(warc_records(pages(spark, base)), warc_records(pages(spark, other))).collect()
    found = Counter((r["key"], r["status"]) for r in got)
    want = Counter((k, "missing") for k, _, _ in base if k is not None and k % 501 == 0)
    want += Counter((k, "changed") for k, _, _ in base if k is not None and k % 700 == 6 and k % 501)
    want[(4, "surplus")] = 1
    changed = {k for k, s in want if s == "changed"}
    assert {k for k, s in found if s == "changed"} == changed
    assert {k: n for k, n in found.items() if k[1] != "changed"} == {k: n for k, n in want.items() if k[1] != "changed"}


def test_starts_are_offsets(spark):
    rows = [(k, "u", "é" * k) for k in range(40)]
    contents = [r["content"].encode() for r in warc_records(pages(spark, rows)).collect()]
    other = [(k, u, h if k not in (7, 33) else h + "?") for k, u, h in rows]
    got = FixityAudit(fanout_bits=2).audit(warc_records(pages(spark, rows)), warc_records(pages(spark, other))).collect()
    assert sorted((r["key"], r["start"], r["length"]) for r in got) == [
        (k, sum(map(len, contents[:k])), len(contents[k])) for k in (7, 33)
    ]


def test_files_of_many_blocks(spark, monkeypatch):
    """Pages without id and copies of one id stand in one file each, which no single task may have to sort."""
    monkeypatch.setattr(running, "BLOCK_BYTES", 20_000)
    rows = [(None, f"u{k}", "h" * (k % 7)) for k in range(1_500)] + [(5, "u", f"h{k % 40}") for k in range(1_500)]
    records = FixityAudit().records(warc_records(pages(spark, rows)))
    got = {(r["file"], r["seq"]): r for r in records.collect()}
    for file in (-1, 0):
        own = [got[file, k] for k in range(1_500)]
        assert [r["start"] for r in own] == list(accumulate([0, *[r["length"] for r in own[:-1]]]))
        assert [r["copy"] for r in own] == list(range(1, 1_501))
        assert [r["digest"] for r in own] == sorted(r["digest"] for r in own)
    other = [*rows[:-1], (5, "u", "changed"), (6, "new", "page")]
    differing = FixityAudit().audit(warc_records(pages(spark, rows)), warc_records(pages(spark, other))).collect()
    assert ("surplus", 6) in {(r["status"], r["key"]) for r in differing} and len(differing) > 1


def test_equal_and_empty_replicas(spark):
    rows = warc_records(pages(spark, [(k, "u", "h") for k in range(100)]))
    none = rows.limit(0)
    audit = FixityAudit().audit
    assert audit(rows, rows).count() == 0
    assert audit(none, none).count() == 0
    assert {r["status"] for r in audit(rows, none).collect()} == {"missing"}
    assert audit(none, rows).where("status = 'surplus'").count() == 100

import hashlib
import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from clickloom.llm.suffix_dedup import SuffixDedup, anchored, merged, repeated_suffixes, without
from clickloom.session import scratch


def brute_force(rows, length):
    raws = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(raw[p : p + length] for _, raw in raws for p in range(len(raw) - length + 1))
    out = []
    for key, raw in raws:
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n, size, letters="ab é"):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(4)]
    rows = []
    for k in range(n):
        parts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, size)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p))
            parts += [p[cut:], rng.choice(["", "x", "yz"]), p[:cut]]
        rows.append((k, "".join(parts)))
    return [*rows, rows[1], (None, rows[2][1]), (n, ""), (n + 1, None), (n + 2, "a" * 3 * size), (n + 3, "ab" * size)]


@pytest.mark.parametrize(("length", "bucket"), [(5, 1_000), (12, 1 << 22), (12, 3_000), (50, 1 << 22), (50, 20_000)])
def test_like_brute_force(spark, docs_of, length, bucket):
    rows = texts(length, 60, 3 * length)
    docs = docs_of(rows, "row string, n_bytes bigint, starts string, places string")
    got = SuffixDedup(length, bucket).report(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows, length)


def test_production_length_with_a_hot_passage(spark, docs_of):
    rng = random.Random(1)

    def prose(n):
        return "".join(rng.choice("abcdefgh ij") for _ in range(n))

    common, edge = prose(900), prose(399)
    rows = [(k, prose(300) + common + prose(300)) for k in range(60)]
    rows += [(100 + k, prose(500) + edge + prose(500)) for k in range(5)]
    rows += [(200, prose(300) + common[:399] + prose(300)), (201, common[:400]), (202, prose(5_000))]
    got = SuffixDedup(bucket_bytes=30_000).report(docs_of(rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows, 400)


def test_steps_over_many_small_partitions_write_few_files(spark, docs_of):
    most = 4 * spark.sparkContext.defaultParallelism
    rows = texts(6, 60, 60)
    settings = {"spark.sql.shuffle.partitions": 2 * most, "spark.sql.adaptive.coalescePartitions.enabled": False}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        with scratch(spark) as path:
            report = SuffixDedup(12, 3_000).report(docs_of(rows))
            report.write.parquet(f"{path}/report-1")
            got = spark.read.parquet(f"{path}/report-1").collect()
            files = {d.name.rpartition("-")[0]: len(list(d.glob("part-*"))) for d in Path(urlparse(path).path).iterdir()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=repr) == brute_force(rows, 12)
    assert len(files) > 10 and max(files.values()) <= most, files


def test_anchors_cover_all_starts_and_follow_the_content():
    rng = np.random.default_rng(2)
    common = rng.integers(97, 105, 300, dtype=np.uint8)
    homes = []
    for k in (0, 37, 501):
        data = np.concatenate([rng.integers(97, 105, k, dtype=np.uint8), common, rng.integers(97, 105, 99, dtype=np.uint8)])
        first, n, anchor = anchored(data, 100, 64)
        assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == len(data) - 99
        of_start = np.repeat(anchor, n)
        assert ((of_start >= np.arange(len(of_start))) & (of_start < np.arange(len(of_start)) + 64)).all()
        homes.append((of_start - k)[k : k + 201].tolist())
    assert homes[0] == homes[1] == homes[2]
    assert [len(x) for x in anchored(data[:99], 100, 64)] == [0, 0, 0]


def test_multikey_quicksort_like_a_set():
    rng = random.Random(3)
    for length in (1, 7, 8, 9, 30):
        raw = bytes(rng.choice(b"ab") for _ in range(400)) + b"abcabcabc" * 30 + bytes(40)
        places = np.arange(len(raw) - length + 1)
        counts = Counter(raw[p : p + length] for p in places)
        want = [p for p in places if counts[raw[p : p + length]] > 1]
        assert sorted(repeated_suffixes(np.frombuffer(raw, np.uint8), places.copy(), length)) == want


def test_ranges():
    assert merged([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)]
    assert without(b"0123456789abcd", [(1, 4), (5, 12)]) == b"04cd"


def test_tables_without_rows(spark, docs_of):
    assert SuffixDedup().report(docs_of([(1, "x")]).limit(0)).count() == 0
    assert [tuple(r)[:4] for r in SuffixDedup().report(docs_of([(1, None)])).collect()] == [(1, 0, 0, 0)]

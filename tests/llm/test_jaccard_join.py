import random
import re

import pytest

from clickloom.llm import jaccard_join, tables
from clickloom.llm.components import components
from clickloom.llm.jaccard_join import JaccardJoin


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_force(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    above = {i: i for i, _ in rows}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                above[max(x, y)] = min(x, y)
    return {(i, len(s), top(i) if s else i) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 5, 30, 60, 90)]
    rows = []
    for k in range(140):
        ws = list(rng.choice(base[5:] if k % 3 else base))
        for _ in range(rng.randint(0, 4)):
            if ws:
                ws[rng.randrange(len(ws))] = rng.choice(words)
        if k % 7 == 0:
            ws += ["a", "common", "passage", "of", "many", "documents", "here", "now"]
        rows.append((k, " ".join(ws).upper() if k % 5 == 0 else "  ".join(ws)))
    return [*rows, (900, None), (901, ""), (902, " \n\t"), (903, "only three words"), (904, "Only three\nwords")]


@pytest.mark.parametrize(("leaf", "seed"), [(192, 1), (4, 2), (1, 3)])
def test_like_brute_force(docs_of, leaf, seed):
    rows = corpus(seed)
    got = JaccardJoin(width=4, percent=85, leaf_docs=leaf, pivots=4).classes(docs_of(rows)).collect()
    assert {tuple(r) for r in got} == brute_force(rows, 4, 85)
    assert len(got) == len(rows)


def test_other_width_and_threshold(docs_of):
    rows = corpus(5)
    got = JaccardJoin().classes(docs_of(rows)).collect()
    assert {tuple(r) for r in got} == brute_force(rows, 5, 80)


def test_large_cells_and_long_sets_at_default_settings(docs_of):
    rng = random.Random(7)
    common = [f"c{k}" for k in range(1_400)]
    rows = []
    for k in range(230):
        ws = list(common)
        for _ in range(rng.choice([0, 1, 20, 45, 90])):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(ws[: rng.choice([1_400, 1_300, 1_200])])))
    got = JaccardJoin().classes(docs_of(rows)).collect()
    want = brute_force(rows, 5, 80)
    assert {tuple(r) for r in got} == want
    assert 1 < len({c for *_, c in want}) < 230 and max(n for _, n, _ in want) > 1_024


def test_counts_of_many_tasks_and_joins_without_broadcast(spark, docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ADDED_AT_ONCE", 3)
    monkeypatch.setattr(tables.written_broadcast, "__defaults__", (0,))
    rows = corpus(6)
    got = JaccardJoin(width=4, percent=85, leaf_docs=4, pivots=4).classes(docs_of(rows).repartition(9)).collect()
    assert {tuple(r) for r in got} == brute_force(rows, 4, 85)


def test_missing_and_repeated_ids(docs_of):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (2, "p q r s t"), (5, "p q r s t"), (None, None)]
    got = sorted(map(tuple, JaccardJoin(4, 85).classes(docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (2, 2, 1), (5, 2, 1), (None, 0, None), (None, 2, None)], key=str)


def test_no_rows(docs_of):
    assert JaccardJoin().classes(docs_of([])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 100), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(("level", "leaf"), [(0, 192), (3, 4), (11, 192)])
def test_rare_shingles_are_brought_together_once(docs_of, monkeypatch, level, leaf):
    tables_of, write = {}, jaccard_join.write_table
    monkeypatch.setattr(jaccard_join, "write_table", lambda df, name, *a: tables_of.setdefault(name, write(df, name, *a)))
    monkeypatch.setattr(jaccard_join, "RARE_LEVEL", level)
    rows = corpus(8)
    got = JaccardJoin(width=4, percent=85, leaf_docs=leaf, pivots=4).classes(docs_of(rows)).collect()
    assert {tuple(r) for r in got} == brute_force(rows, 4, 85)
    prefixes = tables_of["signed"].selectExpr("sum(size(rare))", "sum(size(common))").first()
    # lists are joined to postings for common shingles alone
    assert (prefixes[0] > 0, prefixes[1] > 0) == (level > 0, level < 11)
    assert (tables_of["lists"].count() > 0) == (level < 11)


def test_bucket_counts_take_a_byte_and_rule_out_no_link():
    rng = random.Random(9)
    sets = []
    for size in (1, 40, 500, 9_000):
        s = [rng.randrange(2**64) for _ in range(size)]
        t = s[: size - size // 20] + [rng.randrange(2**64) for _ in range(size // 20)]
        sets += [jaccard_join.np.array(sorted(x), "uint64") for x in (s, t)]
    # one bucket full beyond a byte
    sets += [jaccard_join.np.arange(k, 4_000 + k, dtype="uint64") for k in (0, 100)]
    frame = jaccard_join.pd.DataFrame(
        {"pivot": 1, "doc_id": range(len(sets)), "n": list(map(len, sets)), "signature": list(map(jaccard_join._signature, sets))}
    )
    assert [len(s) for s in frame["signature"][:6]] == [64] * 6
    assert set(jaccard_join._possible(frame, 85)["doc_id"]) >= set(range(2, len(sets)))

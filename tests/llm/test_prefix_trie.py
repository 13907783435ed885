import hashlib
import random
import zlib

import pytest

from clickloom.llm import prefix_trie
from clickloom.llm.prefix_trie import PrefixTrie

COLUMNS = "conv_id bigint, turn bigint, role string, text string, depth bigint, pos bigint, ids string"


def brute_force(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)

    totals = {}
    for k in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(k, [])]
        saved = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        totals[k] = sum(x for x, _ in below) if below else 1, saved + sum(x for _, x in below)
    return sorted(
        (
            min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children.get(k, [])), *totals[k],
            hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(k)).encode()).hexdigest(),
        )
        for k, cs in members.items()
    )


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        if rng.random() < 0.1:
            continue
        turns = list(range(rng.randint(1, 14)))
        rng.shuffle(turns)
        rows += [(c, t, rng.choice(["a", "b", None]), rng.choice(["x", "é", None, "yy"])) for t in turns]
    rows += [(3, None, "a", "x"), (3, None, "a", "x"), (3, 2, "z", "same number"), (None, 1, "a", "x"), (None, None, None, None)]
    rows += [(n + 1, t, "a", f"t{t}") for t in range(300)]
    rows += [(1000 + k, t, "a", f"u{t}") for k in range(60) for t in range(9)]
    return [(*r, None, None, None) for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = conversations(seed)
    got = PrefixTrie().nodes(spark.createDataFrame(rows, COLUMNS))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_force(rows), key=key)


def test_other_numbers_after_a_collision(spark, monkeypatch):
    # equal fingerprints for all prefixes of a depth: only the verification can see that
    rows = conversations(3, 20)
    want = sorted(brute_force(rows), key=lambda r: r[:2])
    tried = []
    groups = PrefixTrie._groups

    def counted(members):
        tried.append(1)
        if len(tried) < 3:
            members = members.withColumns({h: members["depth"] * 0 for h in ("h0", "h1", "h2")})
        return groups(members)

    monkeypatch.setattr(prefix_trie.PrefixTrie, "_groups", staticmethod(counted))
    got = sorted(map(tuple, PrefixTrie().nodes(spark.createDataFrame(rows, COLUMNS)).collect()), key=lambda r: r[:2])
    assert got == want and len(tried) == 3


def test_long_lists_of_ids_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_PIECE_IDS", 7)
    rows = [(c, 0, "a", "x", None, None, None) for c in range(0, 500, 5)]
    got = PrefixTrie().nodes(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(rows))


def test_tables_without_rows(spark):
    assert PrefixTrie().nodes(spark.createDataFrame([(None, 1, "a", "b", None, None, None)], COLUMNS)).count() == 0

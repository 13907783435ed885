import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from clickloom.llm.spelling import SpellingVariants, near_in_blocks


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_force(rows, ratio=10):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: sorted(((-words[v], v) for v in words if one_edit(v, w))) for w in words}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= ratio * n else None for w, n in words.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def edited(rng, word):
    k, c = rng.randrange(len(word) + 1), rng.choice("abcdeñ×ÿ")
    return rng.choice([word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word[:k] + word[k + 1 :]])


def texts(seed, n=300):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeñ") for _ in range(rng.randint(7, 12))) for _ in range(12)]
    stems += ["aaaaaaaa", "aaaaaaaaa", "Éabcdefg", "ABCDEFGH", "x" * 3000]
    rows = []
    for k in range(n):
        words = [rng.choice(stems) for _ in range(30)]
        words = [edited(rng, w) if rng.random() < 0.2 else w for w in words]
        rows.append((k, " ".join(words)))
    return [*rows, rows[0], (None, rows[1][1]), (7, ""), (8, None), (9, "short abcdefg-abcdefg_abcdefg1abcdefg")]


@pytest.mark.parametrize("tile", [2_048, 7])
def test_like_brute_force(spark, docs_of, tile):
    rows = texts(tile)
    docs = docs_of(rows, "word string, n bigint, half string, root string")
    got = {tuple(r) for r in SpellingVariants(tile=tile).group(docs).collect()}
    want = brute_force(rows)
    assert got == want
    assert any(form for _, form, *_ in want)


def test_chains_of_forms(spark, docs_of):
    chain = [("abcdefgh", 2), ("abcdefgx", 20), ("abcdefyx", 200), ("abcdezyx", 2000)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    # ids under which no letter is left out
    free = [next(i for i in range(1000) if zlib.crc32(f"{i}:{w}".encode()) % 31) for w, _ in chain]
    rows = [(i, t) for i, (_, t) in zip(free, rows, strict=True)]
    got = {r["word"]: r["root"] for r in SpellingVariants().group(docs_of(rows)).collect()}
    assert got == dict.fromkeys([w for w, _ in chain], "abcdezyx")


def test_pairs_of_blocks_like_plain_comparison():
    rng = random.Random(5)
    for _ in range(200):
        short = [sorted({"ab" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(rng.randint(0, 9))}) for _ in range(4)]
        long = [sorted({"ab" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(rng.randint(0, 9))}) for _ in range(4)]
        if not any(short):
            continue
        words = [(w, k) for k, ws in enumerate(short) for w in ws], [(w, k) for k, ws in enumerate(long) for w in ws]
        numbers = [np.array([k for _, k in ws], dtype=np.int64) for ws in words]
        i, j = near_in_blocks([w for w, _ in words[0]], numbers[0], [w for w, _ in words[1]], numbers[1], 4)
        both = words[0] + words[1]
        want = {
            (a, b)
            for a in range(len(words[0]))
            for b in range(a + 1, len(both))
            if both[a][1] == both[b][1] and one_edit(both[a][0], both[b][0])
        }
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_tables_without_rows(spark, docs_of):
    docs = docs_of([(1, None)])
    assert SpellingVariants().group(docs).count() == 0
    assert SpellingVariants().group(docs.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]

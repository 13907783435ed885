import hashlib
import random
import re

import pytest

from clickloom.llm.decontaminate import Automaton, Decontaminator, merged, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(text, items, span):
    doc, hit, found = plain_words(text), set(), set()
    for item, t in items:
        ws = plain_words(t)
        size = min(span, len(ws))
        windows = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if ws else set()
        for k in range(len(doc) - size + 1):
            if tuple(doc[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(item)
    return len(doc), len(hit), found


def test_automaton_like_brute_force():
    rng = random.Random(3)
    for _ in range(800):
        letters = ["a", "b", "C", "d", "é", "x1"][: rng.randint(2, 6)]

        def text(n, letters=letters):
            return " ".join(rng.choice(letters) for _ in range(n))

        span = rng.choice([3, 4, 10])
        items = [(i, text(rng.choice([0, 1, 2, 3, 5, 12, 20]))) for i in range(rng.randint(0, 5))]
        doc = text(rng.randint(0, 60))
        if items:
            doc += " - " + rng.choice(items)[1] + ", " + text(5)
        spans, found = Automaton([(i, words(t)) for i, t in items], span).spans(words(doc))
        assert (len(words(doc)), sum(b - a for a, b in merged(spans)), found) == brute_force(doc, items, span)


ITEMS = [(k, " ".join(f"q{k}x{j}" for j in range(14))) for k in range(6)] + [(90, "Short One"), (91, ""), (92, None), (None, "p q")]


def documents():
    rng = random.Random(1)
    rows = [(None, "short one"), (1, None), (2, ""), (3, "... --- \t"), (4, "a short, ONE b short.One")]
    for k in range(5, 40):
        ws = [f"w{rng.randrange(50)}" for _ in range(30)]
        a, b = sorted(rng.sample(range(15), 2))
        ws[10:10] = ITEMS[k % 6][1].split()[a:b]
        rows.append((k, " ".join(ws)))
    return [*rows, (39, ITEMS[3][1] + " " + ITEMS[3][1].upper()), (50, "w " * 60_000 + ITEMS[2][1])]


@pytest.mark.parametrize("operator", [Decontaminator(), Decontaminator(shard_words=10, broadcast_words=20)])
def test_report_like_brute_force(spark, docs_of, operator):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, doc_id int")
    rows = documents()
    got = operator.report(docs_of(rows), items).collect()
    known = [(i, t) for i, t in ITEMS if i is not None]
    want = []
    for doc_id, text in rows:
        n, hit, found = brute_force(text, known, 10)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.append((doc_id, n, hit, len(found), digest, hit > 0))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_remove(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    passage = ITEMS[0][1]
    rows = [(1, f"Keep  this. {passage}, and this\n" + "more words " * 20), (2, passage), (3, None), (4, "  as it is\t"), (5, "")]
    docs = docs_of(rows)
    out = Decontaminator().remove(docs, items)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        1: "Keep  this. , and this\n" + "more words " * 20,
        3: None,
        4: "  as it is\t",
        5: "",
    }


def test_no_items_and_no_rows(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = Decontaminator().report(docs_of([(1, "a b")]), none).first()
    assert tuple(got)[:4] == (1, 2, 0, 0) and got["contaminated"] is False
    assert Decontaminator().report(docs_of([]), none).count() == 0

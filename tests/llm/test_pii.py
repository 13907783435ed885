import random
import re
import time

import numpy as np
import pytest

from clickloom.llm import bilstm_crf, pii
from clickloom.llm.pii import PiiFinder
from clickloom.llm.tables import read

TAGS_HERE = 5

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_force(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = digits[-1::-2], digits[-2::-2]
            luhn = (sum(map(int, odd[0])) + sum(sum(divmod(2 * int(d), 10)) for d in odd[1])) % 10 == 0
            fits = (
                True,
                kind != 1 or all(int(p) <= 255 for p in m.group().split(".")),
                14 <= len(digits) <= 19 and luhn,
                10 <= len(digits) <= 15,
            )[kind]
            if fits:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_like_plain_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+-2 (45)9b%é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_force(text)
    cards = "4111 1111 1111 1111, 4111-1111-1111-1112 +1 (988) 555-2485; 1.2.3.4.5.6.7.8 256.1.1.1 a@b.c@d.e"
    assert pii.base_spans(cards) == brute_force(cards)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000 + "@", "a@" * 50_000, "1." * 50_000, "+1 " * 50_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def trained(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    return PiiFinder().fit(docs)


def test_the_network_finds_held_out_spans(spark, trained):
    texts = [r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect() if r["text"]]
    texts = [t for t in texts if pii.base_spans(t)]
    decoded = PiiFinder().decode(trained, texts)
    hits = [span in got for t, got in zip(texts, decoded, strict=True) for span in brute_force(t)]
    assert np.mean(hits) > 0.9


def test_the_network_adds_other_spellings(trained):
    text = "thon er (988) 555-2486 the onre " + "anter ed " * 30 + "bosbt.42 (at) mail8.example.com inthe 42[.]144[.]35[.]254 er"
    got = PiiFinder().decode(trained, [text])[0]
    assert [text[a:b] for a, b, _ in got] == ["(988) 555-2486", "bosbt.42 (at) mail8.example.com", "42[.]144[.]35[.]254"]


def test_spelled_out_addresses_without_digits(docs_of, trained, monkeypatch):
    texts = [
        "thon er the onre jane.doe (at) example.com inthe er",
        "write to jane.doe[at]example[dot]com please",
        "plain words " * 40 + "jane.doe (at) example.com" + " anter ed" * 30,
    ]
    want = ["jane.doe (at) example.com", "jane.doe[at]example[dot]com", "jane.doe (at) example.com"]
    got = PiiFinder().decode(trained, texts)
    assert [[t[a:b] for a, b, _ in g] for t, g in zip(texts, got, strict=True)] == [[w] for w in want]
    monkeypatch.setattr(PiiFinder, "fit", lambda self, docs: trained)
    docs = docs_of(list(enumerate(texts)))
    assert [r["n_added"] for r in PiiFinder().report(docs).collect()] == [1, 1, 1]
    redacted = [r["text"] for r in PiiFinder().redact(docs).collect()]
    assert redacted == [t.replace(w, "<email>") for t, w in zip(texts, want, strict=True)]


def test_every_form_holds_a_trigger():
    assert pii.well_formed("mary at example dot org", "email")
    for text in ("mary at example dot org", "a\u2003at\u00a0b.co", "a\x1cat\x1fb.co", "a(at)b.co", "é a[at]b.co", "at at at.at", "a@b.co", "1.2.3.4"):
        form = any(pattern.search(text) for pattern in pii._ADDED.values())
        assert form and len(pii.triggers(np.frombuffer(text.encode(), np.uint8)))
        assert re.search("[0-9@]", text) or pii._AT_WORD.search(text)
    for text in ("", "a", "at", " at", "plain chat atlas", "that. at"):
        assert not len(pii.triggers(np.frombuffer(text.encode(), np.uint8)))


def test_windows_without_digits_add_nothing(trained):
    finder = PiiFinder()
    texts = ["plain words of no kind " * 50, "", "é", "1", "ab 12 " + "x" * 500 + " 3"]
    one_by_one = [finder.decode(trained, [t])[0] for t in texts]
    assert finder.decode(trained, texts) == one_by_one
    assert one_by_one[0] == []


def test_report(spark, docs_of, trained, monkeypatch):
    monkeypatch.setattr(PiiFinder, "fit", lambda self, docs: trained)
    rows = [(1, None), (2, ""), (None, "mail a@b.co"), (3, "é 1.2.3.4 +1 (988) 555-2485"), (3, "call (988) 555-2486"), (4, "9" * 50_000)]
    got = PiiFinder().report(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got, strict=True):
        base = brute_force(text or "")
        assert r["doc_id"] == doc_id and r["base_sha256"] == pii.base_digest(text)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in range(4)]
        assert set(filter(None, pii.listed(base).split(","))) <= set(r["spans"].split(","))
    assert got[4]["spans"] == "phone:5:19" and got[4]["n_added"] == 1
    assert PiiFinder().report(docs_of([])).count() == 0


def test_redact(spark, docs_of, trained, monkeypatch):
    monkeypatch.setattr(PiiFinder, "fit", lambda self, docs: trained)
    docs = docs_of([(1, "é a@b.co, 1.2.3.4!"), (2, None), (3, "  plain ")])
    out = PiiFinder().redact(docs)
    assert out.schema == docs.schema
    assert [r["text"] for r in out.collect()] == ["é <email>, <ip>!", None, "  plain "]


def test_nothing_to_learn(docs_of):
    assert PiiFinder().fit(docs_of([(1, "no spans at all")])) is None
    assert PiiFinder().report(docs_of([(1, "no spans 12")])).first()["spans"] == ""


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in bilstm_crf.initial(7, 5, 3, 4, 1).items()}
    symbols, tags = rng.integers(0, 7, (6, 3)), rng.integers(0, 5, (6, 3))
    lengths = np.array([6, 4, 1])
    loss, d = bilstm_crf.gradient(p, symbols, lengths, tags)
    for name in p:
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-3
        up = bilstm_crf.gradient(moved, symbols, lengths, tags)[0]
        moved[name][at] -= 2e-3
        down = bilstm_crf.gradient(moved, symbols, lengths, tags)[0]
        assert abs((up - down) / 2e-3 - d[name][at]) < 2e-2, name


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(2)
    e, transition = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3))
    got = bilstm_crf.viterbi(e, transition, np.array([4, 3]))
    for j, n in enumerate((4, 3)):
        best = max(
            itertools.product(range(3), repeat=n),
            key=lambda p, j=j, n=n: sum(e[t, j, p[t]] for t in range(n)) + sum(transition[p[t], p[t + 1]] for t in range(n - 1)),
        )
        assert tuple(got[:n, j]) == best


def test_long_sequences_are_decoded_like_short_ones(monkeypatch):
    rng = np.random.default_rng(4)
    transition = rng.normal(size=(TAGS_HERE, TAGS_HERE)).astype(np.float32)
    for n in (1, 7, 8, 9, 100, 515):
        e = rng.normal(size=(n, TAGS_HERE)).astype(np.float32)
        want = bilstm_crf.viterbi(e[:, None], transition, np.array([n]))[:, 0]
        for segment in (1, 8, 512):
            monkeypatch.setattr(bilstm_crf, "_SEGMENT", segment)
            assert bilstm_crf.viterbi_long(e, transition).tolist() == want.tolist()


def test_long_stretches_take_linear_time(trained):
    finder = PiiFinder()
    for text in ("9" * 1_000_000, "1 2 " * 250_000):
        start = time.time()
        finder.decode(trained, [text])
        assert time.time() - start < 120


def test_spans_beyond_the_reach_are_found_whole(trained):
    address = "a" * 150 + "." + "b" * 150 + " (at) " + "mail." * 40 + "example.com"
    text = "thon er the onre " * 30 + address + " inthe er" * 30
    near, every = (PiiFinder(reach=r).decode(trained, [text])[0] for r in (160, 10_000))
    assert near == every


def test_rare_kinds_are_learned(docs_of):
    rows = [(k, f"call +1 (988) 555-{k:04d} now, number {k}") for k in range(9_999)]
    rows += [(20_000 + k, "no such thing") for k in range(3_000)] + [(30_000, "mail joe.doe@mail.example.com to")]
    seen = []

    class Watched(PiiFinder):
        def _train(self, labelled, plain):
            seen.append((labelled, plain))

    Watched().fit(docs_of([*rows, *rows[:500]]))
    kinds = [r["kind"] for r in seen[0][0]]
    assert kinds.count(0) == 1 and kinds.count(3) == 375 and len(seen[0][1]) <= 750
    assert len({r["context"] for r in seen[0][0]}) == len(seen[0][0])

import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clickloom.llm.pieces_sampling import PieceSampler, Vocabulary, default_model
from clickloom.llm.tables import read
from clickloom.llm.token_files import RunEncoder, TokenFiles, default_tokenizer
from clickloom.llm.words import PIECE, buffers

ODD = ["", "a", " ", "   ", "\n", "a \n b", "Hello  world\n\tÉté ▁x 日本語 \U0001f600", "it's <|endoftext|> 'll", " lead trail ", "\0 ", "x" * 3000, "×÷ ß", "a\n\nb", "12ab!!c"]


# ---- token files


def test_runs_give_the_tokenizer_s_ids():
    import random

    own, rng = RunEncoder(default_tokenizer()), random.Random(1)
    parts = ["a", "The", "é", "ß", "'s", "'", "!!", "1", "23", " ", "  ", "\n", "\t", "<|endoftext|>", "日本", "\xa0", ".", "×", "x"]
    simple = ["ab", "The", "é", "!", " ", " ", "\n", "9", ".,"]
    for _ in range(150):
        texts = ["".join(rng.choice(p) for _ in range(rng.randint(0, 20))) for p in (parts, simple) * 10] + ODD
        ids, bounds = own.encode(*buffers(pa.array(texts)))
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == own.whole(t).tolist(), t


def test_new_runs_led_by_blanks_go_to_the_tokenizer_as_one_text():
    own = RunEncoder(default_tokenizer())
    plain, given = own.tokenizer, []

    class Counted:
        def encode(self, text, **how):
            given.append(text)
            return plain.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **how)

    own.tokenizer = Counted()
    texts = [f"a {k} w{'xyzéß'[k % 5] * (k // 5)} {'+-=#'[k % 4] * (k // 4 + 1)}" for k in range(400)]
    for _ in range(2):
        ids, bounds = own.encode(*buffers(pa.array(texts)))
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids
    assert len(given) == 2  # all that blanks lead, and the first "a" of every text


@pytest.mark.parametrize("kept", [1, 40, 1_000])
def test_runs_that_share_slots_and_a_store_that_is_emptied_keep_the_ids(monkeypatch, kept):
    import random

    from clickloom.llm import token_files

    plain, rng = token_files.run_hashes, random.Random(2)
    monkeypatch.setattr(token_files, "run_hashes", lambda *a: plain(*a) << np.uint64(16) | np.uint64((1 << 16) - 1))
    monkeypatch.setattr(token_files, "KEPT_RUNS", kept)
    monkeypatch.setattr(token_files, "JOINED_RUNS", 7)
    own = RunEncoder(default_tokenizer())
    for _ in range(30):
        texts = [" ".join(rng.choice("ab1+é") * rng.randint(1, 9) for _ in range(rng.randint(0, 30))) for _ in range(9)]
        ids, bounds = own.encode(*buffers(pa.array(texts)))
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == own.whole(t).tolist(), t


def test_more_runs_than_slots_make_more_slots():
    own = RunEncoder(default_tokenizer())
    texts = [" ".join(f"x{k}" for k in range(a, a + 1_000)) for a in range(0, 40_000, 1_000)]
    for _ in range(2):
        ids, bounds = own.encode(*buffers(pa.array(texts)))
        for k in (0, 20, 39):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == own.whole(texts[k]).tolist()
    assert 2 * own.entries <= len(own.slots)


def test_long_batches_are_encoded_in_small_pieces_with_a_bounded_store(docs_of, tmp_path, monkeypatch):
    from clickloom.llm import token_files

    seen, plain = [], token_files.pieces
    monkeypatch.setattr(token_files, "pieces", lambda texts, limit=PIECE: seen.append(limit) or plain(texts, limit))
    caught = []
    monkeypatch.setattr(token_files, "tidy", lambda run: caught.append(run) or (lambda batches: iter(())))
    TokenFiles().write(docs_of([(1, "a")]), f"{tmp_path}/files")
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    texts = pa.array([f"text {i} " + "word " * 2_000 + "end" for i in range(150)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(150), pa.int64()), texts], ["doc_id", "text"])
    out = list(caught[0](iter([batch])))
    assert seen == [PIECE] and max(r.num_rows for r in out) <= PIECE // 10_000
    assert sum(r.num_rows for r in out) == 150
    assert token_files.KEPT_RUNS <= 1_000_000


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_come_back(spark, docs_of, tmp_path, encoding):
    rows = [(None, "no id"), (7, None), (-3, "first"), *[(10 + k, t) for k, t in enumerate(ODD)], (7, "again"), (7, "again")]
    files = TokenFiles(encoding=encoding, page_rows=3, row_group_bytes=1 << 12)
    path = str(tmp_path / "t")
    files.write(docs_of(rows).repartition(3), path)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = files.digests(spark, path).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert at == start
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert {tuple(r)[:2] for r in files.metadata(spark, path).collect()} == {(r["doc_id"], r["start"]) for r in got}
    assert sorted(r["doc_id"] for r in files.tokens(spark, path, 7, 11).collect()) == [7, 7, 7, 10, 11]
    plan = files.tokens(spark, path, 7, 11)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,7)" in plan and "ReadSchema: struct<doc_id:bigint,ids:array<int>>" in plan


def test_no_documents(docs_of):
    assert TokenFiles().round_trip(docs_of([])).count() == 0


def test_registered_query_starts_follow_ids(spark):
    from clickloom.llm.queries import QUERIES

    rows = sorted(QUERIES["op3_token_files"](spark, "/root/testdata/sf0.001").collect())
    texts = {r["doc_id"]: r["text"] for r in read(spark, "/root/testdata/sf0.001", "documents").collect()}
    tokenizer, start = Tokenizer.from_file(default_tokenizer()), 0
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# ---- sampled pieces


@pytest.fixture(scope="module")
def vocabulary() -> Vocabulary:
    return PieceSampler().vocabulary()


def encode(vocabulary, texts, keys):
    data, offsets = buffers(pa.array(texts))
    ids, firsts = vocabulary.encode(data, offsets, np.array(keys, np.int64))
    raw, bounds = vocabulary.decode(ids, firsts)
    out = [ids[firsts[k] : firsts[k + 1]].tolist() for k in range(len(texts))]
    return out, [raw[bounds[k] : bounds[k + 1]].tobytes().decode() for k in range(len(texts))]


def test_round_trip(vocabulary):
    ids, back = encode(vocabulary, ODD, range(len(ODD)))
    assert back == ODD
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for text, i in zip(ODD, ids, strict=True):
        if "▁" not in text:
            assert sp.decode(i) == text


def test_same_key_same_segmentation(vocabulary):
    text = "thnttiereoring onathedble ereningsh " * 20
    alone = encode(vocabulary, [text], [5])[0][0]
    among, _ = encode(vocabulary, ["other", text, "", text], [1, 5, 2, 6])
    assert among[1] == alone != among[3]


def test_samples_follow_the_lattice(vocabulary):
    unit = b" abcde"
    piece = {b: i for i, b in enumerate(vocabulary.bytes) if i > 258}
    chance: dict[tuple, float] = {}

    def walk(at, ids, log):
        if at == len(unit):
            chance[tuple(ids)] = np.exp(log)
        for end in range(at + 1, len(unit) + 1):
            i = piece.get(unit[at:end])
            if i is not None:
                walk(end, [*ids, i], log + vocabulary.weight[i])

    walk(0, [], 0.0)
    total, n = sum(chance.values()), 40_000
    ids, _ = encode(vocabulary, ["abcde"] * n, range(n))
    drawn = {k: 0 for k in chance}
    for i in ids:
        drawn[tuple(i)] += 1
    assert max(abs(drawn[k] / n - c / total) for k, c in chance.items()) < 0.01


def test_long_units_like_short_ones(vocabulary, monkeypatch):
    from clickloom.llm import pieces_sampling

    texts = ["abcabcabc" * 40, "é" * 200, "日" * 100]
    before = encode(vocabulary, texts, [1, 2, 3])
    monkeypatch.setattr(pieces_sampling, "SHORT", 4)
    after = encode(vocabulary, texts, [1, 2, 3])
    assert before[1] == after[1] == texts
    assert np.mean([len(a) for a in before[0]]) == pytest.approx(np.mean([len(a) for a in after[0]]), rel=0.05)


def test_encode_and_decode_frames(docs_of):
    rows = [(None, "no id"), (1, None), *[(10 + k, t) for k, t in enumerate(ODD)], (10, "twice"), (10, "twice")]
    sampler = PieceSampler()
    encoded = sampler.encode(docs_of(rows))
    got = encoded.collect()
    assert [(r["doc_id"], r["n_tokens"] == len(r["ids"])) for r in got] == [(i, True) for i, _ in rows]
    assert all(r["lossless"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    assert all(r["text_crc32"] == zlib.crc32((t or "").encode()) for r, (_, t) in zip(got, rows, strict=True))
    assert got[-1]["ids"] == got[-2]["ids"] and got[1]["ids"] == []
    assert [r["text"] for r in sampler.decode(encoded).collect()] == [t or "" for _, t in rows]
    assert [r["ids"] for r in sampler.encode(docs_of(rows).repartition(5)).where("doc_id = 16").collect()] == [
        r["ids"] for r in got if r["doc_id"] == 16
    ]
    assert sampler.encode(docs_of([])).count() == 0

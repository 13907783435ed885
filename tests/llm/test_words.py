import numpy as np
import pyarrow as pa

from clickloom.llm.words import ALNUM, FOLD, NOT_BLANK, hash_words, pieces, shingle_sets

TEXTS = ["", None, "One two  three", "one", "\tÉté, été\n", "x" * 5000, "ONE two three"]


def hashes(texts, limit, inside=NOT_BLANK):
    out = []
    for first, end, data, offsets in pieces(pa.array(texts), limit):
        words, firsts = hash_words(data, offsets, inside, FOLD)
        out += [words[firsts[k] : firsts[k + 1]].tolist() for k in range(end - first)]
    return out


def test_words_do_not_depend_on_the_cut():
    assert hashes(TEXTS, 1) == hashes(TEXTS, 1 << 20)
    assert [len(h) for h in hashes(TEXTS, 16)] == [0, 0, 3, 1, 2, 1, 3]
    assert hashes(TEXTS, 16)[2] == hashes(TEXTS, 16)[6]


def test_words_of_letters_and_digits():
    assert [len(h) for h in hashes(["a-b, c3", "...", "ß"], 100, ALNUM)] == [3, 0, 1]


def test_slices_keep_their_texts():
    whole = pa.array(["ab cd", "e", None, "f g h"])
    assert hashes(whole.slice(1, 3).to_pylist(), 9) == hashes(whole, 9)[1:]


def test_shingles():
    data = pa.array(["a b c d e", "a b", "", "a a a a a a"])
    (_, _, raw, offsets), = pieces(data)
    sets = list(shingle_sets(*hash_words(raw, offsets, NOT_BLANK), 4))
    assert [len(s) for s in sets] == [2, 1, 0, 1]
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)

"""Token files: exact round trips, the tokenizers library as the measure."""
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ionweave.llm import idcoder as C
from ionweave.llm.tokens import WordIds, default_tokenizer, word_ids
from tests.llm.common import EDGE, edge, none, saved


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(1, 70))
def test_frame_round_trip(ids, block):
    ids = np.array(ids * 2, "<u4")
    frame = C.encode_frame([4, None], [len(ids) // 2, len(ids) - len(ids) // 2], ids, C.CoderParams(block=block))
    out = list(C.decode_frame(frame))
    assert [d for d, _ in out] == [4, None] and np.array_equal(np.concatenate([x for _, x in out]), ids)


def test_predictions_pay():
    ids = np.tile(np.random.default_rng(0).integers(0, 1 << 27, 50), 40).astype("<u4")
    assert len(C.encode_frame([1], [len(ids)], ids, C.CoderParams())) < len(ids)     # below eight bits an id


def test_damage_is_noticed():
    ids = np.random.default_rng(1).integers(0, 5000, 3000).astype("<u4")
    frame = bytearray(C.encode_frame([1], [3000], ids, C.CoderParams(block=500)))
    frame[-40] ^= 255
    with pytest.raises(ValueError):
        list(C.decode_frame(bytes(frame)))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aB '.,0\n\t́éΣ"))), max_size=60))
def test_words_equal_the_library(text):
    tok = Tokenizer.from_file(default_tokenizer())
    assert np.frombuffer(next(iter(word_ids(default_tokenizer()).of([text]))), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_parts_equal_the_library():
    tok, words = Tokenizer.from_file(default_tokenizer()), word_ids(default_tokenizer())
    odd = ["İ,\nİ.", "“hello”, “hello” “hello”.", "don't, İx'll", "Ça, ÇA\tß²ª", "x\u0338= =\u0338,", "中，文, 中", "", " ", "<|endoftext|> a,", None, "a"]
    for texts in (odd, odd[::-1], *[[t] for t in odd]):
        assert [np.frombuffer(x, "<u4").tolist() for x in words.of(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_word_is_kept_once_whatever_stands_beside_it():
    words = WordIds(default_tokenizer())
    some = [f"{a}{b}ing" for a in ("bar", "tol", "mun") for b in ("qua", "sel", "dro")]
    list(words.of([" ".join(a + w + b for w in some for a in ("", "(", "[") for b in ("", ",", ".", ";", ")", "]"))]))
    assert len(words.young) <= len(some) + 9


def test_query_on_edges(spark, tmp_path):
    from ionweave.llm.idcoder import op1_token_files

    rows = op1_token_files(spark, saved(spark, tmp_path, documents=edge(spark))).collect()
    tok = Tokenizer.from_file(default_tokenizer())
    want, at = [], 0
    for d, t, _ in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_ids_are_read_back(spark, tmp_path):
    C.write_ids(edge(spark), f"{tmp_path}/ids")
    got = {r.doc_id: r.ids for r in C.read_ids(spark, f"{tmp_path}/ids").collect()}
    assert got[2] == [2] and got[11][0] == 49407 and len(got) == len({r[0] for r in EDGE})


def test_no_documents(spark, tmp_path):
    assert C.op1_token_files(spark, saved(spark, tmp_path, documents=none(spark))).count() == 0

import hashlib
import random

import pytest

from framewright.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(encoded):
    import numpy as np

    return np.frombuffer(encoded, dtype="<u4").tolist()


HARD = ["", " ", "  two  spaces  ", "▁ mark ▁▁", "<s> </s> <unk> <0x41>", "a\x00b\r\n\tc", "😀 ünïcode 中文字符 𝔘𝔫𝔦", "ab" * 3000, "a" * 5000, " " * 300, "xyz▁", " ﻿​", "é ﬁ", "1234567890" * 20]


def test_hard_texts(library):
    t = pieces.table(MODEL)
    for text in HARD:
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids_of(t.encode(text)) == want, text[:40]
        assert t.decode(t.encode(text)) == library.decode(want), text[:40]


def test_random_texts(library):
    t, rng = pieces.table(MODEL), random.Random(7)
    letters = "abcdeinorst  \n▁éß中😀0-"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids_of(t.encode(text)) == want, repr(text)
        assert t.decode(t.encode(text)) == library.decode(want), repr(text)


def test_documents(spark, sf_dir, texts, library):
    import numpy as np

    got = pieces.op8_pieces(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_memory_is_bounded_without_change(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 5)
    t = pieces.PrefixTable(open(MODEL, "rb").read())
    text = "many different words appear here so that the memory overflows often"
    assert ids_of(t.encode(text)) == library.encode(text, add_bos=True, add_eos=True) and len(t.words) <= 5


def test_odd_rows(odd, empty):
    out = pieces.encode_documents(odd, MODEL)
    assert out.count() == odd.count() and pieces.encode_documents(empty, MODEL).count() == 0
    assert [ids_of(r["ids"]) for r in out.where("doc_id = 1").collect()] == [[1, 2]]

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import byte_bpe
from corpusloom.llm.queries import tokenizer_path

PATH = tokenizer_path()
ODD = ["", "  a  b\n\n c", "a<|endoftext|>b <|endoftext|>", "don't we'll I'M", "\x1c\x1d x\x1e\x1f\x85y\xa0z q　 ", "日本語 テスト 😀👍🏽", "é ١٢٣ Ⅷ ½", "x" * 1000, "ab" * 3000, " " * 700, "​﻿\x00\x7f", "a\r\nb\t\tc "]


@pytest.fixture(scope="module")
def both():
    return byte_bpe.ByteBpe(PATH), Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ODD)
def test_same_ids_and_text_as_the_library(both, text):
    own, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_random_texts_and_ids(both):
    own, library = both
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("ab 'st1\n\té漢😀.-  ") for _ in range(r.randint(0, 80)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_array_and_heap_agree(both):
    own, _ = both
    r = random.Random(2)
    for _ in range(200):
        parts = [own.byte_ids[r.choice(b"the and ing ")] for _ in range(r.randint(1, 120))]
        assert own._by_array(list(parts)) == own._by_heap(list(parts))


def test_nulls_empty_clashes_and_repeats(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "hello hello", 7), (3, "hello hello", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = byte_bpe.bpe_decode(byte_bpe.bpe_encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["", "", "hello hello", "hello hello"]
    assert out[0].ids == [] and out[2].ids == out[3].ids and len(out[2].ids) > 0
    assert byte_bpe.bpe_encode(df.limit(0), PATH).count() == 0


def test_encode_and_decode_in_one_pass(spark):
    df = spark.createDataFrame([(1, "héllo  wörld"), (2, None)], "doc_id long, text string").selectExpr("*", "5 AS decoded")
    rows = {r.doc_id: r for r in byte_bpe.bpe_encode(df, PATH, decoded="decoded").collect()}
    assert rows[1].decoded == "héllo  wörld" and rows[2].decoded == "" and rows[2].ids == [] and rows[1].ids

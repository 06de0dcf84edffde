import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm.token_files import Dac, PieceEncoder, TokenFiles, dac_encode, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODE = PieceEncoder(PATH)


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=30, deadline=None)
def test_dac_round_trip_and_random_access(ids):
    dac = Dac(dac_encode(np.array(ids, np.uint32)))
    assert dac.decode().tolist() == ids
    assert [dac[i] for i in range(0, len(ids), 7)] == ids[::7]


@given(st.text(alphabet="ab  \n\t  \x1c\x85é'1.,s", max_size=60) | st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_equal_whole_texts(text):
    assert ENCODE(text).tolist() == plain(text)


_PARTS = st.sampled_from(["<|endoftext|>", " ", "\n", "  ", "the", " word,", "x.y", "'s", "né!", "12", "\u3000", "\t"])


@given(st.lists(st.none() | st.lists(_PARTS, max_size=12).map("".join), max_size=12))
@settings(max_examples=200, deadline=None)
def test_columns_equal_whole_texts(texts):
    ids, at = ENCODE.column(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain(t or "") for t in texts]


def test_special_token_is_that_of_the_plain_tokenizer():
    assert 50256 in plain("a <|endoftext|> b") and ENCODE("a <|endoftext|> b").tolist() == plain("a <|endoftext|> b")


def test_memo_that_overflows():
    small = PieceEncoder(PATH)
    small.KEEP = 5
    for text in ("a b c d, e. f g\nh!! i j", "a b " + "x" * 99 + ", z", "q w e r t y u i o p.", "a b"):
        assert small(text).tolist() == plain(text)
        assert len(small.parts) <= 5


def test_files_against_brute_force(spark, tmp_path):
    texts = {3: "one two  three\n four ", 1: None, 2: "", 9: "x" * 500, 4: "a b " * 900, 7: "<|endoftext|> été", None: "null id"}
    docs = spark.createDataFrame([(k, v, "q") for k, v in texts.items()], "doc_id long, text string, payload string")
    write_token_files(docs, path := f"file://{tmp_path}/t", PATH, segment=100)
    start, want = 0, {}
    for k in sorted(texts, key=lambda k: -1 if k is None else k):
        ids = [*plain(texts[k] or ""), 0]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r[1:]) for r in read_token_files(spark, path).collect()} == want
    files = TokenFiles(spark, path)
    assert len(files) == start
    every = [x for k in sorted(texts, key=lambda k: -1 if k is None else k) for x in [*plain(texts[k] or ""), 0]]
    assert [files[i] for i in range(0, start, 211)] == every[::211]


def test_empty_table(spark, tmp_path):
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path := f"file://{tmp_path}/e", PATH)
    assert read_token_files(spark, path).count() == 0 and len(TokenFiles(spark, path)) == 0

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnesis.llm import queries
from mnesis.llm.tokens import count_tokens, pieces

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_whole_table_equals_the_library(spark):
    got = queries.op8_tokens(spark, SF).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    t = Tokenizer.from_file(PATH)
    want = [len(t.encode(x, add_special_tokens=False)) for x in docs.text]
    assert got.n_tokens.tolist() == want
    assert got.n_bytes.tolist() == [len(x.encode()) for x in docs.text]
    assert got.over_limit.tolist() == [n > 512 for n in want]


ODD = ["", "  a  b   c ", "don't  stop\n\n now 12 34 x", "<|endoftext|> a <|endoftext|>b c", "é ü ß a　b 漢字 漢 字", "a" * 500, "1 2 3 _ _ a _ b", "x\x1c y \x1f z", "🙂 a 🙂 b"]


@pytest.mark.parametrize("size", [1, 3, 7])
def test_cut_texts_have_the_same_tokens(size):
    t = Tokenizer.from_file(PATH)
    for text in [*ODD, " ".join(ODD) * 3]:
        parts = pieces(text, size)
        assert "".join(parts) == text
        assert sum((t.encode(p, add_special_tokens=False).ids for p in parts), []) == t.encode(text, add_special_tokens=False).ids


def test_odd_rows_and_other_files(spark, documents):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "hello world"), (3, "hello world"), (4, "word and " * 60_000)]
    got = count_tokens(documents(rows), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(0, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 11, 2, False), (3, 11, 2, False), (4, 540_000, 120_001, True)]
    piece = count_tokens(documents(rows), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.n_tokens for r in piece}[2] == 0
    assert count_tokens(documents([]), PATH).collect() == []

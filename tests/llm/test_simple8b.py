import zlib
from array import array

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matricula.llm import queries, simple8b
from matricula.llm.tokens import default_path, tokenizer
from tests.conftest import SF


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=700))
def test_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    words, blocks = simple8b.encode(values)
    assert simple8b.decode(words, blocks, len(values)).tolist() == values.tolist()


def test_runs_of_zeros_are_small():
    words, _ = simple8b.encode(np.zeros(2560, dtype=np.uint64))
    assert len(words) == 30


def expected(docs):
    t, at, out = Tokenizer.from_file(default_path()), 0, []
    for doc_id, text in sorted(docs, key=lambda x: (x[0], x[1] or "")):
        ids = array("I", [*t.encode(text or "", add_special_tokens=False).ids, 0]).tobytes()
        out.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_added_tokens_are_the_librarys():
    t = Tokenizer.from_file(default_path())
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny.", "<|endoftext|", "one two three"):
        assert np.frombuffer(tokenizer(default_path()).encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op6_simple8b_ids(spark, SF).collect())) == expected(docs)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    simple8b.write_ids(odd_docs, f"file://{tmp_path}/a", chunk_ids=5000)
    assert sorted(map(tuple, simple8b.read_ids(spark, f"file://{tmp_path}/a").collect())) == expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    simple8b.write_ids(no_docs, f"file://{tmp_path}/b")
    assert simple8b.read_ids(spark, f"file://{tmp_path}/b").collect() == []

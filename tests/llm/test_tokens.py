import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from matricula.llm.tokens import PieceTokenizer, default_path

WORDS = ["a", "The", "don't", "'s", "x'll", "''", "éa", "ß", "Жук", "Ǆa", "²", "中文", "…", "😀", "­", "﻿", "\x00", "&&&", "ok!!", "3a", "12", ",", "..", "\n", "\nno", " ", "\t", "　", "<|endoftext|>"]


class Spy:
    """Counts the characters that pass through a tokenizer."""

    def __init__(self, inner):
        self.inner, self.seen = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.seen += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


def same(tokenizer, texts):
    library = Tokenizer.from_file(default_path())
    want = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode(pa.array(texts, pa.string()))] == want


@pytest.mark.parametrize("most", [20, 100_000])
def test_ids_are_the_librarys_for_any_mix_of_signs(most):
    rng, tokenizer = random.Random(4), PieceTokenizer(default_path(), max_entries=most)
    for _ in range(15):
        same(tokenizer, [None, *("".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randrange(20))) for _ in range(100))])
    texts = pa.array(["cut", "one two!", "three\nfour, é.", None, "five"])
    assert tokenizer.encode(texts.slice(1)) == tokenizer.encode(texts.slice(1).to_pylist())


def test_words_are_known_again_beside_other_signs():
    """"word!!" was a piece of its own, and each such piece went through the pattern."""
    tokenizer = PieceTokenizer(default_path())
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    tokenizer.encode(["start " + " ".join(words)])
    spy = tokenizer._tokenizer = Spy(tokenizer._tokenizer)
    same(tokenizer, ["start " + " ".join(x + "!" * k for x in words) for k in range(1, 6)])
    assert spy.seen < 100


def test_a_full_memo_learns_what_has_become_frequent():
    """what came first stayed, and all else was encoded in each batch anew."""
    tokenizer = PieceTokenizer(default_path(), max_entries=100)
    tokenizer.encode([" ".join(f"früh{i}x" for i in range(300))])
    late = [" ".join(x * 3 for x in "abcdefghij")] * 50
    tokenizer.encode(late)
    spies = [Spy(tokenizer._tokenizer), Spy(getattr(tokenizer, "_units", None))]
    tokenizer._tokenizer, tokenizer._units = spies
    same(tokenizer, late)
    assert sum(x.seen for x in spies) == 0


def test_another_pattern_is_encoded_whole(tmp_path):
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(default_path())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    text = "word, other\nwords 12ab."
    assert np.frombuffer(PieceTokenizer(str(tmp_path / "other.json")).encode([text])[0], "<u4").tolist() == other.encode(text, add_special_tokens=False).ids

import os
import random
import subprocess
import sys
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from themeloom.llm import bpe

PATH = bpe.vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    theirs = Tokenizer.from_file(PATH)
    theirs.no_truncation()
    theirs.no_padding()
    return bpe.Encoder(bpe.read_vocabulary(PATH)), theirs


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choices("abcdet  \n.,'é日1-A", k=n)) for n in range(0, 400, 3)]
    return [*made, "", " ", "the the theory", "a" * 5000, "x y " * 3000, "<|endoftext|> <unk>"]


def test_same_as_the_library(pair):
    ours, theirs = pair
    for text in texts():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert list(ours.encode(text)) == ids, text[:80]
        found = ours.decode(ours.encode(text))
        assert found == theirs.decode(ids, skip_special_tokens=False), text[:80]


def mixed(seed, n=1000):
    """Texts of every white space, marks that join what is before them, and added tokens."""
    rng = random.Random(seed)
    white = [*bpe.WHITE_SPACE, " ", "\x1c", "\x1f", "\u200b", "\ufeff", "\u180e"]
    some = ["é", "e\u0301", "\u0301", "日7", "7", "ab", "İ", "ß", "'s", "--", "ﬁ", "क्", "<|endoftext|>"]
    return ["".join(rng.choice(rng.choice([white, some, some])) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def differing(seed):
    theirs = Tokenizer.from_file(PATH)
    ours = bpe.Encoder(bpe.read_vocabulary(PATH))
    texts = mixed(seed) + ["un é7\xa0b7 c \xa0 日7 d", "é\tb \t ü", "é\tb", "\t", "ü", "é\tb"]
    wanted = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    twice = [list(ours.encode_many(texts)) for _ in range(2)]
    return sum(list(np.frombuffer(a, "<u4")) != b for own in twice for a, b in zip(own, wanted))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mixed_white_space_under_any_hash_seed(seed):
    code = f"from tests.llm.test_bpe import differing; print(differing({seed}))"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONHASHSEED": str(seed), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=root, capture_output=True, text=True)
    assert done.stdout.split()[-1:] == ["0"], done.stderr


def test_white_space_of_the_vocabulary(pair):
    normalise = pair[0].tokenizer.normalizer.normalize_str
    chars = [chr(code) for code in range(0x110000) if unicodedata.category(chr(code))[0] in "ZC"]
    found = {c for c in chars if not "\ud800" <= c <= "\udfff" and " " in normalise(f"a{c}b")}
    assert found == {*bpe.WHITE_SPACE, " "}


def test_null_is_empty(pair):
    assert len(pair[0].encode(None)) == 0


def test_rows_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "a b", "y"), (3, "a b", "y"), (None, "c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = bpe.digests(docs, PATH).collect()
    assert sorted(r.n_tokens for r in found)[:2] == [0, 0] and len(found) == 5
    assert bpe.digests(docs.limit(0), PATH).count() == 0

from __future__ import annotations

import random
from pathlib import Path

import pytest

from millrace.llm.tokenization import VOCABULARY, ForcedBoundaryEncoder, decode_ids, encode_texts

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return ForcedBoundaryEncoder()


@pytest.fixture(scope="module")
def other():
    """Another library's encoder of the same vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


ALPHABET = "ab'sretlvdmLZ 0123 \t\n\r\x0b\x85\xa0　 àäßéж日本語、。🎉👍\x1c\x1f=_-#{}()[]'´́‍퟿�𝒳"


def test_against_another_library(encoder, other):
    rng = random.Random(1)
    for k in range(8000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 200 if k % 5 == 0 else 25)))
        assert encoder.encode(text) == other(text), repr(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n\n", "<|endoftext|>", "it's we'll they've I'm he'd", "!'s", "x'sy", "a  b   c\t\td \r\n e", "à b à\n", "ﬁ　ﬁ", "'" * 200, "=" * 500, "日本語のテキスト" * 50, "a" * 3000, "qjxzQJXZ09" * 300, "🎉" * 200, " " * 500 + "x"],
)
def test_odd_texts(encoder, other, text):
    assert encoder.encode(text) == other(text)


def test_cuts_are_many_and_join_to_the_text(encoder):
    text = "".join(random.Random(3).choices("0123456789abcdefqjxzQJXZ+/", k=20_000))
    parts = encoder._cut(text)
    assert "".join(parts) == text and len(parts) > 2000


def test_cuts_around_other_white_space(encoder, other):
    rng = random.Random(5)
    for k in range(300):
        text = "".join(rng.choice(["qjxzQJXZ09", "あ", "'", "\xa0", "\u3000", "\u2003x", "Zß", "=#"]) for _ in range(rng.randint(5, 60)))
        assert encoder.encode(text) == other(text), repr(text)
    text = "\xa0".join("".join(rng.choices("0123456789qjxzQJXZ+/", k=50)) for _ in range(400))
    parts = encoder._cut(text)
    assert "".join(parts) == text and len(parts) > 2000 and max(map(len, parts)) < 60


def test_long_texts_take_time_in_proportion(encoder):
    import time

    text, spent = "".join(random.Random(4).choices("0123456789qjxzQJXZ+/", k=2_000_000)), []
    for n in (200_000, 2_000_000):
        start = time.process_time()
        encoder.encode(text[:n])
        spent.append(time.process_time() - start)
    assert spent[1] < 40 * max(spent[0], 0.02)


def test_rows(spark, other):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (None, "don't  stop\n", "x"), (4, "word " * 200_000, "x")]
    df = spark.createDataFrame(rows, "id long, text string, ids string")
    got = encode_texts(df, "text", ["id"]).collect()
    assert [r.id for r in got] == [r[0] for r in rows]
    assert all(r.ids == other(x or "") for r, (_, x, _) in zip(got, rows))
    assert encode_texts(df, "text", ["id"]).schema["ids"].dataType.simpleString() == "array<int>"
    assert [r.n_tokens for r in encode_texts(df, "text", ["id"], count=True).collect()] == [len(r.ids) for r in got]
    assert encode_texts(df.where("false"), "text", ["id"]).count() == 0
    back = decode_ids(encode_texts(df, "text", ["id"]), "ids", ["id"]).collect()
    assert [r.text for r in back] == [x or "" for _, x, _ in rows]
    assert decode_ids(spark.createDataFrame([(1, None)], "id long, ids array<int>"), "ids", ["id"]).first().text is None

"""The tokenizer's shared front: the library's ids, from few calls of the library."""

import random

import numpy as np
import pytest

from tessera.llm import common


class Counted:
    """The library's model, which counts its calls."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, text):
        self.calls += 1
        return self.model.tokenize(text)


@pytest.fixture
def encoder():
    out = common.Encoder(common.vocabulary(), most=1000)
    out.model = Counted(out.model)
    return out


def want(encoder, texts):
    return [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def words(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdeéßñ", k=draw.randrange(4, 12))) for _ in range(n)]


def test_new_words_go_to_the_model_together(encoder):
    texts = [" ".join(w + draw for w in words(500, k) for draw in ("", "###")) for k in range(4)]
    got = encoder(texts)
    assert encoder.model.calls < 100  # of 2000 words, each seen for the first time
    assert got == want(encoder, texts)
    assert len(encoder.known) + len(encoder.older) <= 1000


def test_a_merge_over_a_words_end_is_undone(encoder):
    texts = [" ".join(words(300))]
    encoder.spaced[:] = False  # as if first tokens had been merged with the words before
    assert encoder(texts) == want(encoder, texts)
    assert encoder.model.calls > 250


def test_texts_of_a_call_do_not_touch(encoder):
    texts = ["a ", " b", "\n", "c", None, "", "d\n", "\ne", "f\xa0", " g", "h", ".", "\n", " ", "é", "!"]
    assert encoder(texts) == want(encoder, texts)


def test_any_text_has_the_librarys_ids(encoder):
    draw = random.Random(3)
    some = [" ", "  ", "\n", "\t", "a", "Bcd", "é", "×", "÷", "ß.", ".", ",", "'s", "'", "12", "\xa0", " ", "　", "日本", "—", "\x1c", "\x85", "!?", "_", "\r\n", "🙂", "é", "İ", "​", "%%", "x" * 70]
    texts = ["".join(draw.choices(some, k=draw.randrange(14))) for _ in range(3000)]
    assert [x for k in range(0, 3000, 100) for x in encoder(texts[k : k + 100])] == want(encoder, texts)

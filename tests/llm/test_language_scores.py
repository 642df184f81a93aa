"""The scorer against plain arithmetic, with languages of very unlike sizes."""

import math

import pytest

from cadenza.llm.language_id import SHARED, Model, _Memo, predict

ROWS = [("en", 0, "the", 900), ("en", 0, "cat", 90), ("tiny", 0, "zot", 2), ("en", 1, "t", 50), ("en", 1, "c", 50), ("tiny", 1, "z", 4), ("en", 2, "ca", 10), ("tiny", 2, "zo", 2), ("en", 1, "^", 40), ("tiny", 1, "^", 4)]
TOTALS = {("en", 0): 1000, ("tiny", 0): 20, ("en", 1): 140, ("tiny", 1): 10, ("en", 2): 20, ("tiny", 2): 5}


def log(size, gram):
    shares = [sum(n for x, s, g, n in ROWS if (x, s, g) == (lang, size, gram)) / TOTALS[lang, size] for lang in ("en", "tiny")]
    return [math.log((1 - SHARED) * x + SHARED * sum(shares) / 2) for x in shares]


def test_scores_are_those_of_the_formula():
    model = Model(["en", "tiny"], ROWS, TOTALS)
    assert model.word("the").tolist() == pytest.approx(log(0, "the"))
    # ^cao$: ^ by itself, ca as the longest known, nothing for o and $
    want = [a / 5 + b * 2 / 5 for a, b in zip(log(1, "^"), log(2, "ca"), strict=True)]
    assert model.word("cao").tolist() == pytest.approx(want)
    total = [2 * a + b for a, b in zip(log(0, "the"), log(0, "cat"), strict=True)]
    lang, score = predict(model, _Memo(model), "The the CAT 12")
    assert lang == "en" and score == pytest.approx(1 / (1 + math.exp(total[1] - total[0])))


def test_a_small_language_does_not_take_words_it_lacks():
    model = Model(["en", "tiny"], ROWS, TOTALS)
    assert all(model.word(w)[0] > model.word(w)[1] for w in ("the", "cat"))
    assert predict(model, _Memo(model), "cat")[0] == "en" and predict(model, _Memo(model), "zot")[0] == "tiny"


@pytest.mark.parametrize("text", [None, "", " 12 ", "½", "²", "Ⅷ", "_", "12½"])
def test_no_letters_no_language(text):
    model = Model(["en", "tiny"], ROWS, TOTALS)
    assert predict(model, _Memo(model), text) == ("und", 0.0)


def test_ties_go_to_the_first():
    model = Model(["a", "b"], [("a", 0, "x", 1), ("b", 0, "x", 1)], {("a", 0): 2, ("b", 0): 2})
    assert predict(model, _Memo(model), "x") == ("a", 0.5)

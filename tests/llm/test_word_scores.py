"""Label scores of many words at once equal those of each word alone."""

import random

import numpy as np

from dashframe.llm import language_id
from dashframe.llm.language_id import Model, bare, features


def model():
    rng = np.random.default_rng(3)
    return Model(["de", "en", "fr"], {"stone": (1,), "grün": (0, 2)}, rng.normal(size=(language_id.FEATURES, 3)),
                 np.zeros((3, 3)))


def words():
    rng = random.Random(4)
    made = ["".join(rng.choice("abcdeßéй東😀\0'-") for _ in range(rng.randint(1, 64))) for _ in range(400)]
    return list(dict.fromkeys(made + ["stone", "Stone,", "grün", "a", "ab", "abc", "İx", "...", "x" * 64, "42", "a\0", "a\0b"]))


def test_scores_equal_those_of_each_word():
    m, tokens = model(), words()
    for part in (tokens[:100], tokens, tokens[::-1], []):
        scores, is_word = m.emissions(part)
        assert scores.shape == (len(part), 3)
        for t, s, w in zip(part, scores, is_word):
            word = bare(t)
            want = m.weight[features(word, m.lexicons, 3)].sum(axis=0) if word else np.zeros(3)
            assert w == bool(word) and np.array_equal(s, want)


def test_a_full_memo_is_forgotten(monkeypatch):
    m, tokens = model(), words()
    want = model().emissions(tokens)[0]
    monkeypatch.setattr(language_id, "MEMO_WORDS", 50)
    got = np.concatenate([m.emissions(tokens[i:i + 40])[0] for i in range(0, len(tokens), 40)])
    assert np.array_equal(got, want) and len(m.memo) <= 50


def test_what_words_share_is_hashed_once(monkeypatch):
    rng = random.Random(5)
    tokens = list({"".join(rng.choice("abcd") for _ in range(12)) for _ in range(2000)})
    calls, hashed = [], language_id.xxhash.xxh32_intdigest
    monkeypatch.setattr(language_id.xxhash, "xxh32_intdigest", lambda name: calls.append(name) or hashed(name))
    model().label(language_id.pa.array([" ".join(tokens)]))
    assert len(calls) < 400

import resource
import sys

import numpy as np
import pytest
from threadloom.llm import language, ppm
from threadloom.llm.common import text_slices


@pytest.mark.parametrize("chars", [1, 4, 10, 1000])
def test_slices_cut_between_words(chars):
    texts = ["one two  three", None, "", " a b ", "x" * 50, "tail end"]
    got = [""] * len(texts)
    for rows, parts in text_slices(texts, chars):
        assert len(rows) == len(parts) and sum(map(len, parts[:-1])) < chars
        for row, part in zip(rows, parts, strict=True):
            got[row] += part
            assert part
    assert got == [t or "" for t in texts]


def test_letters_are_letters():
    assert language._words("a½b ² Ⅷ ① Été x_y 12z ß-Σ 你好") == ["a", "b", "été", "x", "y", "z", "ß", "σ", "你好"]
    model = language.LanguageModel({"en": {"the": 3}, "fr": {"le": 2}})
    assert model.predict(["² ½ Ⅷ ①", "½the", None, ""])[0] == ["und", "en", "und", "und"]


def test_language_by_hand():
    """Every word scored on its own, whole texts at once."""
    counts = {"en": {"the": 5, "house": 2, "and": 4}, "fr": {"le": 5, "maison": 2, "et": 4}, "de": {"das": 4, "haus": 2, "und": 5}}
    model = language.LanguageModel(counts)
    texts = ["the house", "le maison et le", "haus und housen", "Maisons", "qqq", "the le das", "x " * 500 + "und " * 3]
    want = []
    for text in texts:
        scores = np.zeros(3)
        for word in text.lower().split():
            if any(word in own for own in counts.values()):
                scores += [np.log((counts[g].get(word, 0) + 0.1) / (sum(counts[g].values()) + 0.1 * 10)) for g in model.langs]
                continue
            for order in language.ORDERS:
                known = [model.logs[order][model.index[order][g]] for g in language._grams(word, order) if g in model.index[order]]
                if known:
                    scores += np.mean(known, axis=0)
                    break
        want.append(model.langs[int(scores.argmax())])
    assert model.predict(texts)[0] == want
    assert model.predict(texts * 2)[0] == want * 2


def test_places_equal_an_index():
    rng = np.random.default_rng(0)
    ordered = np.unique(rng.integers(-50, 50, 40))
    asked = rng.integers(-60, 60, 300)
    where = {int(v): k for k, v in enumerate(ordered)}
    assert ppm._places(ordered, asked).tolist() == [where.get(int(v), -1) for v in asked]
    assert ppm._places(ordered[:0], asked).tolist() == [-1] * 300 and ppm._places(ordered, asked[:0]).tolist() == []


def test_a_batch_of_long_texts_stays_small():
    model = language.LanguageModel({"en": {f"w{k}": 1 for k in range(100)}, "fr": {"le": 2}})
    text = " ".join(f"{chr(97 + k % 26)}{chr(97 + k % 17)}{chr(97 + k % 11)}" for k in range(400_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model.predict([text] * 20)  # 32 million characters
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / (1024 if sys.platform == "linux" else 1 << 20) < 150

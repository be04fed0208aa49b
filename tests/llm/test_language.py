"""Languages by writing system and letter trigrams."""

import pandas as pd
import pytest

from millrace.llm.language import Languages


@pytest.fixture(scope="module")
def model():
    r = pd.read_parquet("/root/testdata/sf0.01/review_samples.parquet")
    return Languages.learn([x for x in [*r.problem, *r.generation] if x])


@pytest.mark.parametrize("code", ["en", "fr", "es", "de", "ru", "zh"])
def test_languages_of_documents(model, code):
    """Texts of another table, whose language is known."""
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [t for t in d[d.lang == code].text if t and len(t) > 200]
    found = [max(x, key=x.get) if x else "" for x in model.read_all(texts)]
    assert len(texts) > 5 and sum(f == code for f in found) >= 0.97 * len(texts)


def test_systems_without_a_model(model):
    for text, name in (("これは日本語の文章です。東京に行きます。", "kana"), ("그는 서울에 갔다. 날씨가 좋다.", "hangul")):
        found = model.read(text)
        assert max(found, key=found.get) == name
    assert model.read("") == {} and model.read("12 + 3 = 15\n\n---") == {}


def test_one_by_one_is_all_at_once(model):
    texts = ["The cat sat on the mat. " * 3, "", "Der Hund ist nicht im Haus. " * 20_000, "1 + 1", "Le chat est sur la table."]
    assert [model.read(t) for t in texts] == model.read_all(texts)

import pytest

from millrace.llm.ending import says_nothing


@pytest.mark.parametrize("n", [1, 199, 200, 5000])
def test_invisible_characters_say_nothing_at_every_length(n):
    assert says_nothing("\u200b" * n) and says_nothing("\u0000\u2060 " * n) and says_nothing("\u200b" * n + "n/a")
    assert not says_nothing("\u200b" * n + "7")

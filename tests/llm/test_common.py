from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hiregrid.llm.common import RollingHash, shared_folder


def thue_morse(n: int) -> str:
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_thue_morse_words_differ():
    one = thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    hashes = RollingHash(np.frombuffer((one + other + one).encode(), np.uint8))(np.array([0, 4096, 8192]), np.array([4096, 8192, 12288]))
    assert hashes[0] == hashes[2] != hashes[1]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60))
def test_equal_ranges_and_only_they_have_equal_hashes(data):
    hashed = RollingHash(np.frombuffer(data, np.uint8))
    ranges = [(a, b) for a in range(len(data) + 1) for b in range(a, min(a + 6, len(data)) + 1)]
    values = hashed(*np.array(ranges, np.int64).T)
    seen: dict[int, bytes] = {}
    of: dict[bytes, int] = {}
    for (a, b), h in zip(ranges, values.tolist(), strict=True):
        assert seen.setdefault(h, data[a:b]) == data[a:b]
        assert of.setdefault(data[a:b], h) == h


def test_a_cluster_has_to_name_its_folder(monkeypatch):
    class Held:
        isEmpty = staticmethod(lambda: True)

    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("sc", (), {"getCheckpointDir": staticmethod(Held)}))

    session = type("session", (), {"sparkContext": Context, "conf": type("conf", (), {"get": staticmethod(lambda key, default: default)})})
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(session)

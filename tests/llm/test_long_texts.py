"""Texts over several windows: the same results as in one piece, with bounded memory."""

from __future__ import annotations

import subprocess
import sys

import numpy as np
import pytest

pytest.importorskip("sparkloom.llm")

from sparkloom.llm import quality, spotsigs  # noqa: E402
from sparkloom.llm.words import WINDOW  # noqa: E402


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _texts(rng: np.random.Generator) -> list[str]:
    own = ["the", "of", "and", "blue", "Wörter", "x1", "sum", "DER", "tree", "!", "long-ish", "|", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    mixed = ["".join(rng.choice(own) + rng.choice([" ", " ", " ", "\n", "\t", "  ", ", ", "\n\n"]) for _ in range(n)) for n in (3, 40, 400)]
    return [*mixed, "the " * 200, "the " * 100 + "blue " + "of " * 100 + "tree", "blue tree " * 60, "blue", "b" * 300, "\n" * 50, "\n\nthe end\n", " " * 99, "one line " * 90, "a\r\nb " * 50]


@pytest.mark.parametrize("most", [1, 7, 64, 1000])
def test_signatures_in_windows(most):
    for text in _texts(np.random.default_rng(most)):
        for chain in (1, 2, 3):
            whole, _ = spotsigs.signatures(_bytes(text), np.array([0, len(text.encode())]), chain)
            assert spotsigs.long_signatures(_bytes(text), chain, most).tolist() == whole.tolist(), (text[:60], chain)
    texts = _texts(np.random.default_rng(5))
    assert [s.tolist() for s in spotsigs.sets_of(texts, most=most)] == [s.tolist() for s in spotsigs.sets_of(texts)]


@pytest.mark.parametrize("most", [1, 7, 64, 1000])
def test_line_features_in_windows(most):
    field = quality.Field(np.random.default_rng(1).normal(size=3 * quality.N_OWN + 3), np.array([[0.3, -0.2], [0.1, 0.4]]), 1.3, -0.2)
    for text in _texts(np.random.default_rng(most)):
        features, at, size = quality.line_features(_bytes(text), np.array([0, len(text.encode())]))
        own, sizes = quality.long_lines(_bytes(text), most)
        assert sizes.tolist() == size.tolist()
        assert np.array_equal(own, features[:, : quality.N_OWN]), text[:60]
        for lines in (1, 3, 4096):
            assert np.allclose(field.long_score(_bytes(text), most, lines), field.scores(features, at, size), rtol=0, atol=1e-12)


def test_windows_of_the_real_size():
    rng = np.random.default_rng(3)
    own = np.array(["the", "of", "blue", "tree", "Wörter", "x1", "and", "sum\n", "seven", "house\n"])
    text = " ".join(own[rng.integers(0, len(own), 700_000)].tolist())
    data = _bytes(text)
    assert len(data) > 2 * WINDOW
    whole, _ = spotsigs.signatures(data, np.array([0, len(data)]))
    assert spotsigs.long_signatures(data).tolist() == whole.tolist()
    features, _, size = quality.line_features(data, np.array([0, len(data)]))
    lines, sizes = quality.long_lines(data)
    assert np.array_equal(lines, features[:, : quality.N_OWN]) and sizes.tolist() == size.tolist()


@pytest.mark.parametrize("use", ["quality.Field(np.zeros(3 * quality.N_OWN + 3), np.zeros((2, 2))).long_score(data)", "spotsigs.long_signatures(data)"])
def test_a_text_of_fifty_megabytes_takes_bounded_memory(use):
    code = f"""
import resource, numpy as np
from sparkloom.llm import quality, spotsigs
rng = np.random.default_rng(1)
some = np.frombuffer(b"the of blue sum a1.", np.uint8)
data = np.concatenate([some[rng.integers(0, len(some), 1 << 20, np.uint8)] for _ in range(50)])
data[::80] = 10
{use}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(got.stdout) < 450, got.stdout

"""Merging many units at once gives what merging one by one gives."""

import random

import numpy as np
import pytest

from quillworks.llm import sentencepiece_codec as codec
from quillworks.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def pieces():
    return codec.load(PIECE_MODEL)


def folded(merges, units):
    found = {}
    for numbers, ids in merges.fold(units):
        found.update(zip(numbers, ids, strict=True))
    return [found[i] for i in range(len(units))]


def test_many_units_at_once(pieces):
    rng = random.Random(3)
    letters = sorted({c for piece in pieces.ids for c in piece}) + ["☃", "\U0001f600", ""]
    names = list(pieces.ids)
    units = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 65))) for _ in range(500)]
    units += ["".join(rng.sample(names, rng.randrange(1, 6)))[: codec.SHORT] for _ in range(3000)]
    units += ["a" * n for n in range(1, 65)] + [codec.SPACE * 40, "é", "☃", "a☃b"]
    found = folded(codec.Merges.of(pieces), units)
    longest = pieces.longest
    for unit, ids in zip(units, found, strict=True):
        if ids is None:
            assert any(c not in pieces.ids for c in unit)
        else:
            assert ids == codec._packed(codec.fold_unit(unit, pieces, longest)), unit
    assert sum(ids is None for ids in found) >= 2


def test_equal_scores_merge_from_the_left():
    ids = {text: i for i, text in enumerate(["a", "b", "ab", "ba", "aba", "aa", "abab"])}
    scores = {"a": -9.0, "b": -9.0, "ab": -1.0, "ba": -1.0, "aba": -2.0, "aa": -1.0, "abab": -2.0}
    pieces = codec.Pieces(ids, scores, {}, 99, "bpe")
    units = ["".join(np.random.default_rng(i).choice(list("ab"), 1 + i % 20)) for i in range(200)]
    for unit, found in zip(units, folded(codec.Merges.of(pieces), units), strict=True):
        assert found == codec._packed(codec.fold_unit(unit, pieces, 4)), unit

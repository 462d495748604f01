"""Ratios of one string to several others against plain versions, and which texts meet at all."""

import random
from difflib import SequenceMatcher

import pytest

from corpusforge.functions import alignment
from corpusforge.operators import leakage


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("letters, longest", [("ab", 30), ("abcdefgh0", 60), ("aaab", 230)])
def test_side_by_side_equals_one_by_one(letters, longest):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, n)))
    for _ in range(25):
        text, others = word(60), [word(longest) for _ in range(rnd.randrange(1, 7))]
        assert alignment.edit_distances(text, others) == [distance(text, o) for o in others]
        assert alignment.best_matching_ratio()(text, others) == max(SequenceMatcher(None, text, o).ratio() for o in others)


def test_texts_of_hopeless_size_meet_nothing(spark):
    """Texts much longer or shorter than every target text are not sent to a block; those at the bound are."""
    sets = lambda sizes: spark.createDataFrame([(0, i, list(range(n))) for i, n in enumerate(sizes)], "all int, rid long, hashes array<bigint>")
    met = leakage._may_meet(sets([1, 3, 10, 40, 66, 80, 5_000]), sets([10, 20]), 0.3).select("rid").collect()
    assert {r[0] for r in met} == {1, 2, 3, 4}


def test_long_strings_look_up_rare_characters_only():
    """Matches equal those of ``difflib`` in any part, and a place whose character it does not look up is not visited."""
    class Counted(dict):
        seen = 0

        def __getitem__(self, key):
            Counted.seen += 1
            return super().__getitem__(key)

    rnd = random.Random(9)
    a, b = ("".join(rnd.choice("abcdefghij" * 12 + "qxz") for _ in range(n)) for n in (700, 260))
    matcher = SequenceMatcher(None, a, b)
    where, b2j = alignment.positions(a), Counted(matcher.b2j)
    spots = sorted(i for c in b2j for i in where.get(c, ()))
    assert len(spots) < 40
    for _ in range(200):
        (alo, ahi), (blo, bhi) = sorted(rnd.choices(range(701), k=2)), sorted(rnd.choices(range(261), k=2))
        Counted.seen = 0
        assert alignment._longest_match(a, b, spots, b2j, alo, ahi, blo, bhi) == tuple(matcher.find_longest_match(alo, ahi, blo, bhi))
        assert Counted.seen <= len(spots)
    assert alignment.matching_ratio(a, matcher, -1.0, 260) == matcher.ratio()

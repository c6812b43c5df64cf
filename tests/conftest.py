import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillmark.session import local_session
    s = local_session(8, shuffle_partitions=8, app="quillmark-tests")
    yield s
    s.stop()


# Hand-made pairs: repeats, one-token texts, punctuation only, non-ASCII,
# identical and disjoint texts, multi-sentence texts.
PAIRS = [
    (1, "The cat sat on the mat.", "The cat sat on the mat."),
    (2, "alpha beta gamma", "delta epsilon zeta"),
    (3, "the the the cat", "the cat the"),
    (4, "word", "word"),
    (5, "!!! ... ???", "a b c"),
    (6, "Über straße café naïve", "uber strasse cafe naive"),
    (7, "A quick brown fox. It jumps over the dog! Then it sleeps.",
     "The fox jumps. A quick brown dog sleeps over it."),
    (8, "one two three four five six", "six five four three two one"),
    (9, "running runners ran quickly", "the runner runs quick"),
    (10, "Numbers 3.50-4 and, commas. Here", "numbers 3.50 - 4 and commas here"),
]


@pytest.fixture(scope="session")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "pair_id long, gold string, predicted string")

"""groups of few places are compared in one row; only crowded ones are put into cells."""

import random

from geoverity.operators import cluster as C
from test_cluster import around, check


def test_small_groups_form_no_cells(spark, monkeypatch):
    rng = random.Random(3)
    groups = {k: around(rng, 12, 77 + k, rng.randint(1, 16), .04) for k in range(30)}
    groups[90] = [(3.0, 4.0)] * 40 + [(None, 4.0)] * 3 + [(3.0, None), (95.0, 4.0)]
    groups[91] = [(None, None)] * 16
    monkeypatch.setattr(C, "_by_cells", None)
    check(spark, groups)


def test_small_beside_crowded(spark):
    rng = random.Random(4)
    check(spark, {0: around(rng, 0, 0, 16, .04), 1: around(rng, 0, 0, 17, .04), 2: [(None, 1.0)] * 20 + [(1.0, 1.0)] * 2})

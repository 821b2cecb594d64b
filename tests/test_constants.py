"""Counts, candidates and weights that follow from parameters alone."""

import numpy as np

from lagweave.functions import basis
from lagweave.functions.basis import Polynomial
from lagweave.operators import affine
from lagweave.plans.model import Spec


def test_number_of_candidates():
    assert {t: len(Spec(2, (2,), t).candidates) for t in ("NARMAX", "NAR", "NFIR")} == {"NARMAX": 15, "NAR": 6, "NFIR": 6}


def test_candidates_in_order_and_their_variables():
    names = ["1", "y_1", "y_2", "x1_1", "x1_2"]
    want = [b if a == "1" else f"{a}*{b}" for i, a in enumerate(names) for b in names[i:]]
    terms = Polynomial(2).terms(basis.lag_columns([1, 2], [[1, 2]]))
    assert [n for n, _ in terms] == want
    assert {n for n, _ in basis.output_terms(terms)} == {n for n in want if "y" in n}
    assert {n for n, _ in basis.input_terms(terms)} == {n for n in want if "x" in n}


def test_grid_of_weights(spark):
    w = [2.71 ** (-0.01 + (-5 + 0.01) * i / 49) for i in range(50)]
    want = sorted((a, 1 - (a + b), b) for a in w for b in w if a + b <= 1)
    assert np.allclose(sorted(map(tuple, affine.weights(spark).collect())), want)

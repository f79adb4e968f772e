"""Pairs of lineages in many populations, without matrices over all pairs of states."""

import math
import time
import tracemalloc

import numpy as np
import pytest

from kinfold.operators.demography import History, PairRates


def a_history(n, rates, sizes, later=(), growth=None, moves=()):
    """Epochs from 0 on with these sizes, and one more for each (start, sizes) of ``later``."""
    table = [{"source": a, "dest": b, "rate": r} for (a, b), r in rates.items()]
    epochs = [{"start_time": t, "sizes": s, "growth": growth or [0.0] * n, "rates": table} for t, s in [(0.0, sizes), *later]]
    return History(n, epochs, [dict(zip(("time", "source", "dest", "proportion"), m, strict=True)) for m in moves])


def both(monkeypatch, ask):
    """The answer with whole matrices and the one without."""
    out = []
    for most in (6, 0):
        monkeypatch.setattr(PairRates, "DENSE", most)
        out.append(ask())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_as_with_whole_matrices(monkeypatch, seed):
    pick = np.random.default_rng(seed)
    rates = {(a, b): float(pick.uniform(0.001, 0.2)) for a in range(3) for b in range(3) if a != b and (seed % 2 or b == (a + 1) % 3)}
    sizes = lambda: pick.uniform(1, 500, 3).tolist()
    growth = [0.0, 0.01, -0.001] if seed == 5 else None
    moves = [(30.0, 0, 1, 0.4), (30.0, 2, 1, 1.0)] if seed > 2 else []
    history = a_history(3, rates, sizes(), [(30.0, sizes()), (200.0, [50.0, 60.0, 70.0])], growth, moves)
    if growth:
        history.epochs[-1]["growth"] = [0.0] * 3
    whole, sparse = both(monkeypatch, lambda: history.pairs([0.0, 1.0, 30.0, 150.0, 900.0], [2, 1, 3]))
    assert all(np.allclose(whole[t], sparse[t], rtol=1e-9, atol=1e-13) for t in whole)
    whole, sparse = both(monkeypatch, lambda: history.mean_time([2, 1, 3]))
    assert math.isclose(whole, sparse, rel_tol=1e-8)


def test_never_meet(monkeypatch):
    """Infinite where a part of the pairs can't meet; not where only places that no lineage reaches are apart."""
    ways = {(0, 1): 0.1, (1, 0): 0.1}
    assert both(monkeypatch, lambda: a_history(3, ways, [10.0] * 3).mean_time([1, 1, 1])) == [math.inf] * 2
    split = {(2, 0): 0.1, (2, 1): 0.1}
    assert both(monkeypatch, lambda: a_history(3, split, [10.0] * 3).mean_time([0, 0, 2])) == [math.inf] * 2
    for found in both(monkeypatch, lambda: a_history(3, ways, [10.0] * 3).mean_time([2, 0, 0])):
        assert math.isclose(found, 40, rel_tol=1e-9)
    for rate, left in both(monkeypatch, lambda: a_history(2, {}, [10.0] * 2).pairs([5.0], [1, 1])[5.0]):
        assert rate == 0 and math.isclose(left, 1)


def test_too_many_steps():
    history = a_history(1, {}, [1000.0], growth=[-1e-3])
    with pytest.raises(ValueError, match="larger change"):
        history.mean_time([2], most=10)


def test_a_hundred_populations():
    """An island model: pairs of one island meet after 2 n d generations, others (d - 1) / (2 m) later, m the rate at which a lineage leaves."""
    d, size, leaves = 100, 20.0, 0.05
    history = a_history(d, {(a, b): leaves / (d - 1) for a in range(d) for b in range(d) if a != b}, [size] * d)
    tracemalloc.start()
    began = time.time()
    within = history.mean_time([2] + [0] * (d - 1))
    apart = history.mean_time([1, 1] + [0] * (d - 2))
    shares = history.pairs([0.0, 50.0], [1] * d)
    assert tracemalloc.get_traced_memory()[1] < 60e6 and time.time() - began < 60  # one matrix over pairs of states is 800 MB
    tracemalloc.stop()
    assert math.isclose(within, 2 * size * d, rel_tol=1e-7) and math.isclose(apart, 2 * size * d + (d - 1) / (2 * leaves), rel_tol=1e-7)
    assert shares[0.0] == (0.0, pytest.approx(1.0)) and 0.9 < shares[50.0][1] < 1

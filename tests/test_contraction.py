"""Accumulated lengths by contraction: chains, trees, braids and cycles against one pass in order."""

import numpy as np
import pytest

from fluvia.operators import graph as G


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, length double")


def in_order(edges):
    """Sums by repeated passes over a graph without cycles."""
    into = {}
    for s, d, c in edges:
        into.setdefault(d, []).append((s, c))
        into.setdefault(s, [])
    up = {}

    def of(v):
        stack = [v]
        while stack:
            w = stack[-1]
            need = [s for s, _ in into[w] if s not in up]
            if need:
                stack += need
            else:
                up[w] = sum(up[s] + c for s, c in into[w])
                stack.pop()
        return up[v]

    return {v: of(v) for v in into}


def test_long_chain_in_few_steps(spark, monkeypatch):
    steps = []
    plain = G._step
    monkeypatch.setattr(G, "_step", lambda df: steps.append(1) or plain(df))
    edges = [(k, k + 1, 1.0 + k % 3) for k in range(10_000)]
    got = {r.node: r.upstream for r in G.accumulate(frame(spark, edges), few=0).collect()}
    assert got == in_order(edges)
    assert len(steps) < 40


@pytest.mark.parametrize("few", [0, 20, 1 << 17])
def test_trees_and_braids(spark, few):
    r = np.random.default_rng(3)
    edges = [(k, int(r.integers(max(0, k - 6), k)), float(r.integers(1, 9))) for k in range(1, 300)]  # a tree
    edges += [(1000 + k, 1000 + k + 1 + int(r.integers(0, 2)), 2.0) for k in range(60) for _ in range(2)]  # braids, parallel edges among them
    got = {r.node: r.upstream for r in G.accumulate(frame(spark, edges), few=few).collect()}
    assert got == pytest.approx(in_order(edges))


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_cycles_are_taken_in_the_order_of_their_nodes(spark, few):
    edges = [(10, 1, 5.0), (1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 2.0), (4, 5, 1.0), (20, 21, 1.0), (21, 20, 4.0), (20, 5, 7.0)]
    want = {10: 0.0, 1: 5.0, 2: 6.0, 3: 7.0, 4: 9.0, 20: 0.0, 21: 1.0, 5: 17.0}
    got = {r.node: r.upstream for r in G.accumulate(frame(spark, edges), few=few).collect()}
    assert got == want
    assert {r.node: r.upstream for r in G.accumulate(frame(spark, list(reversed(edges))), few=few).collect()} == want


def test_no_edges(spark):
    assert G.accumulate(frame(spark, [])).isEmpty()

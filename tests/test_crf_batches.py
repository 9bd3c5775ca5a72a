"""A CRF steps through sequences of a length together: gradient and best paths are those of all label paths written out."""

import itertools

import numpy as np

from paperloom.operators.sequence import Crf


def test_gradient_and_paths_of_many_sequences():
    r = np.random.default_rng(3)
    model = Crf(["A", "B", "C"], r.normal(size=(9, 3)), r.normal(size=(3, 3)))
    features = [[r.integers(0, 9, r.integers(0, 4)) for _ in range(n)] for n in (3, 0, 1, 3, 4, 1, 2, 3)]
    gold = [r.integers(0, 3, len(f)) for f in features]
    node, edge, want_node, want_edge, likelihood, best = np.zeros((9, 3)), np.zeros((3, 3)), np.zeros((9, 3)), np.zeros((3, 3)), 0.0, []
    for f, g in zip(features, gold, strict=True):
        if not len(f):
            best.append([])
            continue
        paths = list(itertools.product(range(3), repeat=len(f)))
        score = np.array([sum(model.node[s, y].sum() for s, y in zip(f, p)) + sum(model.edge[a, b] for a, b in zip(p, p[1:])) for p in paths])
        chance = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        best.append([model.labels[y] for y in paths[int(score.argmax())]])
        likelihood += float(np.log(chance[paths.index(tuple(g))]))
        for p, weight in [(tuple(g), 1.0), *zip(paths, -chance)]:
            for s, y in zip(f, p):
                np.add.at(want_node[:, y], s, weight)
            for a, b in zip(p, p[1:]):
                want_edge[a, b] += weight
    assert np.isclose(model.gradient(features, gold, node, edge), likelihood)
    assert np.allclose(node, want_node) and np.allclose(edge, want_edge)
    assert model.decode(features) == best

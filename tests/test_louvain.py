"""Communities of the ladder against a plain sequential version."""

import collections
import random

import pytest

from adjudica.operators import louvain


def quality(edges, of, r):
    m2 = 2 * sum(edges.values())
    degree, inside = collections.Counter(), 0.0
    for (a, b), w in edges.items():
        degree[of[a]] += w
        degree[of[b]] += w
        inside += 2 * w * (of[a] == of[b])
    return inside / m2 - r * sum((k / m2) ** 2 for k in degree.values())


def plain_louvain(edges, r):
    """Nodes one after the other, to the neighbouring community of most gain, until none gains; then communities as nodes."""
    member = {n: n for e in edges for n in e}
    graph = dict(edges)
    while True:
        m2 = 2 * sum(graph.values())
        near, degree = collections.defaultdict(collections.Counter), collections.Counter()
        for (a, b), w in graph.items():
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        of, mass, moved = {n: n for n in degree}, collections.Counter(degree), True
        while moved:
            moved = False
            for n in sorted(degree):
                weights = collections.Counter()
                for o, w in near[n].items():
                    weights[of[o]] += w
                mass[of[n]] -= degree[n]
                score = lambda c: weights[c] - r * degree[n] * mass[c] / m2  # noqa: B023, E731
                best = max(sorted(weights), key=score, default=of[n])
                if score(best) > score(of[n]) + 1e-10:
                    of[n], moved = best, True
                mass[of[n]] += degree[n]
        if all(n == c for n, c in of.items()):
            return member
        member = {n: of[c] for n, c in member.items()}
        new = collections.Counter()
        for (a, b), w in graph.items():
            x, y = sorted((of[a], of[b]))
            new[x, y] += w
        graph = new


def test_ladder_is_as_good_as_the_sequential_rule(spark):
    rng = random.Random(1)
    edges = collections.Counter()
    for _ in range(420):
        a = rng.randrange(90)
        b = (a // 9) * 9 + rng.randrange(9) if rng.random() < 0.8 else rng.randrange(90)
        if a != b:
            edges[min(a, b), max(a, b)] += rng.choice([1, 1, 2, 5])
    edges.update({(200, 201): 3, (300, 301): 1, (300, 302): 1, (301, 302): 1})
    rows = [(a, b, float(w)) if k % 2 else (b, a, float(w)) for k, ((a, b), w) in enumerate(edges.items())]
    rows += [(None, 3, 1.0), (4, None, 1.0), (5, 6, None), (5, 7, -2.0)]
    frame = spark.createDataFrame(rows, "a long, b long, weight double")
    ladder = (1.0, 5.0)
    members = louvain.ladder(frame, ladder)
    got = collections.defaultdict(dict)
    for row in members.collect():
        got[row.resolution, row.level][row.node] = row.community
    told = {(row.resolution, row.level): row for row in louvain.modularity(frame, members).collect()}
    assert set(told) == set(got) and {r for r, _ in got} == set(ladder)
    for (r, level), of in got.items():
        assert set(of) == {n for e in edges for n in e} and all(of[c] == c and c <= n for n, c in of.items())
        assert told[r, level].modularity == pytest.approx(quality(edges, of, r), abs=1e-12)
        assert told[r, level].communities == len(set(of.values())) and told[r, level].largest == max(collections.Counter(of.values()).values())
        if (r, level + 1) in got:  # each level holds the one below, and is better
            assert len({(of[n], c) for n, c in got[r, level + 1].items()}) == len(set(of.values()))
            assert told[r, level + 1].modularity > told[r, level].modularity
    for r in ladder:
        last = max(level for x, level in got if x == r)
        plain = quality(edges, plain_louvain(edges, r), r)
        assert told[r, last].modularity >= plain - 0.02 * abs(plain), (r, told[r, last].modularity, plain)
    assert louvain.ladder(frame.limit(0), ladder).count() == 0

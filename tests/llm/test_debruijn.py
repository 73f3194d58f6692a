"""The graph of repeated windows: degrees, nonbranching paths and circles against plain loops."""

import random
from collections import defaultdict

import pytest

from foldstat.llm import debruijn


def brute_paths(pieces):
    """The maximal chains of pieces (id, tail, head), joined where heads meet tails; a circle is one set."""
    start = {t: i for i, t, _ in pieces if t is not None}
    after = {i: start[h] for i, _, h in pieces if h is not None and h in start and start[h] != i}
    firsts = {i for i, _, _ in pieces} - set(after.values())
    out = []
    for i in firsts:
        chain = [i]
        while chain[-1] in after:
            chain.append(after[chain[-1]])
        out.append(chain)
    circles = {i for i, _, _ in pieces} - {i for c in out for i in c}
    return out, circles


@pytest.mark.parametrize("seed", range(4))
def test_paths(spark, seed):
    rng = random.Random(seed)
    nodes, rows, node = [], [], 0
    for length in [1, 1, 2, 3, 9, 33, 64]:  # chains
        names = [None, *range(node, node + length - 1), None]
        node += length
        rows += [(names[i], names[i + 1]) for i in range(length)]
    for length in [2, 5, 12]:  # circles
        names = list(range(node, node + length))
        node += length
        rows += [(names[i], names[(i + 1) % length]) for i in range(length)]
    rows.append((node, node))  # a loop on itself
    rng.shuffle(rows)
    pieces = [(i, 100 * i, rng.randrange(1, 9), t, h) for i, (t, h) in enumerate(rows)]
    frame = spark.createDataFrame(pieces, "block long, word long, n long, tail long, head long").repartition(3)
    got = {r.block: (r.path, r.at) for r in debruijn.paths(frame).collect()}
    size = {p[0]: p[2] for p in pieces}
    chains, circles = brute_paths([(p[0], p[3], p[4]) for p in pieces])
    for chain in chains:
        at = 0
        for i in chain:
            assert got[i] == (got[chain[0]][0], at)
            at += size[i]
    by_path = defaultdict(list)
    for i in circles:
        by_path[got[i][0]].append((got[i][1], i))
    for own in by_path.values():  # parts of a circle follow each other in it
        own.sort()
        assert own[0][0] == 0
        for (a, i), (b, j) in zip(own, own[1:]):
            assert b == a + size[i] and rows[i][1] == rows[j][0]
    assert len({p for p, _ in got.values()}) == len(chains) + len(by_path)


def test_pieces_are_cut_where_nodes_branch(spark):
    # Two source runs that cross in node 5 (place 2 of the first, place 1 of the second), and one that only touches an end.
    nodes = [(1, 0, 0, 0, 1), (2, 0, 1, 1, 1), (5, 0, 2, 1, 1), (3, 0, 3, 1, 0), (7, 1, 9, 0, 1), (5, 1, 10, 1, 1), (8, 1, 11, 1, 0), (3, 1, 20, 0, 1), (9, 1, 21, 1, 0)]
    frame = spark.createDataFrame(nodes, "node long, block long, at long, ins int, outs int")
    got = sorted((r.block, r.word, r.n, r.tail, r.head) for r in debruijn.pieces(frame).collect())
    assert got == [(0, 0, 2, 1, None), (0, 2, 1, None, 3), (1, 9, 1, 7, None), (1, 10, 1, None, 8), (1, 20, 1, 3, 9)]

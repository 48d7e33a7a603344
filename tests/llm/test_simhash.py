"""SimHash: fingerprints, the Gray index and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from edge import edge_documents, with_clashes
from pulsetrace.llm import simhash as S
from pulsetrace.llm.components import components, roots


def brute_fingerprint(text, n=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows, bits=3):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= bits and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [
        (i, f"{fp:016x}", min((prints[k][0] for k in range(len(rows)) if group[k] == g and prints[k][0] is not None), default=None))
        for (i, fp), g in zip(prints, group)
    ]


def texts(n, seed=0):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120)) for _ in range(8)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "Edit%d" % rng.randint(0, 9)
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("cell", [4096, 4])
def test_components_equal_brute_force(spark, cell):
    rows = texts(150)
    df = with_clashes(edge_documents(spark, *[(i + 100, t) for i, t in rows]))
    got = S.near_duplicates(df, cell=cell).collect()
    plain = [(r["doc_id"], r["text"]) for r in df.collect()]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(plain), key=key)


def test_empty_table(spark):
    assert S.near_duplicates(edge_documents(spark).limit(0)).count() == 0


def test_gray_index_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = centre[rng.integers(0, 30, 900)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fps = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 600, dtype=np.uint64)]))
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    got = {(i, j) for a, b in S.GrayIndex(fps).pairs(3) for i, j in zip(a.tolist(), b.tolist())}
    distance = np.bitwise_count(fps[:, None] ^ fps[None, :])
    i, j = np.nonzero(np.triu(distance <= 3, 1))
    assert got == set(zip(i.tolist(), j.tolist()))


def test_bands_cover_every_pair_within_the_limit():
    for mask in (0, *S.bands(0, 4)):
        children = S.bands(mask, 4)
        assert all(c & mask == mask for c in children)
        free = [c ^ mask for c in children]
        assert sum(free) == (1 << 64) - 1 - mask and all(a & b == 0 for a in free for b in free if a != b)


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-50, 400, 250), rng.integers(-50, 400, 250)
    chain = np.arange(1000, 1300)
    a, b = np.concatenate([a, chain, [7777]]), np.concatenate([b, chain + 1, [7777]])
    nodes, low = roots(a, b)
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == dict(zip(nodes.tolist(), low.tolist())) and components(edges.limit(0)).count() == 0

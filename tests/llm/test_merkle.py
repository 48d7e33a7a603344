"""Trees, proofs and altered rows against a tree built in plain Python."""

import hashlib
import zlib
from string import ascii_lowercase, ascii_uppercase

import pytest
from edge import documents, edge_documents, with_clashes
from pulsetrace.llm import merkle as M

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """(root, for each leaf the (left, right) siblings on the way up)."""
    paths = [[] for _ in digests]
    nodes, below = list(digests), [[i] for i in range(len(digests))]
    while len(nodes) > 1:
        parents, members = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in below[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(sha(*run))
            members.append([i for b in below[at : at + 8] for i in b])
        nodes, below = parents, members
    return nodes[0], paths


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append((r, leaf(r, r["text"])))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    roots, paths = {}, {}
    for lang in order:
        langs[lang].sort(key=lambda x: (x[0]["doc_id"] is None, x[0]["doc_id"] or 0, x[1]))
        roots[lang], paths[lang] = tree([d for _, d in langs[lang]])
    if not order:
        return []
    root, above = tree([roots[x] for x in order])
    out = []
    for lang, up in zip(order, above):
        for (r, own), path in zip(langs[lang], paths[lang]):
            whole = path + up
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            end = leaf(r, r["text"] and r["text"].translate(LOWER)) if changed else own
            for left, right in whole:
                end = sha(left, end, right)
            proof = sha(*(a + b for a, b in whole))
            out.append((r["doc_id"], own, roots[lang], root, proof, end, end == root))
    return out


def found(docs):
    return sorted(map(tuple, M.manifest(docs).collect()), key=str)


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 8}, {"en": 9, "de": 1, None: 2}, {"en": 600, "": 65, None: 1, "é": 17, "z": 64},
    {f"l{i:02}": 1 + i % 3 for i in range(70)},
])
def test_equal_to_plain_python(spark, sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for k in range(n):
            rows.append((1000 - 7 * i % 1009 * 3, None if k % 11 == 5 else f"Text {i % 13} É" * (k % 4), lang))
            i += 1
    docs = documents(spark, rows)
    got = found(docs)
    assert got == sorted(brute(docs.collect()), key=str) and len(got) == len(rows)
    assert {r[-1] for r in got} <= {True, False}


def test_odd_rows(spark):
    docs = edge_documents(spark, *[(9, "Copy", lang) for lang in ("en", "en", None)])
    got = found(docs)
    assert got == sorted(brute(docs.collect()), key=str)
    clashing = with_clashes(docs).withColumns({c: docs.n_chars for c in ("group", "digest", "at", "path", "slot0", "seen", "height")})
    assert found(clashing) == got
    assert found(docs.limit(0)) == []


def test_an_altered_row_is_found_and_the_others_hold(spark):
    docs = documents(spark, [(i, "Upper CASE" if i % 2 else "lower case") for i in range(40)])
    for r in M.manifest(docs).collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["doc_id"] % 2 == 1
        assert r["verified"] is not changed

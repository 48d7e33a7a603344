"""Repeated passages against a brute-force scan of all windows."""

import hashlib
import random

import numpy as np
import pytest
from edge import edge_documents, with_clashes
from pulsetrace.llm import suffixes as S


def brute(rows, match=100):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - match + 1):
            window = raw[p : p + match]
            if window in seen:
                gone[p : p + match] = b"\x01" * match
            else:
                seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc_id, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows():
    rng = random.Random(3)
    words = ["alpha", "be", "gamma", "dé", "eps", "zeta", "eta", "theta"]
    mixed = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [mixed(40) for _ in range(4)]
    out = []
    for i in range(50):
        text = mixed(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            passage, at = rng.choice(passages), rng.randint(0, 40)
            text += passage[at : at + rng.randint(90, 200)] + mixed(rng.randint(0, 8))
        out.append((i + 100, text))
    long = "a" * 70_000 + mixed(9000)
    return [*out, (160, long), (161, "a" * 300), (162, long[69_000:90_000]), (163, out[5][1])]


def test_texts_side_by_side_have_the_entries_of_each_alone():
    texts = [t.encode() for _, t in rows()] + [b"", b"x" * 99, b"ab" * 50]
    number, *many = S.entries_of(texts)
    for i, text in enumerate(texts):
        own = number == i
        for a, b in zip(many, S.entries(text)):
            assert a[own].tolist() == b.tolist()


def test_named_suffixes_are_the_least_hashes_of_their_windows():
    rng = np.random.default_rng(2)
    for n, width in ((1, 1), (7, 7), (50, 7), (49, 7), (8, 3), (100, 69)):
        values = rng.integers(0, 20, n).astype(np.uint64)
        assert S._least(values, width).tolist() == [values[i : i + width].min() for i in range(n - width + 1)]


def key(r):
    return str(r[0]), r[1:]


@pytest.mark.parametrize("batches, group", [(2, 2048), (5, 2), (1, 1)])
def test_equal_to_brute_force(spark, batches, group):
    from edge import documents

    df = documents(spark, rows())
    got = S.remove_repeats(df, batches=batches, group=group).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows()))


def test_odd_rows(spark):
    df = with_clashes(edge_documents(spark))
    plain = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = S.remove_repeats(df).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(plain), key=key)
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_kept_texts(spark):
    from edge import documents

    text = "".join(chr(97 + i % 23) + str(i) for i in range(80))
    df = documents(spark, [(1, text), (2, "before " + text + " after"), (3, text[:60])])
    kept = {r["doc_id"]: bytes(r["kept"]) for r in S.remove_repeats(df, texts=True).collect()}
    assert kept == {1: text.encode(), 2: b"before  after", 3: text[:60].encode()}


def test_levels_merge_geometrically(spark):
    from edge import documents

    family = S.SuffixFamily(spark)
    found = 0
    for n, (doc_id, text) in enumerate(r for r in rows() if len(r[1]) > 200):
        if n == 7:
            break
        batch = documents(spark, [(doc_id, text)]).selectExpr("doc_id AS doc", "text")
        found += family.add(batch).count()
    assert sorted(size for size, *_ in family.levels) in ([1, 2, 4], [1, 1, 1, 4], [1, 2, 2, 2], [1, 1, 1, 2, 2], [1, 2, 2, 2])
    family._settle()
    assert sorted(size for size, *_ in family.levels) == [1, 2, 4]

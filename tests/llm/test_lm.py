"""Language-model scores: counts and base scores by hand, the lattice by enumeration."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from edge import edge_documents, with_clashes
from pulsetrace.llm import lm
from pulsetrace.llm.common import held_out
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def lattice():
    return lm.Lattice.load(lm.vocabulary_path())


def enumerated(word, lattice, log_p):
    """Sum over all segmentations of a short word, one by one."""
    chars = b" " + word

    def rest(at):
        if at == len(chars):
            return 1.0
        total, state = 0.0, 0
        for stop in range(at, len(chars)):
            state = lattice.nodes[state].get(chars[stop])
            if state is None:
                break
            if lattice.piece_at[state] >= 0:
                total += math.exp(log_p[lattice.piece_at[state]]) * rest(stop + 1)
        return total

    return math.log(rest(0))


def test_the_lattice_sums_over_all_segmentations(lattice):
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(lattice.size)))
    words = [b"a", b"the", b"there", b"\xc3\xa9t\xc3\xa9", b"\x00\xff", b"thhaoner", b"1.5", b"inandan"]
    got = lattice.score(words, log_p)
    assert got == pytest.approx([enumerated(w, lattice, log_p) for w in words])
    long = b"thing" * 40
    assert lattice.score([long], log_p)[0] == pytest.approx(lattice._score_block(np.frombuffer(long, np.uint8)[None], log_p)[0])
    assert lattice.score([b""], log_p)[0] == log_p[0]
    assert math.isfinite(lattice.score([b"z" * 20_000], log_p)[0])


def test_weights_are_a_distribution_over_pieces(lattice):
    assert lattice.piece_at.max() < lattice.size
    singles = {bytes([b]) for b in range(256)}
    assert all(lattice.piece_at[lattice.nodes[0][s[0]]] >= 0 for s in singles)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 20])
def test_columns_by_hand(spark, frequent):
    texts = [(i + 50, f"The cat {i} sat on THE mat\tand\x0bran {'x' * (i % 4)}") for i in range(40)]
    df = with_clashes(edge_documents(spark, *texts))
    docs = [(r["doc_id"], r["text"], r["h"]) for r in df.select("doc_id", "text", held_out(7, 2).alias("h")).collect()]
    split = lambda t: re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = Counter(w for _, t, h in docs if not h for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), h, len(split(t)), sum(w in counts for w in split(t)), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t, h in docs
    )
    rows = lm.score_documents(df, held_out(7, 2), frequent=frequent).collect()
    got = sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in rows)
    assert got == want
    scores = {}
    for r in rows:
        scores.setdefault(r["doc_id"], set()).add(round(r["score"], 6))
    assert all(len(s) == 1 and max(s) < 0 for s in scores.values())
    assert scores[1] == scores[2] == scores[3]  # the end token alone


def test_nothing_to_learn_from_and_no_rows(spark):
    df = edge_documents(spark)
    rows = lm.score_documents(df, F.lit(True)).collect()
    assert len(rows) == df.count() and {r["train_tokens"] for r in rows} == {0} and {r["n_known"] for r in rows} == {0}
    assert lm.score_documents(df.limit(0), held_out(7, 2)).count() == 0

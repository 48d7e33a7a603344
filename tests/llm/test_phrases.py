"""Phrase mining against counting every phrase in plain Python."""

import random
import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest
from edge import documents, edge_documents, with_clashes
from pulsetrace.llm import phrases as P

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def brute(rows, least, longest=3, top=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, words[i : i + size]] += 1
    out = {}
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in candidates.items():
        around = [n for (x, v), n in candidates.items() if x == lang and len(v) > len(w)
                  and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * n >= 50 * a for n in around):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        phrase = " ".join(w)
        out.setdefault(lang, []).append(
            ((-score, -a, phrase.encode()), (phrase, a, counts[lang, w[:k]], counts[lang, w[k:]], total[lang], score)))
    return [(lang, i + 1, *row) for lang, rows in out.items() for i, (_, row) in enumerate(sorted(rows)[:top])]


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["A", "b", "ce", "Dé", " x", "e\x1cf", "über", "😀"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", ";", " ! ", "?\x0b"]
    return [
        (i, "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"]))
        for i in range(n)
    ]


def found(docs, **settings):
    return sorted(map(tuple, P.collocations(docs, **settings).collect()))


@pytest.mark.parametrize("seed, settings", [
    (1, {"least": 3}), (2, {"least": 10}), (3, {"least": 2, "longest": 4}), (4, {"least": 1, "longest": 2}),
])
def test_equal_to_counting_all_phrases(spark, seed, settings):
    rows = texts(seed)
    got = found(documents(spark, rows), **settings)
    assert got == sorted(brute([(lang, t) for _, t, lang in rows], **settings)) and got


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = texts(5)
    docs = documents(spark, rows)
    want = found(docs, least=3)
    monkeypatch.setattr(P, "bitmap", lambda *_: np.full(1, 2**64 - 1, np.uint64))  # every group seems known
    assert found(docs, least=3) == want


def test_blocks_change_nothing(spark, monkeypatch):
    docs = documents(spark, texts(6))
    want = found(docs, least=3)
    monkeypatch.setattr(P, "_HELD", 50)
    assert found(docs, least=3) == want


def test_a_rank_ends_at_the_limit(spark):
    rows = [(i, "one two, two three, three one, one three", "en") for i in range(12)]
    got = found(documents(spark, rows), per_language=2)
    assert [r[1:3] for r in got] == [(1, "one two"), (2, "two three")]


def test_scores_past_64_bits(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, big + 1, 2 * big)], "a long, l long, r long")
    assert df.select(P._score(df.a, df.l, df.r)).first()[0] == 1_000_000 * big * big // ((big + 1) * 2 * big)


def test_odd_rows(spark):
    docs = edge_documents(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    clashing = with_clashes(docs).withColumns({c: docs.n_chars for c in ("word", "at", "words", "rank", "phrase", "hash")})
    got = found(clashing)
    assert got == sorted(brute(rows, 10)) and got
    assert found(docs.limit(0)) == [] and found(docs.where("text IS NULL")) == []

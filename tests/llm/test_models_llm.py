"""Quality, language, decontamination: held-out accuracy on rows with a known answer, and odd rows."""

import random

import numpy as np
import pytest
from edge import documents, edge_documents, with_clashes
from pulsetrace.llm import decontaminate as D
from pulsetrace.llm import language as L
from pulsetrace.llm import quality as Q
from pulsetrace.llm.common import held_out

SMALL = "/root/testdata/sf0.01"
VOICES = {
    "aa": ["kala", "moro", "tiki", "sana", "pilo"], "bb": ["schwund", "grenz", "holtz", "brumm", "schatt"],
    "cc": ["eaux", "oisie", "ouille", "aient", "ieux"],
}


def speech(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang]) + rng.choice(VOICES[lang]) for _ in range(n))


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").selectExpr("doc_id", "quality AS label")
    scored = Q.classify(docs, labels, held_out(5, 0))
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    hits = np.mean([r["predicted"] == r["label"] for r in rows])
    share = np.mean([r["label"] for r in rows])
    assert len(rows) > 40 and hits >= 0.9 and hits > max(share, 1 - share)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_takes_odd_rows_and_labels(spark):
    docs = with_clashes(edge_documents(spark))
    schema = "doc_id long, label int"
    for labels in ([], [(4, 1)], [(4, 1), (5, 0), (8, 1)], [(4, None), (99, 1), (4, 7)], [(5, 0), (5, 1), (6, 1)]):
        scored = Q.classify(docs, spark.createDataFrame(labels, schema), held_out(5, 0)).collect()
        assert len(scored) == docs.count()
        assert all(0 <= r["score"] <= 1 for r in scored)
        assert len({r["score"] for r in scored if r["doc_id"] == 5}) == 1
    assert {r["score"] for r in Q.classify(docs, spark.createDataFrame([], schema), held_out(5, 0)).collect()} == {0.5}
    none = docs.limit(0)
    assert Q.classify(none, spark.createDataFrame([(4, 1)], schema), held_out(5, 0)).count() == 0


def test_discriminant_equals_the_density_ratio():
    rng = np.random.default_rng(0)
    mean, cov = rng.normal(size=(2, 3)), np.stack([np.diag([1.0, 2, 3]), np.diag([2.0, 1, 0.5])])
    low = np.linalg.cholesky(cov)
    model = Q.Discriminant(np.log([0.3, 0.7]), mean, np.linalg.inv(low), np.log(np.linalg.det(cov)))
    x = rng.normal(size=(5, 3))

    def density(v, c):
        d = v - mean[c]
        return np.exp(-0.5 * d @ np.linalg.inv(cov[c]) @ d) / np.sqrt(np.linalg.det(2 * np.pi * cov[c]))

    want = [np.log(0.7 * density(v, 1) / (0.3 * density(v, 0))) for v in x]
    assert model.log_odds(x) == pytest.approx(want)


def test_the_fit_is_the_shrunk_gaussian_of_its_rows(spark):
    """Means, covariances, factors and scores once more from the rows themselves."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["Alpha", "be", "7", "x!", "längs.", "\n"]) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    labels = [(i, (i * 7) % 3 == 0) for i in range(80)]
    docs = documents(spark, texts)
    known = spark.createDataFrame([(i, int(y)) for i, y in labels], "doc_id long, label int")
    stats = Q.document_statistics(docs, held_out(5, 0))
    model = Q.fit(stats, known, to_pooled=0.3, to_sphere=0.1)
    kept = {r["doc_id"]: r["held_out"] for r in stats.collect()}
    x = np.array([Q.statistics(t) for _, t in texts])
    y = np.array([int(label) for _, label in labels])
    learn = np.array([not kept[i] for i, _ in texts])
    n = np.array([(y[learn] == c).sum() for c in (0, 1)])
    own = [np.cov(x[learn & (y == c)].T, bias=True) for c in (0, 1)]
    pooled = sum(n[c] * own[c] for c in (0, 1)) / n.sum()
    odds = []
    for c in (0, 1):
        cov = 0.6 * own[c] + 0.3 * pooled + 0.1 * np.diag(np.maximum(np.diag(pooled), 1e-9))
        away = x - x[learn & (y == c)].mean(axis=0)
        density = -0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1]
        odds.append(density + np.log(n[c] / n.sum()))
    want = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -700, 700)))
    got = {r["doc_id"]: r["score"] for r in Q.score(stats, model).collect()}
    assert [got[i] for i, _ in texts] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_shares_are_the_likeliest_mixture():
    """EM against a search over all shares of two and three languages; the set against trying every set."""
    rng = np.random.default_rng(8)
    for k in (2, 3):
        p = rng.dirichlet(np.ones(40) * 0.3, k).T + 1e-6
        truth = rng.dirichlet(np.ones(k))
        n = rng.multinomial(3000, (p @ truth) / (p @ truth).sum()).astype(float)
        pi, value = L.shares(p, n, rounds=2000)
        grid = np.array([g for g in np.ndindex(*[41] * k) if sum(g) == 40]) / 40
        best = max(float(n @ np.log(np.maximum(p @ g, 1e-300))) for g in grid)
        assert abs(pi.sum() - 1) < 1e-9 and value >= best - 1e-6


@pytest.mark.parametrize("text, letters", [
    ("😀😀", 0), ("𝟏𝟐", 0), ("🎉 1", 0), ("\U0010ffff \U000e0001", 0), ("½ ² _", 0), ("𠀀𠀁", 2), ("𝐀 b", 2), ("ª1", 1), ("é\u0301", 1),
])
def test_letters_of_all_planes(text, letters):
    assert sum(map(str.isalpha, text)) == letters
    slots, n = L.trigrams(text)
    assert n.sum() == letters
    model = L.Languages(["aa", "bb"], np.full((L.SLOTS, 2), -11.0))
    assert (L.named(text, model) == ("und", 0.0)) == (letters == 0)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = L.identify(docs, held_out(3, 1)).join(docs.select("doc_id", "lang", held_out(3, 1).alias("h")), "doc_id").collect()
    tested = [r for r in rows if r["h"]]
    assert len(rows) == docs.count() and len(tested) > 200
    assert np.mean([r["lang_pred"] == r["lang"] for r in tested]) >= 0.98


def test_mixtures_and_odd_texts(spark):
    rng = random.Random(1)
    learnt = [(i, speech(rng, lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    model = L.learn(documents(spark, [*learnt, (200, None, "zz"), (201, "x", None)]))
    assert model.names == ["aa", "bb", "cc"]
    for a, b, share in (("aa", "bb", 0.7), ("cc", "aa", 0.6)):
        text = speech(rng, a, int(100 * share)) + " " + speech(rng, b, int(100 * (1 - share)))
        best, _, found = L.infer(*[x.astype(float) if k else x for k, x in enumerate(L.trigrams(text))], model)
        assert model.names[best] == a and np.count_nonzero(found) == 2 and abs(found[best] - share) < 0.15
    one = L.infer(*[x.astype(float) if k else x for k, x in enumerate(L.trigrams(speech(rng, "bb", 50)))], model)
    assert model.names[one[0]] == "bb" and np.count_nonzero(one[2]) == 1 and one[1] > 0.99
    odd = {r["doc_id"]: r for r in L.predict(with_clashes(edge_documents(spark)), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4 and odd[1]["score"] == 0
    assert odd[6]["lang_pred"] in model.names and 0 <= odd[6]["score"] <= 1
    nothing = L.learn(documents(spark, learnt).limit(0))
    assert {r["lang_pred"] for r in L.predict(edge_documents(spark), nothing).collect()} == {"und"}
    assert L.predict(edge_documents(spark).limit(0), model).count() == 0


def test_trigrams_do_not_depend_on_the_block_size(monkeypatch):
    text = "Wörter und 日本 x1y " * 400
    whole = L.trigrams(text)
    monkeypatch.setattr(L, "BLOCK", 37)
    assert all(np.array_equal(a, b) for a, b in zip(whole, L.trigrams(text)))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def leaks(spark):
    rng = random.Random(4)
    bench = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(30))) for i in range(12)]
    noise = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    rows, want = [], set()
    for i in range(60):
        item, text = bench[i % 12]
        words = text.split()
        if i % 3 == 0:  # one word in six changed, one left out, one added
            for k in range(0, 30, 6):
                words[k] = "edited"
            words = words[:10] + ["added"] + words[10:20] + words[21:]
        if i % 4 != 3:
            want.add((i, item))
            rows.append((i, f"{noise(40)} {' '.join(words).upper()}. {noise(40)}"))
        else:
            rows.append((i, noise(120)))
    rows.append((70, noise(30_000) + " " + bench[3][1]))
    return bench, rows, want | {(70, 3)}


def test_exact_and_edited_copies_are_found_and_others_left(spark):
    bench, rows, want = leaks(spark)
    docs = with_clashes(edge_documents(spark, *[(i + 100, t) for i, t in rows], *[(170, rows[-1][1])]))
    want = {(i + 100, k) for i, k in want}
    for limit in (D.BROADCAST_BYTES, 600):  # one part of the benchmark, and several
        got = D.contaminated(docs, items(spark, [*bench, (90, None), (91, " ")]), broadcast_bytes=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
        assert all(0.5 <= r["similarity"] <= 1 for r in got)


def local_score(item, passage):
    """Smith-Waterman over words, cell by cell."""
    table = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            same = D.MATCH if a == b else D.MISMATCH
            table[i][j] = max(0, table[i - 1][j - 1] + same, table[i - 1][j] + D.GAP, table[i][j - 1] + D.GAP)
    return max(map(max, table))


def test_matches_are_those_of_aligning_all_with_all(spark):
    """Every document against every item, whole texts: a pair counts if they share a seed and align well enough."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 25)}"
    bench = [(i, " ".join(word() for _ in range(rng.randint(2, 9)))) for i in range(8)]
    rows = []
    for i in range(40):
        words = [word() for _ in range(rng.randint(0, 25))]
        if i % 2:
            copied = bench[i % 8][1].split()
            if i % 3 == 0 and len(copied) > 4:
                copied[rng.randrange(len(copied))] = "edit"
            at = rng.randint(0, len(words))
            words = words[:at] + copied + words[at:]
        rows.append((i, " ".join(words)))
    grams = lambda words: [tuple(words[k : k + min(3, len(words))]) for k in range(len(words) - min(3, len(words)) + 1)]
    inside = lambda gram, words: any(tuple(words[k : k + len(gram)]) == gram for k in range(len(words)))
    texts = {i: t.split() for i, t in rows}
    want = {}
    for item_id, text in bench:
        item = text.split()
        counts = [sum(inside(g, words) for words in texts.values()) for g in grams(item)]
        middle = sorted(counts)[(len(counts) - 1) // 2]
        chosen = [g for g, n in zip(grams(item), counts) if n <= D.RARE * (middle + 1) + D.SLACK]
        for i, words in texts.items():
            score = local_score(item, words) / (D.MATCH * len(item))
            if any(inside(g, words) for g in chosen) and score >= D.SIMILARITY:
                want[i, item_id] = score
    got = {(r[0], r[1]): r[2] for r in D.contaminated(documents(spark, rows), items(spark, bench)).collect()}
    assert got == pytest.approx(want) and len(want) > 20


def test_a_passage_in_every_document_still_has_seeds(spark):
    item = "a passage that every document of this corpus has copied word by word"
    docs = documents(spark, [(i, f"text {i} {item} end") for i in range(30)])
    assert D.contaminated(docs, items(spark, [(1, item), (2, "short one"), (3, item)])).count() == 60
    assert D.contaminated(docs, items(spark, [(2, "TEXT 5")])).collect()[0]["doc_id"] == 5
    assert D.contaminated(docs, items(spark, [])).count() == 0
    assert D.contaminated(docs.limit(0), items(spark, [(1, item)])).count() == 0


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(7)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                score = D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + score, h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
        assert D.alignment(a, b) == h.max()

"""Packing: ids as the tokenizer gives them, gapless sequences, few of them."""

import zlib

import numpy as np
import pytest
from edge import documents, edge_documents, with_clashes
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pulsetrace.llm import packing as P

TEXTS = [
    "", "plain words, and more", "a<|endoftext|>b", "日本語 text ١٢", "x y  z\n\n\n q's I'LL we'll", " nbsp 　 \t\n a",
    "ſtrange ﬁ Ǆ ʰ", "emoji 😀 ok", "é́ combining", "1234 ²³½ Ⅷ", "\n\n\n", "   ", "a\r\n\r\nb \x0b\x0c c", "tab\t\tend\n",
    "***!!! $$$ word*** _x_", "'s't'S 'd", "\x00\x1c\x1d\x1f\x85 control",
    "\n\n\x1cs!1a! \x0b's", "1\t\t\t.\x1f'sb", "a \x1e b\x1d\x1c",
]


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder.load(P.vocabulary_path(), P.vocabulary_path("byte_bpe_50k.tiktoken"))


def test_ids_are_those_of_the_tokenizer(encoder, monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    texts = TEXTS + [r["text"] for r in docs]
    want = [encoder.reference.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    for known in (P._KNOWN, 50):
        monkeypatch.setattr(P, "_KNOWN", known)
        got = [ids for at in range(0, len(texts), 7) for ids in encoder.encode(texts[at : at + 7])]
        assert [g.tolist() for g in got] == want


@settings(max_examples=1000, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(st.sampled_from("ab's1 \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0.!éß²😀中"), max_size=14))
def test_ids_of_odd_texts(encoder, text):
    assert encoder.encode([text])[0].tolist() == encoder.reference.encode(text, add_special_tokens=False).ids + [0]


def least_bins(lengths, capacity):
    """The smallest number of bins, by trying every placement (largest first, equal rooms once)."""
    order, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= order[i]}:
            left = list(rooms)
            left.remove(room)
            place(i + 1, left + [room - order[i]])
        place(i + 1, [*rooms, capacity - order[i]])

    place(0, [])
    return best[0]


def test_small_shards_need_as_few_sequences_as_any_placement():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = np.sort(rng.integers(5, 60, 9))[::-1]
        shard = P.Shard(lengths, 100)
        best = shard.evolve(shard.start(rng, 6), rng, 60)[0]
        assert len(best) == least_bins(lengths.tolist(), 100)


def checked(rows, encoder, docs, capacity):
    """Every document whole, in order, and every sequence gapless and within capacity."""
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    of = {}
    for r in rows:
        of.setdefault((r["doc_id"], r["copy"]), []).append(r)
    assert sorted(str(k[0]) for k in of) == sorted(str(i) for i, t in texts.items() for _ in t)
    for (doc_id, _), parts in of.items():
        ids = encoder.encode([texts[doc_id][0]])[0]
        at = 0
        for n, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            piece = ids[at : at + r["length"]]
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(piece.astype("<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1])
        assert sum(n for _, n in parts) <= capacity
    return len(sequences)


def test_documents_are_packed_whole(spark, encoder):
    rng = np.random.default_rng(3)
    many = [(i + 100, " ".join("word" for _ in range(rng.integers(1, 300)))) for i in range(300)]
    docs = with_clashes(edge_documents(spark, *enumerate(TEXTS, 50), *many))
    for shard, capacity in ((P.SHARD, 512), (40, 512)):
        rows = P.pack_documents(docs, capacity=capacity, shard=shard).collect()
        n = checked(rows, encoder, docs, capacity)
        assert n <= 1.02 * sum(r["length"] for r in rows) / capacity + 2
    assert P.pack_documents(docs.limit(0)).count() == 0


def test_pieces_can_carry_their_ids(spark, encoder):
    found = P.pieces(documents(spark, [(1, "a b c d e f")]), capacity=4, keep_ids=True).collect()
    whole = [i for r in sorted(found, key=lambda r: r["piece"]) for i in r["ids"]]
    assert whole == encoder.encode(["a b c d e f"])[0].tolist() and [len(r["ids"]) for r in found] == [3, 4]


def test_moves_keep_every_piece_once():
    rng = np.random.default_rng(1)
    shard = P.Shard(np.sort(rng.integers(1, 2048, 300))[::-1], 2048)
    groups = shard.start(rng, 4)
    worst = len(groups[0])
    for _ in range(10):
        child = shard.mutate(shard.cross(groups[0], groups[1], rng), rng)
        assert sorted(i for b in child for i in b) == list(range(300))
        assert all(shard.fill(b) <= 2048 for b in child)
        groups = [child, *groups[:3]]
    best = shard.evolve(shard.start(rng, 4), rng, 20)[0]
    assert shard.bound() <= len(best) <= worst
    assert P._decode(P._encode([best], 300)[0]) == [sorted(b) for b in best]

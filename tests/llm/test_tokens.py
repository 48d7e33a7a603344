"""Token counts against the library's own count of every whole text."""

import random
from functools import cache

from edge import LONG, documents, edge_documents, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsetrace.llm import tokens as T
from tokenizers import Tokenizer


@cache
def library():
    return Tokenizer.from_file(T.vocabulary_path())


def plain(text):
    return len(library().encode(text or "", add_special_tokens=False).ids)


@cache
def lengths():
    return T.Lengths(T.vocabulary_path())


ODD = st.text(st.one_of(
    st.sampled_from("ab's tdlmrev12 \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　'.!?<|>éßªº²½̀😀中а"), st.characters()
), max_size=30)


@settings(max_examples=1500, deadline=None)
@given(ODD)
def test_counts_of_odd_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert lengths().counts([text]) == [plain(text)]


def test_pre_tokens_are_the_library_s_for_plain_texts():
    rng = random.Random(1)
    marks = ["'s", "'ll", " ", "  ", "\n", "\t ", "\x1c", "\x1f", "x", "É", "7", "!", "'", "\x0b", "\x00", "_", "ɏ"]
    for _ in range(20_000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 9)))
        parts = [text[a:b] for _, (a, b) in library().pre_tokenizer.pre_tokenize_str(text)]
        assert T._PRE_TOKEN.findall(text) == parts, text


def test_special_strings_count_once():
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "é中<|endoftext|> x"):
        assert lengths().counts([text]) == [plain(text)]


def test_long_pre_tokens_are_not_remembered():
    counter = T.Lengths(T.vocabulary_path())
    for text in ("a" * 100_000, " " * 100_000, "x" * 33 + " y"):
        assert counter.counts([text]) == [plain(text)]
        assert all(len(w) <= T.LONGEST for w in counter.known)


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    counter = T.Lengths(T.vocabulary_path())
    counter.use({" two": 1})
    for text in ("one two three four", "five six seven", "one two"):
        assert counter.counts([text]) == [plain(text)]
        assert len(counter.known) <= 6 and " two" in counter.known


def test_frequent_pre_tokens_of_all_tasks(spark):
    docs = documents(spark, [(i, "the rare%d the the word" % i) for i in range(300)])
    table = {r["word"]: r["tokens"] for r in T.frequent(docs, T.vocabulary_path(), size=3).collect()}
    assert len(table) == 3 and " the" in table and " word" in table
    assert all(n == plain(w) for w, n in table.items())


def test_rows(spark):
    docs = edge_documents(spark, (20, "中文 <|endoftext|> é"), (21, LONG))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), plain(r["text"]), plain(r["text"]) > 512)
                   for r in docs.collect()), key=str)
    assert sorted(map(tuple, T.count_tokens(with_clashes(docs)).collect()), key=str) == want
    assert sorted(map(tuple, T.count_tokens(docs, size=2).collect()), key=str) == want
    assert T.count_tokens(docs.limit(0)).count() == 0

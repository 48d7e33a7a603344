"""Personal data: base spans, disguises, offsets, redaction."""

import re
import time

import pytest
from edge import LONG, edge_documents, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsetrace.llm import pii as P

DISGUISED = {
    "write john.doe [at] example (dot) com now": [("email", "john.doe [at] example (dot) com")],
    "jane at site dot org answers": [("email", "jane at site dot org")],
    "j.d (AT) mail1 [DOT] example [dot] com": [("email", "j.d (AT) mail1 [DOT] example [dot] com")],
    "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ": [("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")],
    "pаul@exаmple.com": [("email", "pаul@exаmple.com")],
    "call plus one five five five one two three four five six seven": [
        ("phone", "plus one five five five one two three four five six seven")],
    "+1 (five five five) 123-4567 x": [("phone", "+1 (five five five) 123-4567")],
    "at 10 dot 0 dot 0 dot 1 it is": [("ip", "10 dot 0 dot 0 dot 1")],
    "four one one one 1111 1111 one one one one": [("card", "four one one one 1111 1111 one one one one")],
    "quatre un un un 1111 1111 un un un un": [("card", "quatre un un un 1111 1111 un un un un")],
}
CLEAN = [
    "He looked at the dot com bubble at length.", "one two three", "at home dot and dash", "un deux trois quatre",
    "the one at the top (at noon) went home", "1.2.3 and 4.5.6", "4111 1111 1111 1112", "+12 345", "a@b", "@x.com",
]


@pytest.mark.parametrize("text", DISGUISED)
def test_disguised_identifiers_map_back_to_the_source(text):
    base, spans = P.find_all(text)
    assert base == [] and [(P.KINDS[k], text[a:b]) for a, k, b in spans] == DISGUISED[text]
    assert not any(text[a:b] in P.redact(text) for a, _, b in spans)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_left_alone(text):
    assert P.find_all(text) == ([], []) and P.redact(text) == text


@pytest.mark.parametrize("text, found", [
    ("write to alice at example.com", "alice at example.com"), ("alice @ example.com", "alice @ example.com"),
    ("é alice  at mail.example.com", "alice  at mail.example.com"), ("john@mail dot com", "john@mail dot com"),
    ("é one\u2003two\u2003three 4111 1111 1111 1111", None),
])
def test_what_is_found_does_not_depend_on_the_rest_of_the_text(text, found):
    base, spans = P.find_all(text)
    if found:
        assert base == [] and [(P.KINDS[k], text[a:b]) for a, k, b in spans] == [("email", found)]
    for other in ("\n a point", "\n [at]", "\n\u00a0", "\n nought zero oh"):
        assert P.find_all(text + other) == (base, spans)


@pytest.mark.parametrize("text, part", [
    ("jоhn@example.com", "hn@example.com"), ("john@mail.cоm", "john@mail.c"), ("a\u200bb@ex.com", "b@ex.com"),
])
def test_a_partly_disguised_address_is_found_and_redacted_whole(text, part):
    base, spans = P.find_all("to " + text + " now")
    found = lambda some: [("to " + text)[a:b] for a, _, b in some]
    assert found(base) == [part] and sorted(found(spans)) == sorted([part, text])
    assert P.redact("to " + text + " now") == "to [EMAIL] now"


def test_rows_hold_the_wider_span_and_count_the_base_one(spark):
    (r,) = P.detect_pii(spark.createDataFrame([(1, "jоhn@example.com")], "doc_id long, text string")).collect()
    assert (r["n_email"], r["spans"]) == (1, "email:0:16,email:2:16")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "a@b.co", "4111 1111 1111 1111", "10.0.0.1", ".", " ", "7", "@", "x", "one ", " dot ", " at ", "[at]", "о", "\u200b", "com",
]), max_size=12).map("".join))
def test_added_spans_are_skipped_only_inside_a_base_span(text):
    base, spans = P.find_all(text)
    assert base == brute(text) and set(base) <= set(spans)
    for a, kind, b in set(spans) - set(base):
        assert 0 <= a < b <= len(text) and not any(k == kind and s <= a and b <= e for s, k, e in base)


@pytest.mark.parametrize("kind, found", [
    *(("email", x) for x in (
        "bob at mail dot it", "bob at mail dot nl", "bob at mail dot ch", "bob at mail dot ai", "bob at mail dot museum",
        "juan arroba correo punto es", "juan punto paz arroba correo punto museum", "uwe at post punkt ch",
        "jean point roux arobase poste point fr", "jean point roux at poste point ch", "bob at mail.nl", "bob @ mail.museum",
    )),
    ("phone", "+1 555 123 45 six seven"), ("phone", "plus 1 555 123 45 six seven"), ("phone", "+1 555 123 45 6 sieben"),
    ("ip", "10.0.0.one"), ("ip", "10 dot 0 dot zero dot one"), ("card", "4111 1111 1111 111 one"),
])
def test_spoken_identifiers_in_other_languages_and_with_few_digit_words(kind, found):
    text = "é; " + found + " ok"
    base, spans = P.find_all(text)
    assert (kind, found) in [(P.KINDS[k], text[a:b]) for a, k, b in spans if (a, k, b) not in base]
    assert found not in P.redact(text)


@pytest.mark.parametrize("text", [
    "He was at one point in charge.", "We met at some point so it is.", "I looked at home.It was late.",
    "In 2019, one of 300 came", "10.5 or one 7", "She is at home dot and dash", "one point 5 and two",
])
def test_prose_with_the_same_words_is_left_alone(text):
    assert P.find_all(text) == ([], [])


def test_a_digit_word_after_an_address_is_not_part_of_it():
    for text in ("10.0.0.1, one more", "10.0.0.1 one more"):
        assert P.redact(text) == "[IP]" + text[8:]


def brute(text):
    """The base rules, every kind on its own, without any shortcut."""
    rules = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for place, (kind, rule) in enumerate(rules.items()):
        for m in re.finditer(rule, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and max(int(x) for x in m.group().split(".")) > 255:
                continue
            if kind == "card":
                double = [d if i % 2 == 0 else sum(map(int, str(2 * d))) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(double) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "a@b.co", "4111 1111 1111 1111", "+1 (383) 555-6083", "10.0.0.1", "300.1.1.1", ".", " ", "-", "7", "+", "@", "x",
    "one ", "dot ", " at ", "[at]", "(dot)", "é", "０", "​", "12345678901234567890", "com",
]), max_size=12).map("".join))
def test_base_spans_stay_and_redaction_takes_all_of_them(text):
    base, spans = P.find_all(text)
    assert base == brute(text) and set(base) <= set(spans)
    for start, kind, end in set(spans) - set(base):
        assert 0 <= start < end <= len(text)
        assert not any(k == kind and a <= start and end <= b for a, k, b in base)
    redacted = P.redact(text)
    assert all(k != kind or text[a:b] not in redacted or text.count(text[a:b]) > 1 for a, k, b in spans for kind in (0, 3))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([
    "a", "7", "0", ".", "a.", "7.", "@", "a@", "@a.", "+", "+1", "-", " ", "(", "[at]", "a@b.c", "1.1.1.1", "\u00a0", "one ", " dot ", "é",
]), st.integers(1, 60)), max_size=8).map(lambda parts: "".join(x * n for x, n in parts)))
def test_base_spans_of_long_runs(text):
    assert P.find_all(text)[0] == brute(text)


MILLION = 1_000_000


@pytest.mark.parametrize("text", [
    " " * MILLION + "(", "(" + " " * MILLION, "1" * MILLION, "a" * MILLION + " x@y", "a" * MILLION + "@", "@" * MILLION, "0" * MILLION + ".1.1.1",
    "x@" + "a" * MILLION, "1." * (MILLION // 2), "a." * (MILLION // 2) + "@", "x at " + "a." * (MILLION // 2), "+1" + " " * MILLION, "[" * MILLION,
    "1 " * (MILLION // 2) + "one", "at " * (MILLION // 3), "dot " * (MILLION // 4), " dot" + " " * MILLION + "x", "1" + " " * MILLION + "dot x", "plus" + " " * MILLION,
    "a@b.c " * (MILLION // 6) + "é [at]", "\u00a0" * (MILLION // 4) + "@", "one " * (MILLION // 4), "x at a" + " dot a" * (MILLION // 6),
    "jоhn@example.com " * (MILLION // 17), "a at " * (MILLION // 5), "x @" + " " * MILLION, "< at" * (MILLION // 4),
], ids=lambda text: repr(text[:12]))
def test_long_runs_take_linear_time(text):
    start = time.perf_counter()
    P.find_all(text)
    assert time.perf_counter() - start < 5


def test_rows(spark):
    docs = edge_documents(spark, (20, "Mail a@b.co or 10.0.0.1. " + LONG + "+1 (383) 555-6083"))
    rows = {r["doc_id"]: r for r in P.detect_pii(with_clashes(docs)).collect()}
    r = rows[20]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 1)
    assert r["spans"].startswith("email:5:11,ip:15:24" [:11]) and r["spans"].endswith(f":{25 + len(LONG) + 17}")
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert all(rows[i]["base_sha256"] == empty and rows[i]["spans"] == "" for i in (1, 2, 3, 5))
    assert P.detect_pii(docs).count() == docs.count() and P.detect_pii(docs.limit(0)).count() == 0


def test_redacted_documents_keep_their_columns(spark):
    docs = with_clashes(edge_documents(spark, (20, "Mail a@b.co now")))
    out = P.redact_documents(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    changed = out.where("doc_id = 20").first()
    assert changed["text"] == "Mail [EMAIL] now" and changed["n_chars"] == 16
    assert out.where("doc_id <> 20 OR doc_id IS NULL").exceptAll(docs).isEmpty()

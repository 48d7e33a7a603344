"""Token counts of whole texts by a two-tier lookup of pre-token lengths.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have
together. The first pass finds the frequent ones: every task sums up its own pre-tokens and
reports those that hold ``1 / SHARE`` of them, so what is frequent in all is reported by some task,
and no pre-token of a text is shuffled, only these short reports. The ``TABLE`` most frequent ones and
their lengths are broadcast. In the second pass a task looks every pre-token up in that table, then in
its worker's cache; the distinct misses of a batch are encoded in one call of the library. Both
tiers only save time: a count never depends on what they hold.

Texts of ASCII and Latin letters are split here, by the vocabulary's own pattern with its classes
written out; the library splits all others. A special string inside a text is one token, as the
library takes it by default.

Defined cases: null and empty text have no bytes and no tokens; repeated rows and null ids are
rows like any other; an empty table gives no rows; other columns are ignored; pre-tokens of more
than ``LONGEST`` characters are encoded where they occur and not remembered, so memory stays
bounded. Texts are read whole.
"""

import json
import os
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows

VOCABULARY = "byte_bpe_50k.json"
OVER = 512
TABLE = 1 << 15
SHARE = 50_000
LONGEST = 32
CACHE = 200_000
_HELD = 1 << 18  # pre-tokens a task counts before it drops those that are rare so far

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SIMPLE = re.compile(rf"[\x00-\x7f{_LETTERS}]*")
_PRE_TOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lengths:
    """Numbers of tokens of texts, from known pre-token lengths and the library for the others."""

    _loaded: dict[str, "Lengths"] = {}

    @classmethod
    def load(cls, path: str) -> "Lengths":
        """One per Python worker, whatever the number of its tasks."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, "rb") as file:
            held = json.load(file)
        form = held["pre_tokenizer"] or {}
        if form.get("type") != "ByteLevel" or form.get("add_prefix_space") or held.get("normalizer"):
            raise ValueError(f"{path}: pre-token lengths add up only for a plain byte-level vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in held["added_tokens"]):
            raise ValueError(f"{path}: special strings that take up their neighbours are not supported")
        self.special = [t["content"] for t in held["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.library = Tokenizer.from_file(path)
        self.table: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def use(self, table: dict[str, int]) -> None:
        """Take ``table`` as the first tier; the cache starts anew if it is another one."""
        if table is not self.table:
            self.table, self.known = table, dict(table)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if _SIMPLE.fullmatch(text):
            return _PRE_TOKEN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, special strings) of a whole text."""
        if not any(s in text for s in self.special):
            return self.split(text), 0
        parts = self.cut.split(text)
        return [w for part in parts for w in self.split(part)], len(parts) - 1

    def encoded(self, words: list[str]) -> list[int]:
        """Numbers of tokens of pre-tokens, by the library."""
        return [len(e) for e in self.library.encode_batch(words, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(t) for t in texts]
        new = set().union(*(words for words, _ in split)).difference(self.known)
        if len(self.known) + len(new) > len(self.table) + CACHE:
            self.known = dict(self.table)
            new = set().union(*(words for words, _ in split)).difference(self.known)
        long = [w for w in new if len(w) > LONGEST]
        order = [w for w in new if len(w) <= LONGEST] + long
        self.known.update(zip(order, self.encoded(order)))
        out = [sum(map(self.known.__getitem__, words)) + n for words, n in split]
        for w in long:
            del self.known[w]
        return out


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def frequent(docs: DataFrame, path: str, size: int = TABLE, share: int = SHARE) -> DataFrame:
    """(word, tokens) of at most ``size`` pre-tokens, the most frequent of those that a task reports."""

    def report(batches: Iterable[pa.RecordBatch]):
        lengths, held, total = Lengths.load(path), Counter(), 0
        for batch in batch_rows(batches):
            for text in _texts(batch):
                words = lengths.pre_tokens(text)[0]
                total += len(words)
                held.update(words)
            if len(held) > _HELD:
                held = Counter({w: n for w, n in held.items() if 2 * n * share >= total})
        found = [(w, n) for w, n in held.items() if n * share >= total and len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"]
        )

    def encode(batches: Iterable[pa.RecordBatch]):
        lengths = Lengths.load(path)
        for batch in batches:
            words = batch.column("word")
            tokens = pa.array(lengths.encoded(words.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([words, tokens], ["word", "tokens"])

    reports = docs.select("text").mapInArrow(report, "word string, n long")
    most = reports.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return most.select("word").mapInArrow(encode, "word string, tokens long")


def count_tokens(docs: DataFrame, over: int = OVER, path: str | None = None, size: int = TABLE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``path`` names a byte-level vocabulary of the ``tokenizers`` library that every worker can open.
    """
    path = path or vocabulary_path()
    held = frequent(docs, path, size).toArrow()
    table = dict(zip(held.column("word").to_pylist(), held.column("tokens").to_pylist()))
    sent = docs.sparkSession.sparkContext.broadcast(table)  # ``size`` words of ``LONGEST`` characters at most
    schema = arrow_schema(doc_id=pa.int64(), n_bytes=pa.int64(), n_tokens=pa.int64(), over_limit=pa.bool_())

    def rows(batches: Iterable[pa.RecordBatch]):
        lengths = Lengths.load(path)
        lengths.use(sent.value)
        for batch in batch_rows(batches, 128):
            texts = pc.fill_null(batch.column("text"), "")
            tokens = lengths.counts(texts.to_pylist())
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, pa.array(tokens, pa.int64()), pa.array([n > over for n in tokens])],
                schema=schema,
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

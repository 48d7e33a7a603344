"""Frequent phrases of every language by set-oriented mining over sorted occurrence relations.

An occurrence relation has one row per document: the places of its occurrences in ascending order (32-bit
numbers side by side), the words there (blanks between them), and marks where a known group starts. Places go on by one inside a piece and skip one between pieces, so two
occurrences are neighbours in a piece exactly if their places follow one another, and the merge-join
of a relation with itself on piece and adjacent place is one pass over a sorted row.

The relation of single words is written first. Its groups are counted; occurrences whose group is
frequent stay (semi-join), neighbours are joined to phrases of two words, counted, the frequent ones
kept and written as the next relation, and so on. Every task adds up its own groups, with exact
codes for its words, before anything is shuffled: a hot word or pair is one row per task.

The semi-join asks a bitmap of the groups' hashes, whose size does not grow with the input. It lets every frequent group pass and now and then a rare one, which the next exact count then
drops: a smaller share pruned costs work, never a row. Counts, parts and scores are exact; groups are told
apart by their words, not by hashes.

Defined cases: null and empty text have no words; a null language is ``und``, one with a text named
``und``; repeated rows count again; ties of scores go by count, then phrase bytewise; a language without
a candidate has no rows; an empty table gives none; other columns are ignored. Texts are read whole.
"""

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import among, bitmap
from .common import batch_rows, discard, settled

LEAST = 10
LONGEST = 3
PER_LANGUAGE = 2000
SCALE = 1_000_000
COVERED = 50  # hundredths of a phrase's count that a longer one must have to take its place
UNNAMED = "und"
_HELD = 1 << 19  # occurrences a task takes before it adds them up
_SENT = 1 << 16  # groups in a batch that it sends

# What ends a piece, and the letters A-Z.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"."
_FOLD = bytes(
    _MARK[0] if c in _ENDS else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)

RELATION = "lang string, at binary, word string, start binary"
GROUPS = "lang string, phrase string, n long"


def words_of(text: str) -> list[bytes]:
    """The words of a text, with a mark where a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(_MARK, b" . ").split()


def occurrences(docs: DataFrame) -> DataFrame:
    """The relation of single words: (lang, at, word, start), one row per text with a word."""

    def rows(batches: Iterable[pa.RecordBatch]):
        for batch in batch_rows(batches):
            parts, sizes = [], []
            for text in batch.column("text").to_pylist():
                found = words_of(text or "")
                parts += found
                sizes.append(len(found))
            words = pa.array(parts, pa.binary())
            kept = pc.not_equal(words, pa.scalar(_MARK, pa.binary())).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(parts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield _relation(
                batch.column("lang"), row[kept], at[kept], words.filter(pa.array(kept)), np.ones(int(kept.sum()), bool)
            )

    named = F.coalesce(F.col("lang").cast("string"), F.lit(UNNAMED)).alias("lang")
    return docs.select(named, "text").mapInArrow(rows, RELATION)


def _blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of ``sizes`` consecutive values each, as binary."""
    offsets = np.concatenate([[0], np.cumsum(sizes) * values.itemsize]).astype(np.int32)
    parts = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), parts)


def _values(blobs: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind)


def _relation(langs: pa.Array, row: np.ndarray, at: np.ndarray, words: pa.Array, start: np.ndarray) -> pa.RecordBatch:
    """Rows with occurrences, from flat columns; ``row`` is the place in ``langs``, ascending."""
    sizes = np.bincount(row, minlength=len(langs))
    some = np.flatnonzero(sizes)
    sizes = sizes[some]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), words)
    return pa.RecordBatch.from_arrays([
        langs.take(pa.array(some)), _blobs(at.astype(np.int32), sizes),
        pc.binary_join(lists.cast(pa.list_(pa.string())), " "), _blobs(start.astype(np.uint8), sizes),
    ], ["lang", "at", "word", "start"])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of groups from those of their language and their words."""
    h = langs
    for word in words:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)
    return h


def _names_hashed(names: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in names.to_pylist()], np.uint64)


class Rows:
    """Some rows of a relation, flat, with codes for languages and words.

    ``start`` marks where a known phrase begins; in the relation of single words, every word.
    """

    def __init__(self, batch: pa.RecordBatch):
        lists = pc.split_pattern(batch.column("word"), " ")
        flat = pc.dictionary_encode(lists.flatten())
        self.words, self.word = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        self.at = _values(batch.column("at"), np.int32)
        self.start = _values(batch.column("start"), np.uint8).astype(bool)
        self.row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
        langs = pc.dictionary_encode(batch.column("lang"))
        self.langs, self.lang_of_row = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
        self.lang = self.lang_of_row[self.row]

    @cached_property
    def lang_hash(self) -> np.ndarray:
        return _names_hashed(self.langs)

    @cached_property
    def word_hash(self) -> np.ndarray:
        return _names_hashed(self.words)

    def joined(self, length: int) -> np.ndarray:
        """Starts of phrases of ``length`` words: known shorter ones that begin at adjacent places of a piece."""
        if length == 1:
            return np.flatnonzero(self.start)
        one, other = slice(None, -1), slice(1, None)
        near = (self.row[one] == self.row[other]) & (self.at[one] + 1 == self.at[other])
        return np.flatnonzero(near & self.start[one] & self.start[other])

    def hashes(self, start: np.ndarray, length: int) -> np.ndarray:
        return _hashes(self.lang_hash[self.lang[start]], [self.word_hash[self.word[start + k]] for k in range(length)])

    def groups(self, start: np.ndarray, length: int) -> pa.RecordBatch:
        """(lang, phrase, n) of the groups that start there, each once."""
        codes = [self.lang[start], *(self.word[start + k] for k in range(length))]
        order = np.lexsort(codes[::-1])
        codes = [c[order] for c in codes]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        lang, *words = (d.take(pa.array(c[first])) for d, c in zip((self.langs, *[self.words] * length), codes))
        phrase = pc.binary_join_element_wise(*words, " ") if length > 1 else words[0]
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Rows]:
    """Rows in blocks of about ``_HELD`` occurrences."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("start"))).as_py() or 0
        if size >= _HELD:
            yield Rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, size = [], 0
    if size:
        yield Rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _count(relation: DataFrame, length: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of ``length`` words, with their exact counts."""

    def rows(batches: Iterable[pa.RecordBatch]):
        for block in _blocks(batches):
            yield from batch_rows([block.groups(block.joined(length), length)], _SENT)

    # A block sends a group once, so another combine in the map task would find little to do and hold much.
    dealt = relation.mapInArrow(rows, GROUPS).repartition("lang", "phrase")
    return dealt.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _groups_hashed(length: int):
    """Hashes of a batch of groups (lang, phrase) of ``length`` words."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        langs = pc.dictionary_encode(batch.column("lang"))
        words = pc.dictionary_encode(pc.split_pattern(batch.column("phrase"), " ").flatten())
        known = _names_hashed(words.dictionary)[words.indices.to_numpy()].reshape(-1, length)
        return _hashes(_names_hashed(langs.dictionary)[langs.indices.to_numpy()], list(known.T))

    return hashes


def frequent_occurrences(relation: DataFrame, groups: DataFrame, length: int) -> DataFrame:
    """The relation of phrases of ``length`` words that are among ``groups``.

    Rows keep the words that such a phrase covers, at their places, and mark where one starts.
    """
    known = bitmap(groups.select("lang", "phrase"), _groups_hashed(length))
    sent = relation.sparkSession.sparkContext.broadcast(known)

    def rows(batches: Iterable[pa.RecordBatch]):
        for block in _blocks(batches):
            found = block.joined(length)
            found = found[among(sent.value, block.hashes(found, length))]
            start = np.zeros(len(block.word), bool)
            start[found] = True
            stays = np.zeros(len(block.word), bool)
            for k in range(length):
                stays[found + k] = True
            langs = block.langs.take(pa.array(block.lang_of_row))
            words = block.words.take(pa.array(block.word[stays]))
            yield _relation(langs, block.row[stays], block.at[stays], words, start[stays])

    return relation.mapInArrow(rows, RELATION)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """For each length from 1 to ``longest``: (lang, phrase, n) of the phrases that occur ``least`` times.

    The first has all words, because their counts also add up to the words of a language.
    """
    relation, path = settled(occurrences(docs), "occurrences")
    counted = []
    for length in range(1, longest + 1):
        if length > 1:
            known = counted[-1].where(F.col("n") >= least)
            pruned, new = settled(frequent_occurrences(relation, known, length - 1), "occurrences")
            discard(docs.sparkSession, path)
            relation, path = pruned, new
        groups = _count(relation, length)
        counted.append(settled(groups if length == 1 else groups.where(F.col("n") >= least), "groups")[0])
    discard(docs.sparkSession, path)
    return counted


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a a / (left right)); products of 64-bit counts below 10^15 fit 38 digits."""
    wide = a.cast("decimal(15,0)")
    top = F.lit(SCALE).cast("decimal(7,0)") * wide * wide
    under = left.cast("decimal(18,0)") * right.cast("decimal(18,0)")
    return F.call_function("div", top, under)


def _part(words: Column, first: int, size: int) -> Column:
    """``size`` of the words from place ``first`` on, as a phrase."""
    return F.concat_ws(" ", F.slice(words, first, size))


def _scored(phrases: DataFrame, counted: list[DataFrame], length: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) by the cut with the lowest score, the earliest on a tie."""
    words = F.split("phrase", " ")
    rows = phrases.select("lang", "phrase", F.col("n").alias("a"))
    for k in range(1, length):
        for name, part, of in (
            (f"l{k}", _part(words, 1, k), k), (f"r{k}", _part(words, k + 1, length - k), length - k)
        ):
            counts = counted[of - 1].select("lang", F.col("phrase").alias("part"), F.col("n").alias(name))
            rows = rows.withColumn("part", part).join(counts, ["lang", "part"]).drop("part")
    cuts = F.array(*[
        F.struct(
            _score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
            F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
        ) for k in range(1, length)
    ])
    return rows.select("lang", "phrase", "a", F.array_min(cuts).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def _longer(counted: list[DataFrame], length: int) -> DataFrame:
    """(lang, phrase, most): for phrases of ``length`` words, the count of the most frequent longer one around them."""
    parts = None
    for more in range(length + 1, len(counted) + 1):
        inside = F.array(*[_part(F.split("phrase", " "), k, length) for k in range(1, more - length + 2)])
        found = counted[more - 1].select("lang", F.explode(inside).alias("phrase"), "n")
        parts = found if parts is None else parts.union(found)
    return parts.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, per_language: int = PER_LANGUAGE
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): every language's best phrases of 2 to ``longest`` words."""
    counted = mine(docs, least, longest)
    totals = counted[0].groupBy("lang").agg(F.sum("n").alias("n"))
    found = None
    counted[0] = counted[0].where(F.col("n") >= least)  # parts of a frequent phrase are frequent
    for length in range(2, longest + 1):
        rows = _scored(counted[length - 1], counted, length)
        if length < longest:
            rows = rows.join(_longer(counted, length), ["lang", "phrase"], "left")
            rows = rows.where(F.coalesce(100 * F.col("most") < COVERED * F.col("a"), F.lit(True))).drop("most")
        found = rows if found is None else found.unionByName(rows)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_language)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )

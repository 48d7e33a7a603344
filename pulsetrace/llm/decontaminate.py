"""Benchmark decontamination: rare n-gram seeds find passages, local alignment scores them.

Every item of the benchmark is cut into word n-grams. Their document frequency over the whole
corpus is counted; n-grams that are rare for their item (not far above its median) are its
seeds, so every item has seeds however often its passage was copied. A document that holds a seed is aligned with the item
(Smith-Waterman over words) around the hit, which gives a score also where words were
changed, added or left out. The score is divided by that of a whole copy.

Defined cases: null or wordless documents and items match nothing; an item shorter than an
n-gram is one n-gram; items with equal words match alike; repeated rows are reported once; an
empty benchmark or corpus gives no rows; other columns are ignored. Texts are read whole.

Scale: the benchmark is measured. Within ``BROADCAST_BYTES`` its words go to every task and
documents never move; beyond, it is cut into parts of that size and each part takes two passes
over the corpus, one for the frequencies and one that aligns. Only counts and matches are shuffled.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows, written

GRAM = 3
RARE, SLACK = 4.0, 16
SIMILARITY = 0.5
BROADCAST_BYTES = 16 * 1024 * 1024
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"[^\W_]+")
_BITS = 21  # bits of a word number inside a packed n-gram


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Items:
    """Benchmark items as word numbers, and the table of their packed n-grams."""

    def __init__(self, rows: list[tuple[int, str]], gram: int = GRAM):
        self.gram = gram
        self.numbers: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for item_id, text in rows:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                self.words.append(
                    np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)
                )
        packed = [self.packed(w) for w in self.words]
        at = [np.arange(len(p)) for p in packed]
        owner = np.repeat(np.arange(len(packed)), [len(p) for p in packed]).astype(np.int64)
        flat = np.concatenate(packed) if packed else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.owner, self.place = owner[order], (np.concatenate(at) if at else flat)[order]
        self.last = np.append(self.first[1:], len(flat))

    def packed(self, numbers: np.ndarray) -> np.ndarray:
        """Every n-gram as one number; shorter sequences are one n-gram."""
        size = min(self.gram, len(numbers))
        out = np.zeros(len(numbers) - size + 1, np.int64)
        for k in range(size):
            out = (out << _BITS) | numbers[k : len(numbers) - size + 1 + k]
        return out

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the document, places in ``grams``) of n-grams of the benchmark."""
        found_at, found = [], []
        for size in sorted({min(self.gram, len(w)) for w in self.words}):
            known = numbers > 0
            n = len(numbers) - size + 1
            if n <= 0:
                continue
            whole = known[:n].copy()
            for k in range(1, size):
                whole &= known[k : n + k]
            at = np.flatnonzero(whole)
            gram = np.zeros(len(at), np.int64)
            for k in range(size):
                gram = (gram << _BITS) | numbers[at + k]
            place = np.searchsorted(self.grams, gram)
            place[place == len(self.grams)] = 0
            same = self.grams[place] == gram
            found_at.append(at[same])
            found.append(place[same])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)

    def number(self, text: str | None) -> np.ndarray:
        get = self.numbers.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)


def alignment(item: np.ndarray, passage: np.ndarray) -> int:
    """Smith-Waterman score of two sequences of word numbers, one row of the table at a time."""
    steps = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best = 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        new = np.maximum(np.maximum(new, row + GAP), 0)
        # Gaps along the row: the best of what lies to the left, less its distance.
        row = np.maximum(np.maximum.accumulate(new + steps) - steps, 0)
        best = max(best, int(row.max()))
    return best


def _windows(at: np.ndarray, place: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Passages (start, end) around seed hits of one item, overlapping ones joined."""
    slack = length // 4 + 4
    start = np.sort(at - place - slack)
    first = 0
    for i in range(1, len(start) + 1):
        if i == len(start) or start[i] > start[i - 1] + length + 2 * slack:
            yield max(int(start[first]), 0), int(start[i - 1]) + length + 2 * slack
            first = i


def _parts(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of at most ``limit`` bytes; one item is never cut."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.where("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    size = F.octet_length("text") + 16
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = -(-total // limit) or 1
    if parts == 1:
        yield [tuple(r) for r in items.orderBy("item_id", "text").collect()]
        return
    # Half-full on average, so that uneven hashing stays near the limit.
    kept = written(items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(2 * parts))), "items")
    for part in range(2 * parts):
        yield [tuple(r) for r in kept.where(F.col("part") == part).drop("part").collect()]


def seeds(items: Items, df: np.ndarray, rare: float = RARE) -> np.ndarray:
    """Which occurrences of n-grams in items are seeds: those not far more frequent than the item's median.

    Copies raise the frequency of all n-grams of an item alike, edited ones less that of the n-grams
    they change; so the measure is the item itself, and at least half of its n-grams are seeds.
    """
    gram = np.repeat(np.arange(len(items.grams)), items.last - items.first)
    order = np.lexsort((df[gram], items.owner))
    size = np.bincount(items.owner, minlength=len(items.ids))
    middle = np.cumsum(size) - size + (size - 1) // 2
    median = df[gram][order][middle]
    return df[gram] <= rare * (median[items.owner] + 1) + SLACK


def _document_frequency(docs: DataFrame, shared, size: int) -> np.ndarray:
    """Rows whose text holds each n-gram of the benchmark, over all rows; a task sends a number per n-gram it has met."""

    def count(batches):
        items = shared.value
        met = np.zeros(size, np.int64)
        for batch in batch_rows(batches):
            for text in batch.column("text").to_pylist():
                met[np.unique(items.hits(items.number(text))[1])] += 1
        gram = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(met[gram])], ["gram", "n"])

    counted = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    df = np.zeros(size, np.int64)
    for gram, n in counted.collect():  # at most the n-grams of this part of the benchmark
        df[gram] = n
    return df


def _matches(docs: DataFrame, shared, chosen: np.ndarray, similarity: float) -> DataFrame:
    """(doc_id, item_id, similarity): stretches of documents that hold a seed of an item, scored by alignment.

    A stretch lies around all hits of the item that are near each other, and is aligned if one of them is a seed;
    nothing else leaves the task.
    """
    schema = arrow_schema(doc_id=pa.int64(), item_id=pa.int64(), similarity=pa.float64())

    def align(batches):
        items = shared.value
        for batch in batch_rows(batches):
            out = ([], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                numbers = items.number(text)
                at, gram = items.hits(numbers)
                if not len(at):
                    continue
                n = items.last[gram] - items.first[gram]
                entry = np.repeat(items.first[gram] - np.cumsum(n) + n, n) + np.arange(n.sum())
                at, owner, place, seed = np.repeat(at, n), items.owner[entry], items.place[entry], chosen[entry]
                for item in np.unique(owner[seed]):
                    own = owner == item
                    where, words = at[own], items.words[item]
                    for a, b in _windows(where, place[own], len(words)):
                        if not seed[own][(where >= a) & (where < b)].any():
                            continue
                        best = alignment(words, numbers[a:b]) / (MATCH * len(words))
                        if best >= similarity:
                            for values, value in zip(out, (doc_id, items.ids[item], best)):
                                values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema
            )

    return docs.mapInArrow(align, "doc_id long, item_id long, similarity double")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    gram: int = GRAM,
    rare: float = RARE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, item_id, similarity) of every document that holds a copy of an item, edited or not."""
    if not 1 <= gram * _BITS <= 63:
        raise ValueError("gram must be 1, 2 or 3")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for rows in _parts(benchmark, broadcast_bytes):
        items = Items(rows, gram)
        if not items.ids:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(items)  # at most ``broadcast_bytes`` of text
        chosen = seeds(items, _document_frequency(source, shared, len(items.grams)), rare)
        part = written(_matches(source, shared, chosen, similarity), "matches")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double")
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))

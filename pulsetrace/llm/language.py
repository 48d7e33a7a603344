"""Language identification as a mixture: each document has shares of the learned languages.

Every language is a distribution over hashed character trigrams, counted over all training
text. Expectation-maximisation finds a document's language shares under those fixed
distributions; the set of languages is the one with the best penalised likelihood, the
likelihood being divided by three because neighbouring trigrams share characters.

Defined cases: text that is null, empty or without a letter is ``und`` with score 0; with nothing
to learn from, every document is ``und``; ties go to the language first in order; null languages
are not learned; repeated rows score alike; an empty table gives no rows; other columns are ignored.
Texts are read whole, in blocks of a million characters.
"""

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows

UNKNOWN = "und"
SLOTS = 1 << 16
BLOCK = 1 << 20
_SMOOTHING = 0.1
_DEPENDENCE = 3.0
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points of all planes are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool))
    return _LETTER[0]


def _slots(text: str) -> Iterator[np.ndarray]:
    """Trigram slots (uint16) around every letter; other characters count as one mark."""
    letter = _letters()
    for at in range(0, max(len(text), 1), BLOCK):
        block = text[max(at - 1, 0) : at + BLOCK + 1].lower()
        code = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letter[code]
        code = np.concatenate([[0], np.where(is_letter, code, 0), [0]]).astype(np.uint32)
        mixed = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA6B))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) + code[2:] * np.uint32(0x27D4EB2F)
        slots = ((mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x165667B1) >> np.uint32(16)).astype(np.uint16)
        keep = is_letter.copy()
        if at:
            keep[0] = False
        if at + BLOCK < len(text):
            keep[-1] = False
        yield slots[keep]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of a text; empty when it has no letter."""
    parts = list(_slots(text))
    if sum(map(len, parts)) > SLOTS:
        counts = sum(np.bincount(p, minlength=SLOTS) for p in parts)
        found = np.flatnonzero(counts)
        return found, counts[found]
    all_slots = np.sort(np.concatenate(parts))
    if not len(all_slots):
        return all_slots, all_slots
    first = np.flatnonzero(np.concatenate([[True], all_slots[1:] != all_slots[:-1]]))
    return all_slots[first], np.diff(np.append(first, len(all_slots)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush():
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                ["lang", "slot", "n"],
            )
        held.clear()

    for batch in batch_rows(batches):
        parts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            parts.setdefault(lang, []).extend(_slots(text))
        for lang, slots in parts.items():
            counts = np.bincount(np.concatenate(slots), minlength=SLOTS)
            held[lang] = held[lang] + counts if lang in held else counts
        if len(held) > 64:
            yield from flush()
    yield from flush()


@dataclass
class Languages:
    """Names in order and the log probability of each slot in each language."""

    names: list[str]
    log_p: np.ndarray  # slots x languages


def learn(training: DataFrame) -> Languages:
    """From (text, lang). What reaches the driver is one number per language and slot."""
    rows = training.select("text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot")
    found = counted.agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    counts = np.zeros((SLOTS, len(names)))
    counts[found["slot"], found["lang"].map({x: i for i, x in enumerate(names)})] = found["n"]
    total = counts.sum(axis=0) + _SMOOTHING * SLOTS
    return Languages(names, np.log((counts + _SMOOTHING) / total))


def shares(p: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """EM for the proportions of the columns of ``p``; (proportions, log likelihood)."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        new = pi * ((n / (p @ pi)) @ p) / total
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, float(n @ np.log(p @ pi))


def infer(slots: np.ndarray, n: np.ndarray, model: Languages) -> tuple[int, float, np.ndarray]:
    """(best language, score, shares of all languages) of a document with letters."""
    log_p = model.log_p[slots]
    alone = n @ log_p
    best = int(np.argmax(alone))
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(log_p - top)  # the scale of a row is common to all languages
    shift = float(n @ top[:, 0])
    found = np.zeros(len(model.names))
    found[best] = 1.0
    gain = alone[best] / _DEPENDENCE
    size = max(n.sum() / _DEPENDENCE, 2.0)
    if len(model.names) > 1:
        order = np.argsort(-shares(p, n)[0], kind="stable")
        for k in range(2, len(order) + 1):
            pi, likelihood = shares(p[:, order[:k]], n)
            value = (likelihood + shift) / _DEPENDENCE - 0.5 * (k - 1) * np.log(size)
            if value <= gain:
                break
            gain = value
            found = np.zeros(len(order))
            found[order[:k]] = pi
    winner = int(np.argmax(found))
    rest = np.delete(alone, winner)
    sure = 1.0
    if len(rest):
        gap = (alone[winner] - rest.max()) / _DEPENDENCE if winner == best else 0.0
        sure = 1 / (1 + np.exp(-min(gap, 700.0)))
    return winner, float(min(found[winner] * sure, 1.0)), found


def named(text: str | None, model: Languages) -> tuple[str, float]:
    """(language, score) of a text."""
    slots, n = trigrams(text or "")
    if not len(slots) or not model.names:
        return UNKNOWN, 0.0
    best, value, _ = infer(slots, n.astype(float), model)
    return model.names[best], value


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, lang_pred, score) for every document, from its text alone."""
    schema = arrow_schema(doc_id=pa.int64(), lang_pred=pa.string(), score=pa.float64())
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 65,536 numbers per language

    def rows(batches):
        model = sent.value
        for batch in batch_rows(batches):
            found = [named(text, model) for text in batch.column("text").to_pylist()]
            names, scores = [name for name, _ in found], [score for _, score in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                schema=schema,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, lang_pred string, score double"
    )


def keep_identified(docs: DataFrame, model: Languages) -> DataFrame:
    """The rows of ``docs`` whose language is not ``und``, all columns; no score is too low."""

    sent = docs.sparkSession.sparkContext.broadcast(model)  # 65,536 numbers per language

    def rows(batches):
        model = sent.value
        for batch in batch_rows(batches):
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            keep = [named(text, model)[0] != UNKNOWN for text in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def identify(docs: DataFrame, held_out) -> DataFrame:
    """Learn from the documents outside ``held_out`` and predict all of ``docs``."""
    return predict(docs, learn(docs.where(~held_out)))

"""Repeated passages by a logarithmic family of sparse suffix arrays.

Every ``MATCH``-byte window of a text names one suffix: the one at the smallest hash among the
``GRAM``-byte grams inside the window (leftmost on ties). Equal windows name equal places, so the
named suffixes are enough to find every match, and they are some three in a hundred of all.
A suffix stands for the run of windows that name it; its entry holds the hash of its gram
(the sort key), a hash of all bytes of that run (its context), and its place.

A batch of documents becomes an array of entries sorted by key, context and place. It is merged
with the arrays of the existing levels in one scan: the first entry of a context stays, the windows
of the later ones are repeats. Where a key has several contexts, the contexts themselves are read back
from the texts and compared window by window. After a batch its array is a level of its own; before
the next one, levels of equal size are merged, so ``n`` batches leave about log2(n) levels. Only those
entries of a level come to a scan whose key a bitmap of the new batch's keys does not rule out.

Arrays are in the order of the hash of a suffix's first ``GRAM`` bytes, not of the bytes: matches ask which suffixes
begin alike, never which is the lesser, and the order of bytes would send some hundred bytes per entry
through every sort. Equal keys and contexts, 128 bits together, count as equal bytes.

Entries of one map task are combined before the shuffle: of equal contexts only the first is
sent, so a passage in a third of all documents sends one entry per task. A key with more than
``GROUP`` contexts is not gathered; its windows become entries of their own, combined in the same way, and
take the same scan. Each table goes when the one made from it is complete, and shuffle files go with it.

Defined cases: null text counts as empty; texts shorter than ``MATCH`` keep all bytes; of repeated
rows the first stays; rows that share an id, and null ids (after all others), are ordered by text
and then arbitrarily among equals; an empty table gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import among, bitmap
from .common import arrow_schema, batch_rows, discard, numbered, settled

MATCH = 100
GRAM = 32
GROUP = 2048
BATCHES = 4
_ENTRIES = 1 << 19  # entries a task holds before it combines them
_BLOCK = 1 << 16

_rng = np.random.default_rng(20)
_BYTES = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1 << 17), _powers(_INVERSE, 1 << 17)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of every gram, in order: ``_hashes`` of all of them with slices for places."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTES[0][x] * _UP[: len(x)], out=sums[1:])
    h = sums[GRAM:] - sums[:-GRAM]
    h *= _DOWN[: len(h)]
    h += np.uint64(GRAM)
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(29)
    return h


def _hashes(x: np.ndarray, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of ``x[start:stop]`` for each pair, from running sums over a block of bytes."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTES[which][x] * _UP[: len(x)], out=sums[1:])
    return _mix((sums[stop] - sums[start]) * _DOWN[start] + (stop - start).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours: running minima inside blocks, from both sides."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


_PLACE = np.uint64((1 << 17) - 1)  # places in a block of windows, the low bits beside a hash
_PLACES = np.arange(1 << 17, dtype=np.uint64)


def _named(h: np.ndarray) -> np.ndarray:
    """The place that each window names, from the hashes of all grams."""
    least = _least((h & ~_PLACE) | _PLACES[: len(h)], MATCH - GRAM + 1)
    least &= _PLACE
    return least.view(np.int64)


def entries(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, first window, further windows) of the suffixes that a text's windows name.

    Long texts are read in blocks of windows; a run that a block border cuts is two entries
    with contexts of their own, at places that depend on the text alone up to that border. Runs of
    the same bytes cut differently share their key and are told apart window by window.
    """
    whole = np.frombuffer(text, np.uint8)
    out = []
    for at in range(0, len(whole) - MATCH + 1, _BLOCK):
        x = whole[at : at + _BLOCK + MATCH - 1]
        h = _gram_hashes(x)
        named = _named(h)
        first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
        last = np.append(first[1:], len(named)) - 1
        out.append((h[named[first]], _hashes(x, 1, first, last + MATCH), first + at, last - first))
    if not out:
        empty = np.empty(0, np.uint64)
        return empty, empty, empty.astype(np.int64), empty.astype(np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


_CHUNK = 1 << 16  # bytes of texts side by side


def entries_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(number of the text, key, context, first window, further windows) for several texts.

    Short texts are taken side by side, which spares work per text and changes no entry: hashes do not depend on
    places, and windows across a border between texts are left out.
    """
    out, chunk, size = [], [], 0

    def together():
        sizes = np.array([len(texts[i]) for i in chunk])
        x = np.frombuffer(b"".join(texts[i] for i in chunk), np.uint8)
        start = np.cumsum(sizes) - sizes
        h = _gram_hashes(x)
        named = _named(h)
        windows = sizes - MATCH + 1
        text = np.repeat(np.arange(len(chunk)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        place = at + start[text]
        named = named[place]
        new = np.ones(len(place), bool)
        new[1:] = (named[1:] != named[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        out.append((
            np.array(chunk)[text[first]], h[named[first]], _hashes(x, 1, place[first], place[last] + MATCH), at[first], last - first
        ))

    for i, text in enumerate(texts):
        if len(text) < MATCH:
            continue
        if len(text) > _BLOCK:
            found = entries(text)
            out.append((np.full(len(found[0]), i), *found))
            continue
        if chunk and size + len(text) > _CHUNK:
            together()
            chunk, size = [], 0
        chunk.append(i)
        size += len(text)
    if chunk:
        together()
    if not out:
        empty = np.empty(0, np.int64)
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    return tuple(np.concatenate(c) for c in zip(*out))


def _raw(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()


ENTRY = "key long, context long, doc long, at int, more int, fresh boolean"
ENTRY_NAMES = ["key", "context", "doc", "at", "more", "fresh"]
#: kind 0: repeated windows; 1: a context to compare, key of few contexts; 2: the same, of many; 3: an entry to keep.
SCANNED = "kind int, key long, context long, doc long, at int, more int, fresh boolean"


def _batch(kind: int, rows: list[np.ndarray]) -> pa.RecordBatch:
    key, context, doc, at, more, fresh = rows
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(context), pa.array(doc),
         pa.array(at.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(fresh)],
        ["kind", *ENTRY_NAMES],
    )


def _combine(parts: list[list[np.ndarray]]):
    """First entry per (key, context) of a task's entries, and the windows of the other fresh ones."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    key, context, doc, at = columns[:4]
    order = np.lexsort((at, doc, context, key))
    columns = [c[order] for c in columns]
    key, context, fresh = columns[0], columns[1], columns[5]
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])])
    for kind, chosen in ((3, first), (0, ~first & fresh)):
        yield _batch(kind, [c[chosen] for c in columns])


def _array(docs: DataFrame) -> DataFrame:
    """Combined entries of (doc, text), and what each task finds repeated in its own documents."""

    def rows(batches):
        parts, held = [], 0
        for batch in batch_rows(batches):
            number, key, context, at, more = entries_of(_raw(batch.column("text")))
            if len(key):
                doc = batch.column("doc").to_numpy()[number]
                parts.append([key.view(np.int64), context.view(np.int64), doc, at, more, np.ones(len(key), bool)])
                held += len(key)
            if held > _ENTRIES:
                yield from _combine(parts)
                parts, held = [], 0
        if parts:
            yield from _combine(parts)

    return docs.select("doc", "text").mapInArrow(rows, SCANNED)


def _scan(array: DataFrame, group: int = GROUP) -> DataFrame:
    """Merge-scan of entries sorted by key, context and place; earlier levels come first by place."""

    def rows(batches):
        # Entries of the key that may go on, and the (key, context) up to which it has been sent on.
        carry, sent = None, None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            passed = columns[0] == 0
            if passed.any():
                yield _batch(0, [c[passed] for c in columns[1:]])
            columns = [c[~passed] for c in columns[1:]]
            if carry is not None:
                columns = [np.concatenate(pair) for pair in zip(carry, columns)]
            if len(columns[0]):
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                if cut:
                    yield from _resolve([c[:cut] for c in columns], group, sent)
                    columns, sent = [c[cut:] for c in columns], None
                if len(columns[0]) > 8 * group:
                    yield from _resolve(columns, group, sent, endless=True)
                    sent = columns[0][-1], columns[1][-1]
                    columns = [c[:0] for c in columns]
            carry = columns
        if carry is not None and len(carry[0]):
            yield from _resolve(carry, group, sent)

    ordered = array.repartition("key").sortWithinPartitions("key", "context", "doc", "at")
    return ordered.mapInArrow(rows, SCANNED)


def _resolve(columns: list[np.ndarray], group: int, sent=None, endless: bool = False):
    """Repeats, contexts to compare, and entries to keep, of keys in order.

    ``sent``: the first key has been sent on up to this context. ``endless``: there is one key and
    it goes on. In both cases that key counts as one of many contexts, new ones among them.
    """
    key, context, fresh = columns[0], columns[1], columns[5]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    first = new_key | np.concatenate([[True], context[1:] != context[:-1]])
    number = np.cumsum(new_key) - 1
    cut = np.zeros(number[-1] + 1, bool)
    if sent is not None and key[0] == sent[0]:
        cut[0] = True
        first[0] = context[0] != sent[1]
    cut |= endless
    contexts = np.bincount(number[first], minlength=len(cut))
    many = (contexts > group) | cut
    compared = (np.bincount(number[first & fresh], minlength=len(cut)) > 0) & (contexts > 1) | cut
    for kind, chosen in (
        (0, ~first & fresh),
        (1, first & (compared & ~many)[number]),
        (2, first & (compared & many)[number]),
        (3, first & fresh),
    ):
        if chosen.any():
            yield _batch(kind, [c[chosen] for c in columns])


def _compare(contexts: DataFrame) -> DataFrame:
    """Windows of new contexts that an earlier context of the same key holds too."""

    def rows(batches):
        open_key, seen = None, set()
        for batch in batches:
            out = ([], [])
            for key, doc, at, more, fresh, raw in zip(
                *(batch.column(c).to_pylist() for c in ("key", "doc", "at", "more", "fresh", "bytes"))
            ):
                if key != open_key:
                    open_key, seen = key, set()
                for k in range(more + 1):
                    window = raw[k : k + MATCH]
                    if window not in seen:
                        seen.add(window)
                    elif fresh:
                        out[0].append(doc)
                        out[1].append(at + k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                 pa.array(np.zeros(len(out[0]), np.int32))],
                ["doc", "at", "more"],
            )

    ordered = contexts.repartition("key").sortWithinPartitions("key", "doc", "at")
    return ordered.mapInArrow(rows, "doc long, at int, more int")


def _hashed_docs(batch: pa.RecordBatch) -> np.ndarray:
    return _mix(batch.column("doc").to_numpy().astype(np.uint64))


def _contexts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted`` (kind, key, doc, at, more, fresh) with the bytes that their windows cover.

    Texts that no wanted place lies in are left out before the shuffle. A document's places
    meet in one row, as its text does; there are fewer of them than bytes in it.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(wanted.select("doc"), _hashed_docs))

    def asked(batches):
        for batch in batch_rows(batches, 128):
            yield batch.filter(pa.array(among(sent.value, _hashed_docs(batch))))

    places = wanted.groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "at", "more", "fresh")).alias("p"))
    some = texts.select("doc", "text").mapInArrow(asked, "doc long, text string")
    joined = some.join(places, "doc").select("doc", "text", "p")

    def cut(batches):
        names = ["kind", "key", "doc", "at", "more", "fresh", "bytes"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batch_rows(batches, 128):
            out = [[] for _ in names]
            for doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "p"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for p in places:
                    row = (p["kind"], p["key"], doc, p["at"], p["more"], p["fresh"],
                           raw[p["at"] : p["at"] + p["more"] + MATCH])
                    for values, value in zip(out, row):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    return joined.mapInArrow(
        cut, "kind int, key long, doc long, at int, more int, fresh boolean, bytes binary"
    )


def _windows(contexts: DataFrame) -> DataFrame:
    """Every window of ``contexts`` as an entry of its own, its 128-bit hash as key and context.

    Of a task's equal windows the first is sent on; the later fresh ones are repeats at once.
    """

    def rows(batches):
        parts, held = [], 0
        for batch in batch_rows(batches):
            for doc, at, more, fresh, raw in zip(
                *(batch.column(c).to_pylist() for c in ("doc", "at", "more", "fresh", "bytes"))
            ):
                n = more + 1
                digest = b"".join(xxhash.xxh3_128_digest(raw[k : k + MATCH]) for k in range(n))
                pair = np.frombuffer(digest, np.int64).reshape(n, 2)
                parts.append([pair[:, 0], pair[:, 1], np.full(n, doc), at + np.arange(n), np.zeros(n, np.int64),
                              np.full(n, fresh)])
                held += n
            if held > _ENTRIES:
                yield from _combine(parts)
                parts, held = [], 0
        if parts:
            yield from _combine(parts)

    return contexts.mapInArrow(rows, SCANNED)


def _hashed_keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("key").to_numpy().view(np.uint64)


class SuffixFamily:
    """Levels of sorted entries; ``add`` finds what a new batch repeats and makes it a level."""

    def __init__(self, spark: SparkSession, group: int = GROUP):
        self.spark, self.group = spark, group
        self.levels: list[tuple[int, DataFrame, str]] = []  # (batches merged, entries, folder)
        self.texts: DataFrame | None = None

    def _settle(self):
        """Merge levels of equal size, smallest first."""
        self.levels.sort(key=lambda level: level[0])
        while len(self.levels) > 1 and self.levels[0][0] == self.levels[1][0]:
            (a, one, at), (b, other, other_at) = self.levels[:2]
            both = one.unionByName(other).repartition("key").sortWithinPartitions("key", "context", "doc", "at")
            merged = settled(both, "level")
            self.levels[:2] = [(a + b, *merged)]
            for path in (at, other_at):
                discard(self.spark, path)
            self.levels.sort(key=lambda level: level[0])

    def _old(self, array: DataFrame) -> list[DataFrame]:
        """Entries of the levels whose key may be in ``array``."""
        if not self.levels:
            return []
        sent = self.spark.sparkContext.broadcast(bitmap(array.where("kind = 3").select("key"), _hashed_keys))

        def met(batches):
            for batch in batches:
                yield batch.filter(pa.array(among(sent.value, _hashed_keys(batch))))

        names = [F.lit(3).alias("kind"), "key", "context", "doc", "at", "more", F.lit(False).alias("fresh")]
        return [
            level.mapInArrow(met, "key long, context long, doc long, at int, more int").select(*names)
            for _, level, _ in self.levels
        ]

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """(doc, at, more): windows of (doc, text) that start earlier too, as runs of starts; written.

        The ids of a batch lie above those of all batches before it. ``keep=False`` for a batch
        after which none follows: its array is not stored.
        """
        self._settle()
        self.texts = docs if self.texts is None else self.texts.unionByName(docs)
        array, array_at = settled(_array(docs), "array")
        met = array
        for old in self._old(array):
            met = met.unionByName(old)
        scanned = _scan(met, self.group)
        if not keep:
            scanned = scanned.where("kind <> 3")
        # Entries to keep and the others lie in folders of their own, so that these can go first.
        scanned, path = settled(scanned.withColumn("stays", F.col("kind") == 3), "scanned", partition="stays")
        discard(self.spark, array_at)
        if keep:
            self.levels.append((1, scanned.where("stays").select("key", "context", "doc", "at", "more"), path))
        rest = scanned.where("NOT stays")
        contexts, contexts_at = settled(_contexts(rest.where("kind IN (1, 2)"), self.texts), "contexts")
        few = _compare(contexts.where("kind = 1").drop("kind"))
        many = _scan(_windows(contexts.where("kind = 2")), self.group).where("kind = 0")
        runs = ["doc", "at", "more"]
        found = rest.where("kind = 0").select(runs).unionByName(few).unionByName(many.select(runs))
        found, _ = settled(found, "repeats")
        discard(self.spark, contexts_at)
        if keep:
            discard(self.spark, f"{path}/stays=false")
        else:
            discard(self.spark, path)
        return found


def spans(owner: np.ndarray, starts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the maximal removed runs under windows that start in the given runs of places."""
    if not len(starts):
        return owner, starts, starts
    order = np.lexsort((starts, owner))
    owner, start, stop = owner[order], starts[order], (starts + more + MATCH)[order]
    shift = owner * (int(stop.max()) + 1)  # texts one after another, a place apart
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return owner[first], start[first], (reach - shift)[last]


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, batches: int = BATCHES, group: int = GROUP, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document.

    ``kept`` (binary) is what remains of the text; it is returned with ``texts=True``.
    """
    source = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    family = SuffixFamily(docs.sparkSession, group)
    cuts = source.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)] or [0.5])).first()[0] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    edges = [None, *cuts, None]
    repeats = None
    for low, high in zip(edges[:-1], edges[1:]):
        part = source
        if low is not None:
            part = part.where(F.col("doc") > low)
        if high is not None:
            part = part.where(F.col("doc") <= high)
        found = family.add(part.select("doc", "text"), keep=high is not None)
        repeats = found if repeats is None else repeats.unionByName(found)
    runs = repeats.groupBy("doc").agg(F.collect_list(F.struct("at", "more")).alias("runs"))
    schema = arrow_schema(
        doc_id=pa.int64(), n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept_sha256=pa.string(),
        **({"kept": pa.binary()} if texts else {}),
    )

    def cut(batches):
        for batch in batch_rows(batches, 128):
            out = [[] for _ in schema]
            found = batch.column("runs")
            number = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
            at, more = (found.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
            owner, start, end = spans(number, at, more)
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            gone = np.stack([start, end], axis=1)
            for k, (doc_id, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), _raw(batch.column("text")))):
                mine = gone[edges[k] : edges[k + 1]].ravel().tolist()
                kept = raw
                if mine:
                    ends = [0, *mine, len(raw)]
                    kept = b"".join([raw[a:b] for a, b in zip(ends[::2], ends[1::2])])
                row = (doc_id, len(raw), len(raw) - len(kept), len(mine) // 2, hashlib.sha256(kept).hexdigest())
                for values, value in zip(out, row + ((kept,) if texts else ())):
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema
            )

    joined = source.join(runs, "doc", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(cut, REMOVED + (", kept binary" if texts else ""))

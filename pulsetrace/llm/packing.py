"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids (byte-level BPE, then one separator id); longer ones are cut into
pieces of ``CAPACITY`` whose first piece may be shorter. Full pieces are sequences of their own;
of every document one shorter piece at most is left to be grouped.

Those are dealt into shards of about ``SHARD`` pieces. On each shard several islands
evolve groupings: a chromosome is a list of bins; crossover injects well-filled bins of one
parent whole into the other, removes the bins that hold the same pieces, and puts displaced pieces
back by best fit. After every epoch the best grouping of each island moves on to the next island of
its shard. The least filled bins of all shards are then grouped again together, which takes
back what the cut into shards has lost.

Ids come from the ``tokenizers`` file or, for texts of Latin letters without the special
token, from the same vocabulary in tiktoken form with a table of known words: equal ids, several
times faster (tests compare them).

Defined cases: null and empty text are the separator alone; repeated rows are pieces of their own,
told apart by ``copy``; pieces of equal length are taken in the order of their keys; an empty table
gives no rows; other columns are ignored.
"""

import base64
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows, written

CAPACITY = 2048
SEPARATOR = 0
SHARD = 1024
ISLANDS = 2
ISLANDS_PER_TASK = 32
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
WELL_FILLED = 0.995
SPECIAL = "<|endoftext|>"
_KNOWN = 120_000  # words a worker remembers; more are learnt again when they come
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SIMPLE = re.compile(rf"[\x00-\x7f{_LETTERS}]*")
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, each followed by the separator."""

    _loaded: dict[tuple[str, str], "Encoder"] = {}

    @classmethod
    def load(cls, json_path: str, ranks_path: str) -> "Encoder":
        """One per Python worker, whatever the number of its tasks."""
        if (json_path, ranks_path) not in cls._loaded:
            cls._loaded[json_path, ranks_path] = cls(json_path, ranks_path)
        return cls._loaded[json_path, ranks_path]

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        self.json_path = json_path
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        (self.line,) = self.fast.encode_ordinary("\n")
        self._forget()

    @cached_property
    def reference(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def _forget(self):
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)  # ids of all known words, with room to grow
        self.used = 0
        self.start = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int64)

    def _learn(self, words: set[str]):
        """Encode new words, those without white space inside in one call, each on a line of its own."""
        lines = [w for w in words if not w.isspace()]
        ids = self.fast.encode_to_numpy("\n".join([*lines, ""]))
        stops = np.flatnonzero(ids == self.line)
        self._append(lines, np.diff(stops, prepend=-1) - 1, ids[ids != self.line])
        blanks = [w for w in words if w.isspace()]
        encoded = [self.fast.encode_ordinary(w) for w in blanks]
        self._append(blanks, np.array([len(e) for e in encoded], np.int64), np.array(sum(encoded, []), np.uint32))

    def _append(self, words: list[str], size: np.ndarray, flat: np.ndarray):
        """Arrays double when full, so each id is moved rarely."""
        first, last = len(self.known), len(self.known) + len(words)
        self.known.update(zip(words, range(first, last), strict=True))
        while last > len(self.size):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[first:last] = size
        self.start[first:last] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; words not met before are encoded once per call."""
        simple = [SPECIAL not in t and _SIMPLE.fullmatch(t) is not None for t in texts]
        words = [_PIECES.findall(t) if s else [] for t, s in zip(texts, simple)]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > _KNOWN:
            self._forget()
            new = set().union(*words)
        if new:
            self._learn(new)
        out = []
        for text, is_simple, parts in zip(texts, simple, words):
            if is_simple:
                at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
                n = self.size[at]
                place = np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                ids = self.flat[place]
            elif SPECIAL not in text:
                ids = np.array(self.fast.encode_ordinary(text), np.uint32)
            else:
                ids = np.array(self.reference.encode(text, add_special_tokens=False).ids, np.uint32)
            out.append(np.append(ids, np.uint32(SEPARATOR)))
        return out


PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32[, ids]) of every document.

    ``copy`` is different in every row of the input; it tells repeated rows apart.
    """
    columns = {
        "doc_id": pa.int64(), "copy": pa.int64(), "piece": pa.int32(), "start": pa.int64(),
        "length": pa.int64(), "ids_crc32": pa.int64(),
    } | ({"ids": pa.list_(pa.int32())} if keep_ids else {})
    schema = arrow_schema(**columns)
    paths = vocabulary_path(), vocabulary_path("byte_bpe_50k.tiktoken")

    def cut(batches):
        encoder = Encoder.load(*paths)
        for batch in batch_rows(batches, 128):
            out = [[] for _ in schema]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist())
            for (doc_id, copy), ids in zip(keys, encoder.encode(texts)):
                first = len(ids) % capacity or capacity
                start = 0
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    part = ids[start:stop]
                    row = (doc_id, copy, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes()))
                    for values, value in zip(out, row + ((part.astype(np.int32),) if keep_ids else ())):
                        values.append(value)
                    start = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema
            )
        encoder._forget()  # idle workers hold no words

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("copy")
    )
    return source.mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


Bin = list[int]  # places of pieces in their shard


class Shard:
    """Lengths of one shard's pieces, in descending order, and moves on groupings of them."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths = lengths.tolist()
        self.capacity = capacity

    def fill(self, b: Bin) -> int:
        return sum(self.lengths[i] for i in b)

    def best_fit(self, bins: list[Bin], loose: list[int]) -> list[Bin]:
        """Put ``loose`` pieces, in their order, where least room is left over."""
        rooms: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        bits = 0  # which rooms have a bin
        for k, b in enumerate(bins):
            room = self.capacity - self.fill(b)
            rooms[room].append(k)
            bits |= 1 << room
        for i in loose:
            size = self.lengths[i]
            above = bits >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                k = rooms[room].pop()
                if not rooms[room]:
                    bits &= ~(1 << room)
                bins[k].append(i)
                room -= size
            else:
                k, room = len(bins), self.capacity - size
                bins.append([i])
            rooms[room].append(k)
            bits |= 1 << room
        return bins

    def fitness(self, bins: list[Bin]) -> float:
        """Fewer bins first; among equals, the more uneven filling, which leaves room for more."""
        return -len(bins) + sum((self.fill(b) / self.capacity) ** 2 for b in bins) / (len(bins) + 1)

    def cross(self, one: list[Bin], other: list[Bin], rng: np.random.Generator) -> list[Bin]:
        """Well-filled bins of ``other`` come whole into ``one``; what they displace is best-fitted."""
        good = [b for b in other if self.fill(b) >= WELL_FILLED * self.capacity]
        take = max(1, len(good) // 3)
        chosen = rng.choice(len(good), take, replace=False) if good else []
        injected = [list(good[k]) for k in sorted(chosen)]
        there = {i for b in injected for i in b}
        kept, loose = injected, []
        for b in one:
            if there.isdisjoint(b):
                kept.append(list(b))
            else:
                loose += [i for i in b if i not in there]
        return self.best_fit(kept, sorted(loose))

    def mutate(self, bins: list[Bin], rng: np.random.Generator, part: float = 0.1) -> list[Bin]:
        """Empty the least filled bins and a few others, then best-fit their pieces."""
        order = sorted(range(len(bins)), key=lambda k: self.fill(bins[k]))
        n = max(2, int(part * len(bins)))
        out = set(order[: n // 2]) | set(rng.choice(len(bins), min(n // 2 + 1, len(bins)), replace=False).tolist())
        loose = [i for k in out for i in bins[k]]
        # A little disorder: large first, but not strictly.
        noise = rng.normal(0, 0.15, len(loose))
        loose = [loose[k] for k in np.argsort(np.array(loose) * (1 + noise), kind="stable")]
        return self.best_fit([list(b) for k, b in enumerate(bins) if k not in out], loose)

    def start(self, rng: np.random.Generator, population: int) -> list[list[Bin]]:
        n = len(self.lengths)
        first = self.best_fit([], list(range(n)))
        others = [np.argsort(np.arange(n) * (1 + rng.normal(0, 0.1, n)), kind="stable") for _ in range(population - 1)]
        return [first, *(self.best_fit([], o.tolist()) for o in others)]

    def bound(self) -> int:
        return -(-sum(self.lengths) // self.capacity)

    def evolve(self, groups: list[list[Bin]], rng: np.random.Generator, generations: int) -> list[list[Bin]]:
        """Steady state: each child takes the place of the worst if it is fitter."""
        scored = sorted(((self.fitness(g), k, g) for k, g in enumerate(groups)), key=lambda x: (-x[0], x[1]))
        for step in range(generations):
            if len(scored[0][2]) <= self.bound():
                break
            a, b = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
            child = self.cross(scored[min(a, b)][2], scored[max(a, b)][2], rng)
            child = self.mutate(child, rng)
            value = self.fitness(child)
            if value > scored[-1][0]:
                scored[-1] = (value, len(groups) + step, child)
                scored.sort(key=lambda x: (-x[0], x[1]))
        return [g for _, _, g in scored]


def _encode(groups: list[list[Bin]], n: int) -> list[list[int]]:
    """Each grouping as the bin number of every piece."""
    out = []
    for bins in groups:
        number = np.zeros(n, np.int32)
        for k, b in enumerate(bins):
            number[b] = k
        out.append(number.tolist())
    return out


def _decode(numbers: list[int]) -> list[Bin]:
    bins: list[Bin] = [[] for _ in range(max(numbers) + 1)]
    for i, k in enumerate(numbers):
        bins[k].append(i)
    return bins


SHARDS = "shard long, keys array<long>, lengths array<int>"
ISLAND = "shard long, island int, groups array<array<int>>, best double"


def evolve_islands(
    shards: DataFrame, capacity: int, islands: int, epochs: int, generations: int, population: int, tasks: int
) -> DataFrame:
    """(shard, bins): the best grouping of each shard, as the bin number of every piece.

    One row per shard and island; an epoch evolves all of them in parallel, and between epochs
    every island hands its best grouping to the next one. State is written after every epoch.
    """
    start = shards.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = None
    for epoch in range(epochs):
        rows = start.withColumn("groups", F.lit(None).cast("array<array<int>>")) if state is None else state
        rows = rows.repartition(tasks, "shard", "island")

        def run(batches, epoch=epoch):
            for batch in batches:
                out = ([], [], [], [])
                for r in batch.to_pylist():
                    shard = Shard(np.array(r["lengths"]), capacity)
                    rng = np.random.default_rng([r["shard"] & 0xFFFFFFFF, r["island"], epoch])
                    groups = [_decode(g) for g in r["groups"]] if r["groups"] else shard.start(rng, population)
                    groups = shard.evolve(groups, rng, generations)
                    row = (r["shard"], r["island"], _encode(groups, len(shard.lengths)), shard.fitness(groups[0]))
                    for values, value in zip(out, row):
                        values.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                     pa.array(out[2], pa.list_(pa.list_(pa.int32()))), pa.array(out[3], pa.float64())],
                    ["shard", "island", "groups", "best"],
                )

        evolved = written(
            rows.select("shard", "island", "lengths", "groups").mapInArrow(run, ISLAND), "islands"
        )
        if epoch + 1 < epochs:
            elite = evolved.select(
                "shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                F.element_at("groups", 1).alias("elite"),
            )
            # The elite takes the place of the worst grouping of the island it comes to.
            moved = evolved.join(elite, ["shard", "island"]).select(
                "shard", "island",
                F.concat(
                    F.slice("groups", F.lit(1), F.greatest(F.size("groups") - 1, F.lit(1))), F.array("elite")
                ).alias("groups"),
            )
            state = moved.join(shards.select("shard", "lengths"), "shard")
    return evolved.groupBy("shard").agg(
        F.max_by(F.element_at("groups", 1), F.struct("best", -F.col("island"))).alias("bins")
    )


def _grouped(items: DataFrame, capacity: int, shard: int, total: int, settings: dict) -> DataFrame:
    """(copy, length, bin) of ``items`` (copy, length); bins are told apart by (shard, number)."""
    count = max(1, round(total / shard))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("copy"), F.lit(count)))
    gathered = dealt.groupBy("shard").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("n"), "copy"))).alias("p")
    )
    shards = written(
        gathered.select(
            "shard", F.col("p.copy").alias("keys"), F.transform("p.n", lambda x: (-x).cast("int")).alias("lengths")
        ),
        "shards",
    )
    tasks = -(-count * settings["islands"] // ISLANDS_PER_TASK)
    best = evolve_islands(shards, capacity, tasks=tasks, **settings)
    pairs = shards.join(best, "shard").select(
        "shard", F.explode(F.arrays_zip("keys", "lengths", "bins")).alias("z")
    )
    return pairs.select(
        F.col("z.keys").alias("copy"), F.col("z.lengths").alias("length"),
        F.struct("shard", F.col("z.bins").alias("number")).alias("bin"),
    )


def _offsets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece of the sequences (sequence_id, copies, lengths): running sums of lengths are the places."""
    for batch in batches:
        numbers, copies, lengths = batch.columns
        n = lengths.value_lengths().to_numpy()
        flat = lengths.flatten().to_numpy()
        upto = np.cumsum(flat) - flat
        first = np.cumsum(n) - n
        offset = upto - np.repeat(upto[first[n > 0]], n[n > 0])
        yield pa.RecordBatch.from_arrays(
            [copies.flatten(), pa.array(np.repeat(numbers.to_numpy(), n)), pa.array(offset)],
            ["copy", "sequence_id", "offset"],
        )


def pack(
    found: DataFrame,
    capacity: int = CAPACITY,
    shard: int = SHARD,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
) -> DataFrame:
    """``found`` (from ``pieces``) with sequence_id and offset; sequences never exceed ``capacity``."""
    settings = {"islands": islands, "epochs": epochs, "generations": generations, "population": population}
    short = found.where(F.col("length") < capacity).select("copy", "length")
    n = short.count()
    first = written(_grouped(short, capacity, shard, n, settings), "grouped")
    # Bins with room left give their pieces to a second round in which bins of all shards meet.
    fills = first.groupBy("bin").agg(F.sum("length").alias("fill"))
    poor = fills.where(F.col("fill") < WELL_FILLED * capacity).select("bin")
    again = first.join(poor, "bin", "left_semi").select("copy", F.col("length").cast("long").alias("length"))
    left = again.count()
    second = _grouped(again, capacity, shard, left, settings) if left else None
    done = first.join(poor, "bin", "left_anti").select("copy", "length", F.lit(1).alias("round"), "bin")
    if second is not None:
        done = done.unionByName(second.withColumn("round", F.lit(2)))
    # Numbers of sequences: a shuffle-free running number over the written bins.
    placed = written(
        done.groupBy("round", "bin").agg(F.sort_array(F.collect_list(F.struct("copy", "length"))).alias("p")), "bins"
    )
    offsets = placed.select(
        F.monotonically_increasing_id().alias("sequence_id"), F.col("p.copy").alias("copies"),
        F.col("p.length").cast("array<long>").alias("lengths"),
    ).mapInArrow(_offsets, "copy long, sequence_id long, offset long")
    whole = found.where(F.col("length") == capacity).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()
    ).withColumn("offset", F.lit(0).cast("long"))
    return found.where(F.col("length") < capacity).join(offsets, "copy").unionByName(whole)


def pack_documents(docs: DataFrame, **settings) -> DataFrame:
    """Tokenise, cut and pack all of ``docs``; one row per piece."""
    found = written(pieces(docs, settings.get("capacity", CAPACITY)), "pieces")
    return pack(found, **settings)

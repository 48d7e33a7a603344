"""SimHash near-duplicates, found with a hierarchical index over Gray-ordered fingerprints.

Distinct fingerprints are the rows of the index; copies are collapsed before anything is compared.
Two fingerprints with at most ``max_bits`` differing bits agree on one of ``max_bits + 1``
bands, so the uppermost nodes of the index are masked bit patterns (mask, value) that Spark
shuffles by. A node with more than ``CELL`` fingerprints is refined by a further band of its
free bits; one that is still larger is dealt as pairs of blocks, each cell of bounded size.
Inside a cell the fingerprints are sorted by Gray rank; runs of ``FAN`` form nodes that hold
the bits common to their members, and bits shared by sibling nodes move up to the parent. A search
adds up differing bits on the way down and leaves a whole subtree once they exceed ``max_bits``.
Cells return spanning trees, not pairs; ``components`` joins them.

Defined cases: null or blank text has fingerprint zero, which links like any other; fewer words
than a shingle hash as one sequence; documents with equal text, repeated rows among them, share a
component; a null ``doc_id`` keeps its row and never names a component that has another id; an empty
table gives no rows; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows, written
from .components import components, roots

SEED = 42
CELL = 4096
DEPTH = 2
FAN = 16
_QUERIES = 512
_SHINGLES = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """Unsigned 64-bit SimHash: a bit is set if over half of the shingle hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: max(len(words) - shingle + 1, 1)]
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _SHINGLES):
        spans = zip(starts[at : at + _SHINGLES].tolist(), stops[at : at + _SHINGLES].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed long."""
    schema = arrow_schema(doc_id=pa.int64(), fp=pa.int64())

    def rows(batches):
        for batch in batch_rows(batches):
            found = [fingerprint(t or "", shingle) for t in batch.column("text").to_pylist()]
            fp = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(rows, "doc_id long, fp long")


def bands(mask: int, parts: int) -> list[int]:
    """Masks that add one of ``parts`` bands of the free bits to ``mask``."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in band.tolist()) for band in np.array_split(free, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _nodes(rows: DataFrame, children: dict[int, list[int]]) -> DataFrame:
    """Rows (fp, mask) below each of the children of their mask: (fp, mask, value)."""
    longs = lambda xs: F.array(*[F.lit(_signed(x)).cast("long") for x in xs])
    if list(children) == [0]:
        masks = longs(children[0])
    else:
        entries = [x for m, c in children.items() for x in (F.lit(_signed(m)).cast("long"), longs(c))]
        masks = F.element_at(F.create_map(*entries), F.col("mask"))
    down = rows.select("fp", F.explode(masks).alias("mask"))
    return down.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order, as a long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def cells(fps: DataFrame, max_bits: int, cell: int = CELL, depth: int = DEPTH) -> DataFrame:
    """(mask, value, low, high, fp): bounded cells that together hold every pair within ``max_bits``."""
    masks = {0: bands(0, max_bits + 1)}
    rows, done = _nodes(fps, masks), None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        sized = written(rows.join(sizes, ["mask", "value"]), "nodes")
        last = level == depth
        kept = sized if last else sized.where(F.col("n") <= cell)
        done = kept if done is None else done.unionByName(kept)
        large = sized.where(F.col("n") > cell)
        if last or large.isEmpty():
            break
        masks = {m: bands(m, max_bits + 1) for c in masks.values() for m in c}
        rows = _nodes(large.select("fp", "mask"), masks)
    blocks = F.ceil(F.col("n") / cell)
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks)
    dealt = done.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    return dealt.select(
        "mask", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"
    )


class GrayIndex:
    """Nodes over fingerprints sorted by Gray rank: the bits their members share, less the parent's."""

    def __init__(self, sorted_fps: np.ndarray):
        self.fps = sorted_fps
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # leaf level first
        pattern, mask = sorted_fps, np.full(len(sorted_fps), ~np.uint64(0))
        while True:
            pad = -len(pattern) % FAN
            p = np.concatenate([pattern, np.repeat(pattern[-1:], pad)]).reshape(-1, FAN)
            m = np.concatenate([mask, np.repeat(mask[-1:], pad)]).reshape(-1, FAN)
            shared = np.bitwise_and.reduce(m, axis=1) & ~np.bitwise_or.reduce(p ^ p[:, :1], axis=1)
            self.levels.append((pattern, mask & ~np.repeat(shared, FAN)[: len(mask)]))
            pattern, mask = p[:, 0] & shared, shared
            if len(pattern) <= FAN:
                self.levels.append((pattern, mask))
                return

    def pairs(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, within ``max_bits`` of each other, in blocks of queries."""
        top = np.arange(len(self.levels[-1][0]))
        for at in range(0, len(self.fps), _QUERIES):
            size = min(_QUERIES, len(self.fps) - at)
            query = np.repeat(np.arange(at, at + size), len(top))
            node, differ = np.tile(top, size), np.zeros(size * len(top), dtype=np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                pattern, mask = self.levels[depth]
                differ = differ + np.bitwise_count((self.fps[query] ^ pattern[node]) & mask[node])
                near = differ <= max_bits
                query, node, differ = query[near], node[near], differ[near]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    query, differ = np.repeat(query, FAN), np.repeat(differ, FAN)
                    there = node < below
                    query, node, differ = query[there], node[there], differ[there]
            later = node > query
            yield query[later], node[later]


def _small(fps: np.ndarray, cell: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions of many cells of at most FAN rows, each one leaf, side by side."""
    left, right = [], []
    for gap in range(1, FAN):
        near = (cell[gap:] == cell[:-gap]) & (np.bitwise_count(fps[gap:] ^ fps[:-gap]) <= max_bits)
        at = np.flatnonzero(near)
        left.append(at)
        right.append(at + gap)
    return np.concatenate(left), np.concatenate(right)


def _trees(fps: np.ndarray, cell: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (fp, root) over the links within the cells of one block of rows."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    few = np.repeat(sizes <= FAN, sizes)
    found = []
    if few.any():
        i, j = _small(fps[few], cell[few], max_bits)
        found.append((fps[few][i], fps[few][j]))
    for at, size in zip(starts[sizes > FAN], sizes[sizes > FAN]):
        index = GrayIndex(fps[at : at + size])
        stars = [roots(index.fps[i], index.fps[j]) for i, j in index.pairs(max_bits) if len(i)]
        found += [(node, root) for node, root in stars]
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (fps[:0], fps[:0])
    node, root = roots(a.view(np.int64), b.view(np.int64)) if len(a) else (a.view(np.int64),) * 2
    return node[node != root], root[node != root]


def links(fps: DataFrame, max_bits: int = 3, cell: int = CELL) -> DataFrame:
    """(a, b): a spanning forest of all links within ``max_bits`` among distinct fingerprints."""
    key = ["mask", "value", "low", "high"]
    dealt = cells(fps.select("fp"), max_bits, cell).repartition(*key)
    rows = dealt.sortWithinPartitions(*key, gray_rank(F.col("fp"))).select(
        F.xxhash64(*key).alias("cell"), "fp"
    )

    def search(batches):
        held_cell, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            here = np.concatenate([held_cell, batch.column("cell").to_numpy()])
            fps_here = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
            # The last cell may go on in the next batch.
            cut = int(np.flatnonzero(here != here[-1])[-1]) + 1 if (here != here[-1]).any() else 0
            held_cell, held_fp = here[cut:], fps_here[cut:]
            if cut:
                yield trees(fps_here[:cut], here[:cut])
        if len(held_cell):
            yield trees(held_fp, held_cell)

    def trees(block, cell_of):
        node, root = _trees(block, cell_of, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    return rows.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; component_id = smallest doc_id reachable."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "distinct"
    )
    linked = components(links(distinct, max_bits, cell)).withColumnRenamed("node", "fp")
    grouped = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = grouped.where("component IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("low"))
    # A fingerprint of one document and without links needs no row: the document is its own component.
    known = (
        grouped.where("component IS NOT NULL OR copies > 1")
        .join(least, "root", "left")
        .select("fp", F.coalesce("low", "first_id").alias("component_id"))
    )
    return marked.join(known, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )

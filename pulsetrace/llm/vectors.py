"""Near-duplicate vectors by product quantisation over inverted lists.

Equal vectors are one class. Coarse centres and, for what is left after subtracting a centre, one
codebook per subspace are fitted on a bounded sample; every class is then put in the list of its
nearest centre as codes. A class probes the lists whose cells can hold a vector within the link
radius, nearest cell wall first: the ``probes`` nearest ones, its own included, or with ``probes=None`` all of
them, which finds every link. In a list, distances are table lookups (one table per query and
subspace); the quantisation error stored with each code makes them lower bounds, so no
candidate within the radius is passed over. Candidates are compared by exact cosine in double precision.

Lists are dealt as cells of bounded size, whatever their length. A cell returns, for each vector,
the number of its links and one edge of a spanning tree, never all pairs.

Defined cases: a vector that is null, empty, zero or holds a null or a non-finite component links
with nothing, copies of itself included; vectors of different lengths never link; copies link with
each other; repeated rows count as vectors; a null ``vec_id`` keeps its row and never names a
component that has another id; an empty table gives no rows; other columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, roots

COSINE = 0.95
SAMPLE = 16_384  # vectors the index is fitted on
ROWS_PER_LIST = 128
MAX_LISTS = 4_096
PROBES = 8
CELL = 128  # rows of a list, and queries, that meet in one task
SUBSPACES = 8
CODEWORDS = 32
_ROUNDS = 8


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(far, 0)


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    parts = [_squared(x[at : at + block], centres).argmin(axis=1) for at in range(0, len(x), block)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres of the bounded sample ``x``; an empty cluster starts again at a sample row."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(_ROUNDS):
        at = _nearest(x, centres)
        size = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


@dataclass
class Quantiser:
    """Coarse centres, and codewords of each slice of the residual."""

    centres: np.ndarray
    slices: list[slice]
    words: list[np.ndarray]

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the error that each code leaves)."""
        codes = np.stack([_nearest(residual[:, s], w) for s, w in zip(self.slices, self.words)], axis=1)
        restored = np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], axis=1)
        return codes.astype(np.uint8), np.sqrt(np.square(residual - restored).sum(axis=1))

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each query to every codeword, per subspace."""
        return [_squared(residual[:, s], w) for s, w in zip(self.slices, self.words)]

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float, most: int | None) -> list[np.ndarray]:
        """Other lists whose cells come within ``radius`` of each row, nearest cell wall first; ``most`` None: all."""
        between = np.sqrt(_squared(self.centres, self.centres))
        out = []
        for at in range(0, len(x), 1024):
            far = _squared(x[at : at + 1024], self.centres)
            home = own[at : at + 1024]
            mine = far[np.arange(len(home)), home][:, None]
            apart = between[home]
            wall = np.where(apart > 0, (far - mine) / (2 * np.where(apart > 0, apart, 1)), np.inf)
            wall[apart == 0] = 0.0
            wall[np.arange(len(home)), home] = np.inf
            for row in wall:
                near = np.argsort(row, kind="stable")[: None if most is None else most - 1]
                out.append(near[row[near] <= radius + 1e-9].astype(np.int32))
        return out


def fit(sample: np.ndarray, lists: int, seed: int = 7) -> Quantiser:
    rng = np.random.default_rng(seed)
    centres = k_means(sample, min(lists, max(1, len(sample) // 4)), rng)
    residual = sample - centres[_nearest(sample, centres)]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    slices = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    k = min(CODEWORDS, len(sample))
    return Quantiser(centres, slices, [k_means(residual[:, s], k, rng) for s in slices])


def _units(batches):
    """(vec_id, unit vector as bytes, its length); null where a vector can't link."""
    for batch in batches:
        found, size = [], []
        for values in batch.column("embedding").to_pylist():
            x = None
            if values and None not in values:
                x = np.array(values, dtype=np.float64)
                scale = np.abs(x).max()
                x = None if not np.isfinite(scale) or scale == 0 else x / scale
            if x is not None:
                x = x / np.sqrt(x @ x) + 0.0
            found.append(None if x is None else x.tobytes())
            size.append(None if x is None else len(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(found, pa.binary()), pa.array(size, pa.int32())],
            ["vec_id", "unit", "size"],
        )


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(column), width))
    for i, raw in enumerate(column.to_pylist()):
        x = np.frombuffer(raw)
        out[i, : len(x)] = x
    return out


INDEX = "cid long, copies long, unit binary, size int, list int, code binary, error double, probes array<int>"


def _index(classes: DataFrame, shared, width: int, radius: float, most: int | None) -> DataFrame:
    def rows(batches):
        q = shared.value
        for batch in batches:
            x = _matrix(batch.column("unit"), width)
            own = q.lists(x)
            codes, error = q.encode(x - q.centres[own])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("cid", "copies", "unit", "size")),
                 pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(error), pa.array(q.probes(x, own, radius, most), pa.list_(pa.int32()))],
                ["cid", "copies", "unit", "size", "list", "code", "error", "probes"],
            )

    return classes.select("cid", "copies", "unit", "size").mapInArrow(rows, INDEX)


FOUND = "cid long, links long, root long"


def _search(shared, width: int, cosine: float, radius: float):
    """Compare the queries of one cell with its rows; a function of the cell's table."""

    def search(cell: pa.Table) -> pa.Table:
        q = shared.value
        there = cell.column("query").to_numpy()
        rows, queries = cell.filter(pa.array(~there)), cell.filter(pa.array(there))
        empty = pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()),
                          "root": pa.array([], pa.int64())})
        if not len(rows) or not len(queries):
            return empty
        at = rows.column("list")[0].as_py()
        x, y = _matrix(rows.column("unit"), width), _matrix(queries.column("unit"), width)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        far = np.zeros((len(y), len(x)))
        for j, table in enumerate(q.tables(y - q.centres[at])):
            far += table[:, codes[:, j]]
        near = np.sqrt(far) - rows.column("error").to_numpy() <= radius + 1e-9
        a, b = (c.column("cid").to_numpy() for c in (queries, rows))
        home = queries.column("list").to_numpy()
        # A pair that both sides would find is left to the smaller class.
        back = np.array([np.isin(home, p) for p in rows.column("probes").to_pylist()]).T
        near &= (a[:, None] < b) | ((home != at)[:, None] & ~back)
        near &= a[:, None] != b
        near &= queries.column("size").to_numpy()[:, None] == rows.column("size").to_numpy()
        i, j = np.nonzero(near)
        linked = np.einsum("ij,ij->i", y[i], x[j]) >= cosine
        i, j = i[linked], j[linked]
        if not len(i):
            return empty
        node, root = roots(a[i], b[j])
        links = np.zeros(len(node), np.int64)
        np.add.at(links, np.searchsorted(node, a[i]), rows.column("copies").to_numpy()[j])
        np.add.at(links, np.searchsorted(node, b[j]), queries.column("copies").to_numpy()[i])
        return pa.table({"cid": node, "links": links, "root": root})

    return search


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, probes: int | None = PROBES,
    rows_per_list: int = ROWS_PER_LIST, cell: int = CELL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    units = source.mapInArrow(_units, "vec_id long, unit binary, size int").withColumn(
        "key", F.unhex(F.md5(F.concat(F.col("unit"), F.encode(F.col("size").cast("string"), "utf-8"))))
    )
    units = written(units, "units")
    able = units.where("unit IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies"),
        F.first("unit").alias("unit"), F.first("size").alias("size"),
    )
    classes = written(able.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, width = classes.agg(F.count("*"), F.max("size")).first()
    if not n:
        return units.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.coalesce(F.col("vec_id").isNotNull(), F.lit(False)).alias("kept"),
        )
    # The smallest digests are a random sample, the same in every run.
    sample = classes.orderBy("key").limit(SAMPLE).select("unit").toArrow()
    radius = float(np.sqrt(max(2 - 2 * cosine, 0)))
    fitted = fit(_matrix(sample.column("unit"), width), int(np.clip(round(n / rows_per_list), 1, MAX_LISTS)))
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)  # MAX_LISTS centres at most
    index = written(_index(classes, shared, width, radius, probes), "index")

    blocks = lambda c: F.ceil(c / cell).cast("int")
    targets = index.select("*", F.explode(F.array_union(F.array("list"), "probes")).alias("target"))
    sizes = index.groupBy(F.col("list").alias("target")).agg(blocks(F.count("*")).alias("row_blocks"))
    asked = targets.groupBy("target").agg(blocks(F.count("*")).alias("query_blocks"))
    shape = F.broadcast(sizes.join(asked, "target"))  # one row per list
    place = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.withColumn("target", F.col("list")).join(shape, "target").withColumn(
        "row_block", place("row_blocks", 1)
    ).withColumn("query_block", every("query_blocks"))
    queries = targets.join(shape, "target").withColumn("query_block", place("query_blocks", 2)).withColumn(
        "row_block", every("row_blocks")
    ).withColumn("code", F.lit(None).cast("binary")).withColumn("probes", F.lit(None).cast("array<int>"))
    names = ["target", "row_block", "query_block", "cid", "copies", "unit", "size", "list", "code", "error", "probes"]
    both = rows.select(*names, F.lit(False).alias("query")).unionByName(
        queries.select(*names, F.lit(True).alias("query"))
    )
    found = written(
        both.groupBy("target", "row_block", "query_block").applyInArrow(
            _search(shared, width, cosine, radius), FOUND
        ),
        "found",
    )
    degrees = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(found.where("cid <> root").select("cid", "root")).withColumnRenamed("node", "cid")
    named = classes.join(linked, "cid", "left").join(degrees, "cid", "left").withColumn(
        "root", F.coalesce("component", "cid")
    ).select("key", "first_id", "copies", "links", "root")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = named.join(least, "root").select(
        "key", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    # Rows that are alone need no lookup.
    known = known.where("n_links > 0")
    joined = units.select("vec_id", "key").join(known, "key", "left").withColumn(
        "component_id", F.coalesce("component_id", "vec_id")
    )
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )

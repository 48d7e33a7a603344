"""k-means from several starts at once.

Equal rows are counted first; every later step reads the distinct rows with their weights. A round
spreads each row over all starts that still move, finds its nearest centre in each, and sums up by
start and cluster: one scan and one small grouped sum for all starts together. Costs and the
sums behind the silhouettes come from one more scan of that kind, the silhouettes from a last one.

Seeds choose their first centres by k-means++ (the next centre with a chance in proportion to weight
times squared distance), as a race: the row with the least exponential waiting time wins. Its
random number is a hash of the row's values, the seed and the centre's number, so the choice does not
depend on how rows are laid out, and a pass finds one more centre of every seed.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_scratch

Centres = list[list[float]]
MAX_ITER, TOL = 20, 1e-4  # MLlib's own


@dataclass
class Start:
    """Where one start ended; ``silhouette`` is None with a single cluster."""

    seed: int
    centres: Centres
    cost: float
    rounds: int
    silhouette: float | None = None


def weighted_points(vectors: DataFrame, features: str = "features") -> DataFrame:
    """(x, w): the distinct rows of a vector column and how often each occurs, written."""
    x = vector_to_array(features).alias("x")
    counted = vectors.select(x).groupBy("x").agg(F.count("*").alias("w"))
    path = new_scratch(vectors.sparkSession, "points")
    counted.write.parquet(path)
    return vectors.sparkSession.read.schema(counted.schema).parquet(path)


def _numbers(values: Sequence[float | None]) -> Column:
    return F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in values])


def _spread(points: DataFrame, starts: Mapping[int, dict[str, Column]]) -> DataFrame:
    """Every point once per start, beside the values of that start."""
    each = F.array(*[
        F.struct(F.lit(seed).cast("long").alias("seed"), *[v.alias(name) for name, v in values.items()])
        for seed, values in starts.items()
    ])
    return points.select("x", "w", F.explode(each).alias("s")).select("x", "w", "s.*")


def _dot(x: Column, y: Column, width: int) -> Column:
    return sum((x[j] * y[j] for j in range(width)), F.lit(0.0))


def assigned(points: DataFrame, centres: Mapping[int, Centres]) -> DataFrame:
    """(x, w, seed, cluster, gap): the nearest centre of each start, the first on a tie, and its squared distance."""
    some = next(iter(centres.values()))
    k, width = len(some), len(some[0])
    rows = _spread(points, {s: {"centres": F.array(*map(_numbers, c))} for s, c in centres.items()})
    gaps = [
        sum(((F.col("x")[j] - F.col("centres")[c][j]) ** 2 for j in range(width)), F.lit(0.0)) for c in range(k)
    ]
    near = rows.select("x", "w", "seed", F.array(*gaps).alias("gaps"))
    near = near.select("x", "w", "seed", "gaps", F.array_min("gaps").alias("gap"))
    place = (F.array_position("gaps", F.col("gap")) - 1).cast("int")
    return near.select("x", "w", "seed", place.alias("cluster"), "gap")


def _sums(rows: DataFrame, width: int, *more: Column) -> dict[tuple[int, int], dict]:
    """Sums by (seed, cluster); there are as many as starts times clusters."""
    sums = [F.sum(F.col("w") * F.col("x")[j]).alias(f"x{j}") for j in range(width)]
    found = rows.groupBy("seed", "cluster").agg(F.sum("w").alias("n"), *sums, *more).collect()
    return {(r["seed"], r["cluster"]): r.asDict() for r in found}


def first_centres(points: DataFrame, seeds: Sequence[int], k: int, far: bool = True) -> dict[int, Centres]:
    """First centres of every seed: different rows, distant ones (``far``) or all with the same chance.

    A seed that runs out of distinct rows repeats its first one.
    """
    chosen: dict[int, Centres] = {}
    for number in range(k):
        if number and not chosen:
            break
        if number:
            rows = assigned(points, chosen).where("gap > 0")
            rows = rows.withColumn("weight", F.col("w") * (F.col("gap") if far else F.lit(1.0)))
        else:
            rows = _spread(points, {s: {} for s in seeds}).withColumn("weight", F.col("w").cast("double"))
        hashed = F.shiftrightunsigned(F.xxhash64("x", "seed", F.lit(number)), 11)
        wait = -F.log((hashed + 0.5) / F.lit(2.0**53)) / F.col("weight")
        winner = F.min_by("x", F.struct(wait.alias("wait"), "x"))
        found = rows.where("weight > 0").groupBy("seed").agg(winner.alias("x")).collect()
        new = {r["seed"]: list(r["x"]) for r in found}
        if not number:
            chosen = {s: [new[s]] for s in seeds if s in new}
        else:
            chosen = {s: [*c, new.get(s, c[0])] for s, c in chosen.items()}
    return chosen


def moved(points: DataFrame, centres: Mapping[int, Centres], max_iter: int = MAX_ITER, tol: float = TOL):
    """(centres, rounds) of every start after Lloyd's rounds.

    A start stops when none of its centres moves by more than ``tol``; a centre without rows stays.
    """
    done, rounds = dict(centres), dict.fromkeys(centres, 0)
    moving = dict(centres)
    for _ in range(max_iter):
        if not moving:
            break
        width = len(next(iter(moving.values()))[0])
        sums = _sums(assigned(points, moving), width)
        still = {}
        for seed, old in moving.items():
            new = []
            for c, centre in enumerate(old):
                got = sums.get((seed, c))
                new.append([got[f"x{j}"] / got["n"] for j in range(width)] if got else centre)
            done[seed], rounds[seed] = new, rounds[seed] + 1
            if any(sum((a - b) ** 2 for a, b in zip(p, q)) > tol * tol for p, q in zip(old, new)):
                still[seed] = new
        moving = still
    return done, rounds


def silhouettes(points: DataFrame, centres: Mapping[int, Centres], sums: Mapping[tuple[int, int], dict]):
    """Mean silhouette (squared Euclidean) of every start, from the sums of its clusters: one scan.

    The mean squared distance of a point p to a cluster is |p|^2 + mean|q|^2 - 2 p.mean(q).
    """
    starts, width, k = {}, 0, 0
    for seed, places in centres.items():
        k, width = len(places), len(places[0])
        got = [sums.get((seed, c)) for c in range(k)]
        if sum(g is not None for g in got) < 2:
            continue
        means = [[g[f"x{j}"] / g["n"] if g else None for j in range(width)] for g in got]
        starts[seed] = {
            "centres": F.array(*map(_numbers, places)), "means": F.array(*map(_numbers, means)),
            "squares": _numbers([g["squares"] / g["n"] if g else None for g in got]),
            "sizes": _numbers([g["n"] if g else None for g in got]),
        }
    if not starts:
        return {}
    x = F.col("x")
    rows = _spread(points, starts)
    gaps = F.array(*[
        sum(((x[j] - F.col("centres")[c][j]) ** 2 for j in range(width)), F.lit(0.0)) for c in range(k)
    ])
    away = F.array(*[
        _dot(x, x, width) + F.col("squares")[c] - 2 * _dot(x, F.col("means")[c], width) for c in range(k)
    ])
    rows = rows.select("seed", "w", "sizes", gaps.alias("gaps"), away.alias("away"))
    rows = rows.withColumn("own", F.array_position("gaps", F.array_min("gaps")).cast("int"))
    n = F.element_at("sizes", F.col("own"))
    others = F.filter(F.transform("away", lambda d, i: F.when(i + 1 != F.col("own"), d)), lambda d: d.isNotNull())
    rows = rows.select(
        "seed", "w", n.alias("n"), F.try_divide(F.element_at("away", F.col("own")) * n, n - 1).alias("a"),
        F.array_min(others).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    value = F.when(F.col("n") <= 1, 0.0).when(a < b, 1 - a / b).when(a > b, b / a - 1).otherwise(0.0)
    found = rows.groupBy("seed").agg((F.sum(F.col("w") * value) / F.sum("w")).alias("s")).collect()
    return {r["seed"]: r["s"] for r in found}


def fit_starts(
    points: DataFrame, centres: Mapping[int, Centres], max_iter: int = MAX_ITER, tol: float = TOL
) -> list[Start]:
    """All starts moved to their ends over ``points`` (x, w), with their costs and silhouettes."""
    if not centres:
        return []
    ends, rounds = moved(points, centres, max_iter, tol)
    width = len(next(iter(ends.values()))[0])
    squares = F.sum(F.col("w") * _dot(F.col("x"), F.col("x"), width)).alias("squares")
    cost = F.sum(F.col("w") * F.col("gap")).alias("cost")
    sums = _sums(assigned(points, ends), width, squares, cost)
    quality = silhouettes(points, ends, sums)
    return [
        Start(seed, places, sum(g["cost"] for (s, _), g in sums.items() if s == seed), rounds[seed], quality.get(seed))
        for seed, places in ends.items()
    ]

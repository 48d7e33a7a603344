"""SQL text of the numeric checks: category index, naive Bayes, metrics, silhouette."""

from collections.abc import Sequence


def with_ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def index_cte(name: str, source: str, column: str) -> str:
    """(value, idx) by descending frequency, ties by value."""
    return f"""
{name} AS (
  SELECT {column} AS value,
    CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS DOUBLE) AS idx
  FROM {source} WHERE {column} IS NOT NULL GROUP BY {column})"""


def indexed_cte(name: str, source: str, indexes: dict[str, str]) -> str:
    """``source`` with a ``<column>_index`` for each column -> index CTE."""
    joins, columns = [], []
    for i, (column, index) in enumerate(indexes.items()):
        joins.append(f"LEFT JOIN {index} x{i} ON s.{column} = x{i}.value")
        columns.append(
            f"coalesce(x{i}.idx, (SELECT CAST(count(*) AS DOUBLE) FROM {index})) AS {column}_index"
        )
    return f"""
{name} AS (SELECT s.*, {", ".join(columns)} FROM {source} s {" ".join(joins)})"""


def gaussian_nb_ctes(train: str, test: str, features: Sequence[str]) -> str:
    """``nb_scored``: test rows with the prediction of a two-class gaussian model."""
    stats = ["ln(count(*) FILTER (label = {c}) / count(*)) AS p{c}"]
    for i, f in enumerate(features):
        stats.append(f"avg({f}) FILTER (label = {{c}}) AS m{{c}}_{i}")
        stats.append(f"var_pop({f}) FILTER (label = {{c}}) + e AS v{{c}}_{i}")
    columns = [s.format(c=c) for c in (0, 1) for s in stats]
    columns = [s.replace(" + e AS", " + any_value(e) AS") for s in columns]
    score = {
        c: f"p{c}" + "".join(
            f" - 0.5 * (ln(2 * pi() * v{c}_{i}) + ({f} - m{c}_{i}) * ({f} - m{c}_{i}) / v{c}_{i})"
            for i, f in enumerate(features)
        )
        for c in (0, 1)
    }
    spread = ", ".join(f"var_pop({f})" for f in features)
    return f"""
nb_eps AS (SELECT 1e-9 * greatest({spread}) AS e FROM {train}),
nb_model AS (SELECT {", ".join(columns)} FROM {train}, nb_eps),
nb_scored AS (
  SELECT t.*, CASE WHEN {score[1]} > {score[0]} THEN 1e0 ELSE 0e0 END AS prediction
  FROM {test} t, nb_model)"""


def multinomial_nb_ctes(train: str, test: str, features: Sequence[str]) -> str:
    """``nb_scored`` of a two-class multinomial model with smoothing 1."""
    columns, score = [], {}
    for c in (0, 1):
        total = " + ".join(f"sum({f}) FILTER (label = {c})" for f in features)
        columns.append(f"ln((count(*) FILTER (label = {c}) + 1) / (count(*) + 2)) AS p{c}")
        for i, f in enumerate(features):
            columns.append(
                f"ln((sum({f}) FILTER (label = {c}) + 1) / ({total} + {len(features)})) AS w{c}_{i}"
            )
        score[c] = f"p{c}" + "".join(f" + {f} * w{c}_{i}" for i, f in enumerate(features))
    return f"""
nb_model AS (SELECT {", ".join(columns)} FROM {train}),
nb_scored AS (
  SELECT t.*, CASE WHEN {score[1]} > {score[0]} THEN 1e0 ELSE 0e0 END AS prediction
  FROM {test} t, nb_model)"""


def metrics_ctes(scored: str) -> str:
    """``rates`` per class and ``metrics`` over all, from rows of (label, prediction)."""
    return f"""
cells AS (
  SELECT CAST(label AS DOUBLE) AS label, CAST(prediction AS DOUBLE) AS prediction, count(*) AS n
  FROM {scored} GROUP BY 1, 2),
classes AS (SELECT label AS class FROM cells UNION SELECT prediction FROM cells),
sums AS (
  SELECT class,
    (SELECT coalesce(sum(n), 0) FROM cells WHERE label = class) AS actual,
    (SELECT coalesce(sum(n), 0) FROM cells WHERE prediction = class) AS predicted,
    (SELECT coalesce(sum(n), 0) FROM cells WHERE label = class AND prediction = class) AS hits
  FROM classes),
rates AS (
  SELECT class, CAST(actual AS BIGINT) AS rows, CAST(predicted AS BIGINT) AS predicted,
    CAST(hits AS BIGINT) AS hits,
    CASE WHEN predicted = 0 THEN 0 ELSE CAST(hits AS DOUBLE) / predicted END AS precision,
    CASE WHEN actual = 0 THEN NULL ELSE CAST(hits AS DOUBLE) / actual END AS recall,
    CASE WHEN actual + predicted = 0 THEN 0
      ELSE 2 * CAST(hits AS DOUBLE) / (actual + predicted) END AS f1
  FROM sums),
metrics AS (
  SELECT CAST(sum(hits) AS DOUBLE) / sum(rows) AS accuracy,
    sum(rows * precision) / sum(rows) AS weighted_precision,
    sum(rows * f1) / sum(rows) AS f1,
    sum(rows * coalesce(recall, 0)) / sum(rows) AS weighted_recall,
    max(recall) FILTER (class = 0) AS tpr_0,
    max(recall) FILTER (class = 1) AS tpr_1
  FROM rates)"""


METRIC_NAMES = ("accuracy", "weighted_precision", "f1", "weighted_recall", "tpr_0", "tpr_1")


def silhouette_ctes(points: str) -> str:
    """``silhouette`` from long rows (id, cluster, dim, x), in closed form over cluster sums.

    Mean squared distance of a point p to a cluster: |p|^2 + mean|q|^2 - 2 p.mean(q).
    """
    return f"""
norms AS (SELECT id, any_value(cluster) AS cluster, sum(x * x) AS pp FROM {points} GROUP BY id),
sizes AS (SELECT cluster, count(*) AS n, avg(pp) AS qq FROM norms GROUP BY cluster),
centres AS (SELECT cluster, dim, avg(x) AS m FROM {points} GROUP BY cluster, dim),
dots AS (
  SELECT p.id, c.cluster, sum(p.x * c.m) AS pq
  FROM {points} p JOIN centres c ON p.dim = c.dim GROUP BY p.id, c.cluster),
dists AS (
  SELECT d.id, d.cluster, o.cluster AS own, s.n, o.pp + s.qq - 2 * d.pq AS dist
  FROM dots d JOIN sizes s ON d.cluster = s.cluster JOIN norms o ON d.id = o.id),
sides AS (
  SELECT id, max(n) FILTER (cluster = own) AS n,
    max(dist) FILTER (cluster = own) AS own_dist,
    min(dist) FILTER (cluster <> own) AS b
  FROM dists GROUP BY id),
parts AS (SELECT n, CASE WHEN n > 1 THEN own_dist * n / (n - 1) END AS a, b FROM sides),
silhouette AS (
  SELECT avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END)
    AS silhouette
  FROM parts)"""


def two_means_ctes(train: str, test: str, features: Sequence[str], rounds: int = 60) -> str:
    """Two clusters from the corners of the training box, moved ``rounds`` times.

    ``centres_found`` (c and the features), ``train_clustered`` and ``test_clustered``
    (rows with a ``c``). Equals a fit that stops at the same fixed point.
    """
    corner = ", ".join(f"CAST({{}}({f}) AS DOUBLE) AS {f}" for f in features)
    means = ", ".join(f"avg({f}) AS {f}" for f in features)
    values = ", ".join(f"any_value(p.{f}) AS {f}" for f in features)
    gap = " + ".join(f"(p.{f} - m.{f}) * (p.{f} - m.{f})" for f in features)

    def clustered(source):
        return f"""
  SELECT * EXCLUDE (row_id), (SELECT arg_min(m.c, {gap}) FROM centres_found m) AS c
  FROM (SELECT *, row_number() OVER () AS row_id FROM {source}) p"""

    return f"""
points_in AS (SELECT row_number() OVER () AS id, {", ".join(features)} FROM {train}),
moved AS (
  SELECT 0 AS step, 0 AS c, {corner.format(*["min"] * len(features))} FROM points_in
  UNION ALL SELECT 0, 1, {corner.format(*["max"] * len(features))} FROM points_in
  UNION ALL
  SELECT any_value(step) + 1, c, {means} FROM (
    SELECT any_value(m.step) AS step, arg_min(m.c, {gap}) AS c, {values}
    FROM points_in p, moved m WHERE m.step < {rounds} GROUP BY p.id)
  GROUP BY c),
centres_found AS (SELECT c, {", ".join(features)} FROM moved WHERE step = {rounds}),
train_clustered AS ({clustered(train)}),
test_clustered AS ({clustered(test)})"""


def starts_ctes(train: str, features: Sequence[str], starts: Sequence[tuple[int, float, float]], rounds=20, tol=1e-4) -> str:
    """``ended`` (seed, step, a_*, b_*) and ``judged`` (seed, cost, silhouette): two means from given starts.

    A start (seed, p, q) has its first centres at the shares p and q of the training box; it moves until neither
    centre goes further than ``tol``, at most ``rounds`` times.
    """
    values = ", ".join(f"({seed}, {p!r}, {q!r})" for seed, p, q in starts)

    def gap(side):
        return " + ".join(f"(p.{f} - m.{side}_{f}) * (p.{f} - m.{side}_{f})" for f in features)

    def step(side, near):
        return ", ".join(f"coalesce(avg(p.{f}) FILTER ({near}), any_value(m.{side}_{f})) AS new_{side}_{f}" for f in features)

    def far(side):
        return " + ".join(f"(new_{side}_{f} - {side}_{f}) * (new_{side}_{f} - {side}_{f})" for f in features)

    old = ", ".join(f"any_value(m.{side}_{f}) AS {side}_{f}" for side in "ab" for f in features)
    new = ", ".join(f"new_{side}_{f}" for side in "ab" for f in features)
    first = ", ".join(f"lo_{f} + (hi_{f} - lo_{f}) * {share} AS {side}_{f}" for side, share in (("a", "p"), ("b", "q")) for f in features)
    box = ", ".join(f"CAST(min({f}) AS DOUBLE) AS lo_{f}, CAST(max({f}) AS DOUBLE) AS hi_{f}" for f in features)
    norm = " + ".join(f"CAST({f} AS DOUBLE) * {f}" for f in features)
    dot = " + ".join(f"t.{f} * s.m_{f}" for f in features)
    means = ", ".join(f"avg({f}) AS m_{f}" for f in features)
    columns = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in features)
    return f"""
start_points AS MATERIALIZED (SELECT row_number() OVER () AS id, label, {columns} FROM {train}),
start_shares(seed, p, q) AS (VALUES {values}),
box AS (SELECT {box} FROM start_points),
stepped AS (
  SELECT CAST(seed AS BIGINT) AS seed, CAST(0 AS BIGINT) AS step, false AS done, {first} FROM box, start_shares
  UNION ALL
  SELECT seed, step + 1, {far("a")} <= {tol * tol!r} AND {far("b")} <= {tol * tol!r}, {new} FROM (
    SELECT m.seed, m.step, {old}, {step("a", f"{gap('a')} <= {gap('b')}")}, {step("b", f"{gap('a')} > {gap('b')}")}
    FROM start_points p, stepped m WHERE NOT m.done AND m.step < {rounds} GROUP BY m.seed, m.step)),
ended AS (SELECT * FROM stepped QUALIFY row_number() OVER (PARTITION BY seed ORDER BY step DESC) = 1),
parted AS MATERIALIZED (
  SELECT m.seed, p.*, CASE WHEN {gap("a")} <= {gap("b")} THEN 0 ELSE 1 END AS c, least({gap("a")}, {gap("b")}) AS gap, {norm} AS pp
  FROM start_points p, ended m),
sides_of AS (SELECT seed, c, count(*) AS n, avg(pp) AS qq, {means} FROM parted GROUP BY seed, c),
away AS (
  SELECT t.seed, t.id, max(s.n) FILTER (s.c = t.c) AS n, max(t.pp + s.qq - 2 * ({dot})) FILTER (s.c = t.c) AS own,
    min(t.pp + s.qq - 2 * ({dot})) FILTER (s.c <> t.c) AS b
  FROM parted t JOIN sides_of s ON s.seed = t.seed GROUP BY t.seed, t.id),
judged_away AS (SELECT seed, n, CASE WHEN n > 1 THEN own * n / (n - 1) END AS a, b FROM away),
judged AS (
  SELECT seed, (SELECT sum(gap) FROM parted x WHERE x.seed = j.seed) AS cost,
    avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS silhouette
  FROM judged_away j GROUP BY seed)"""

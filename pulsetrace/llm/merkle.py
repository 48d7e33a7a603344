"""A Merkle tree per language over the rows of a table, one tree over these, and a proof for every row.

The children of a node are spread into ``FANOUT`` slot columns by conditional aggregates: the columns
side by side hash to the parent; without a child's own column they are its siblings, those before it
on the left and those after it on the right. Consecutive leaves meet in the map tasks, because the
leaves are sorted, so about one row per parent is shuffled. Places of leaves come from one range sort
and a starting number for each partition, whatever share of the rows a language has.

Proofs go from the top down: a parent's row hands its own path, with the siblings of each child put
before it, to its children. Only rows of parents are joined; a leaf's path arises where it is hashed.
The row's leaf is computed anew from its (possibly altered) fields and folded with that path.

Defined cases: a null field is ``-``, an empty one ``0:``; rows with a null id come last in their
language and are never altered; rows that share an id are ordered by leaf, and equal rows are
leaves of their own with equal digests; a lone leaf is its language's subroot, and a lone subroot the
root, with nothing hashed again; the null language comes first; an empty table gives no rows; other
columns are ignored. Texts are read whole.
"""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """``bytes:value`` of a field, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column, fields=FIELDS) -> Column:
    """Digest of a row whose text is ``text``."""
    return digest(F.concat(*[field(text if name == "text" else F.col(name)) for name in fields]))


def altered_rows(every: int = 3) -> Column:
    """Whether the row is altered before it is checked: ``every`` divides the crc32 of its decimal id."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every
    return F.coalesce(remainder == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in the order within ``group``, and ``n``, the group's size.

    One range sort; a partition's rows start after those of the partitions before it. ``order`` must end with
    a column that differs in every row, so that equal rows too go to several partitions.
    """
    keys = [F.col(group), *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    counts = kept.groupBy(group, part).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    # Neighbouring partitions share a group, so there are as many rows here as partitions and groups together.
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        group, "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    joined = kept.withColumn("_part", F.shiftright("_at", 33)).join(before, [group, "_part"])
    return joined.withColumn("at", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_at", "_part", "_before", "_first"
    )


def _slot(k: int) -> str:
    return f"slot{k}"


def _side(slots: range) -> Column:
    return F.concat(F.lit(""), *[F.coalesce(F.col(_slot(k))["digest"], F.lit("")) for k in slots])


def pivoted(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(group, at, n, slot0 .. slot7, digest) of the parents of ``nodes`` (group, at, n, digest, ``payload``)."""
    child = F.struct("digest", *payload)
    slots = [
        F.max(F.when(F.col("at") % FANOUT == k, child)).alias(_slot(k)) for k in range(FANOUT)
    ]
    parent = F.floor(F.col("at") / FANOUT).cast("long").alias("at")
    size = F.ceil(F.col("n") / FANOUT).cast("long").alias("n")
    spread = nodes.groupBy("group", parent, size).agg(*slots)
    return spread.withColumn("digest", digest(_side(range(FANOUT))))


class Tree:
    """The levels of the trees of all groups over ``leaves`` (group, at, n, digest, ``payload``), from the leaves up."""

    def __init__(self, leaves: DataFrame, payload: list[str]):
        self.payload = payload
        self.leaves = leaves
        self.levels: list[DataFrame] = []  # pivoted parents of the leaves, their parents, ...
        self.roots = leaves.where("n = 1").select("group", F.lit(0).alias("height"), "digest")
        most = leaves.agg(F.max("n")).first()[0] or 0
        nodes = leaves
        while most > 1:
            level = pivoted(nodes.where("n > 1"), payload if not self.levels else [])
            self.levels.append(written(level, "level"))
            nodes = self.levels[-1].select("group", "at", "n", "digest")
            self.roots = self.roots.union(
                nodes.where("n = 1").select("group", F.lit(len(self.levels)).alias("height"), "digest")
            )
            most = -(-most // FANOUT)

    def paths(self, above: DataFrame) -> DataFrame:
        """(group, digest, ``payload``, path, ...) of every leaf; ``above``: (group, height, path, ...) of every root.

        A path lists what stands left and right of the node on each level, from the leaf's up. Further
        columns of ``above`` go down to all leaves of the group.
        """
        more = [c for c in above.columns if c not in ("group", "height", "path")]
        known = None
        for k in range(len(self.levels), 0, -1):
            roots = above.where(F.col("height") == k).select(
                "group", F.lit(0).cast("long").alias("at"), "path", *more
            )
            known = roots if known is None else known.unionByName(roots)
            sides = [F.struct(_side(range(s)).alias("left"), _side(range(s + 1, FANOUT)).alias("right"))
                     for s in range(FANOUT)]
            children = self.levels[k - 1].join(known, ["group", "at"]).select(
                "group", "at", *more, "path",
                F.explode(F.array(*[
                    F.when(F.col(_slot(s)).isNotNull(), F.struct(
                        F.lit(s).alias("slot"), F.col(_slot(s)).alias("child"), sides[s].alias("sides")
                    )) for s in range(FANOUT)
                ])).alias("c"),
            ).where("c IS NOT NULL")
            path = F.concat(F.array("c.sides"), F.col("path")).alias("path")
            if k > 1:
                place = (F.col("at") * FANOUT + F.col("c.slot")).alias("at")
                known = written(children.select("group", place, path, *more), "paths")
            else:
                own = [F.col(f"c.child.{c}").alias(c) for c in ("digest", *self.payload)]
                known = children.select("group", *own, path, *more)
        alone = self.leaves.where("n = 1").join(above.where("height = 0").drop("height"), "group").select(
            "group", "digest", *self.payload, "path", *more
        )
        return alone if known is None else known.unionByName(alone)


def folded(start: Column, path: Column) -> Column:
    """The digest at the end of ``path`` for a leaf digest ``start``."""
    return F.aggregate(path, start, lambda d, x: digest(F.concat(x["left"], d, x["right"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on ``path``, level by level, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"]))))


def manifest(docs: DataFrame, group: str = "lang", every: int = 3) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    The rows that ``altered_rows(every)`` names are checked with their text in lower case (A-Z only).
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then bytewise
    own = leaf(F.col("text"))
    seen = F.when(altered_rows(every), leaf(lower_ascii(F.col("text")))).otherwise(own)
    hashed = written(docs.select(
        key.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("digest"), seen.alias("seen"),
        F.monotonically_increasing_id().alias("copy"),
    ), "leaves")
    order = [F.asc_nulls_last("doc_id"), F.col("digest"), F.col("copy")]
    leaves = written(placed(hashed, "group", order).drop("copy"), "leaves")
    lower = Tree(leaves, ["doc_id", "seen"])
    subroots = written(lower.roots, "subroots")
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "height", "digest")
    upper = Tree(written(placed(named, "group", [F.col("name")]), "ranked"), ["name", "height"])
    top = upper.roots.first()
    above = upper.roots.select("group", "height", F.array().cast(_PATH).alias("path"))
    tops = upper.paths(above).select(
        F.col("name").alias("group"), "height", "path", F.col("digest").alias("subroot")
    )
    found = lower.paths(written(tops, "tops"))
    rows = found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(top and top["digest"]).cast("string").alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

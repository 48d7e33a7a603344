"""The corpus operators over their whole tables, and SQL where it can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, decontaminate, language, lm, merkle, packing, phrases, pii, quality, simhash, suffixes, tokens, vectors,
)
from .common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

CONTROL_CONVERSATION = -7
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds a copy of."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")
    )
    return quality.classify(table(spark, sf_dir, "documents"), labels, held_out(5, 0))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), held_out(7, 2))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control one, formatted, then read back from the examples."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(CONTROL_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.read_back(chat.format_examples(rows.unionByName(control)))


OP4_SQL = f"""
WITH spoken AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({CONTROL_CONVERSATION}, 0, 'user', '{CONTROL_TEXT}'),
    ({CONTROL_CONVERSATION}, 1, 'assistant', '{CONTROL_TEXT}')),
sized AS (
  SELECT *, length(role) + length(text) + 8
      + 4 * (length(role || text) - length(replace(role || text, '&', '')))
      + 3 * (length(role || text) - length(replace(role || text, '<', '')))
      + 4 * (length(role || text) - length(replace(role || text, '[', '')))
      + 5 * (length(role || text) - length(replace(role || text, '|', ''))) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM spoken),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id"""


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links,
  least(e.vec_id, coalesce(l.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.a LEFT JOIN least l ON e.vec_id = l.a"""


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), held_out(3, 1))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect_pii(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


# Steps of a CRC over a byte that is already mixed in, and the whole CRC of a decimal number.
_CRC_BYTE = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
_CRC = f"""xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))),
    lambda c, d: xor(c >> 8, {_CRC_BYTE.format(x="xor(c & 255, d)")})))"""


def _leaf_sql(text: str) -> str:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    values = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in columns]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


OP11_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("text")} AS leaf,
    {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
    coalesce({_CRC} % 3 = 0, false) AS altered
  FROM documents),
leaves AS (
  SELECT *, CASE WHEN altered THEN lowered ELSE leaf END AS seen,
    row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n
  FROM hashed),
nodes AS (
  SELECT g, CAST(0 AS BIGINT) AS height, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT g, height + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY g, height, place // 8),
subroots AS (
  SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT CAST(0 AS BIGINT) AS height, place, n, digest FROM subroots
  UNION ALL
  SELECT height + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM tops WHERE n > 1 GROUP BY height, place // 8),
low_sides AS (
  SELECT l.g, l.place AS leaf_at, k.height, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < k.own), '') AS lefts,
    coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > k.own), '') AS rights
  FROM leaves l
  JOIN (SELECT DISTINCT g, height FROM nodes WHERE n > 1) h ON h.g = l.g
  , LATERAL (SELECT h.height, l.place // CAST(8 ** h.height AS BIGINT) AS own) k
  JOIN nodes s ON s.g = l.g AND s.height = k.height AND s.place // 8 = k.own // 8
  GROUP BY ALL),
top_sides AS (
  SELECT r.g, t.height, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < t.own), '') AS lefts,
    coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > t.own), '') AS rights
  FROM (SELECT r.g, h.height, r.place // CAST(8 ** h.height AS BIGINT) AS own
        FROM subroots r, (SELECT DISTINCT height FROM tops WHERE n > 1) h) t
  JOIN subroots r ON r.g = t.g
  JOIN tops s ON s.height = t.height AND s.place // 8 = t.own // 8
  GROUP BY ALL),
sides AS (
  SELECT g, leaf_at, height AS step, lefts, rights FROM low_sides
  UNION ALL
  SELECT l.g, l.place, t.height + (SELECT max(height) FROM nodes x WHERE x.g = l.g), t.lefts, t.rights
  FROM leaves l JOIN top_sides t ON t.g = l.g),
steps AS (
  SELECT g, leaf_at, row_number() OVER (PARTITION BY g, leaf_at ORDER BY step) AS step, lefts, rights FROM sides),
folds AS (
  SELECT g, place, CAST(0 AS BIGINT) AS step, seen AS digest FROM leaves
  UNION ALL
  SELECT f.g, f.place, s.step, sha256(s.lefts || f.digest || s.rights)
  FROM folds f JOIN steps s ON s.g = f.g AND s.leaf_at = f.place AND s.step = f.step + 1),
ends AS (SELECT g, place, arg_max(digest, step) AS folded_root FROM folds GROUP BY g, place),
proofs AS (
  SELECT g, leaf_at AS place, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof FROM steps GROUP BY ALL)
SELECT l.doc_id, l.leaf, r.digest AS subroot, t.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
  e.folded_root, e.folded_root = t.digest AS verified
FROM leaves l JOIN subroots r ON r.g = l.g JOIN tops t ON t.n = 1 JOIN ends e ON e.g = l.g AND e.place = l.place
LEFT JOIN proofs p ON p.g = l.g AND p.place = l.place"""


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, unnest(w) AS one, unnest(w[2:] || [NULL]) AS two, unnest(w[3:] || [NULL, NULL]) AS three FROM words
  WHERE len(w) > 0),
ones AS MATERIALIZED (SELECT lang, one, count(*) AS f FROM placed WHERE one IS NOT NULL GROUP BY ALL),
twos AS MATERIALIZED (
  SELECT lang, one, two, count(*) AS f FROM placed WHERE two IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
threes AS MATERIALIZED (
  SELECT lang, one, two, three, count(*) AS f FROM placed WHERE three IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM ones GROUP BY lang),
around AS (
  SELECT lang, one, two, max(f) AS most FROM (
    SELECT lang, one, two, f FROM threes UNION ALL SELECT lang, two, three, f FROM threes) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.one || ' ' || c.two AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM twos c JOIN ones l ON l.lang = c.lang AND l.one = c.one JOIN ones r ON r.lang = c.lang AND r.one = c.two
  LEFT JOIN around b ON b.lang = c.lang AND b.one = c.one AND b.two = c.two
  WHERE b.most IS NULL OR 100 * b.most < 50 * c.f
  UNION ALL
  SELECT c.lang, c.one || ' ' || c.two || ' ' || c.three, c.f, 1, l.f, r.f
  FROM threes c JOIN ones l ON l.lang = c.lang AND l.one = c.one
  JOIN twos r ON r.lang = c.lang AND r.one = c.two AND r.two = c.three
  UNION ALL
  SELECT c.lang, c.one || ' ' || c.two || ' ' || c.three, c.f, 2, l.f, r.f
  FROM threes c JOIN twos l ON l.lang = c.lang AND l.one = c.one AND l.two = c.two
  JOIN ones r ON r.lang = c.lang AND r.one = c.three),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN totals USING (lang) QUALIFY rank <= 2000"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_quality_classifier, op3_lm_scoring, op4_chat_formatting,
        op5_embedding_near_dedup, op6_suffix_array_dedup, op7_best_fit_packing, op8_language_id, op9_pii, op10_simhash_near_dedup,
        op11_merkle_manifest, op12_phrase_collocations, op13_token_counts,
    )
}
SQL: dict[str, str] = {
    "op4_chat_formatting": OP4_SQL, "op5_embedding_near_dedup": OP5_SQL,
    "op11_merkle_manifest": OP11_SQL, "op12_phrase_collocations": OP12_SQL,
}

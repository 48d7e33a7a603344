"""Language-model scores: a subword lattice that sums over all segmentations of every word.

The pieces are those of an existing vocabulary; nothing about the set of pieces is trained. Its
file ranks merges and has no probabilities, so a piece weighs what its share is when the
vocabulary cuts the training words (add-one smoothed). A word is a space and its bytes; its probability
is the sum over all its segmentations, by forward recursion in log space; an end token closes each
text. Every byte is a piece, so every word has a probability.

Each distinct word of the corpus is scored once. Words that make up at least one part in
``FREQUENT`` of all tokens, at most that many, go to every task; the others are joined by word, so no
joined key has more than that share of the rows. Counts are combined before the shuffle.

Defined cases: null text counts as empty and is the end token alone; a null ``doc_id`` is scored
and trained on; repeated rows are scored each; without training text counts are zero and all pieces
weigh the same; an empty table gives no rows; other columns are ignored. Texts are read whole.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, written

FREQUENT = 50_000
END = b""  # no word is empty
_FLUSH = 200_000
_LONG = 48
_MARK = "▁"


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, split at ASCII white space, then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """A trie over the surfaces of the vocabulary's pieces, as a table of next states."""

    _loaded: dict[str, "Lattice"] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        surfaces: dict[bytes, int] = {END: 0}
        self.surface_of = np.full(self.model.get_piece_size(), -1)
        for i in range(self.model.get_piece_size()):
            if self.model.is_control(i) or self.model.is_unknown(i):
                continue
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                raw = bytes([int(piece[3:5], 16)])
            else:
                raw = piece.replace(_MARK, " ").encode()
            # A space begins a word and is nowhere else.
            if raw.rfind(b" ") <= 0:
                self.surface_of[i] = surfaces.setdefault(raw, len(surfaces))
        self.size = len(surfaces)
        nodes, piece_at = [{}], [-1]
        for raw, place in surfaces.items():
            if not raw:
                continue
            state = 0
            for byte in raw:
                state = nodes[state].setdefault(byte, len(nodes))
                if state == len(nodes):
                    nodes.append({})
                    piece_at.append(-1)
            piece_at[state] = place
        self.nodes, self.piece_at = nodes, np.array(piece_at)
        self.next = np.full((len(nodes), 256), -1, np.int32)
        for state, edges in enumerate(nodes):
            for byte, to in edges.items():
                self.next[state, byte] = to

    @classmethod
    def load(cls, path: str) -> "Lattice":
        """One table per Python worker, whatever the number of its tasks."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def count(self, words: list[bytes], n: np.ndarray) -> np.ndarray:
        """How often each surface is used when the vocabulary cuts ``words``, met ``n`` times each."""
        cut = self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        ids = np.fromiter((i for ids in cut for i in ids), np.int64, size.sum())
        surface = self.surface_of[ids]
        weight = np.repeat(n, size)
        return np.bincount(surface[surface >= 0], weights=weight[surface >= 0], minlength=self.size)

    def score(self, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, summed over its segmentations."""
        out = np.zeros(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(size):
            where = np.flatnonzero(size == length)
            if length == 0:
                out[where] = log_p[0]
            elif length > _LONG:
                out[where] = [self._score_one(words[i], log_p) for i in where]
            else:
                for at in range(0, len(where), 1 << 14):
                    part = where[at : at + (1 << 14)]
                    flat = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
                    out[part] = self._score_block(flat.reshape(len(part), length), log_p)
        return out

    def _score_block(self, body: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Words of one length side by side: every start pushes along the trie."""
        chars = np.concatenate([np.full((len(body), 1), 32, np.uint8), body], axis=1)
        n, length = chars.shape
        forward = np.full((length + 1, n), -np.inf)
        forward[0] = 0.0
        for start in range(length):
            row, state = np.arange(n), np.zeros(n, np.int32)
            for at in range(start, length):
                state = self.next[state, chars[row, at]]
                live = state >= 0
                if not live.all():
                    row, state = row[live], state[live]
                if not len(row):
                    break
                piece = self.piece_at[state]
                known = piece >= 0
                to = row[known]
                forward[at + 1, to] = np.logaddexp(
                    forward[at + 1, to], forward[start, to] + log_p[piece[known]]
                )
        return forward[length]

    def _score_one(self, word: bytes, log_p: np.ndarray) -> float:
        """A long word alone, in memory of its own length."""
        chars = b" " + word
        forward = [-math.inf] * (len(chars) + 1)
        forward[0] = 0.0
        for start in range(len(chars)):
            state, here = 0, forward[start]
            for at in range(start, len(chars)):
                state = self.nodes[state].get(chars[at])
                if state is None:
                    break
                piece = self.piece_at[state]
                if piece >= 0:
                    a, b = forward[at + 1], here + log_p[piece]
                    high, low = (a, b) if a > b else (b, a)
                    forward[at + 1] = high + math.log1p(math.exp(low - high)) if low > -math.inf else high
        return forward[-1]


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, train, total) over all tokens, the end token among them."""

    def count(batches):
        held = Counter(), Counter()

        def flush():
            words = list(held[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([held[0][w] for w in words], pa.int64()),
                 pa.array([held[1][w] for w in words], pa.int64())],
                ["word", "train", "total"],
            )
            held[0].clear()
            held[1].clear()

        for batch in batch_rows(batches):
            for text, out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                words = tokens(text)
                held[1].update(words)
                if not out:
                    held[0].update(words)
            if len(held[1]) > _FLUSH:
                yield from flush()
        yield from flush()

    parts = docs.select("text", "held_out").mapInArrow(count, "word binary, train long, total long")
    return parts.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def _piece_weights(counts: DataFrame, path: str, ends: int) -> np.ndarray:
    """Natural log probability of every surface, the end token first."""

    def count(batches):
        lattice = Lattice.load(path)
        total = np.zeros(lattice.size)
        for batch in batches:
            total += lattice.count(batch.column("word").to_pylist(), batch.column("train").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["piece", "n"]
        )

    trained = counts.where((F.col("train") > 0) & (F.octet_length("word") > 0)).select("word", "train")
    found = trained.mapInArrow(count, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    weights = np.ones(Lattice.load(path).size)
    weights[0] += ends
    for piece, n in found.collect():  # at most the vocabulary
        weights[piece] += n
    return np.log(weights / weights.sum())


def _scored_words(counts: DataFrame, path: str, log_p: np.ndarray) -> DataFrame:
    """(word, train, total, ln_p) of every distinct word."""
    shared = counts.sparkSession.sparkContext.broadcast(log_p)  # one number per piece

    def score(batches):
        lattice = Lattice.load(path)
        for batch in batches:
            values = lattice.score(batch.column("word").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, "ln_p"])

    return counts.mapInArrow(score, "word binary, train long, total long, ln_p double")


ROWS = "row long, doc_id long, held_out boolean, word binary, tf long, n_tokens long, n_known long, base double, ln_p double"


def _document_rows(docs: DataFrame, frequent: dict[bytes, tuple[int, float]]) -> DataFrame:
    """One row per document with the sums over frequent words, one per document and other word."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT words
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), *[pa.int64()] * 3, pa.float64(), pa.float64()]
    schema = pa.schema(list(zip([c.split()[0] for c in ROWS.split(", ")], types)))

    def rows(batches):
        get = {w: (c, math.log10(c + 1), ln_p) for w, (c, ln_p) in shared.value.items()}.get
        for batch in batch_rows(batches, 128):
            out = tuple([] for _ in types)
            for row, doc_id, held_out, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "held_out", "text"))):
                words = Counter(tokens(text))
                known, base, ln_p = 0, 0.0, 0.0
                for word, tf in words.items():
                    found = get(word)
                    if found is None:
                        for values, value in zip(out, (row, None, None, word, tf, None, None, None, None)):
                            values.append(value)
                    else:
                        c, log_c, log_word = found
                        known += tf if c else 0
                        base += tf * log_c
                        ln_p += tf * log_word
                total = sum(words.values())
                for values, value in zip(out, (row, doc_id, held_out, None, None, total, known, base, ln_p)):
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, types)], schema=schema
            )

    return docs.mapInArrow(rows, ROWS)


def score_documents(docs: DataFrame, held_out, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); scores are log10."""
    path = path or vocabulary_path()
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        held_out.alias("held_out"), "text",
    )
    counts = written(_word_counts(source), "word-counts")
    totals = counts.agg(
        F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0),
        F.coalesce(F.sum("total"), F.lit(0)),
        F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("train"))), F.lit(0)),
    ).first()
    n, v, everything, ends = totals
    log_p = _piece_weights(counts, path, ends)
    scored = written(_scored_words(counts, path, log_p), "scored-words")
    often = F.col("total") * frequent >= everything
    known = {bytes(r["word"]): (r["train"], r["ln_p"]) for r in scored.where(often).collect()}
    rows = written(_document_rows(source, known), "document-words")
    whole = rows.where("word IS NULL").drop("word", "tf")
    rare = rows.where("word IS NOT NULL").select("row", "word", "tf").join(
        scored.where(~often).select("word", "train", "ln_p"), "word"
    )
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("train") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10(F.col("train") + 1)).alias("more_base"),
        F.sum(F.col("tf") * F.col("ln_p")).alias("more_ln_p"),
    )
    added = lambda name: F.col(name) + F.coalesce(f"more_{name.removeprefix('n_')}", F.lit(0))
    return whole.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        added("n_known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (added("base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (added("ln_p") / math.log(10)).alias("score"),
    )

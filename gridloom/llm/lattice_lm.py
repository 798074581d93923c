"""Language-model scoring with a subword lattice.

Tokens are the words of the text (A-Z lower-cased) and one end.  A word's
probability is a marginal: the forward recursion, in log space, sums over all ways
to write it with the pieces of an existing vocabulary.  The first piece is one that
begins a word, later ones are not; after each piece the word stops or goes on, so
the lattice gives a distribution over words.  A character without a piece of its own
is written in byte pieces.  A text's score is the log10 of the product of its words'
marginals and of the end's probability: the marginal probability of the document, as
no piece reaches over a gap between words.

Piece probabilities start from the vocabulary's own scores (a score is minus a
rank; the prior is 1 / (rank + ``RANK_OFFSET``)) and are re-estimated by
expectation-maximisation over all uses of words in the training texts, with the
prior as ``PRIOR_COUNTS`` pseudo-counts.  The end's probability is the share of ends
among the training tokens.

``mixed_score``, a column beside the score, is another model that takes the lattice as
the back-off of whole-word counts: p(word) = max(c - d, 0) / n + d * v / n * lattice(word),
with c the word's training count, n all, v distinct training words, d = ``DISCOUNT``.

Scale: documents are read in chunks of about ``CHUNK_BYTES``.  A chunk is encoded
against its own dictionary, and only distinct words of chunks are shuffled: once to
be counted over the corpus, once back to their chunk with count and probability.  A
task scores the chunks dealt to it; their number grows with the input.
What reaches the driver is one number a piece and totals.

Defined cases: null text counts as empty and has the end token only; without any
training document every word has its probability by the vocabulary's scores alone;
repeated rows are scored one by one and count one by one in training; ids may be of
any type; a very long text is a chunk of its own and read whole; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import regroup, store
from gridloom.llm.pieces import MARK, default_model, vocabulary

CHUNK_BYTES = 24 << 20
RANK_OFFSET, PRIOR_COUNTS, ROUNDS, DISCOUNT = 10.0, 1000.0, 4, 0.75
#: Matrix cells (words x longest word) that the recursion handles at once.
CELLS = 1 << 20
NEG = -1e30


class Lattice:
    """The pieces as a trie in sorted arrays, with log probabilities.

    logp: one value a piece, then one for a byte, then one for the stop.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], logp: np.ndarray | None = None):
        self.starts = np.array([t.startswith(MARK) for t, _, _ in pieces])
        children: dict[tuple[int, int], int] = {}
        piece = [-1]
        for k, (text, _, _) in enumerate(pieces):
            node = 0
            for ch in map(ord, text):
                nxt = children.get((node, ch))
                if nxt is None:
                    nxt = children[node, ch] = len(piece)
                    piece.append(-1)
                node = nxt
            piece[node] = k
        keys = np.array([(n << 21) | c for n, c in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), np.int64)[order]
        self.piece = np.array(piece, np.int64)
        self.longest = max((len(t) for t, _, _ in pieces), default=1)
        ranks = -np.array([s for _, s, _ in pieces], float)
        prior = 1.0 / (ranks - ranks.min() + RANK_OFFSET)
        self.prior = np.concatenate([prior / prior.sum(), [1e-4, 0.3]])
        self.logp = self.normalise(np.zeros(len(pieces) + 2)) if logp is None else logp

    def normalise(self, counts: np.ndarray) -> np.ndarray:
        """Log probabilities: first pieces sum to 1; later pieces, bytes and stop do."""
        total = counts + PRIOR_COUNTS * self.prior
        first = np.concatenate([self.starts, [False, False]])
        out = np.empty(len(total))
        out[first] = np.log(total[first] / total[first].sum())
        later = total[~first] / total[~first].sum()
        out[~first] = np.log(later)
        out[-2] -= math.log(256)  # one of 256 bytes
        return out

    def step(self, node: np.ndarray, ch: np.ndarray) -> np.ndarray:
        key = (node << 21) | ch
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(indices, code points (L, N), lengths), the words of a group sorted by length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        start = 0
        while start < len(order):
            n = max(1, min(len(order) - start, CELLS // int(lengths[order[start]])))
            while n > 1 and n * int(lengths[order[start + n - 1]]) > 2 * CELLS:
                n //= 2
            some = order[start : start + n]
            longest = int(lengths[some[-1]])
            text = "".join((MARK + words[i]).ljust(longest, "\0") for i in some)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, longest).T.astype(np.int64)
            yield some, np.ascontiguousarray(codes), lengths[some]
            start += n

    def forward(self, codes: np.ndarray, lengths: np.ndarray, edges: list | None = None) -> np.ndarray:
        """alpha (L + 1, N): log of the sum over all ways to write each prefix."""
        longest, n = codes.shape
        alpha = np.full((longest + 1, n), NEG)
        alpha[0] = 0.0
        for i in range(longest):
            alive = np.arange(np.searchsorted(lengths, i, side="right"), n)
            node = np.zeros(len(alive), np.int64)
            for width in range(1, min(self.longest, longest - i) + 1):
                if width > 1:
                    fits = lengths[alive] >= i + width
                    alive, node = alive[fits], node[fits]
                if not len(alive):
                    break
                node = self.step(node, codes[i + width - 1, alive])
                k = np.where(node >= 0, self.piece[node], -1)
                hit = k >= 0
                if width == 1 and not hit.all():
                    lost = alive[~hit]
                    ch = codes[i, lost]
                    size = 1 + (ch >= 0x80) + (ch >= 0x800) + (ch >= 0x10000)
                    self._relax(alpha, i, 1, lost, size * self.logp[-2], edges, np.full(len(lost), len(self.logp) - 2), size)
                if hit.any():
                    self._relax(alpha, i, width, alive[hit], self.logp[k[hit]], edges, k[hit], None)
                going = node >= 0
                alive, node = alive[going], node[going]
        return alpha

    @staticmethod
    def _relax(alpha, i, width, who, logp, edges, piece, size):
        alpha[i + width, who] = np.logaddexp(alpha[i + width, who], alpha[i, who] + logp)
        if edges is not None:
            edges.append((i, width, who, logp, piece, size))

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural log of the marginal probability of each word."""
        out = np.empty(len(words))
        for some, codes, lengths in self.groups(words):
            alpha = self.forward(codes, lengths)
            out[some] = alpha[lengths, np.arange(len(some))] + self.logp[-1]
        return out

    def expected_counts(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, byte and stop over all segmentations."""
        out = np.zeros(len(self.logp))
        for some, codes, lengths in self.groups(words):
            edges: list = []
            alpha = self.forward(codes, lengths, edges)
            each = np.arange(len(some))
            total = alpha[lengths, each]
            beta = np.full_like(alpha, NEG)
            beta[lengths, each] = 0.0
            weight = counts[some].astype(float)
            for i, width, who, logp, piece, size in reversed(edges):
                through = logp + beta[i + width, who]
                beta[i, who] = np.logaddexp(beta[i, who], through)
                used = np.exp(alpha[i, who] + through - total[who]) * weight[who] * (1 if size is None else size)
                out += np.bincount(piece, used, len(out))
            out[-1] += weight.sum()
        return out


def _bytes_list(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(values, np.int32).tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def tokenise(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows of two kinds by chunk: documents as word numbers (ids), and the chunk's
    dictionary (wid, word, n_train: its uses in training documents)."""
    source = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), source.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("ids", T.BinaryType()), T.StructField("wid", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n_train", T.LongType())])
    names = schema.fieldNames()

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in regroup(batches, "text", CHUNK_BYTES):
            # lowered in Python: Arrow's ascii_lower misreads slices of longer arrays
            lowered = pa.array([t.encode().lower() for t in batch.column(2).to_pylist()], pa.large_binary())
            lists = pc.ascii_split_whitespace(lowered.cast(pa.large_string()))
            offsets = np.asarray(lists.offsets)
            coded = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
            words, ids = coded.dictionary, np.asarray(coded.indices, np.int32)
            offsets = offsets - offsets[0]
            blank = pc.index(words, "").as_py() if len(words) else -1
            if blank >= 0:
                real = ids != blank
                offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
                ids = ids[real]
            training = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            used = np.bincount(ids[np.repeat(training, np.diff(offsets))], minlength=len(words))
            n, v = batch.num_rows, len(words)
            kinds = [pa.int64(), batch.column(0).type, pa.bool_(), pa.binary(), pa.int32(), pa.string(), pa.int64()]
            columns = [pa.array(np.full(n, chunk)), batch.column(0), batch.column(1), pa.array(_bytes_list(ids, offsets), pa.binary()), *[pa.nulls(n, t) for t in kinds[4:]]]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            for a in range(0, v, 65536):
                b = min(v, a + 65536)
                wid = np.arange(a, b, dtype=np.int32)
                columns = [pa.array(np.full(b - a, chunk)), *[pa.nulls(b - a, t) for t in kinds[1:4]], pa.array(wid), words[a:b].cast(pa.string()), pa.array(used[a:b].astype(np.int64))]
                out = pa.RecordBatch.from_arrays(columns, names=names)
                yield out if blank < 0 else out.filter(pa.array(wid != blank))
            chunk += 1

    return source.mapInArrow(run, schema)


def fit_pieces(words: DataFrame, model_file: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece log probabilities by expectation-maximisation on words(word, c), each c times."""
    pieces = vocabulary(model_file).pieces
    logp = Lattice(pieces).logp
    for _ in range(rounds):

        def expect(batches, logp=logp):
            lattice = Lattice(vocabulary(model_file).pieces, logp)
            total = np.zeros(len(logp))
            for batch in batches:
                total += lattice.expected_counts(batch.column(0).to_pylist(), np.asarray(batch.column(1), float))
            at = np.flatnonzero(total).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

        sums = words.select("word", "c").mapInArrow(expect, "k int, n double").groupBy("k").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(logp))
        for r in sums.collect():  # a row a piece at most
            counts[r["k"]] = r["n"]
        logp = Lattice(pieces).normalise(counts)
    return logp


def score(docs: DataFrame, held_out: Column, model_file: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score."""
    path = model_file or default_model()
    tokens = store(tokenise(docs, held_out))
    rows = tokens.where(F.col("ids").isNotNull()).select("chunk", "doc_id", "held_out", "ids")
    dictionary = tokens.where(F.col("word").isNotNull()).select("chunk", "wid", "word", "n_train")
    words = store(dictionary.groupBy("word").agg(F.sum("n_train").alias("c")))
    n_words, v_words = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    ends, chunks = rows.agg(F.count_if(~F.col("held_out")), F.count_distinct("chunk")).collect()[0]
    logp = fit_pieces(words.where("c > 0"), path)
    total, distinct = n_words + ends, v_words + (1 if ends else 0)
    p_end = (ends + 0.5) / (total + 1.0)

    def word_probabilities(batches):
        lattice = Lattice(vocabulary(path).pieces, logp)
        for batch in batches:
            c = np.asarray(batch.column(1), float)
            q = lattice.log_probability(batch.column(0).to_pylist())
            mixed = q
            if n_words:
                seen = np.log(np.maximum(c - DISCOUNT, 1e-300) / n_words)
                seen[c == 0] = -np.inf
                mixed = np.logaddexp(seen, math.log(DISCOUNT * v_words / n_words) + q)
            go_on = math.log(1 - p_end)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q + go_on), pa.array(mixed + go_on)], names=["word", "c", "lp", "mixed"])

    table = words.mapInArrow(word_probabilities, "word string, c long, lp double, mixed double")
    known = dictionary.drop("n_train").join(table, "word").select(F.col("chunk").alias("part"), "wid", "c", "lp", "mixed")
    smooth = 1.0 * (total + 1.0 * (distinct + 1))
    longs = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
    doubles = [T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "mixed_score")]
    out = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *longs, *doubles])

    def score_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        wid = np.asarray(right["wid"].to_numpy(), np.int64)
        size = int(wid.max()) + 1 if len(wid) else 0
        c, lp, mixed = np.zeros(size), np.zeros(size), np.zeros(size)
        c[wid], lp[wid], mixed[wid] = right["c"].to_numpy(), right["lp"].to_numpy(), right["mixed"].to_numpy()
        base = np.log10((c + 1) / smooth)
        end_base = math.log10((ends + 1) / smooth)
        end_model = math.log10(p_end)
        made: list[list] = [[], [], [], [], []]
        for raw in left["ids"]:
            ids = np.frombuffer(raw.as_buffer(), np.int32)
            sums = (len(ids) + 1, int((c[ids] > 0).sum()) + (1 if ends else 0), base[ids].sum() + end_base)
            for column, value in zip(made, (*sums, lp[ids].sum() / math.log(10) + end_model, mixed[ids].sum() / math.log(10) + end_model)):
                column.append(value)
        columns = [pa.array(x, pa.int64()) for x in made[:2]] + [pa.array([total] * left.num_rows, pa.int64())] + [pa.array(x, pa.float64()) for x in made[2:]]
        return pa.Table.from_arrays([left["doc_id"].combine_chunks(), left["held_out"].combine_chunks(), *columns], names=out.fieldNames())

    # a few chunks a task, however many there are
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks)
    dealt = rows.repartition(tasks, "chunk"), known.repartition(tasks, "part")
    return dealt[0].groupBy("chunk").cogroup(dealt[1].groupBy("part")).applyInArrow(score_chunk, out)

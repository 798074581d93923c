"""SentencePiece encoding and decoding over an existing piece vocabulary.

An Aho-Corasick automaton over the pieces is driven once over each unit of text;
at every position the output links name all pieces that end there, and each
relaxes the best score of its end (a single-pass Viterbi).

Text rules (those of the vocabulary's own normaliser): a space becomes U+2581,
one U+2581 is put before the text, nothing else is changed.  A character that no
piece covers costs ``min score - 10`` and is written as its UTF-8 byte pieces.  A
literal U+2581 in the text is written as byte pieces too, so that decoding gives
the text back exactly.  Of equal scores the longest last piece wins.

A text is cut before each run of spaces that follows another character.  No piece
holds U+2581 after another character (checked at load; else texts stay whole), so
the units are independent and a unit seen before needs no second pass.

Defined cases: null text -> null ids, null count, null score; '' -> no ids, 0;
texts of any length are encoded whole; repeated rows give equal rows; an input
column named like an output column is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import map_text

MARK = "▁"
#: Stands for a literal U+2581 of the text; no valid UTF-8 holds a lone surrogate.
LITERAL = "\udc81"
UNKNOWN_PENALTY = 10.0
#: Units whose encoding a worker remembers; further ones are encoded anew.
MEMO = 100_000
#: Text encoded, and rows decoded, at once: bounds of a worker's memory.
ENCODE_BYTES, DECODE_ROWS = 2 << 20, 500

_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceAutomaton:
    """Aho-Corasick over pieces with failure and output links, in flat lists."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]):
        """pieces: (text, score, id); byte_ids: the 256 ids of byte pieces."""
        self.goto: list[dict[str, int]] = [{}]
        self.depth, self.pid, self.score = [0], [-1], [0.0]
        for text, score, piece_id in pieces:
            state = 0
            for ch in text:
                nxt = self.goto[state].get(ch)
                if nxt is None:
                    nxt = len(self.goto)
                    self.goto[state][ch] = nxt
                    self.goto.append({})
                    self.depth.append(self.depth[state] + 1)
                    self.pid.append(-1)
                    self.score.append(0.0)
                state = nxt
            self.pid[state], self.score[state] = piece_id, score
        self.fail, self.link = [0] * len(self.goto), [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for state in queue:  # grows while it is read: breadth first
            up = self.fail[state]
            self.link[state] = up if self.pid[up] >= 0 else self.link[up]
            for ch, child in self.goto[state].items():
                queue.append(child)
                back = up
                while back and ch not in self.goto[back]:
                    back = self.fail[back]
                self.fail[child] = self.goto[back].get(ch, 0)
        self.byte_ids = byte_ids
        self.unknown = min((s for _, s, _ in pieces), default=0.0) - UNKNOWN_PENALTY
        self.splits = all(MARK not in text.lstrip(MARK) for text, _, _ in pieces)

    def viterbi(self, unit: str) -> tuple[list[int], float]:
        """Best ids and score of one unit (spaces already U+2581)."""
        goto, fail, link, pid, depth, score = self.goto, self.fail, self.link, self.pid, self.depth, self.score
        best, back = [0.0], [0]
        state, i = 0, 0
        for ch in unit:
            i += 1
            nxt = goto[state].get(ch)
            while nxt is None and state:
                state = fail[state]
                nxt = goto[state].get(ch)
            state = nxt or 0
            end = state if pid[state] >= 0 else link[state]
            top, via, single = float("-inf"), 0, False
            while end:
                d = depth[end]
                s = best[i - d] + score[end]
                if s > top:
                    top, via = s, end
                single = d == 1
                end = link[end]
            if not single:
                s = best[i - 1] + self.unknown
                if s > top:
                    top, via = s, 0
            best.append(top)
            back.append(via)
        ids: list[int] = []
        while i:
            via = back[i]
            if via:
                ids.append(pid[via])
                i -= depth[via]
            else:
                raw = (MARK if unit[i - 1] == LITERAL else unit[i - 1]).encode("utf-8", "surrogatepass")
                ids.extend(self.byte_ids[b] for b in reversed(raw))
                i -= 1
        ids.reverse()
        return ids, best[-1]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        if not self.splits:
            return [MARK + text.replace(" ", MARK)]
        if text[0] != " " and "  " not in text:
            return [MARK + w for w in text.split(" ")]
        return _UNIT.findall(MARK + text.replace(" ", MARK))


class Vocabulary:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        byte_ids = [-1] * 256
        pieces = []
        self.raw: list[bytes] = []
        for i in ids:
            if model.is_byte(i):
                byte_ids[int(self.text[i][1:-1], 16)] = i
                self.raw.append(bytes([int(self.text[i][1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                pieces.append((self.text[i], float(model.get_score(i)), i))
                self.raw.append(self.text[i].replace(MARK, " ").encode())
        if -1 in byte_ids:
            raise ValueError(f"{model_file} has no full set of byte pieces")
        self.pieces = pieces
        self.automaton = PieceAutomaton(pieces, byte_ids)

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoder(model_file: str):
    """A function from a list of texts to (ids, count, score) Arrow arrays."""
    auto = vocabulary(model_file).automaton
    memo: dict[str, tuple[bytes, float]] = {}

    def encode(texts: list[str | None]) -> list[pa.Array]:
        fresh: dict[str, tuple[bytes, float]] = {}
        parts: list[bytes] = []
        counts, scores = [], []
        for text in texts:
            if text is None:
                counts.append(None)
                scores.append(None)
                continue
            units = auto.units(text)
            got = list(map(memo.get, units))
            if None in got:
                for k, hit in enumerate(got):
                    if hit is None:
                        unit = units[k]
                        hit = fresh.get(unit)
                        if hit is None:
                            ids, s = auto.viterbi(unit)
                            hit = (np.array(ids, np.int32).tobytes(), s)
                            if len(memo) < MEMO and len(unit) <= 64:
                                memo[unit] = hit
                            else:
                                fresh[unit] = hit
                        got[k] = hit
            joined = b"".join([g[0] for g in got])
            parts.append(joined)
            counts.append(len(joined) // 4)
            scores.append(float(sum([g[1] for g in got])))
        values = np.frombuffer(b"".join(parts), np.int32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([c or 0 for c in counts], out=offsets[1:])
        marks = pa.array([None if c is None else int(o) for c, o in zip(counts, offsets)] + [int(offsets[-1])], pa.int32())
        return [pa.ListArray.from_arrays(marks, pa.array(values)), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())]

    return encode


def encode(docs: DataFrame, model_file: str | None = None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns plus piece_ids array<int>, n_pieces long, piece_score double."""
    path = model_file or default_model()
    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType()), T.StructField("piece_score", T.DoubleType())]
    return map_text(docs, lambda: encoder(path), fields, text_col, carry, ENCODE_BYTES)


def decode(encoded: DataFrame, model_file: str | None = None, ids_col: str = "piece_ids") -> DataFrame:
    """All columns plus decoded string: the exact text the ids were made from."""
    path = model_file or default_model()
    keep = [c for c in encoded.columns if c.lower() != "decoded"]
    source = encoded.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        vocab = vocabulary(path)
        for whole in batches:
            for start in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(start, DECODE_ROWS)
                column = batch.column(batch.schema.get_field_index(ids_col))
                values, offsets, valid = np.asarray(column.values), column.offsets.to_pylist(), column.is_valid().to_pylist()
                texts = [vocab.decode(values[a:b].tolist()) if ok else None for a, b, ok in zip(offsets, offsets[1:], valid)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return source.mapInArrow(run, schema)

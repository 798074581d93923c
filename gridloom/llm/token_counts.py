"""Token counts of whole texts: Arrow functions that return lengths only.

A text is split at safe boundaries: before a space that follows a character which
isn't white space.  A byte-level pre-token never holds white space after another
character, so no token spans such a boundary and the counts of the parts add up
to the count of the whole (special strings hold no space either and are
recognised within their part, as the library does by default).  Parts not met
before are encoded in batches balanced by bytes; a worker remembers the lengths
of up to ``MEMO`` short parts, which bounds its memory and changes no result.

Defined cases: null text counts as empty; '' has 0 tokens; texts of any length are
counted whole; an input column named like an output column is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import map_text

MEMO = 400_000
#: Bytes of parts given to the library at once.
CALL_BYTES = 1 << 20

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_BOUNDARY = re.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def parts_of(text: str) -> list[str]:
    if not text:
        return []
    if text[0] == " " or _SPACE_AFTER_SPACE.search(text):
        return _BOUNDARY.split(text)
    words = text.split(" ")
    return [words[0], *[" " + w for w in words[1:]]]


def counter(path: str):
    """A function from a list of texts to [n_bytes, n_tokens] Arrow arrays."""
    encode = tokenizer(path).encode_batch_fast
    memo: dict[str, int] = {}

    def lengths(parts: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        call: list[str] = []
        held = 0
        for part in parts:
            call.append(part)
            held += len(part.encode()) + 16
            if held >= CALL_BYTES:
                out.update(zip(call, map(len, encode(call, add_special_tokens=False))))
                call, held = [], 0
        if call:
            out.update(zip(call, map(len, encode(call, add_special_tokens=False))))
        return out

    def count(texts: list[str | None]) -> list[pa.Array]:
        cut_up = [parts_of(t) if t else [] for t in texts]
        fresh = set().union(*cut_up) if cut_up else set()
        fresh.difference_update(memo)
        found = lengths(list(fresh))
        if len(memo) < MEMO:
            for part, n in found.items():
                if len(part) <= 64:
                    memo[part] = n
                    if len(memo) >= MEMO:
                        break
        known = memo if not found else {**memo, **found} if len(found) > len(memo) else _Either(memo, found)
        tokens = [sum(map(known.__getitem__, parts)) for parts in cut_up]
        sizes = [len(t.encode()) if t else 0 for t in texts]
        return [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]

    return count


class _Either(dict):
    """Looks in the first mapping, then, for a key it lacks, in the second."""

    def __init__(self, first: dict, second: dict):
        self.second = second
        self.first = first

    def __getitem__(self, key):
        n = self.first.get(key)
        return self.second[key] if n is None else n


def token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns plus n_bytes long (UTF-8) and n_tokens long."""
    where = path or default_tokenizer()
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_text(docs, lambda: counter(where), fields, text_col, carry)

"""Odd tables for each operator: nulls, repeated rows, long texts, clashing names, no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import fingerprints, langid, lattice_lm, line_dedup, mixing, pieces, quality, sharding, simhash, token_counts
from gridloom.llm.common import id_bucket

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{i}" for i in range(25))


def identify(docs):
    net = langid.fit(docs, id_bucket(F.col("doc_id"), 5) != 0)
    return langid.identify(docs, net, ["doc_id"])


#: operators that give a row for each row
ROW_BY_ROW = {
    "pieces": lambda d: pieces.decode(pieces.encode(d, carry=["doc_id", "text"])),
    "sharding": sharding.shard_documents,
    "token_counts": token_counts.token_counts,
    "mixing": mixing.mix,
    "langid": identify,
    "simhash": lambda d: simhash.link_documents(d, 3),
    "lattice_lm": lambda d: lattice_lm.score(d, id_bucket(F.col("doc_id"), 7) == 2),
    "quality": quality.quality_rules,
    "line_dedup": line_dedup.dedup_lines,
    "fingerprints": fingerprints.fingerprint_documents,
}
#: operators that choose rows or change texts and give the columns of their input
STAGES = {
    "filter_documents": quality.filter_documents,
    "clean_documents": line_dedup.clean_documents,
    "keep_one": simhash.keep_one,
    "apply_mix": lambda d: mixing.apply_mix(d, mixing.mix(d)),
}


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 3)
    monkeypatch.setattr(lattice_lm, "ROUNDS", 1)


@pytest.mark.parametrize("name", [*ROW_BY_ROW, *STAGES])
def test_no_rows(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    got = (ROW_BY_ROW | STAGES)[name](empty)
    assert got.collect() == []


#: Names that operators use for their own columns.
OUTPUTS = ["n_words", "n_lines", "n_removed", "n_tokens", "kept", "base_failed", "shard", "slot", "simhash", "node", "root", "key", "score", "size", "copies", "target", "Lang_Pred", "p", "n", "h", "a", "b", "site", "lo", "component_id", "text_hash", "piece_ids"]
LONG = "\n".join(f"line {i} of a long text with number {i * i}" for i in range(30_000))
ROWS = [(None,) * 5] * 3 + [(1, "", None, "s", 0), (2, " \n\t", "en", "s", 3), (3, None, "en", None, None)]
ROWS += [(4, WORDS, "en", "s", 9)] * 6 + [(5, WORDS, "fr", "t", 9), (None, WORDS, None, "t", 9)]
ROWS += [(6, LONG, "en", "s", 9), (7, LONG + " end", "en", "t", 9), (8, "x" * 300_000, "fr", "t", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty texts, ties, repeated rows, very long texts and
    further columns with clashing names."""
    assert len(LONG) > 1_000_000
    schema = SCHEMA + "".join(f", `{c}` int" for c in OUTPUTS)
    return spark.createDataFrame([(*r, *[-7] * len(OUTPUTS)) for r in ROWS], schema).repartition(3).cache()


@pytest.mark.parametrize("name", list(ROW_BY_ROW))
def test_a_row_for_each_row(odd, name):
    got = ROW_BY_ROW[name](odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    if name not in ("sharding", "mixing"):  # these place rows one by one
        assert len({str(r) for r in got if r["doc_id"] == 4}) == 1


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_keep_columns(odd, name):
    out = STAGES[name](odd)
    got = out.collect()
    assert out.columns == odd.columns
    assert all(r[c] == -7 for r in got for c in OUTPUTS)
    texts = Counter(r["text"] for r in got)
    if name == "keep_one":  # one of the texts without words, one of each other
        assert sorted((t or "").strip() for t in texts) == sorted(["", WORDS, LONG, "x" * 300_000]) and set(texts.values()) == {1}
        assert {r["doc_id"] for r in got if r["text"] and r["text"].strip()} == {4, 6, 8}
    if name == "clean_documents":
        assert texts == Counter(r[1] for r in ROWS)
    if name == "filter_documents":
        assert texts == Counter({WORDS: 8, LONG: 1, LONG + " end": 1})
    if name == "apply_mix":
        own = Counter(ROWS)
        assert all(n <= 3 * own[r] for r, n in Counter(tuple(r)[:5] for r in got).items())

"""Cross-site boilerplate lines, by the distinct sites a line is found on.

A line's key is the 64-bit hash of the line without outer spaces; blank lines have
none.  HyperLogLog sketches of the sites merge by aggregation over the line keys.
A line whose estimate is clearly above ``MIN_SITES`` is boilerplate, clearly below
it is not; near-threshold lines get exact distinct counts.  A boilerplate line is
taken out of every document but the one with the smallest doc_id that holds it, so
its text is never lost altogether.

Only line hashes are shuffled to find the lines; a text moves once, to meet the
hashes to be taken out of it.

Defined cases: null text stays null; a null site counts as no site; a document may
lose all lines and then has text ''; null doc_ids never keep a boilerplate line;
rows that share a doc_id lose the same lines, and a line that repeats within a document
counts once for its site; a text at exactly ``MIN_SITES`` sites is boilerplate; a very
long text is split in one row; input columns called n_lines or n_removed are replaced in
``dedup_lines`` and kept as they are in ``clean_documents``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut

MIN_SITES = 5
#: Log2 of the sketch's registers: a standard error of 1.04 / 16 = 6.5 %.
LG_K = 8
#: Half width of the near-threshold band, in standard errors.
BAND = 4.0


def line_key(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.when(trimmed != "", F.xxhash64(trimmed))


def line_keys(text: Column) -> Column:
    """Keys of the distinct non-blank lines; null text has none."""
    keys = F.transform(F.split(text, "\n"), line_key)
    return F.coalesce(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())), F.array().cast("array<bigint>"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source") -> DataFrame:
    """(key, keeper): boilerplate line keys and the smallest doc_id that holds each."""
    band = BAND * 1.04 / (1 << LG_K) ** 0.5
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    spread = cut(docs.select("doc_id", F.col(site_col).cast("string").alias("site"), F.explode(line_keys(F.col("text"))).alias("key")))
    # a line found in fewer documents than sites are asked for needs no sketch
    often = cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper")).where(F.col("n") >= min_sites))
    found = spread.join(often.select("key"), "key", "left_semi")
    estimated = cut(found.groupBy("key").agg(F.hll_sketch_agg("site", LG_K).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("sites")))
    clear = estimated.where(F.col("sites") > high).select("key")
    near = estimated.where(F.col("sites").between(low, high)).select("key")
    exact = spread.join(near, "key", "left_semi").groupBy("key").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites).select("key")
    return cut(often.select("key", "keeper").join(clear.unionByName(exact), "key", "left_semi"))


def removals(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, drop): the keys to take out, for documents that lose a line."""
    held = docs.select("doc_id", F.explode(line_keys(F.col("text"))).alias("key"))
    lost = held.join(lines, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")) | F.col("doc_id").isNull())
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source") -> DataFrame:
    """All columns with the cleaned text, plus n_lines and n_removed (long)."""
    made = _cleaned(docs, min_sites, site_col)
    keep = [F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return made.select(*keep, F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


def clean_documents(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The columns of ``docs`` with the cleaned text; ``length_col``, if there is one,
    follows the text where a line was taken out."""
    made = _cleaned(docs, min_sites, site_col)
    changed = F.col("__removed") > 0
    new = {"text": F.col("__text")}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.when(changed, F.length("__text").cast(kind)).otherwise(F.col(f"`{length_col}`"))
    return made.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def _cleaned(docs: DataFrame, min_sites: int, site_col: str) -> DataFrame:
    """``docs`` with __text, __lines and __removed."""
    lost = cut(removals(docs, boilerplate(docs, min_sites, site_col))).withColumnRenamed("doc_id", "__id").withColumnRenamed("drop", "__drop")
    joined = docs.join(lost, docs["doc_id"].eqNullSafe(lost["__id"]), "left")
    parts = F.split(F.col("text"), "\n")
    goes = lambda x: F.array_contains(F.col("__drop"), F.coalesce(line_key(x), F.lit(0).cast("long"))) & (F.trim(x) != "")
    cleaned = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x: ~goes(x)), "\n"))
    n_removed = F.when(F.col("__drop").isNull() | F.col("text").isNull(), 0).otherwise(F.size(F.filter(parts, goes)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: F.trim(x) != "")))
    return joined.withColumns({"__text": cleaned, "__removed": n_removed.cast("long"), "__lines": n_lines.cast("long")})

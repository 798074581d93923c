"""Host-level quality rules (native).

Rules of a document: ``base`` (under 20 words, or more than 30 % of its words lie
in 8-word windows that repeat) and ``soft`` (more than ``SYMBOLS`` symbols a
word, or more than ``DUP_LINES`` of its lines repeat earlier ones).

Failures of either kind are aggregated by host.  A beta prior is fitted to the hosts'
raw rates by the method of moments, and a host's rate is shrunk to
(failures + alpha) / (documents + alpha + beta): a host with few documents is held
close to the corpus.  A host is rejected when its shrunk rate is over the limit, which
comes from the fitted prior: its mean and ``SPREAD`` standard deviations, but no
less than ``LEAST_LIMIT`` (a host whose documents mostly pass is never rejected) and
no more than ``MOST_LIMIT`` (however bad the other hosts are).  The verdicts are
joined back: a document goes if it fails ``base`` or if its host is rejected; ``soft``
failures count for the host's rate only.

Defined cases: null text has no words and fails; a null host is no host and gets no
verdict; a null doc_id or repeated rows are judged like any other row; hosts exactly
at the limit stay; a very long text is measured whole; input columns named like a
metric are replaced in ``quality_rules`` and kept as they are in ``filter_documents``;
an empty table gives no rows.
Eight-word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_GAP, cut, join_small, let, store

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS, DUP_LINES = 0.5, 0.5
SPREAD, LEAST_LIMIT, MOST_LIMIT = 2.0, 0.5, 0.75

FLAGS = ["base_failed", "soft_failed"]
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words that lie in an n-word window found at least twice in the text."""
    windows = F.when(F.size(words) > n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n))))

    def covered(at: Column) -> Column:
        # at: sorted starts of windows that repeat; the union of [start, start + n)
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(n)))
        return F.aggregate(gaps, F.lit(n).cast("long"), lambda s, g: s + g)

    def starts(pairs: Column) -> Column:
        # pairs: (hash, start) in order; a hash repeats if a neighbour has it
        own = F.filter(
            pairs,
            lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | ((i + 1 < F.size(pairs)) & (F.get(pairs, i + 1)["h"] == p["h"])),
        )
        return F.sort_array(F.transform(own, lambda p: p["i"]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(let(let(pairs, starts), covered))

    return let(windows, count)


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns plus METRICS (long), base_failed, soft_failed (boolean)."""
    new = {*METRICS, *FLAGS}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    keep = [f"`{c}`" for c in docs.columns if c.lower() not in new]
    measured = docs.select(
        *keep,
        by_words.alias("__w"),
        by_lines.alias("__l"),
        F.length(F.regexp_replace(text, WORD_GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    flat = measured.select(*keep, "__w.n_words", "word_chars", "n_symbols", "__l.n_dup_lines", "__l.n_lines", "__w.n_repeat_words")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    soft = (F.col("n_symbols") > SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > DUP_LINES * F.col("n_lines"))
    return flat.withColumn("base_failed", base).withColumn("soft_failed", soft)


def host_verdicts(judged: DataFrame, host_col: str = "source") -> DataFrame:
    """host, docs, failures, rate (shrunk), rejected; the null host is left out."""
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = cut(judged.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).cast("string").alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(failed).alias("failures")))
    # method of moments: mean and variance of the raw rates, less the binomial part
    rate = F.col("failures") / F.col("docs")
    m = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("var"), F.avg(1 / F.col("docs")).alias("inv")).collect()[0]
    mean = min(max(m["mean"] or 0.0, 1e-4), 1 - 1e-4)
    between = max((m["var"] or 0.0) - mean * (1 - mean) * (m["inv"] or 0.0), 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4)
    alpha, beta = mean * strength, (1 - mean) * strength
    deviation = (mean * (1 - mean) / (strength + 1)) ** 0.5
    limit = min(max(mean + SPREAD * deviation, LEAST_LIMIT), MOST_LIMIT)
    shrunk = (F.col("failures") + alpha) / (F.col("docs") + alpha + beta)
    return hosts.withColumn("rate", shrunk).withColumn("rejected", shrunk > limit)


def judge(judged: DataFrame, verdicts: DataFrame, host_col: str = "source") -> DataFrame:
    """Add kept: base passed, and of no rejected host.  Only rejected hosts are joined."""
    bad = cut(verdicts.where("rejected").select(F.col("host").alias("__host")))
    keyed = judged.withColumn("__key", F.col(host_col).cast("string"))
    joined = join_small(keyed, bad, "__key", "__host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("__host").isNull()).drop("__host", "__key")


def quality_rules(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host column, metrics, base_failed, soft_failed, kept of all rows.

    Only the digest is kept for the second use; no text is stored or shuffled.
    """
    digest = metrics(docs.select("doc_id", host_col, "text")).drop("text")
    digest = cut(digest)
    return judge(digest, host_verdicts(digest, host_col), host_col)


def filter_documents(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as given.

    A text is measured once.  The rows are stored with their flags, without the texts
    that fail ``base`` and go anyway; the hosts' rates and the rows are read from that.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*columns).alias("__row"), F.col(f"`{host_col}`").alias("__site"), "text")
    flagged = metrics(row).select(F.when(~F.col("base_failed"), F.col("__row")).alias("__row"), "__site", *FLAGS)
    flagged = store(flagged)
    judged = judge(flagged, host_verdicts(flagged, "__site"), "__site")
    return judged.where("kept").select("__row.*")

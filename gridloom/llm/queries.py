"""Driver queries of the corpus operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import fingerprints, langid, lattice_lm, line_dedup, mixing, pieces, quality, sharding, simhash, token_counts
from gridloom.llm.common import id_bucket, read_table

TOKEN_LIMIT = 1024


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, decoded again and compared."""
    encoded = pieces.encode(read_table(spark, sf_dir, "documents"), carry=["doc_id", "text"])
    decoded = pieces.decode(encoded)
    return decoded.select("doc_id", "n_pieces", F.xxhash64("piece_ids").alias("ids_hash"), "piece_score", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    net = langid.fit(docs, ~held_out)
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.identify(marked, net, ["doc_id", "held_out"])


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link_documents(read_table(spark, sf_dir, "documents"), width=3, radius=2)
    return linked.select("doc_id", simhash.hex16(F.col("simhash")).alias("fingerprint"), "component_id")


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(read_table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 7) == 2)


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_sharding, op3_token_counts, op4_source_mixing, op5_language_id, op6_simhash_dedup, op7_lattice_lm, op8_host_quality, op9_line_dedup, op10_doc_fingerprints)
}

ORACLE_SQL = {
    "op9_line_dedup": f"""
        WITH cut_up AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS pos
            FROM documents WHERE text IS NOT NULL),
        boiler AS (
            SELECT trim(line, ' ') AS k, min(doc_id) AS keeper FROM cut_up
            WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
        marked AS (
            SELECT c.doc_id, c.pos, c.line, trim(c.line, ' ') <> '' AS filled,
                   b.k IS NOT NULL AND c.doc_id <> b.keeper AS goes
            FROM cut_up c LEFT JOIN boiler b ON trim(c.line, ' ') = b.k)
        SELECT d.doc_id,
               coalesce(m.n_lines, 0)::BIGINT AS n_lines,
               coalesce(m.n_removed, 0)::BIGINT AS n_removed,
               CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(m.cleaned, '')) END AS text_md5
        FROM documents d LEFT JOIN (
            SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (goes) AS n_removed,
                   string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes) AS cleaned
            FROM marked GROUP BY doc_id) m USING (doc_id)
    """,
    "op8_host_quality": f"""
        WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
        cut_up AS (
            SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM numbered),
        word AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS pos FROM cut_up),
        windows AS (
            SELECT rid, pos, lead(w, {quality.WINDOW - 1}) OVER win AS last,
                   {" || ' ' || ".join(f"coalesce(lead(w, {k}) OVER win, '')" for k in range(quality.WINDOW))} AS gram
            FROM word WINDOW win AS (PARTITION BY rid ORDER BY pos)),
        repeated AS (
            SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n FROM windows WHERE last IS NOT NULL)
            WHERE n > 1),
        covered AS (
            SELECT rid, sum(reach) AS n_repeat_words
            FROM (SELECT rid, least(coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos) - pos, {quality.WINDOW}), {quality.WINDOW}) AS reach FROM repeated)
            GROUP BY rid),
        measured AS (
            SELECT doc_id, source, len(words) AS n_words,
                   length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                   len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM cut_up LEFT JOIN covered USING (rid)),
        judged AS (
            SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
                   n_symbols > {quality.SYMBOLS} * n_words OR n_dup_lines > {quality.DUP_LINES} * n_lines AS soft_failed
            FROM measured),
        hosts AS (
            SELECT source, count(*)::DOUBLE AS docs, count(*) FILTER (base_failed OR soft_failed)::DOUBLE AS failures
            FROM judged WHERE source IS NOT NULL GROUP BY source),
        moments AS (
            SELECT least(greatest(coalesce(avg(failures / docs), 0), 1e-4), 1 - 1e-4) AS mean,
                   coalesce(var_pop(failures / docs), 0) AS var, coalesce(avg(1 / docs), 0) AS inv FROM hosts),
        prior AS (
            SELECT mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-6) - 1, 1), 1e4) AS strength
            FROM moments),
        rejected AS (
            SELECT source FROM hosts, prior
            WHERE (failures + mean * strength) / (docs + strength)
                  > least(greatest(mean + {quality.SPREAD} * sqrt(mean * (1 - mean) / (strength + 1)), {quality.LEAST_LIMIT}), {quality.MOST_LIMIT}))
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT base_failed AND r.source IS NULL AS kept
        FROM judged LEFT JOIN rejected r ON judged.source = r.source
    """,
}

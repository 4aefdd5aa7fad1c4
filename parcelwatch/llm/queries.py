"""The registered queries of this subpackage, one an operator, and the SQL of those SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwatch.llm import (
    align,
    chat,
    decontaminate,
    html_text,
    langid,
    lexical,
    mixing,
    pii,
    quality_model,
    quality_rules,
    simhash,
    toxicity,
    warc,
)
from parcelwatch.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs.filter(~held), labels.filter(~held))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.col("toxicity.worst_word").alias("worst_word"),
    )


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_text.extract_pages(pages).select("page_id", "url", "text")
    return text.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group(table(spark, sf_dir, "documents"), simhash.CLOSE)
    return grouped.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and blocks of all metadata and conversion records of the pages."""
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    headers = F.col("headers")
    return made.select(
        "page_id",
        "type",
        "record_id",
        "target_uri",
        "refers_to",
        headers["WARC-Date"].alias("date"),
        headers["Content-Type"].alias("content_type"),
        headers["WARC-Source-Payload-Digest"].alias("source_digest"),
        headers["WARC-Block-Digest"].alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        "block",
    )


@query(
    "op5_quality_rules",
    f"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text,
               list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
        FROM documents),
    n AS (
        SELECT *, len(ws) AS n_words,
               regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS solid,
               list_filter(string_split(text, chr(10)),
                           lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls,
               CASE WHEN len(ws) < 3 THEN [] ELSE
                   [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END AS wins
        FROM t),
    o AS (SELECT row_number() OVER () AS k, * FROM n),
    w AS (SELECT k, unnest(wins) AS win, unnest(range(len(wins))) AS i FROM o),
    d AS (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM w),
    r AS (SELECT k, count(DISTINCT p) AS n_repeat_words
          FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM d WHERE c > 1) GROUP BY k),
    m AS (
        SELECT o.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
               length(solid) AS word_chars,
               length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
               len(list_filter(ws, lambda x: list_contains(
                   {sorted(set(" ".join(quality_rules.STOP_WORDS.values()).split()))}, lower(x)))) AS n_stop_words,
               length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_capitals,
               length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')) AS n_letters
        FROM o LEFT JOIN r USING (k)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
           n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
           n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND NOT (
               word_chars < 2.0 * n_words OR word_chars > 15.0 * n_words OR n_symbols > 0.4 * n_words
               OR n_dup_lines > 0.5 * n_lines OR n_stop_words < 0.02 * n_words
               OR n_capitals > 0.6 * n_letters OR n_letters < 0.6 * word_chars) AS kept
    FROM f""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(f"measures.{c}" for c in counts), "base_failed", "kept")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it contains a copy of."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "matched", "item_words", "start", "end")


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.account(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learnt from rows whose crc32(doc_id) mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 3) == 1
    model = quality_model.train(docs.filter(~held), labels.filter(~held))
    sites = quality_model.sites_of_pages(table(spark, sf_dir, "pages"))
    scored = quality_model.classify(docs, sites, model)
    return scored.select(
        "doc_id", held.alias("held_out"), "host", "path", "evidence", "host_posterior", "path_posterior",
        "score", (F.col("score") >= 0.5).alias("kept"),
    )


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect_documents(docs, pii.train(docs))
    counts = (F.col(f"pii.n_{kind}").alias(f"n_{kind}") for kind in pii.KINDS)
    return found.select(
        "doc_id", *counts, F.sha2(F.col("pii.base").cast("binary"), 256).alias("base_sha256"), "pii.spans"
    )


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_report(table(spark, sf_dir, "documents"))


@query(
    "op12_chat_formatting",
    r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    t AS (
        SELECT *, role || chr(10) || text || chr(10) AS said, role = 'assistant' AS loss,
               length(role || text) - length(replace(role || text, '\', ''))
               + length(role) - length(replace(role, ':', ''))
               + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0)
               + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
               + len(regexp_extract_all(role, '</turn>')) + len(regexp_extract_all(text, '</turn>')) AS escapes
        FROM c),
    g AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(said, '' ORDER BY turn, role, text) AS said,
               coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (loss), '') AS answers,
               sum(length(role) + length(text) + escapes + length('### ' || ': ' || '</turn>') + 1) AS n
        FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256,
           length(answers)::BIGINT AS loss_chars, sha256(answers) AS loss_sha256, n::BIGINT AS formatted_chars
    FROM g""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own markers."""
    said = r"\### Assistant: </turn> ok"
    known = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], known.schema)
    return chat.read_back(chat.format_conversations(known.unionAll(marked)))


@query(
    "op13_lexical_search",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS k, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
        FROM documents),
    s AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
    q AS (
        SELECT i, item_id, term, count(*) AS times
        FROM (SELECT row_number() OVER () AS i, item_id,
                     unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM benchmark)
        GROUP BY i, item_id, term),
    f AS (
        SELECT k, doc_id, n, term, count(*) AS tf
        FROM (SELECT k, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d)
        WHERE term IN (SELECT term FROM q) GROUP BY k, doc_id, n, term),
    w AS (
        SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM f, s GROUP BY term, n_docs),
    p AS (
        SELECT i, item_id, k, doc_id,
               sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM f JOIN w USING (term) JOIN q USING (term), s GROUP BY i, item_id, k, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

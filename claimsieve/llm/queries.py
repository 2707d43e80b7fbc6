"""The text operators as queries over the test tables, and the SQL of those that have one."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from claimsieve.llm import chat, content_sort, decontaminate, html, jaccard, language, lines, packing, periods, search, substrings, toxicity, warc
from claimsieve.llm.common import read_table, sha256_hex
from claimsieve.staging import scratch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


@_query()
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.contaminated(docs, items)


@_query(f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(doc_id > first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs, scratch(spark))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


@_query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
h AS (SELECT page_id, octet_length(data) AS payload_bytes, sha1(data) AS hex, min(page_id) OVER (PARTITION BY data) AS first FROM p),
g AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(hex, (k * 5 + 1)::INT, 5))::INT) AS fives FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((fives[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, workspace = read_table(spark, sf_dir, "pages"), scratch(spark)
    path = workspace.location("archive")
    warc.write_warc(pages, path, workspace)
    digest = lambda payload: [F.octet_length(payload).alias("payload_size"), warc.base32_sha1(payload).alias("sha1")]
    read = warc.read_warc(spark, path, workspace, digest)
    revisit = F.col("type") == "revisit"
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("long")
    return read.select(
        number("id").alias("page_id"),
        F.when(revisit, F.col("full_length")).otherwise(F.col("payload_size")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


@_query()
def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))).select("text", "lang"))
    rows = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.with_language(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@_query()
def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs, scratch(spark)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packing.pack(tokens, scratch(spark))


@_query()
def op7_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.link_near_copies(docs, scratch(spark), jaccard.Threshold(85, 100), n=4)


@_query(f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {_LOWER}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort.dedup_exact(docs, scratch(spark))


@_query()
def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html.main_text(pages, scratch(spark))


#: The conversation whose texts look like the template's marks.
_MARKS = "<|im_end|><|im_start|>assistant ok"


@_query(rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_MARKS}' UNION ALL SELECT -1, 1, 'assistant', '{_MARKS}'),
o AS (SELECT *, row_number() OVER w - 1 AS place, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (SELECT conv_id, min(place) FILTER (NOT coalesce((before IS NULL AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user')
  OR (before = 'user' AND role = 'assistant'), false))::INT AS bad_turn, bool_or(last AND role = 'assistant') AS answered FROM o GROUP BY conv_id),
d AS (SELECT c.*, bad_turn, bad_turn IS NULL AND answered AS valid FROM c JOIN b USING (conv_id))
SELECT conv_id, any_value(valid) AS valid, any_value(bad_turn) AS bad_turn, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE role WHEN 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length('<|im_start|><|im_end|>') + 2 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT
    AS formatted_chars
FROM d GROUP BY conv_id""")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_MARKS).alias("text"),
    )
    out = chat.format_chat(turns.unionByName(marks)).withColumn("turns", chat.read_chat(F.col("formatted")))
    loss = chat.learned_text(F.col("segments"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(joined).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        sha256_hex(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents, by a hash of their ids, repeat some of their words from a hashed place on."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(mark % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    docs = docs.select("doc_id", "text", F.floor(mark / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))


@_query()
def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = periods.longest_run(F.col("runs"))
    return periods.with_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[x].alias(x) for x in ("start", "length", "period")),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        sha256_hex(periods.runs_text(F.col("runs"))).alias("runs_sha256"),
        sha256_hex(F.col("collapsed")).alias("collapsed_sha256"),
    )


@_query()
def op12_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language.held_out(F.col("doc_id"))
    labels = read_table(spark, sf_dir, "labels").where(~held)
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return toxicity.with_toxicity(rows, model).select("doc_id", "held_out", "score", "predicted")


@_query(rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{search.TERM}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts))::BIGINT AS big_l FROM t),
p AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM t),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{search.TERM}')) AS term FROM benchmark),
c AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY ALL),
w AS (SELECT item_id, term, c * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM c JOIN df USING (term), s),
h AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM w JOIN tf USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM h WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return search.search(docs, items, scratch(spark), k=20)

"""Queries over texts: sentences, tokens, spans, indices, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.fixed import MAX_LENGTH
from spanlake.functions import text as tx
from spanlake.operators import gates, index, segment
from spanlake.operators import prompts as pr
from spanlake.plans import corpus
from spanlake.plans import sql_parts as sp
from spanlake.plans.catalog import query, r4, sql_r4, table, texts
from spanlake.session import cut_lineage

#: Responses with more tokens than this are routed out in the queries; the given answers are short.
SHORT = 400

_SENT = "WITH " + sp.sentences("documents")
_SPAN = _SENT + "," + sp.tokens("documents") + "," + sp.aligned()


def _spans(spark, sf) -> DataFrame:
    docs = texts(spark, sf, "doc_id", "text")
    return segment.sentence_rows(segment.segment(docs, None, "text", max_length=1 << 40), ["doc_id"])


_SPAN_COLS = ("doc_id", "sent_idx", "char_start", "char_end", "tok_start", "tok_end")


@query("P7", _SENT + " SELECT * FROM sent")
def sentences(spark, sf):
    return segment.split_sentences(texts(spark, sf, "doc_id", "text"))


@query("P8", "WITH " + sp.tokens("documents") + ' SELECT doc_id, tok_idx, start_ AS "start", end_ AS "end" FROM tok')
def tokens(spark, sf):
    return segment.tokenize(texts(spark, sf, "doc_id", "text"))


@query("P8", "WITH " + sp.tokens("documents") + " SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY doc_id")
def token_counts(spark, sf):
    n = F.size(segment.spans.token_pieces(F.col("text"))).cast("long")
    return texts(spark, sf, "doc_id", "text").select("doc_id", n.alias("n_tokens"))


@query("J1", _SPAN + " SELECT doc_id, sent_idx, char_start, char_end, tok_start, tok_end FROM span")
def span_alignment_join(spark, sf):
    docs = texts(spark, sf, "doc_id", "text")
    return segment.align_spans(segment.split_sentences(docs), segment.tokenize(docs))


@query("J1", _SPAN + " SELECT doc_id, sent_idx, char_start, char_end, tok_start, tok_end FROM span")
def span_alignment_in_row(spark, sf):
    return _spans(spark, sf).select(*_SPAN_COLS)


@query(
    "J2",
    "WITH chat AS (SELECT doc_id, length(source) + 2 AS prefix_len, source || ': ' || text AS full_text FROM documents),"
    + sp.tokens("chat", text="full_text")
    + """, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id)
SELECT n.doc_id, coalesce(min(t.tok_idx), n) AS resp_tok_start, coalesce(max(t.tok_idx) + 1, n) AS resp_tok_end,
       n AS n_tokens
FROM n LEFT JOIN chat USING (doc_id)
LEFT JOIN tok t ON t.doc_id = n.doc_id AND t.start_ < t.end_ AND t.start_ >= prefix_len
GROUP BY n.doc_id, n""",
)
def response_token_span(spark, sf):
    prefix = F.concat("source", F.lit(": "))
    chat = texts(spark, sf, "doc_id", "source", "text").select(
        "doc_id", F.length(prefix).alias("prefix_len"), F.concat(prefix, "text").alias("full_text")
    )
    return segment.response_span(segment.tokenize(chat, "full_text", ["doc_id", "prefix_len"]))


@query(
    "J5",
    _SPAN
    + """ SELECT doc_id, string_agg(sent_idx || ':' || tok_start || '-' || tok_end, ' ' ORDER BY sent_idx) AS spans
FROM span GROUP BY doc_id""",
)
def spans_nested(spark, sf):
    rows = _spans(spark, sf).withColumnRenamed("sent_idx", "global_idx")
    nested = segment.spans_by_response(rows, "doc_id")
    entry = F.transform("spans", lambda s: F.format_string("%d:%d-%d", s["global_idx"], s["tok_start"], s["tok_end"]))
    return nested.select("doc_id", F.array_join(entry, " ").alias("spans"))


@query(
    "A4",
    _SPAN
    + """ SELECT doc_id, count(*) AS n_sentences, sum(tok_end - tok_start)::BIGINT AS n_span_tokens,
       max(tok_end - tok_start) AS max_span_tokens FROM span WHERE tok_start IS NOT NULL GROUP BY doc_id""",
)
def response_statistics(spark, sf):
    return segment.response_stats(_spans(spark, sf), "doc_id")


def chat_sql(max_length: int) -> str:
    """CTEs ending in ``span``: the sentences of the responses that are not too long, with their tokens."""
    return (
        "WITH "
        + sp.GENERATIONS
        + f""",
chat AS (SELECT *, '<|user|>' || chr(10) || prompt || chr(10) || '<|assistant|>' || chr(10) AS prefix FROM gen),
full_ AS (SELECT response_id, prefix || response AS full_text, length(prefix) AS shift FROM chat),"""
        + sp.tokens("full_", "response_id", "full_text")
        + f""",
n AS (SELECT response_id, count(*) AS n FROM tok GROUP BY response_id),
usable AS (
  SELECT chat.*, n FROM chat JOIN n USING (response_id) WHERE trim(response) <> '' AND n <= {max_length}),"""
        + sp.sentences("usable", "response_id", "response")
        + """,
span AS (
  SELECT s.*, min(t.tok_idx) AS tok_start, max(t.tok_idx) + 1 AS tok_end
  FROM sent s JOIN full_ f USING (response_id) LEFT JOIN tok t
    ON t.response_id = s.response_id AND t.end_ > s.char_start + f.shift AND t.start_ < s.char_end + f.shift
  GROUP BY ALL)"""
    )


#: All rows of the skip table under the short limit.
SKIPS_SQL = chat_sql(SHORT) + f"""
SELECT response_id, 'too_long' AS reason, n::VARCHAR AS detail FROM n WHERE n > {SHORT}
UNION ALL SELECT response_id, 'empty_response', NULL FROM chat WHERE trim(response) = ''
UNION ALL SELECT response_id, 'degenerate_token_span', left(text, 80) FROM span WHERE tok_start IS NULL"""


@query("P6", SKIPS_SQL)
def skip_events(spark, sf):
    return corpus.tables_of(corpus.conversation_generations(spark, sf), max_length=SHORT).skips


@query(
    "P4 P5 P6 P7 P8 J1 W1",
    chat_sql(MAX_LENGTH)
    + """
SELECT row_number() OVER (ORDER BY s.response_id, sent_idx) - 1 AS global_idx,
       dense_rank() OVER (ORDER BY s.response_id) - 1 AS response_idx,
       s.response_id, dataset, row_id, prompt_col, sample_idx, sent_idx, text, char_start, char_end,
       tok_start, tok_end, tok_end - tok_start AS n_tokens
FROM span s JOIN usable u USING (response_id) WHERE tok_start IS NOT NULL""",
)
def sentence_table(spark, sf):
    return corpus.tables_of(corpus.conversation_generations(spark, sf)).sentences


@query(
    "A4 J2 W1",
    chat_sql(MAX_LENGTH)
    + """,
per AS (SELECT response_id, count(*) AS n_sentences FROM span WHERE tok_start IS NOT NULL GROUP BY response_id),
inside AS (
  SELECT t.response_id, min(tok_idx) AS a, max(tok_idx) + 1 AS b
  FROM tok t JOIN full_ USING (response_id) WHERE start_ >= shift GROUP BY t.response_id)
SELECT row_number() OVER (ORDER BY response_id) - 1 AS response_idx, response_id, dataset, row_id, prompt_col,
       sample_idx, 'stand-in' AS model, n_sentences, n AS n_tokens_full_text,
       coalesce(a, n) AS resp_tok_start, coalesce(b, n) AS resp_tok_end
FROM per JOIN usable USING (response_id) LEFT JOIN inside USING (response_id)""",
)
def response_table(spark, sf):
    return corpus.tables_of(corpus.conversation_generations(spark, sf)).responses


@query("F1", f"SELECT doc_id, md5({sp.normalize('text')}) AS text_md5, length({sp.normalize('text')}) AS n_chars FROM documents")
def normalized_whitespace(spark, sf):
    docs = texts(spark, sf, "doc_id", "text").select("doc_id", tx.normalize_ws(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query(
    "F2",
    f"""SELECT item_id, trim(raw, {sp.SPACE}) AS text,
       (7 + length(raw) - length(ltrim(raw, {sp.SPACE})))::BIGINT AS char_start,
       (7 + length(raw) - length(ltrim(raw, {sp.SPACE})) + length(trim(raw, {sp.SPACE})))::BIGINT AS char_end
FROM (SELECT item_id, '  ' || chr(10) || text || chr(9) || ' ' AS raw FROM benchmark)""",
)
def trimmed_spans(spark, sf):
    raw = F.concat(F.lit("  \n"), "text", F.lit("\t "))
    return table(spark, sf, "benchmark").select("item_id", tx.trim_span(raw, F.lit(7)).alias("s")).select("item_id", "s.*")


@query(
    "F3",
    """SELECT doc_id, CASE WHEN length(text) > 45 THEN left(text, 45) || '…' ELSE text END AS short,
       left(text, 80) AS detail,
       md5(CASE WHEN length(text) > 800
           THEN left(text, 800 - length(note)) || note ELSE text END) AS noted_md5
FROM (SELECT *, chr(10) || '...[truncated, ' || length(text) || ' chars total]' AS note FROM documents)""",
)
def truncated_texts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.ellipsize(t).alias("short"),
        F.substring(t, 1, 80).alias("detail"),
        F.md5(tx.truncate_noted(t, 800)).alias("noted_md5"),
    )


@query(
    "F4",
    """WITH d AS (SELECT sha256(sha256(doc_id::VARCHAR) || ',' || sha256(text)) AS h FROM documents),
leaf AS (SELECT h || ':' || count(*) AS item, left(h, 6) AS p FROM d GROUP BY h),
l6 AS (SELECT left(p, 3) AS q, p || ':' || sha256(string_agg(item, ',' ORDER BY item)) AS item FROM leaf GROUP BY p),
l3 AS (SELECT q || ':' || sha256(string_agg(item, ',' ORDER BY item)) AS item FROM l6 GROUP BY q)
SELECT sha256(string_agg(item, ',' ORDER BY item)) AS fingerprint FROM l3""",
)
def content_fingerprint(spark, sf):
    from spanlake.sources.freeze import fingerprint

    return fingerprint(texts(spark, sf, "doc_id", "text"))


@query(
    "W1",
    _SENT + " SELECT doc_id, sent_idx, row_number() OVER (ORDER BY doc_id, sent_idx) - 1 AS global_idx FROM sent",
)
def dense_sentence_index(spark, sf):
    rows = segment.split_sentences(texts(spark, sf, "doc_id", "text")).select("doc_id", "sent_idx")
    return index.dense_index(rows, ["doc_id", "sent_idx"])


@query(
    "P10 W6",
    """SELECT doc_id, n_chars, ((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 8)::BIGINT AS batch_id,
       (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) % 8 AS batch_pos FROM documents""",
)
def longest_first_batches(spark, sf):
    return index.longest_first(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8)


@query(
    "P9",
    "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5",
)
def first_per_source(spark, sf):
    return index.limit_per(table(spark, sf, "documents").select("source", "doc_id"), ["source"], 5, ["doc_id"])


@query("P9", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def first_in_total(spark, sf):
    return index.limit_total(table(spark, sf, "documents").select("doc_id", "source"), 25, ["doc_id"])


@query("W7", "SELECT doc_id, source FROM documents ORDER BY md5('0|' || doc_id), doc_id LIMIT 20")
def seeded_sample(spark, sf):
    return index.sample_n(table(spark, sf, "documents").select("doc_id", "source"), 20, 0, ["doc_id"])


@query(
    "W8",
    """SELECT vec_id, row_number() OVER (ORDER BY md5('0|' || vec_id)) <= greatest(1, (count(*) OVER () * 5) // 100) AS is_val
FROM embeddings""",
)
def exact_split(spark, sf):
    return index.train_val_split(table(spark, sf, "embeddings").select("vec_id"), 0.05, ["vec_id"])


_CHECKED_SQL = (
    _SPAN
    + f""",
picked AS (
  SELECT * FROM span WHERE tok_start IS NOT NULL
  ORDER BY md5('0|' || doc_id || '|' || sent_idx), doc_id, sent_idx LIMIT 20),
cut AS (
  SELECT p.doc_id, p.sent_idx, p.text, min(t.start_) AS a, max(t.end_) AS b
  FROM picked p JOIN tok t ON t.doc_id = p.doc_id AND t.tok_idx >= p.tok_start AND t.tok_idx < p.tok_end GROUP BY ALL),
checked AS (
  SELECT c.doc_id, c.sent_idx, c.text AS expected, substring(d.text, a + 1, b - a) AS decoded
  FROM cut c JOIN documents d USING (doc_id))"""
)


@query(
    "Q1",
    _CHECKED_SQL
    + f" SELECT *, {sp.normalize('decoded')} = {sp.normalize('expected')} AS agrees FROM checked",
)
def span_round_trip(spark, sf):
    return gates.check_spans(_spans(spark, sf), segment.tokenize, texts(spark, sf, "doc_id", "text"), 20)


@query(
    "Q1",
    _CHECKED_SQL
    + f""" SELECT count(*) AS n, avg(ok::INTEGER) AS pass_rate, avg(ok::INTEGER) >= 0.95 AS passed
FROM (SELECT {sp.normalize('decoded')} = {sp.normalize('expected')} AS ok FROM checked)""",
)
def span_verdict(spark, sf):
    return gates.span_verdict(span_round_trip(spark, sf))


@query(
    "Q3",
    """SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, min(doc_id) AS "first", max(doc_id) AS "last",
       count(DISTINCT doc_id) = count(*) AND min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AS dense FROM documents""",
)
def key_integrity(spark, sf):
    return gates.check_keys(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "Q3",
    """SELECT count(*) FILTER (l.doc_id IS NULL) AS only_in_a, count(*) FILTER (d.doc_id IS NULL) AS only_in_b,
       count(*) FILTER (l.doc_id IS NULL OR d.doc_id IS NULL) = 0 AS same
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def same_keys(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return gates.check_same_keys(docs.select("doc_id"), labels.select("doc_id"), "doc_id")


@query(
    "A6 P7 P8 J1",
    _SPAN
    + f""",
tv AS (SELECT doc_id, tok_idx, [(end_ - start_)::DOUBLE, (start_ % 7)::DOUBLE, (tok_idx % 5)::DOUBLE] AS v FROM tok),
m AS (
  SELECT s.doc_id, s.sent_idx, avg(v[1]) AS a, avg(v[2]) AS b, avg(v[3]) AS c
  FROM span s JOIN tv t ON t.doc_id = s.doc_id AND t.tok_idx >= s.tok_start AND t.tok_idx < s.tok_end
  GROUP BY s.doc_id, s.sent_idx)
SELECT doc_id, sent_idx, {sql_r4('a')} AS mean_width, {sql_r4('b')} AS mean_place, {sql_r4('c')} AS mean_index FROM m""",
)
def span_mean_pool(spark, sf):
    from spanlake.operators.pooling import mean_pool

    toks = segment.tokenize(texts(spark, sf, "doc_id", "text"))
    values = [F.col("end") - F.col("start"), F.col("start") % 7, F.col("tok_idx") % 5]
    vectors = toks.select("doc_id", "tok_idx", F.array(*[v.cast("double") for v in values]).alias("vector"))
    spans = cut_lineage(_spans(spark, sf).select("doc_id", "sent_idx", "tok_start", "tok_end"))  # cut once, whatever task is repeated
    pooled = mean_pool(vectors, spans, "doc_id", ["sent_idx"], extra_keys=[])
    names = ("mean_width", "mean_place", "mean_index")
    return pooled.select("doc_id", "sent_idx", *[r4(F.get("vector", F.lit(i))).alias(n) for i, n in enumerate(names)])


@query(
    "A6",
    f"""WITH v AS (
  SELECT vec_id // 50 AS block, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) - 1 AS pos FROM embeddings),
span AS (
  SELECT block, i AS span, [0, 3, 3, 0][i + 1] AS a, [3, 9, 3, 50][i + 1] AS b FROM (SELECT DISTINCT block FROM v), range(4) AS t(i)),
m AS (
  SELECT block, span, avg(e[1]) AS x, avg(e[64]) AS y FROM span JOIN v USING (block) WHERE pos >= a AND pos < b GROUP BY ALL)
SELECT block, span, {sql_r4('x')} AS first_value, {sql_r4('y')} AS last_value FROM span LEFT JOIN m USING (block, span)""",
)
def pooled_in_row(spark, sf):
    """Spans over rows of fifty vectors: a short one, a longer one, an empty one, and all."""
    from spanlake.operators.pooling import pool_nested

    block = F.floor(F.col("vec_id") / 50).alias("block")
    item = F.struct("vec_id", "embedding")
    nested = table(spark, sf, "embeddings").groupBy(block).agg(F.array_sort(F.collect_list(item)).alias("_v"))
    n = F.size("_v")
    ends = ((0, 3), (3, 9), (3, 3), (0, 50))
    spans = F.array(*[F.struct(F.least(F.lit(a), n).alias("tok_start"), F.least(F.lit(b), n).alias("tok_end")) for a, b in ends])
    rows = nested.select("block", F.col("_v.embedding").alias("v"), spans.alias("spans"))
    pooled = pool_nested(rows, "v", "spans").select("block", F.posexplode("pooled").alias("span", "mean"))
    values = [r4(F.get("mean", F.lit(i))).alias(name) for i, name in ((0, "first_value"), (63, "last_value"))]
    return pooled.select("block", F.col("span").cast("long").alias("span"), *values)

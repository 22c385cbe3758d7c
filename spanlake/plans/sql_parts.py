"""Building blocks of the SQL twins."""

from spanlake.fixed import SENTENCE_END, TOKEN, WS

#: The white space that bounds sentences and tokens.
SPACE = "(' ' || chr(9) || chr(10) || chr(12) || chr(13))"


def normalize(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'), ' ')"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{WS}+|{WS}+\z', '', 'g')"


def sentences(src: str, id_col: str = "doc_id", text: str = "text") -> str:
    """CTEs ending in ``sent(id, sent_idx, text, char_start, char_end)``."""
    return rf"""
pieces AS (
  SELECT {id_col}, string_split(regexp_replace({text}, '{SENTENCE_END}', '\1\2' || chr(1), 'g'), chr(1)) AS p
  FROM {src}),
piece AS (SELECT {id_col}, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM pieces),
piece_end AS (
  SELECT {id_col}, pos, piece, sum(length(piece)) OVER (PARTITION BY {id_col} ORDER BY pos) AS e FROM piece),
sent AS (
  SELECT {id_col}, row_number() OVER (PARTITION BY {id_col} ORDER BY pos) - 1 AS sent_idx,
         trim(piece, {SPACE}) AS text,
         (e - length(ltrim(piece, {SPACE})))::BIGINT AS char_start,
         (e - length(ltrim(piece, {SPACE})) + length(trim(piece, {SPACE})))::BIGINT AS char_end
  FROM piece_end WHERE trim(piece, {SPACE}) <> '')"""


def tokens(src: str, id_col: str = "doc_id", text: str = "text") -> str:
    """CTEs ending in ``tok(id, tok_idx, start_, end_)``."""
    return rf"""
tok_pieces AS (SELECT {id_col}, regexp_extract_all({text}, '{TOKEN}') AS p FROM {src}),
tok_piece AS (SELECT {id_col}, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM tok_pieces),
tok_end AS (
  SELECT {id_col}, pos, piece, sum(length(piece)) OVER (PARTITION BY {id_col} ORDER BY pos) AS e FROM tok_piece),
tok AS (
  SELECT {id_col}, (pos - 1)::BIGINT AS tok_idx, (e - length(ltrim(piece, {SPACE})))::BIGINT AS start_, e::BIGINT AS end_
  FROM tok_end)"""


def aligned(id_col: str = "doc_id", shift: str = "0") -> str:
    """CTE ``span``: sentences with the token range they overlap (nulls when there is none)."""
    return f"""
span AS (
  SELECT s.{id_col}, s.sent_idx, s.text, s.char_start, s.char_end,
         min(t.tok_idx) AS tok_start, max(t.tok_idx) + 1 AS tok_end
  FROM sent s LEFT JOIN tok t
    ON t.{id_col} = s.{id_col} AND t.end_ > t.start_
   AND t.end_ > s.char_start + {shift} AND t.start_ < s.char_end + {shift}
  GROUP BY ALL)"""


#: A dictionary from the labelled vectors: unit-length mean per label, as (latent_id, dim, w).
DICTIONARY = """
long AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
mean_dim AS (SELECT label, dim, avg(x) AS m FROM long GROUP BY label, dim),
mean_norm AS (SELECT label, sqrt(sum(m * m)) AS norm FROM mean_dim GROUP BY label),
dict AS (
  SELECT label AS latent_id, dim, m / greatest(norm, 1e-8) AS w FROM mean_dim JOIN mean_norm USING (label))"""

#: Encoder outputs and codes with k = 3, no bias.
CODES = DICTIONARY + """,
zpre AS (SELECT vec_id, latent_id, sum(x * w) AS z FROM long JOIN dict USING (dim) GROUP BY vec_id, latent_id),
code AS (
  SELECT vec_id, latent_id, z AS strength, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, latent_id) AS rank
  FROM zpre WHERE z > 0 QUALIFY rank <= 3)"""

#: Strongest latent of every vector.
ASSIGNED = CODES + """,
assign AS (
  SELECT e.vec_id AS global_idx, coalesce(c.latent_id, -1) AS latent_id, coalesce(c.strength, 0.0) AS strength
  FROM embeddings e LEFT JOIN code c ON c.vec_id = e.vec_id AND c.rank = 1)"""

#: User turns with the assistant's answer, as generations.
GENERATIONS = """
gen AS (
  SELECT 'conversations' AS dataset, u.conv_id::VARCHAR AS row_id, 'text' AS prompt_col, u.turn::INTEGER AS sample_idx,
         u.text AS prompt, a.text AS response,
         'conversations__' || u.conv_id || '__text__' || u.turn AS response_id
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

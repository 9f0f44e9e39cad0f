"""Queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import conversation_digests, format_conversations
from .common import read, saved


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds the template's own control strings, formatted and read back."""
    hard = "\\### Assistant: </turn> ok"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return conversation_digests(saved(format_conversations(turns.unionByName(more))))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
), w AS (
  SELECT *, length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' ELSE '### "' || role || '": ' END)
    + length(regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g')) + length('x</turn>x') AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""

QUERIES = {"op13_chat_formatting": op13_chat_formatting}
ORACLES = {"op13_chat_formatting": OP13_SQL}

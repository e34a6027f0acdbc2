"""Queries of the two operators that use DataFrame functions only, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, parse_chats, probe
from .common import table
from .mixing import mix_documents


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    read = parse_chats(format_chats(turns.unionByName(probe(spark, turns))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS pos
  FROM documents
), sizes AS (
  SELECT source, sum(size)::DOUBLE AS source_size FROM base GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         3.0::DOUBLE * source_size AS most
  FROM sizes
), shared AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM ranked
), targets AS (
  SELECT source, source_size, CASE WHEN most <= weight * share THEN most
         ELSE weight * max(CASE WHEN most > weight * share THEN share END) OVER () END AS target
  FROM shared
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), remainders AS (
  SELECT *, greatest(0.0, target - whole * source_size) AS remainder FROM plan
), running AS (
  SELECT b.source, b.pos, b.size, r.remainder, sum(b.size) OVER (PARTITION BY b.source ORDER BY b.pos) AS upto
  FROM (SELECT source, pos, sum(size) AS size FROM base GROUP BY source, pos) b JOIN remainders r ON b.source IS NOT DISTINCT FROM r.source
), edges AS (
  SELECT source, min(pos) AS pos, arg_min(upto, pos) AS upto, arg_min(size, pos) AS size, min(remainder) AS remainder FROM running WHERE upto > remainder GROUP BY source
), below AS (
  SELECT source, pos + CASE WHEN upto - remainder < remainder - (upto - size) THEN 1 ELSE 0 END AS below FROM edges
)
SELECT b.doc_id, b.size, r.source_size::BIGINT AS source_size, r.target, (b.size * (r.whole + CASE WHEN b.pos < e.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN remainders r ON b.source IS NOT DISTINCT FROM r.source LEFT JOIN below e ON b.source IS NOT DISTINCT FROM e.source
"""

OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS same,
    len(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_role\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|endoftext\|>)', '\1\\\2\3', 'g')) AS n_text,
    len(regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_role\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|endoftext\|>)', '\1\\\2\3', 'g')) AS n_role
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE WHEN same THEN 10 ELSE 33 + n_role END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUERIES = {"op4_mix_sources": op4_mix_sources, "op5_chat_format": op5_chat_format}
SQL = {"op4_mix_sources": OP4_SQL, "op5_chat_format": OP5_SQL}

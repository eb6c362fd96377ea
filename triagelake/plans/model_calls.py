"""Replayed model calls over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model_calls as C
from ..sources.tables import table
from .registry import query

TEMPLATE = "Read the text.\n{{text}}\nRole: {{role}}"
SCHEMA = "category string, confidence double, cases array<struct<title:string,serious:boolean>>"

#: Every user turn is asked about; two thirds of the answers were recorded, some within fences, some unreadable.
PROMPTS_SQL = """WITH i AS (SELECT conv_id, turn, 'Read the text.' || chr(10) || text || chr(10) || 'Role: ' || role AS prompt FROM conversations),
k AS (SELECT *, sha256('P1' || chr(31) || 'v2' || chr(31) || prompt) AS call_key, (conv_id * 10 + turn) % 7 AS c FROM i),
r AS (SELECT call_key, max(conv_id * 10 + turn) AS call_id FROM k WHERE c < 5 GROUP BY 1),
j AS (SELECT k.*, r.call_id FROM k LEFT JOIN r USING (call_key))
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = C.render(TEMPLATE, text=F.col("text"), role=F.col("role"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("prompt"))
    return turns.withColumn("call_key", C.call_key(F.lit("P1"), F.lit("v2"), F.col("prompt")))


def recorded(inputs: DataFrame) -> DataFrame:
    n = F.col("conv_id") * 10 + F.col("turn")
    body = F.concat(F.lit('{"category": "ICSR", "confidence": 0.'), (n % 7 + 1).cast("string"), F.lit(', "cases": [{"title": "a", "serious": true}, {"title": "b", "serious": false}]}'))
    reply = F.when(n % 7 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(n % 7 == 2, F.lit("no json")).otherwise(body)
    return inputs.where(n % 7 < 5).select("call_key", n.alias("call_id"), reply.alias("reply"))


@query(
    "L01 L02 L06 L07 L08 L09 S14 S20 X33 X34",
    PROMPTS_SQL
    + """SELECT conv_id, turn, substr(sha256(prompt), 1, 16) AS prompt_hash, CASE WHEN call_id IS NULL THEN 'MISSING_REPLAY' WHEN call_id % 7 = 2 THEN 'SCHEMA_FAILED' ELSE 'OK' END AS outcome,
 CASE WHEN call_id % 7 <> 2 THEN 'ICSR' END AS category, CASE WHEN call_id % 7 <> 2 THEN round((call_id % 7 + 1) / 10, 1) END AS confidence FROM j""",
)
def replayed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = asked(spark, sf_dir)
    out = C.replay(inputs, recorded(inputs), SCHEMA)
    ok = F.col("outcome") == "OK"
    return out.select(
        "conv_id", "turn", C.prompt_hash(F.col("prompt")).alias("prompt_hash"), "outcome", F.when(ok, F.col("parsed.category")).alias("category"), F.when(ok, F.col("parsed.confidence")).alias("confidence")
    )


@query(
    "L10 R20",
    PROMPTS_SQL + "SELECT conv_id, turn, i AS case_index, CASE i WHEN 0 THEN 'a' ELSE 'b' END AS title, i = 0 AS serious FROM (SELECT conv_id, turn, unnest([0, 1]) AS i FROM j WHERE call_id % 7 <> 2)",
)
def screened_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases that each reply names, one row each."""
    inputs = asked(spark, sf_dir)
    out = C.replay(inputs, recorded(inputs), SCHEMA).where(F.col("outcome") == "OK")
    return out.select("conv_id", "turn", F.posexplode("parsed.cases").alias("case_index", "c")).select("conv_id", "turn", "case_index", "c.*")


@query(
    "R21 R22 X35 X38 X54",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'unit ' || (conv_id % 5) END AS unit, CASE WHEN trim(text) = '' THEN 1.0 ELSE least(greatest(conv_id % 13 / 10, 0), 1) END AS legibility,
 string_agg(CASE WHEN n % 2 = 0 THEN lower(line) ELSE line END, chr(10) ORDER BY n) AS translated
FROM (SELECT conv_id, turn, role, text, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS line FROM (SELECT *, string_split(text, chr(10)) AS x FROM conversations)) GROUP BY conv_id, turn, role, text""",
)
def replay_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons, legibility and translated blocks of replies."""
    lines = F.split("text", "\n")
    back = F.map_filter(F.map_from_arrays(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(lines, F.lower)), lambda k, _: k % 2 == 0)
    reason = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("stated (twice) (from unit "), (F.col("conv_id") % 5).cast("string"), F.lit(")"))).otherwise("none given")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", C.source_unit(reason).alias("unit"), C.legibility(F.col("text"), F.col("conv_id") % 13 / 10).alias("legibility"), C.reassembled(lines, back).alias("translated")
    )

"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as assistant
and the others as named users; the mask has the spans (code points, ends exclusive) that the assistant
is trained on, namely each of the speaker's texts and its end mark. System turns are shared by all
and no participant.

An example holds a whole conversation, whatever its length, so a conversation must fit in a row.
Conversations too long for the consumer can be cut on demand (``per_example``): then a segment holds that
many consecutive turn numbers and starts with the system turns of earlier segments, which are never in a mask;
only those who speak in a segment have a perspective of it.

Participants are told apart by their raw role. In the shown name ``%``, ``|``, ``<``, ``>`` and line ends are
written as ``%25`` and so on, so that different roles have different names and none can forge a mark; a
null role is shown as ``%null``. Order within an example: turn (null first), name, text. A null text is
empty. ``<|`` in a text becomes ``< |``, so no text can forge a mark either. A row with a null conv_id
belongs to no dialogue and is a conversation of its own, so such rows are never gathered. Repeated rows
are repeated messages. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import need

END = "<|end|>"
#: What is escaped in a name, in this order.
ESCAPED = {"%": "%25", "|": "%7C", "<": "%3C", ">": "%3E", "\n": "%0A", "\r": "%0D"}
NO_ROLE = "%null"


def shown_name(role: Column) -> Column:
    return F.coalesce(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPED.items(), role), F.lit(NO_ROLE))


def messages(turns: DataFrame, per_example: int | None = None) -> DataFrame:
    """``(conv_id, segment, m)`` a row; without ``per_example`` all segments are 0."""
    rows = need(turns, "conv_id", "turn", "role", "text")
    segment = F.coalesce(F.floor(F.col("turn") / per_example).cast("long"), F.lit(-1).cast("long")) if per_example else F.lit(0).cast("long")
    return rows.select(
        "conv_id",
        segment.alias("segment"),
        F.struct(F.col("turn").alias("turn"), shown_name(F.col("role")).alias("name"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")).alias("m"),
    )


def _with_system(said: DataFrame) -> DataFrame:
    """Each segment's messages and the system turns of the segments before it, which are few."""
    system = said.where("m.name = 'system'").select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.col("m").alias("again"))
    segments = said.where("m.name <> 'system'").select("conv_id", "segment").distinct()
    before = segments.join(system, (segments["conv_id"] == system["c"]) & (F.col("s") < F.col("segment")))
    return said.unionByName(before.select("conv_id", "segment", F.col("again").alias("m")))


def rotate(turns: DataFrame, per_example: int | None = None) -> DataFrame:
    """``(conv_id, segment, perspective, n_messages, n_own, rendered, mask)``; mask: array of spans."""
    said = messages(turns, per_example)
    known, alone = said.where("conv_id IS NOT NULL"), said.where("conv_id IS NULL")
    gathered = (_with_system(known) if per_example else known).groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    examples = gathered.unionByName(alone.select("conv_id", "segment", F.array("m").alias("ms")))
    speakers = F.array_distinct(F.transform(F.filter("ms", lambda m: m["name"] != "system"), lambda m: m["name"]))
    seen = examples.select("conv_id", "segment", "ms", F.explode(speakers).alias("perspective"))

    def head(m: Column) -> Column:
        as_user = F.concat(F.lit("<|user:"), m["name"], F.lit("|>\n"))
        return F.when(m["name"] == "system", F.lit("<|system|>\n")).when(m["name"] == F.col("perspective"), F.lit("<|assistant|>\n")).otherwise(as_user)

    parts = F.transform("ms", lambda m: F.struct((m["name"] == F.col("perspective")).alias("own"), head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body")))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda done, p: F.struct(
            (done["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).alias("at"),
            F.when(
                p["own"],
                F.array_append(
                    done["spans"],
                    F.struct((done["at"] + F.length(p["head"])).alias("start"), (done["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")),
                ),
            ).otherwise(done["spans"]).alias("spans"),
        ),
        lambda done: done["spans"],
    )
    made = seen.select("conv_id", "segment", "perspective", parts.alias("parts"))
    return made.select(
        "conv_id",
        "segment",
        "perspective",
        F.size("parts").cast("long").alias("n_messages"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        spans.alias("mask"),
    )


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every whole conversation of ``conversations`` from each side; the mask as ``start:end`` joined by commas."""
    made = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    flat = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return made.withColumn("mask", flat)


_NAME_SQL = reduce(lambda c, e: f"replace({c}, {'chr(%d)' % ord(e[0]) if ord(e[0]) < 32 else repr(e[0])}, '{e[1]}')", ESCAPED.items(), "role")
OP4_SQL = rf"""
WITH m AS (SELECT conv_id, coalesce(conv_id::VARCHAR, 'alone ' || row_number() OVER ()) AS dialogue, turn, coalesce({_NAME_SQL}, '{NO_ROLE}') AS name,
  replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT dialogue, name AS perspective FROM m WHERE name <> 'system'),
r AS (SELECT m.*, perspective, name = perspective AS own,
  CASE WHEN name = 'system' THEN '<|system|>' WHEN name = perspective THEN '<|assistant|>' ELSE '<|user:' || name || '|>' END || chr(10) AS head,
  text || '<|end|>' AS body FROM m JOIN p USING (dialogue)),
o AS (SELECT *, row_number() OVER w AS k, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS pos FROM r
  WINDOW w AS (PARTITION BY dialogue, perspective ORDER BY turn NULLS FIRST, name, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, 0::BIGINT AS segment, perspective, count(*) AS n_messages, count(*) FILTER (WHERE own) AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(pos::BIGINT || ':' || (pos + length(body))::BIGINT, ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, dialogue, perspective
"""

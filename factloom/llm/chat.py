"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log is partitioned by conversation, its events are sorted by sequence number and folded into final messages: `message` begins
a message with role and text, `delta` appends to the text, `edit` replaces it, `regenerate` empties it so that later deltas fill
it again. Several `message` events of a turn are several messages; what follows one belongs to it. Messages are then rendered
with a template whose marks begin with a character that escaped texts never hold.

Null text and null role count as empty, a null kind as `message`; a null conversation id is an id of its own; null turns and
sequence numbers come first. Events with the same number are ordered by their content, repeated rows stay. A table without
rows gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

OPEN, MID, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Characters of an event in the log that the query makes of a table.
STREAM = 64
#: The character that begins each mark, another that common templates use, and the escape itself become codes.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, seq, kind, role, text -> conv_id, turn, part, role, text: the final messages in order of turn and part.

    The only shuffle is by conversation; what follows reuses it. An event is in the part that the last `message` before it in its
    turn began (what comes before the first one is part 0). Within a part the last edit or regeneration is found, and the deltas
    after it are joined."""
    e = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    e = e.repartition("conv_id")
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("part", F.count(F.when(F.col("kind") == "message", 1)).over(order)).withColumn("at", F.row_number().over(order))
    parts = e.groupBy("conv_id", "turn", "part").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "role", "text"))).alias("e"))
    fresh = F.filter("e", lambda x: x["kind"] != "delta")
    begin = F.coalesce(F.try_element_at(fresh, F.lit(-1))["at"], F.lit(0))
    live = F.filter("e", lambda x: x["at"] >= F.col("begin"))
    text = F.array_join(F.transform(F.filter(live, lambda x: x["kind"] != "regenerate"), lambda x: x["text"]), "")
    role = F.coalesce(F.try_element_at(F.filter("e", lambda x: x["role"] != ""), F.lit(1))["role"], F.lit(""))
    return parts.withColumn("begin", begin).select("conv_id", "turn", "part", role.alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss: the spans (start, size in code points of formatted) of the assistant's texts."""
    m = messages.select("conv_id", "turn", "part", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID)).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("own"))
    w = Window.partitionBy("conv_id").orderBy("turn", "part")
    size = (F.length("head") + F.length("body") + len(CLOSE)).cast("long")
    m = m.withColumn("at", F.row_number().over(w)).withColumn("start", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("body") - len(CLOSE))
    rows = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "head", "body", "own", "start"))).alias("m"))
    formatted = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    loss = F.transform(F.filter("m", lambda x: x["own"]), lambda x: F.struct(x["start"].alias("start"), F.length(x["body"]).cast("long").alias("size")))
    return rows.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, at, role, text, under_mask for each turn of rendered conversations (a saved table): formatted texts are split at
    their marks once, and a turn is under the mask where a span begins and ends with its text. Texts are unescaped."""
    turns = rendered.select("conv_id", F.posexplode(F.split("formatted", r"<\|end\|>")).alias("at", "turn")).filter("turn <> ''")
    w = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = F.substring_index("turn", MID, -1)
    turns = turns.withColumn("body", body).withColumn("end", F.sum(F.length("turn") + len(CLOSE)).over(w) - len(CLOSE))
    turns = turns.select("conv_id", "at", F.substring_index(F.replace("turn", F.lit(OPEN), F.lit("")), MID, 1).alias("role"), "body", (F.col("end") - F.length("body")).alias("start"), F.length("body").cast("long").alias("size"))
    spans = rendered.select(F.col("conv_id").alias("c"), F.explode("loss").alias("s")).select("c", F.col("s.start").alias("s"), F.col("s.size").alias("n"))
    both = turns.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("start") == F.col("s")) & (F.col("size") == F.col("n")), "left")
    return both.select("conv_id", "at", unescape(F.col("role")).alias("role"), unescape(F.col("body")).alias("text"), F.col("s").isNotNull().alias("under_mask"))


def events_of(rows: DataFrame) -> DataFrame:
    """A log whose fold gives the rows of a table back, as a chat service would have written it. A text comes as a `message` with
    its first STREAM characters and one `delta` for each further STREAM. By a hash of conversation and turn, one text in four is
    regenerated (a first answer, which breaks off, comes before it), and one in four is edited (its last delta is missing, then
    the whole text replaces it)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(w).cast("long").alias("n"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)).alias("way"))
    piece = lambda k, text, role=None: F.struct(F.lit(k).alias("kind"), (F.lit("") if role is None else role).alias("role"), text.alias("text"))
    head = F.substring("text", 1, STREAM)
    tail = F.when(F.length("text") > STREAM, F.regexp_extract_all(F.expr(f"substring(text, {STREAM + 1})"), F.lit(f"(?s).{{1,{STREAM}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    deltas = F.transform(tail, lambda x: piece("delta", x))
    again = F.array(piece("message", head, F.col("role")), piece("delta", F.lit(" and so ")), piece("regenerate", F.lit("")), piece("delta", head))
    once = F.array(piece("message", head, F.col("role")))
    log = F.when(F.col("way") == 1, F.concat(again, deltas)).when(F.col("way") == 2, F.concat(once, F.slice(deltas, F.lit(1), F.greatest(F.size(deltas) - 1, F.lit(0))), F.array(piece("edit", F.col("text"))))).otherwise(F.concat(once, deltas))
    events = rows.select("conv_id", "turn", "n", F.posexplode(log).alias("i", "x"))
    return events.select("conv_id", "turn", (F.col("n") * (1 << 32) + F.col("i")).alias("seq"), "x.kind", "x.role", "x.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings of another template: written as a log of events,
    folded, rendered, and read back."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = common.saved(render(fold(events_of(rows.unionByName(more)))), "rendered")
    said = F.sort_array(F.collect_list(F.struct("at", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t"))))
    masked = F.sort_array(F.collect_list(F.when(F.col("under_mask"), F.struct("at", F.col("text").alias("t")))))
    got = read_back(out).groupBy("conv_id").agg(F.count("*").alias("n_turns"), said.alias("said"), masked.alias("masked"))
    got = got.select(F.col("conv_id").alias("c"), "n_turns", F.sha2(F.array_join("said.t", ""), 256).alias("turns_sha256"), F.array_join("masked.t", "").alias("target"))
    size = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))
    return size.join(got, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "n_turns", "turns_sha256", F.length("target").cast("long").alias("loss_chars"), F.sha2("target", 256).alias("loss_sha256"), "formatted_chars")


#: formatted_chars counts what the template adds: its marks, and two characters for each escaped one.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), u AS (
  SELECT *, role || text AS rt FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(rt) + 2 * (length(rt) - length(replace(replace(replace(rt, '%', ''), '<', ''), '[', ''))))::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""

"""Chat formatting after cumulative-snapshot collapse.

A log often holds a conversation several times, each snapshot being a prefix of the next.  Each
turn gets the hash of the turns up to it: the exclusive or of two 64-bit hashes of (position, role,
text), which is a running aggregate.  A conversation whose last hash is an inner prefix hash of a
longer one goes (left anti join on position and hash); of equal conversations the smallest id
stays.  What is left is rendered, a header line and the text for each turn.

Positions are counted in blocks of ``BLOCK`` turn numbers and the blocks' counts and hashes are
carried over, so one conversation with very many turns is spread over tasks until it is rendered.
Inner prefixes are made distinct before the join, so an opening that many conversations share is
one row.

Nulls: a null role renders as ``unknown``, a null text as empty, and neither equals the empty
string when conversations are compared; rows without an id form one conversation.  Repeated rows
count once; different rows with the same turn number follow one another by role and text.  A very long
text is one value of a row; a conversation is rendered in one task's memory.  Extra columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.llm.common import read_table, stored

BLOCK = 512
_ID = ("conv_id", "conv_null")


def positions(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their position (from 1) and the two running prefix hashes."""
    turns = conversations.select("conv_id", "turn", "role", "text").dropDuplicates()
    turns = turns.withColumn("conv_null", F.col("conv_id").isNull()).withColumn("conv_id", F.coalesce(F.col("conv_id"), F.lit(0)))
    turns = turns.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    inside = Window.partitionBy(*_ID, "block").orderBy("turn", "role", "text")
    rows = turns.withColumn("at", F.row_number().over(inside))
    before = Window.partitionBy(*_ID).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*_ID)
    size = rows.groupBy(*_ID, "block").agg(F.count("*").alias("c"))
    size = size.select(*_ID, "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("skip"), F.sum("c").over(every).alias("n"))
    rows = rows.join(size, [*_ID, "block"]).withColumn("pos", F.col("skip") + F.col("at")).drop("at", "skip")
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))
    rows = rows.withColumns({f"h{i}": F.xxhash64(F.lit(i), "pos", mark("role"), mark("text")) for i in (1, 2)})
    hashes = rows.groupBy(*_ID, "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    hashes = hashes.select(*_ID, "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    running = Window.partitionBy(*_ID, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"h{i}": F.bit_xor(f"h{i}").over(running) for i in (1, 2)})
    rows = rows.join(hashes, [*_ID, "block"])
    return rows.withColumns({f"h{i}": F.col(f"h{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)}).drop("b1", "b2", "block")


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, conv_null, n_turns, n_copies) of the conversations that stay."""
    key = ["pos", "h1", "h2"]
    inner = rows.where(F.col("pos") < F.col("n")).select(*key).distinct()
    fulls = rows.where(F.col("pos") == F.col("n")).groupBy(*key).agg(F.min(F.struct("conv_null", "conv_id")).alias("first"), F.count("*").alias("n_copies"))
    return fulls.join(inner, key, "left_anti").select("first.conv_id", "first.conv_null", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def render(rows: DataFrame) -> DataFrame:
    """(conv_id, conv_null, chat): header line, text and line end of each turn, in order."""
    turn = F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("unknown")), F.lit("|>\n"), F.coalesce(F.col("text"), F.lit("")), F.lit("\n"))
    parts = rows.groupBy(*_ID).agg(F.sort_array(F.collect_list(F.struct("pos", turn.alias("t")))).alias("ts"))
    return parts.select(*_ID, F.concat_ws("", F.col("ts.t")).alias("chat"))


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) of each maximal conversation."""
    rows = stored(positions(conversations), "turns")
    stay = stored(maximal(rows), "maximal")
    chats = render(rows.join(stay, [*_ID], "left_semi").select(*_ID, "pos", "role", "text"))
    return stay.join(chats, [*_ID]).select(F.when(~F.col("conv_null"), F.col("conv_id")).alias("conv_id"), "n_turns", "n_copies", "chat")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formatted(read_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "n_copies", F.length("chat").cast("long").alias("n_chars"), F.sha2("chat", 256).alias("chat_sha256"))

"""Chat formatting in budgeted windows.

Prefix sums of turn tokens put every turn into the window in which it ends, so a
window is a span of whole turns. Each window after the first begins with the
conversation's system turn and with the last turns of the window before it, up to
`history` tokens; both are repeats and carry no loss. The loss mask covers the text
of each assistant turn in the one window to which it belongs.

Template, one turn: `<|role|>text</s>`. Inside roles and texts the characters that
control strings begin with are written as a backslash and a letter, so no text can
imitate a mark, and `unescape` restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .base import query, rows_frame, table

BUDGET, HISTORY = 2048, 512
BYTES_PER_TOKEN, TURN_TOKENS = 4, 4
CHUNK_TURNS = 512
END = "</s>"
# What stands for each character inside a text.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}


def escape(text: Column) -> Column:
    for char, mark in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    """Escapes are pairs read from the left: split at the doubled backslashes, undo
    the others in the parts, and join with single backslashes."""

    def part(p: Column) -> Column:
        for char, mark in ESCAPES.items():
            if char != "\\":
                p = F.replace(p, F.lit(mark), F.lit(char))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Every turn with its number `idx` and its window `win`, and again as a repeat
    in the next window if it ends within `history` tokens of its begin.

    Running sums are taken inside chunks of CHUNK_TURNS turn numbers and added to
    the sums of the chunks before, so a conversation of any length is spread over
    many tasks."""
    body = budget - history
    head = F.concat(F.lit("<|"), escape(F.coalesce("role", F.lit(""))), F.lit("|>"))
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        head.alias("head"),
        escape(text).alias("body"),
        F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 60))).alias("chunk"),
        (F.ceil(F.octet_length(text) / BYTES_PER_TOKEN) + TURN_TOKENS).alias("tokens"),
    )
    totals = rows.groupBy("conv_id", "chunk").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("__conv"),
        F.col("chunk").alias("__chunk"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ahead"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead_n"),
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "body")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*", F.sum("tokens").over(upto).alias("run"), (F.row_number().over(inside) - 1).alias("place")
    ).join(totals, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("chunk") == F.col("__chunk")))
    placed = rows.select(
        "conv_id",
        "role",
        "head",
        "body",
        (F.col("ahead_n") + F.col("place")).alias("idx"),
        (F.col("ahead") + F.col("run")).alias("end"),
    ).withColumn("win", F.floor((F.col("end") - 1) / body))
    system = (F.col("idx") == 0) & (F.col("role") == "system")
    repeat = (F.col("end") > (F.col("win") + 1) * body - history) & ~system
    own = F.struct(F.col("win").alias("win"), F.lit(True).alias("fresh"))
    again = F.struct((F.col("win") + 1).alias("win"), F.lit(False).alias("fresh"))
    uses = F.when(repeat, F.array(own, again)).otherwise(F.array(own))
    return placed.withColumn("use", F.explode(uses)).select(
        "conv_id", "role", "head", "body", "idx", system.alias("system"), "use.win", "use.fresh"
    )


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (the numbers may have gaps), formatted, fresh_from (code
    points of repeated turns at its begin), loss: array of (start, length) in code
    points of `formatted`.

    Tokens are estimated as UTF-8 bytes / 4 + 4 per turn. A turn longer than the
    budget has a window to itself and its repeats. Turns are ordered by turn, role,
    text; ties and repeated rows are turns of their own. Null role or text: empty;
    null conv_id: one conversation; null turn: first. An empty table gives no
    window. Extra columns are ignored.
    """
    rows = _placed(turns, budget, history)
    first = rows.where("system AND fresh").select(
        F.col("conv_id").alias("__conv"), F.concat("head", "body", F.lit(END)).alias("system_turn")
    )
    turn = F.struct("idx", "fresh", "role", "head", "body")
    packed = rows.groupBy("conv_id", "win").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.max("fresh").alias("any_fresh")
    )
    packed = packed.where("any_fresh").join(first, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    kept = F.when(F.col("win") > 0, F.coalesce("system_turn", F.lit(""))).otherwise(F.lit(""))

    def size(t: Column) -> Column:
        return F.length(t["head"]) + F.length(t["body"]) + len(END)

    lead = packed.withColumn("kept", kept)
    state = F.aggregate(
        "turns",
        F.struct(F.length("kept").alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("loss")),
        lambda s, t: F.struct(
            (s["at"] + size(t)).alias("at"),
            F.when(
                t["fresh"] & (t["role"] == "assistant"),
                F.array_append(
                    s["loss"],
                    F.struct(
                        (s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")
                    ),
                ),
            )
            .otherwise(s["loss"])
            .alias("loss"),
        ),
    )
    repeats = F.aggregate(
        F.filter("turns", lambda t: ~t["fresh"]), F.length("kept"), lambda a, t: a + size(t)
    )
    texts = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    return lead.select(
        "conv_id",
        F.col("win").alias("window"),
        F.concat("kept", F.array_join(texts, "")).alias("formatted"),
        repeats.alias("fresh_from"),
        state["loss"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window: turns (array of role, text) that are no repeats, and the text
    under the loss mask, both parsed from `formatted`."""
    fresh = F.expr("substring(formatted, fresh_from + 1)")
    parts = F.filter(F.split(fresh, END, -1), lambda p: p != "")
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p.substr(F.lit(3), F.length(p)), "|>", 1)).alias("role"),
            unescape(p.substr(F.instr(p, "|>") + 2, F.length(p))).alias("text"),
        ),
    )
    loss = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows. The digests need a conversation's text in
    one value; nothing else here does."""
    read = read_back(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = F.sort_array(F.collect_list(F.struct("window", lines.alias("lines"), F.col("loss_text").alias("loss"))))
    all_lines = F.array_join(F.transform("parts", lambda p: p["lines"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return (
        read.groupBy("conv_id")
        .agg(
            F.sum(F.size("turns")).alias("n_turns"),
            parts.alias("parts"),
            F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            F.col("n_turns").cast("long").alias("n_turns"),
            F.sha2(all_lines, 256).alias("turns_sha256"),
            F.length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


def _size_sql(column: str) -> str:
    return f"(2 * length({column}) - length(regexp_replace({column}, '[\\\\<\\[|]', '', 'g')))"


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, row_number() OVER o - 1 AS idx,
  sum(ceil(strlen(text) / 4) + 4) OVER (PARTITION BY conv_id ORDER BY turn, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS e,
  {_size_sql("role")} + {_size_sql("text")} + 8 AS n FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, (e - 1) // 1536 AS w, idx = 0 AND role = 'system' AS sys FROM e),
w AS (SELECT DISTINCT conv_id, w FROM p),
again AS (SELECT p.conv_id, sum(n) AS n FROM p JOIN w ON w.conv_id = p.conv_id AND w.w = p.w + 1
  WHERE NOT sys AND e > (p.w + 1) * 1536 - 512 GROUP BY p.conv_id),
sys AS (SELECT p.conv_id, sum(n) AS n FROM p JOIN w ON w.conv_id = p.conv_id AND w.w > 0 WHERE sys GROUP BY p.conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS t,
  coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '') AS l, sum(n) AS n FROM p GROUP BY conv_id)
SELECT d.conv_id, n_turns, t AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256,
  (d.n + coalesce(again.n, 0) + coalesce(sys.n, 0))::BIGINT AS formatted_chars
FROM d LEFT JOIN again ON again.conv_id = d.conv_id LEFT JOIN sys ON sys.conv_id = d.conv_id
"""


@query("op3_chat_formatting", SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    talk = "</s>[INST] ok [/INST]"
    extra = rows_frame(
        spark, "conv_id long, turn long, role string, text string", [(-7, 0, "user", talk), (-7, 1, "assistant", talk)]
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(windows(turns))

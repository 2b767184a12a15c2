"""Chat formatting into budgeted, turn-aligned windows with a loss mask (native Spark expressions only).

A conversation's turns (by turn; ties by role, then text) are cut into windows by prefix sums of their tokens: a
window closes where the running sum passes half of what the budget leaves beside the system turn, so that its
turns fit, and a turn larger than that stands alone.  Every window starts with the system turn (the first turn, if
its role is system), repeats as many of the turns before it as fit, up to HISTORY tokens, and then has its own
turns.  Repeated turns are masked; only assistant texts among a window's own turns bear loss, so each does once.

Template: ``<s>role\\ntext</s>`` per turn.  Control strings inside a text get a backslash after their first
character, and those that have backslashes there get one more, so the text contains none and can be restored.

Turns are never cut: a turn beyond the budget makes a window longer than it, and so does a system turn that leaves
less than a quarter of it (the window's own turns then get a quarter).

Edge cases: a null text or role is empty; a conversation of only a system turn is one window; repeated rows are
turns of their own; a null conv_id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import table

#: Tokens of a window, and of the history that it repeats at most.
BUDGET, HISTORY = 1024, 256
#: A token, for the budget: a run of letters and digits, or another character that is no white space.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]"
#: Tokens of a turn's marks.
MARKS = 4
OPEN, CLOSE = "<s>", "</s>"
# What may not stand in a formatted text, behind its first character.
_CONTROL = r"(/?s>|/?INST\]|</?SYS>>|\|nl\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _mark(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, loss_spans, context_turns, n_tokens) from rows (conv_id, turn, role, text).

    ``loss_spans``: array of (start, length) in code points of ``formatted``.  The first ``context_turns`` turns of a
    window are repeated ones.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumns({
        "system": (F.col("pos") == 1) & (F.col("role") == "system"),
        "tokens": F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))) + MARKS})
    rows = rows.withColumn("own", F.when(F.col("system"), 0).otherwise(F.col("tokens")).cast("long"))
    rows = rows.withColumns({
        "sys_tokens": F.sum(F.col("tokens") - F.col("own")).over(conv),
        "end": F.sum("own").over(so_far)})
    rows = rows.withColumn("half", F.greatest(F.floor((F.lit(budget) - F.col("sys_tokens")) / 2), F.lit(budget // 8)))
    rows = rows.withColumns({
        "cell": F.floor((F.greatest("end", F.lit(1)) - 1) / F.col("half")),
        "large": F.col("own") > F.col("half")})
    opens = (F.col("cell") != F.lag("cell", 1, -1).over(order)) | F.col("large") | F.lag("large", 1, False).over(order)
    rows = rows.withColumn("opens", F.when(F.col("system"), F.lit(0)).otherwise(opens.cast("int")))
    # the system turn belongs to the first window, which the turn after it opens
    rows = rows.withColumn("window", F.greatest(F.sum("opens").over(so_far), F.lit(1)).cast("long"))
    role = F.regexp_replace(escape(F.col("role")), "\n", "<|nl|>")
    rows = rows.withColumns({"role": role, "loss": F.col("role") == "assistant", "text": escape(F.col("text")),
                             "start": F.col("end") - F.col("own")})
    windows = rows.groupBy("conv_id", "window").agg(
        F.min("start").alias("from"), F.sum("own").alias("new"), F.max("sys_tokens").alias("sys"),
        F.min("pos").alias("first"))
    windows = windows.where("window > 1").withColumn(
        "room", F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("sys") - F.col("new"))))
    # history: turns whose start lies at most ``room`` tokens before the window; cells keep the join small
    near = windows.select("conv_id", F.col("window").alias("w"), "from", "room", "first",
                          F.floor(F.col("from") / history).alias("h"))
    past = rows.where("NOT system").withColumn("h", F.explode(F.array(
        F.floor(F.col("start") / history), F.floor(F.col("start") / history) + 1)))
    part = ["conv_id", "pos", "role", "text", "tokens"]
    repeated = past.join(near.withColumnRenamed("conv_id", "_c").withColumnRenamed("h", "_h"),
                         F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h") == F.col("_h"))).where(
        (F.col("pos") < F.col("first")) & (F.col("from") - F.col("start") <= F.col("room"))).select(
        *part, F.col("w").alias("window"), F.lit(1).alias("kind"), F.lit(False).alias("loss"))
    lead = rows.where("system").join(windows.select(F.col("conv_id").alias("_c"), F.col("window").alias("w")),
                                     F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        *part, F.col("w").alias("window"), F.lit(0).alias("kind"), F.lit(False).alias("loss"))
    own = rows.select(*part, "window", F.lit(2).alias("kind"), "loss")
    parts = own.unionByName(repeated).unionByName(lead)
    at = Window.partitionBy("conv_id", "window").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("mark", _mark(F.col("role"), F.col("text")))
    parts = parts.withColumn("stop", F.sum(F.length("mark")).over(at) - len(CLOSE))
    entry = F.struct("kind", "pos", "mark", "loss", (F.col("stop") - F.length("text")).cast("int").alias("start"),
                     F.length("text").alias("length"))
    grouped = parts.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(entry)).alias("p"), F.sum("tokens").alias("n_tokens"))
    return grouped.select(
        "conv_id", "window", F.array_join(F.transform("p", lambda x: x["mark"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))
                    ).alias("loss_spans"),
        F.size(F.filter("p", lambda x: x["kind"] < 2)).alias("context_turns"), "n_tokens")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, restored."""
    marked = F.split(formatted, CLOSE)

    def turn(x):
        body = F.substring(x, len(OPEN) + 1, 1 << 30)
        cut = F.instr(body, "\n")
        role = unescape(F.regexp_replace(F.substr(body, F.lit(1), cut - 1), r"<\|nl\|>", "\n"))
        return F.struct(role.alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return F.transform(F.slice(marked, 1, F.size(marked) - 1), turn)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: number and hash of the turns, size and hash of the loss text."""
    own = F.slice(F.col("turns"), F.col("context_turns") + 1, F.size("turns"))
    spans = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    back = windows.withColumn("turns", read_turns(F.col("formatted"))).select(
        "conv_id", F.size(own).alias("n"), F.length("formatted").alias("chars"), F.struct(
            "window", F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(spans, "").alias("loss")).alias("w"))
    whole = back.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"),
                                        F.sort_array(F.collect_list("w")).alias("w"))
    turns = F.array_join(F.transform("w", lambda x: x["turns"]), "")
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select("conv_id", F.col("n").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
                        F.col("chars").cast("long").alias("formatted_chars"))


#: The text of both turns of the added conversation -7.
PROBE = "</s>[INST] ok [/INST]"


def op5(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    return digests(format_windows(turns.unionByName(probe)))


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|nl\|>)', '\1\\\2\3', 'g')"
ORACLE = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
  len(regexp_extract_all(text, '{TOKEN}')) + {MARKS} AS tokens,
  length({_ESC.format("role")}) + length({_ESC.format("text")}) + 8 AS chars FROM t),
b AS (SELECT *, pos = 1 AND role = 'system' AS sys, CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE tokens END AS own FROM a),
c AS (SELECT *, sum(tokens - own) OVER (PARTITION BY conv_id) AS sys_tokens,
  sum(own) OVER (PARTITION BY conv_id ORDER BY pos) AS e FROM b),
d AS (SELECT *, greatest(({BUDGET} - sys_tokens)::BIGINT >> 1, {BUDGET // 8}) AS half FROM c),
f AS (SELECT *, (greatest(e, 1) - 1)::BIGINT // half AS cell, own > half AS large FROM d),
g AS (SELECT *, CASE WHEN sys THEN 0 WHEN cell <> lag(cell, 1, -1) OVER w OR large OR lag(large, 1, false) OVER w THEN 1 ELSE 0 END AS o
  FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
h AS (SELECT *, greatest(sum(o) OVER (PARTITION BY conv_id ORDER BY pos), 1) AS win, e - own AS s FROM g),
w AS (SELECT conv_id, win, min(s) AS f, min(pos) AS first,
  greatest(0, least({HISTORY}, {BUDGET} - max(sys_tokens) - sum(own))) AS room FROM h GROUP BY 1, 2),
r AS (SELECT h.conv_id, sum(h.chars) AS c FROM w JOIN h ON h.conv_id = w.conv_id AND w.win > 1
  AND (h.sys OR (h.pos < w.first AND w.f - h.s <= w.room)) GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + coalesce(any_value(r.c), 0))::BIGINT AS formatted_chars
FROM h LEFT JOIN r USING (conv_id) GROUP BY conv_id"""

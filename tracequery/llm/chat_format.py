r"""Chat formatting into budgeted windows, in DataFrame operations only.

A turn is written ``<|role|>text<|end|>``.  In texts ``\`` becomes ``\b`` and
``<|`` becomes ``<\v``; in roles ``\`` becomes ``\b`` and ``|`` becomes ``\v``.
So no text or role can hold a marker, and undoing the second replacement and
then the first gives back the original.

Prefix sums of turn tokens choose the windows: a window is the system turn, if
a conversation starts with one, then the last earlier turns that fit into
``history`` tokens and leave room for the first new turn, then new turns while
all of it stays within ``budget``.  Every turn is new in exactly one window.
Turns are never cut and the system turn is never left out, so a window exceeds
the budget only where its first new turn does so alone or with the system
turn; it then has no history and no other new turn.  The loss mask covers the
texts of new assistant turns; repeated ones are left out of it.

Turns of a conversation are gathered, as its digest needs them; each turn
looks back at the few turns its history can hold, and a window holds only its
own turns.

A turn's tokens are its ASCII letter runs and every other character above
space, plus ``MARKERS`` for its markers.

Defined results: rows are ordered by turn, then role, then text, nulls first;
null texts and roles are empty; a null conv_id is a conversation of its own;
repeated rows are turns; an empty table gives no windows; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, MARKERS = 512, 128, 4
_TOKEN = r"[A-Za-z]+|[^\x00-\x20A-Za-z]"
_END = "<|end|>"


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\v"))


def unescape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\v"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("|"), F.lit("\\v"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\v"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each window: conv_id, window, n_repeated (turns shown before), n_tokens, text, mask (array of start, length in characters)."""
    empty = F.lit("")
    rows = conversations.select(
        "conv_id", F.col("turn").alias("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text")
    )
    shown = rows.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>")).alias("head"), escape_text(F.col("text")).alias("body"),
        (F.regexp_count("text", F.lit(_TOKEN)) + F.lit(MARKERS)).cast("long").alias("tokens"),
    )
    talk = Window.partitionBy("conv_id")
    order = talk.orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + F.lit(len(_END))
    system = F.first("role").over(order) == "system"
    numbered = shown.select(
        "conv_id", "tokens", "head", "body", "role",
        F.row_number().over(order).alias("n"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("at"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("char"),
        F.when(system, 1).otherwise(0).alias("n_system"),
        F.when(system, F.first("tokens").over(order)).otherwise(F.lit(0)).cast("long").alias("system_tokens"),
    )
    # Turns hold one token at least, so no more than ``history`` of them lie in this frame.
    near = F.collect_list(F.struct("n", "at")).over(talk.orderBy("at").rangeBetween(-history, -1))
    room = F.least(F.lit(history), F.lit(budget) - F.col("system_tokens") - F.col("tokens"))
    kept = F.filter("near", lambda t: (t["n"] > F.col("n_system")) & (F.col("at") - t["at"] <= room))
    oldest = F.array_min(kept)
    placed = numbered.withColumn("near", near).withColumn("oldest", oldest)
    turn = F.struct(
        "n", "at", "tokens", "char", "n_system",
        # Where a window that opens with this turn starts to repeat, and the tokens it repeats.
        F.coalesce(F.col("oldest")["n"], F.col("n")).alias("from"),
        (F.when(F.col("n") > 1, F.col("system_tokens")).otherwise(F.lit(0)) + F.coalesce(F.col("at") - F.col("oldest")["at"], F.lit(0))).alias("base"),
        (F.col("role") == "assistant").alias("is_target"),
        F.char_length("head").alias("head_size"),
        F.char_length("body").alias("body_size"),
        F.concat("head", "body", F.lit(_END)).alias("shown"),
    )
    talks = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    state = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("at"))

    def step(s, t):
        fits = (t["n"] == 1) | (s["base"] + t["at"] + t["tokens"] - s["at"] <= budget)
        return F.when(fits, s).otherwise(F.struct(F.concat(s["starts"], F.array(t["n"])).alias("starts"), t["base"].alias("base"), t["at"].alias("at")))

    starts = F.aggregate("turns", state, step, lambda s: s["starts"])

    def window(start, i):
        first = F.element_at("turns", start)
        end = F.coalesce(F.get("starts", i + 1) - 1, F.size("turns"))
        lead = F.slice("turns", F.lit(1), F.when(start > 1, first["n_system"]).otherwise(F.lit(0)))
        return F.struct(i.alias("window"), start.alias("start"), F.size(lead).alias("n_system"), first["from"].alias("from"), F.concat(lead, F.slice("turns", first["from"], end - first["from"] + 1)).alias("picked"))

    spans = talks.select("conv_id", "turns", starts.alias("starts")).select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    # Places of the picked turns in the window: the system turn first, the others as they lie in the conversation.
    first = F.col("picked")[0]
    lead = F.when(F.col("n_system") > 0, first["head_size"] + first["body_size"] + len(_END)).otherwise(F.lit(0))
    origin = F.element_at("picked", F.col("n_system") + 1)["char"]
    targets = F.filter("picked", lambda t: t["is_target"] & (t["n"] >= F.col("start")))
    mask = F.transform(targets, lambda t: F.struct((F.col("lead") + t["char"] - F.col("origin") + t["head_size"]).cast("long").alias("start"), t["body_size"].cast("long").alias("length")))
    tokens = F.aggregate("picked", F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    return spans.select("*", lead.alias("lead"), origin.alias("origin")).select(
        "conv_id", F.col("window").cast("long").alias("window"), (F.col("n_system") + F.col("start") - F.col("from")).cast("long").alias("n_repeated"), tokens.alias("n_tokens"),
        F.array_join(F.transform("picked", lambda t: t["shown"]), "").alias("text"), mask.alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and targets of each window, read from its text: conv_id, window, turns (array of role, text), targets (array of text), chars."""
    parts = F.split("text", r"<\|end\|>", -1)
    new = F.slice(parts, F.col("n_repeated").cast("int") + 1, F.size(parts) - 1 - F.col("n_repeated").cast("int"))
    role = lambda p: F.substring_index(p, "|>", 1)
    turn = lambda p: F.struct(unescape_role(F.substring(role(p), 3, 1 << 30)).alias("role"), unescape_text(F.substr(p, F.char_length(role(p)) + 3)).alias("text"))
    target = lambda m: unescape_text(F.substr(F.col("text"), (m["start"] + 1).cast("int"), m["length"].cast("int")))
    return formatted.select("conv_id", "window", F.transform(new, turn).alias("turns"), F.transform("mask", target).alias("targets"), F.char_length("text").cast("long").alias("chars"))


def digest(formatted: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read_back(formatted).select("conv_id", F.struct("window", said.alias("said"), F.array_join("targets", "").alias("targets")).alias("w"), F.size("turns").alias("n"), "chars")
    talks = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    talks = talks.select("conv_id", "n_turns", "formatted_chars", F.array_join(F.transform("w", lambda w: w["said"]), "").alias("said"), F.array_join(F.transform("w", lambda w: w["targets"]), "").alias("loss"))
    return talks.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def oracle(extra: str) -> str:
    """The query's rows in SQL over ``conversations`` and the rows of ``extra``."""
    return rf"""
WITH RECURSIVE told AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra})),
turns AS (
  SELECT *, CAST(len(regexp_extract_all(text, '[A-Za-z]+|[^\x00-\x20A-Za-z]')) + {MARKERS} AS BIGINT) AS tokens,
    length(replace(replace(role, '\', '\b'), '|', '\v')) + length(replace(replace(text, '\', '\b'), '<|', '<\v')) + {4 + len(_END)} AS size
  FROM told),
placed AS (
  SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
    first_value(role) OVER (PARTITION BY conv_id ORDER BY n) = 'system' AS has_system, first_value(tokens) OVER (PARTITION BY conv_id ORDER BY n) AS first_tokens
  FROM turns),
near AS (
  SELECT a.conv_id, a.n, a.pos, a.tokens, coalesce(min(b.n), a.n) AS hist, CASE WHEN any_value(a.has_system) THEN any_value(a.first_tokens) ELSE 0 END + coalesce(a.pos - min(b.pos), 0) AS base
  FROM placed a LEFT JOIN placed b ON b.conv_id = a.conv_id AND b.n < a.n AND b.n > CAST(a.has_system AS INT) 
    AND a.pos - b.pos <= least({HISTORY}, {BUDGET} - a.tokens - CASE WHEN a.has_system THEN a.first_tokens ELSE 0 END)
  GROUP BY a.conv_id, a.n, a.pos, a.tokens),
walk AS (
  SELECT conv_id, n, n AS start, CAST(0 AS BIGINT) AS base, pos AS since FROM near WHERE n = 1
  UNION ALL
  SELECT x.conv_id, x.n, CASE WHEN fits THEN start ELSE x.n END, CASE WHEN fits THEN w_base ELSE x.base END, CASE WHEN fits THEN since ELSE x.pos END
  FROM (SELECT near.*, w.start, w.base AS w_base, w.since, w.base + near.pos + near.tokens - w.since <= {BUDGET} AS fits FROM walk w JOIN near ON near.conv_id = w.conv_id AND near.n = w.n + 1) x),
repeated AS (
  SELECT s.conv_id, sum(p.size) AS chars
  FROM (SELECT DISTINCT walk.conv_id, start, hist FROM walk JOIN near ON near.conv_id = walk.conv_id AND near.n = walk.start WHERE start > 1) s
  JOIN placed p ON p.conv_id = s.conv_id AND (p.n >= s.hist AND p.n < s.start OR p.n = 1 AND p.has_system) GROUP BY s.conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + coalesce(any_value(repeated.chars), 0) AS BIGINT) AS formatted_chars
FROM turns t LEFT JOIN repeated ON repeated.conv_id = t.conv_id GROUP BY t.conv_id
"""

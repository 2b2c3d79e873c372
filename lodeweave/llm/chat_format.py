r"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A conversation is a log of events in the order of ``seq``: ``message`` starts a message of a turn, ``delta`` appends streamed text to it,
``edit`` replaces its text, ``regenerate`` throws its text away so that later deltas write it anew. The fold is two running counts over the
events of one turn, sorted by seq: how many messages began, and how many times their text began. What is left of a message is the events of its
last beginning, joined in order. A turn is a window of its own, so no task holds a conversation.

Rendering: each turn becomes ``<s>[ROLE]role[/ROLE]text</s>``. A control string inside a role or text is broken by a backslash after its
first character, and each backslash is doubled before that, so nothing in a text reads as control and every text can be had back. A
conversation is rendered in parts of at most PART turns, which in order make up its formatted text; each part has the spans of its loss
mask, the assistants' texts. Long conversations thus never are one row of the fold, and spans are short-range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import read, text_of

PART = 128
#: Fixed control strings of the template and of the formats that texts may hold.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>")
BREAK = r"(<(?=/?s>)|\[(?=/?INST\])|\[(?=/?ROLE\])|<(?=</?SYS>>))"
EVENTS = "conv_id, seq, kind, turn, role, text"


def escape(text: Column) -> Column:
    """Double each backslash, then break each control string after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), BREAK, r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log with the columns EVENTS: ``conv_id``, ``turn``, ``message`` (its number in the turn), ``role``, ``text``.

    Events of one turn are taken by seq, ties by role and text. A delta, edit or regeneration before any message is the first message
    itself, with its own role. Null text counts as empty, null kind as ``message``. Two messages of one turn both stay, in that order.
    """
    kind = F.coalesce("kind", F.lit("message"))
    e = events.select("conv_id", "seq", "turn", F.col("role").cast("string").alias("role"), text_of().alias("text"), kind.alias("kind"))
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumns(
        {
            "message": F.greatest(F.sum((F.col("kind") == "message").cast("long")).over(order), F.lit(1)),
            "begin": F.sum((F.col("kind") != "delta").cast("long")).over(order),
            "place": F.count("*").over(order),
        }
    )
    whole = Window.partitionBy("conv_id", "turn", "message")
    e = e.withColumn("last", F.max("begin").over(whole))
    piece = F.struct("place", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))
    kept = F.when(F.col("begin") == F.col("last"), piece)
    return e.groupBy("conv_id", "turn", "message").agg(
        F.min_by("role", "place").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), "").alias("text")
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Parts of formatted conversations: ``conv_id``, ``part``, ``formatted``, ``loss`` (array of start and length in code points), ``n_turns``.

    Parts are numbered by the turn: part p holds turns p*PART to p*PART + PART-1, so a part can be rendered without knowing the rest;
    a null turn comes first. The formatted text of a conversation is its parts, joined in order.
    """
    role = escape(F.coalesce("role", F.lit("")))
    text = escape(F.col("text"))
    m = messages.select(
        "conv_id",
        F.floor(F.col("turn") / PART).alias("part"),
        F.struct("turn", "message", F.concat(F.lit("<s>[ROLE]"), role, F.lit("[/ROLE]")).alias("head"), text.alias("text"), (F.col("role") == loss_role).alias("loss")).alias("m"),
    )
    p = m.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    formatted = F.array_join(F.transform("ms", lambda x: F.concat(x["head"], x["text"], F.lit("</s>"))), "")
    # spans by one running sum over the turns of a part
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(a: Column, x: Column) -> Column:
        span = F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["text"]).alias("length")))
        return F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["text"]) + 4).alias("at"), F.when(F.coalesce(x["loss"], F.lit(False)), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans")
        )

    return p.select("conv_id", "part", formatted.alias("formatted"), F.aggregate("ms", start, add, lambda a: a["spans"]).alias("loss"), F.size("ms").cast("long").alias("n_turns"))


def parse(parts: DataFrame) -> DataFrame:
    """Read formatted parts back: ``turns`` (array of role and text, as they were) and ``loss_text`` (what the mask covers, unescaped)."""
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, F.lit(len("<s>[ROLE]") + 1), F.length(x)), "[/ROLE]", 1)).alias("role"),
        unescape(F.substring(x, F.call_function("instr", x, F.lit("[/ROLE]")) + F.lit(len("[/ROLE]")), F.length(x))).alias("text"),
    )
    ended = F.split("formatted", "</s>")
    turns = F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), turn)
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return parts.select("*", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def format_conversations(events: DataFrame) -> DataFrame:
    """The whole operator: fold a log of EVENTS and render it; see ``fold`` and ``render``. An empty log gives no rows."""
    return render(fold(events))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    events = rows.unionByName(extra).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")
    read_back = parse(format_conversations(events)).select(
        "conv_id",
        F.struct(
            "part",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.col("loss_text").alias("loss"),
        ).alias("p"),
        "n_turns",
        F.length("formatted").cast("long").alias("chars"),
    )
    c = read_back.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list("p")).alias("ps"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("ps", lambda p: p[name]), "")
    c = c.withColumns({"turns": joined("turns"), "loss": joined("loss")})
    return c.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def oracle_sql() -> str:
    parts = "|".join(("<s>", "</s>", r"\[INST\]", r"\[/INST\]", r"\[ROLE\]", r"\[/ROLE\]", "<</?SYS>>"))
    extra = lambda c: f"length({c}) + length({c}) - length(replace({c}, chr(92), '')) + len(regexp_extract_all({c}, '{parts}'))"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len("<s>[ROLE][/ROLE]</s>")} + {extra("role")} + {extra("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

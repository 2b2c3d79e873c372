"""What surrounds a model's answer: context within a budget, citation markers, logs, conversation history. The model itself is a caller's function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeweave.functions.text import position_label, snippet

MARKER = r"\[#(\d+)\]"
SYSTEM = "Answer from the numbered passages alone, and put the marker of a passage, such as [#1], after each claim that it supports. If they don't hold the answer, reply with exactly: "
REFUSAL = "The passages that were found don't answer this question."
REMINDER = "\n\nThe answer that you gave has no markers of passages. Write it again with the same facts, and a marker such as [#1] after every claim."

#: A caller's model: a frame of questions or prompts in, a frame of replies out.
Model = Callable[[DataFrame], DataFrame]


def budget(hits: DataFrame, tokens: int = 6000, query_id: str = "query_id", order: str = "rank", size: str = "token_count") -> DataFrame:
    """Hits of each query in order while their tokens fit; the first always does, and the first that doesn't fit ends the list. ``marker`` counts from 1."""
    w = Window.partitionBy(query_id).orderBy(order)
    running = hits.withColumns({"marker": F.row_number().over(w), "used_tokens": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return running.where((F.col("marker") == 1) | (F.col("used_tokens") <= tokens))


def continue_markers(hits: DataFrame, given: DataFrame, turn: list[str], order: str = "rank") -> DataFrame:
    """Hits of a further call in a turn with markers that go on after those that the turn has given out (``given``: turn, marker)."""
    last = given.groupBy(*turn).agg(F.max("marker").alias("_last"))
    n = F.row_number().over(Window.partitionBy(*turn).orderBy(order))
    return hits.join(last, turn, "left").withColumn("marker", F.coalesce("_last", F.lit(0)) + n).drop("_last")


def context(citations: DataFrame, query_id: str = "query_id", label: str = "label", text: str = "content") -> DataFrame:
    """The prompt's passages: ``[#n] label`` and the text, in order."""
    part = F.concat(F.lit("[#"), F.col("marker").cast("string"), F.lit("] "), F.col(label), F.lit("\n"), F.col(text))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("marker", part.alias("part")))), lambda x: x["part"])
    return citations.groupBy(query_id).agg(F.array_join(parts, "\n\n").alias("context"))


def fetch_document(chunks: DataFrame, chars: int = 24_000, document: str = "document_id") -> DataFrame:
    """Documents put together from their chunks in order, as many as fit into ``chars``: ``content``, ``chunks``, ``truncated``."""
    w = Window.partitionBy(document).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = chunks.withColumn("_chars", F.sum(F.length("content")).over(w))
    fits = F.col("_chars") <= chars
    parts = F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("ordinal", "content")))), lambda x: x["content"])
    return c.groupBy(document).agg(F.array_join(parts, "\n\n").alias("content"), F.count_if(fits).alias("chunks"), F.max(~fits).alias("truncated"))


def markers(answer: Column) -> Column:
    """Distinct citation markers of an answer, as they first occur."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1)), lambda x: x.cast("int")))


def drop_unknown_markers(answer: Column, known: Column) -> Column:
    """An answer without markers of passages that it wasn't given (``known``: array of int)."""
    unknown = F.array_except(markers(answer), known)
    return F.trim(F.aggregate(unknown, answer, lambda a, m: F.regexp_replace(a, F.concat(F.lit("\\s*\\[#"), m.cast("string"), F.lit("\\]")), F.lit(""))))


def judge_answers(answers: DataFrame, citations: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Answers with unknown markers removed, ``used`` markers and ``refused``: blank, or without a marker that is known."""
    known = citations.groupBy(query_id).agg(F.array_sort(F.collect_set("marker")).alias("_known"))
    a = answers.join(known, query_id, "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<int>")))
    a = a.withColumn("used", F.array_intersect(markers(F.col("answer")), F.col("_known"))).withColumn("answer", drop_unknown_markers(F.col("answer"), F.col("_known")))
    return a.withColumn("refused", (F.trim("answer") == "") | (F.size("used") == 0)).drop("_known")


def mark_used(citations: DataFrame, judged: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Citations with ``used``."""
    return citations.join(judged.select(query_id, F.col("used").alias("_used")), query_id, "left").withColumn("used", F.coalesce(F.array_contains("_used", F.col("marker")), F.lit(False))).drop("_used")


def labelled(citations: DataFrame, title: str = "title") -> DataFrame:
    """Citations with ``label``: the title of the document, where there is one, and the position."""
    position = position_label("position_start", "position_end", ":start", ":start-:end")
    return citations.withColumn("label", F.concat_ws(" - ", F.when(F.col(title) != "", F.col(title)), position))


def prompts(questions: DataFrame, citations: DataFrame, history: DataFrame | None = None, system: str = SYSTEM + REFUSAL, query_id: str = "query_id") -> DataFrame:
    """(query, ``system``, ``prompt``) of each question that has passages: earlier turns (``history``: query, turn, question, answer), passages, the question."""
    p = questions.select(query_id, "question").join(context(citations, query_id), query_id)
    parts = [F.col("context"), F.concat(F.lit("Question: "), F.col("question"))]
    if history is not None:
        said = F.concat(F.lit("User: "), F.col("question"), F.lit("\nAssistant: "), F.col("answer"))
        turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))), lambda x: x["said"])
        p = p.join(history.groupBy(query_id).agg(F.array_join(turns, "\n").alias("_before")), query_id, "left")
        parts.insert(0, F.col("_before"))
    return p.select(query_id, F.lit(system).alias("system"), F.concat_ws("\n\n", *parts).alias("prompt"))


def replies(asked: DataFrame, model: Model, refusal: str = REFUSAL, require_citations: bool = True, settle: Callable[[DataFrame], DataFrame] = lambda df: df, query_id: str = "query_id") -> DataFrame:
    """What the model says to each prompt (query, ``answer``, ``model``, ``prompt_tokens``, ``completion_tokens``, ``retried``).

    A reply that is neither blank nor the refusal, but has no marker, is asked for once more; what the second call says counts, and the tokens of both. ``settle`` keeps a frame that is computed once, so that no call is
    paid twice. ``model`` turns (query, system, prompt) into (query, answer) and, where it knows them, the other three.
    """

    def call(p: DataFrame) -> DataFrame:
        said = model(p)
        known = lambda name, kind: F.col(name).cast(kind) if name in said.columns else F.lit(None).cast(kind)
        return settle(said.select(query_id, "answer", known("model", "string").alias("model"), F.coalesce(known("prompt_tokens", "long"), F.lit(0)).alias("prompt_tokens"), F.coalesce(known("completion_tokens", "long"), F.lit(0)).alias("completion_tokens")))

    first = call(asked)
    if not require_citations:
        return first.withColumn("retried", F.lit(False))
    text = F.trim("answer")
    again = first.where((text != "") & (text != refusal.strip()) & ~text.rlike(MARKER)).select(query_id)
    second = call(asked.join(again, query_id, "left_semi").withColumn("prompt", F.concat("prompt", F.lit(REMINDER))))
    second = second.select(query_id, F.struct("answer", "model", "prompt_tokens", "completion_tokens").alias("_2"))
    both, redone = first.join(second, query_id, "left"), F.col("_2").isNotNull()
    tokens = [(F.col(c) + F.coalesce(F.col(f"_2.{c}"), F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    return both.select(query_id, F.when(redone, F.col("_2.answer")).otherwise(F.col("answer")).alias("answer"), F.when(redone, F.col("_2.model")).otherwise(F.col("model")).alias("model"), *tokens, redone.alias("retried"))


def answers(questions: DataFrame, citations: DataFrame, said: DataFrame, refusal: str = REFUSAL, require_citations: bool = True, snippet_chars: int = 300, query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(log, citations) of questions, the passages given for them and what ``replies`` has: a row of the log for each question, and each passage with ``used`` and a snippet in place of its text.

    Refused, with the refusal as answer: questions without passages or without a reply, blank answers, and (``require_citations``) answers that mark none of their passages.
    """
    judged = judge_answers(said, citations, query_id)
    log = query_log(questions).join(judged, query_id, "left")
    # of passages in order the first has the best score
    given = citations.groupBy(query_id).agg(F.count("*").alias("top_k"), F.min_by("score", "marker").alias("top_score"))
    blank = F.coalesce(F.trim("answer"), F.lit("")) == ""
    log = log.join(given, query_id, "left").withColumn("refused", blank | F.col("refused") if require_citations else blank)
    log = log.withColumns({"answer": F.when(F.col("refused"), F.lit(refusal)).otherwise(F.trim("answer")), "top_k": F.coalesce("top_k", F.lit(0)), "used": F.coalesce("used", F.array().cast("array<int>"))})
    log = log.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("prompt_tokens", "completion_tokens")}).withColumn("retried", F.coalesce("retried", F.lit(False)))
    return log, mark_used(citations, judged, query_id).withColumn("snippet", snippet("content", snippet_chars)).drop("content")


def query_log(asked: DataFrame, snippet_chars: int = 300) -> DataFrame:
    """Log rows of asked questions: with a hash of the question in lower case, trimmed; passages are cut to ``snippet_chars``."""
    out = asked.withColumn("question_hash", F.sha2(F.lower(F.trim("question")), 256))
    return out.withColumn("snippet", snippet("content", snippet_chars)) if "content" in asked.columns else out


def last_turns(log: DataFrame, n: int, conversation: str = "conversation_id", turn: str = "turn", tie: str = "id") -> DataFrame:
    """The last n answered turns of each conversation, the oldest first."""
    if "refused" in log.columns:
        log = log.where(~F.coalesce(F.col("refused"), F.lit(False)) & F.col("answer").isNotNull())
    w = Window.partitionBy(conversation).orderBy(F.col(turn).desc(), F.col(tie).desc())
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).orderBy(conversation, turn, tie).drop("_n")


def recent_conversations(conversations: DataFrame, limit: int, pinned_first: bool = True) -> DataFrame:
    """The latest conversations, pinned ones first."""
    order = [F.col("pinned").desc()] if pinned_first else []
    return conversations.orderBy(*order, F.col("last_message_at").desc(), F.col("id").desc()).limit(limit)


def recent_with_pinned(conversations: DataFrame, limit: int, pinned_ids: DataFrame) -> DataFrame:
    """The latest ones and those pinned that aren't among them, by time."""
    recent = conversations.orderBy(F.col("last_message_at").desc(), F.col("id").desc()).limit(limit)
    more = conversations.join(pinned_ids.select("id"), "id", "left_semi").join(recent.select("id"), "id", "left_anti")
    return recent.unionByName(more.select(recent.columns)).orderBy(F.col("last_message_at").desc(), F.col("id").desc())


def is_quoted(question: Column) -> Column:
    """Whether a question stands in double quotes as a whole: it asks for those very words, so rewriting it is of no use."""
    return question.rlike(r'(?s)^\s*["“«].*["”»]\s*$')


def rewrites(answer: Column, question: Column, most: int = 4) -> Column:
    """Rewrites of a question in a model's reply: the texts in the list ``queries`` of a JSON object, whatever stands around it, or else the reply's lines.

    Without numbers and bullets before them, quotes around them, those of more than 600 characters, the question itself and repeats in any case.
    """
    listed = F.try_variant_get(F.try_parse_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0)), "$.queries", "array<variant>")
    texts = F.transform(F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    lines = F.coalesce(texts, F.split(answer, r"\R+"))
    clean = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s*(?:[-*•\d.)]+\s+)", ""), r"^[ \t\"'“”«»]+|[ \t\"'“”«»]+$", ""))
    kept = F.filter(clean, lambda x: (F.length(x) > 0) & (F.length(x) <= 600) & (F.lower(x) != F.lower(F.trim(question))))
    # first spelling wins
    low = F.transform(kept, lambda x: F.lower(x))
    return F.slice(F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), F.lit(1), F.lit(most))


def expand(questions: DataFrame, model: Model, most: int = 4, query_id: str = "query_id") -> DataFrame:
    """Rewrites of questions (query, ``rewrite`` from 1, question). Blank and quoted ones aren't given to the model; a question without a reply, or with a reply that says nothing, has none.

    ``model`` turns (query, question) into (query, ``reply``).
    """
    q = questions.where((F.length(F.trim("question")) > 0) & ~is_quoted(F.col("question"))).select(query_id, "question")
    said = model(q).select(query_id, "reply").join(q, query_id)
    out = said.select(query_id, F.posexplode(rewrites(F.col("reply"), F.col("question"), most)).alias("_n", "question"))
    return out.select(query_id, (F.col("_n") + 1).cast("int").alias("rewrite"), "question")


def first_spelling(words: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct phrases whatever their case, in the spelling that comes first."""
    return words.groupBy(F.lower(column).alias("_low")).agg(F.min_by(column, order).alias(column), F.min(order).alias(order)).drop("_low")


def parse_passages(rendered: Column) -> Column:
    """(marker, label, text) of passages in a rendered context."""
    blocks = F.filter(F.split(rendered, r"\n\n(?=\[#\d+\] )"), lambda b: b.rlike(r"^\[#\d+\] "))
    return F.transform(
        blocks,
        lambda b: F.struct(F.regexp_extract(b, r"^\[#(\d+)\]", 1).cast("int").alias("marker"), F.regexp_extract(b, r"^\[#\d+\] ([^\n]*)", 1).alias("label"), F.regexp_extract(b, r"(?s)^[^\n]*\n(.*)$", 1).alias("text")),
    )

r"""Line de-duplication with a log-template tree (DataFrame functions only).

The tree has a fixed depth: a line goes down by its number of tokens and its first token, to a leaf. A token that holds a digit counts as ``<*>`` throughout. In a
leaf, lines belong to one template if they agree but for some variable fields, wherever these stand: a line of SEGMENTS tokens or more is cut into SEGMENTS runs of
tokens, of which any two may vary, so three quarters of it agree; of a shorter line any one token may, but in a line of 3 tokens none (but for digits). The first token never varies; a
line of fewer than MIN_TOKENS tokens has no template and always stays.

That is an equality, so a leaf is not searched line by line: a line has a hash for each choice of fields that may vary, and what recurs is counted. As these are
28 for a long line, a sieve goes before: if two of eight runs vary, one of three groups of them is the same in both lines, so only lines of which such a group
recurs can have a template that does. The sieve loses none, and few lines pass it.

A template recurs if at least ``min_docs`` rows of the corpus have it, or two, if it has LONG_TOKENS tokens or more, as chance doesn't repeat such a passage. Its lines are
dropped from every document but the first (the one of the smallest id), so one copy of each text stays in the corpus.

A row counts once for each template before anything is shuffled, and counts are summed before the shuffle, so a line that a third of all
documents have costs no more than any other; the joins back are of sides that Spark may split where they are skewed.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, drop_columns, loose, read, text_of

MIN_DOCS, LONG_DOCS, MIN_TOKENS, LONG_TOKENS, SEGMENTS = 5, 2, 3, 50, 8
#: The groups of runs for the sieve: first run and number of runs.
GROUPS = ((0, 3), (3, 3), (6, 2))
RESULTS = ("n_lines", "n_dropped")


def parsed_lines(text: Column) -> Column:
    """For each line of a text ``n`` (tokens), ``leaf`` and ``runs`` (hashes of its runs of tokens, or of its tokens); null for a line without a template."""
    # white space becomes one space, and a token with a digit <*>, where there are any; a match begins at a token's start alone, so that long tokens take linear time
    spaced = F.lit(False)
    for c in ("  ", "\t", "\v", "\f", "\r"):
        spaced = spaced | F.contains(text, F.lit(c))
    plain = F.when(spaced, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text)
    masked = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(x)))
    tokens = F.transform(masked, lambda m: F.split(m, " "))

    def line(t: Column) -> Column:
        n = F.size(t)
        begin = lambda s: F.shiftright(s * n, 3)  # noqa: E731  an eighth
        run = lambda s: F.hash(F.slice(t, begin(s) + 1, begin(s + 1) - begin(s)))
        runs = F.when(n >= SEGMENTS, F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), run)).otherwise(F.transform(t, lambda x: F.hash(x)))
        return F.when(n >= MIN_TOKENS, F.struct(n.alias("n"), F.xxhash64(n, t[0]).alias("leaf"), runs.alias("runs")))

    return F.transform(tokens, line)


def sieve_keys(x: Column) -> Column:
    """Hashes of groups of runs (of halves of a short line), one of which two lines of one template share."""
    half = F.floor(x["n"] / 2).cast("int")
    group = lambda k, a, size: F.xxhash64(x["leaf"], F.lit(k), F.slice(x["runs"], a, size))
    return (
        F.when(x["n"].isNull(), F.array().cast("array<bigint>"))
        .when(x["n"] >= SEGMENTS, F.array(*[group(k, F.lit(a + 1), F.lit(size)) for k, (a, size) in enumerate(GROUPS)]))
        .when(x["n"] > MIN_TOKENS, F.array(group(0, F.lit(1), half), group(1, half + 1, x["n"] - half)))
        .otherwise(F.array(group(0, F.lit(1), x["n"])))
    )


def template_keys(x: Column) -> Column:
    """The template hashes of a line, one for each choice of what may vary."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(SEGMENTS), 2)])
    places = F.when(x["n"] >= SEGMENTS, pairs).when(x["n"] > MIN_TOKENS, F.transform(F.sequence(F.lit(1), x["n"] - 1), lambda i: F.struct(i.alias("i"), (i - i - 1).alias("j"))))
    hashes = F.transform(x["runs"], lambda r, k: F.xxhash64(k, r))
    # all runs together by exclusive or, from which those that may vary are taken out again
    both = F.transform(F.array(hashes), lambda h: F.struct(h.alias("h"), F.aggregate(h, F.lit(0).cast("long"), lambda a, y: a.bitwiseXOR(y)).alias("all")))

    def keys(q: Column) -> Column:
        out = lambda k: F.when(k >= 0, q["h"][F.greatest(k, F.lit(0))]).otherwise(F.lit(0).cast("long"))
        return F.transform(places, lambda p: F.xxhash64(x["leaf"], p["i"], p["j"], q["all"].bitwiseXOR(out(p["i"])).bitwiseXOR(out(p["j"]))))

    return F.when(x["n"] > MIN_TOKENS, F.transform(both, keys)[0]).otherwise(F.array(F.xxhash64(x["leaf"], x["runs"])))


def recurring(keys: DataFrame, min_docs: int, long_docs: int) -> DataFrame:
    """``key`` and ``first`` (the smallest id) of what enough rows have, of (id, ``keys``): a row counts once, and the last bit of a key says that its lines are long."""
    counted = keys.select("id", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    return counted.where(F.col("rows") >= F.when(F.col("key") % 2 == 0, min_docs).otherwise(long_docs)).select("key", "first")


def drop_recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """Every row with its text without recurring lines, ``n_lines`` (lines before) and ``n_dropped``.

    Null text becomes empty and has one blank line. Blank lines always stay. A text may lose all of its lines and is then empty. A
    null id is no document's smallest: its lines go where an id that isn't null has them too. Rows that repeat count as often as they
    occur and are treated alike. Input columns named like a result are replaced.
    """
    d = drop_columns(docs, *RESULTS)
    row_hash = F.xxhash64(text_of(text_col))
    parsed = cut(d.select(F.col(f"`{id_col}`").alias("id"), row_hash.alias("hash"), parsed_lines(text_of(text_col)).alias("lines")), "line_keys")
    # numbers and not structs, as Spark finds distinct structs pair by pair
    tagged = lambda keys: lambda x: F.transform(keys(x), lambda k: k.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.when(x["n"] >= long_tokens, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
    # the sieve
    sieved = parsed.select("id", "hash", F.transform("lines", tagged(sieve_keys)).alias("by_line"))
    some = recurring(sieved.select("id", F.flatten("by_line").alias("keys")), min_docs, long_docs)
    at = sieved.select("id", "hash", F.posexplode("by_line").alias("at", "keys")).select("id", "hash", "at", F.explode("keys").alias("key"))
    passed = at.join(loose(some.select("key")), "key", "left_semi").groupBy("id", "hash").agg(F.collect_set("at").alias("passed"))
    # the templates of what passes; a row of each for rows that repeat
    p = passed.select(F.col("id").alias("other_id"), F.col("hash").alias("other_hash"), "passed")
    open_ = parsed.join(loose(p), F.col("id").eqNullSafe(F.col("other_id")) & (F.col("hash") == F.col("other_hash")))
    line = lambda i: F.col("lines")[i]
    open_ = cut(open_.select("id", "hash", F.transform("passed", lambda i: F.struct(i.alias("at"), tagged(template_keys)(line(i)).alias("keys"))).alias("open")), "line_templates")
    last = recurring(open_.select("id", F.flatten(F.col("open.keys")).alias("keys")), min_docs, long_docs)
    each = open_.select("id", "hash", F.explode("open").alias("o")).select("id", "hash", "o.at", F.explode("o.keys").alias("key"))
    gone = each.join(loose(last), "key").where(~F.col("id").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("id").alias("__gone_id"), F.col("hash").alias("__gone_hash")).agg(F.collect_set("at").alias("__gone"))
    out = d.withColumn("__row_hash", row_hash).join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__gone_id")) & (F.col("__row_hash") == F.col("__gone_hash")), "left")
    out = out.withColumn("__lines", F.split(text_of(text_col), "\n"))
    kept = F.expr("array_except(sequence(0, size(__lines) - 1), coalesce(__gone, cast(array() as array<int>)))")
    out = out.withColumns(
        {
            text_col: F.when(F.col("__gone").isNull(), text_of(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.col("__lines")[i]), "\n")),
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": F.coalesce(F.array_size("__gone"), F.lit(0)).cast("long"),
        }
    )
    return out.select(*[F.col(f"`{c}`") for c in d.columns], *RESULTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", *RESULTS)


def oracle_sql() -> str:
    pairs = ", ".join(f"{{'i': {i}, 'j': {j}}}" for i, j in combinations(range(SEGMENTS), 2))
    runs = ", ".join(f"array_to_string(t[{s} * n // {SEGMENTS} + 1 : {s + 1} * n // {SEGMENTS}], ' ')" for s in range(SEGMENTS))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
m AS (SELECT rid, doc_id, pos, regexp_replace(trim(regexp_replace(line, '[ \\t-\\r]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM l),
t AS (SELECT rid, doc_id, pos, string_split(m, ' ') AS t, len(string_split(m, ' ')) AS n FROM m),
r AS (SELECT rid, doc_id, pos, n, t[1] AS lead, CASE WHEN n >= {SEGMENTS} THEN [{runs}] ELSE t END AS runs,
      CASE WHEN n >= {SEGMENTS} THEN [{pairs}] WHEN n > {MIN_TOKENS} THEN list_transform(range(1, n), lambda i: {{'i': i, 'j': i}}) ELSE [{{'i': -1, 'j': -1}}] END AS masks FROM t WHERE n >= {MIN_TOKENS}),
k AS MATERIALIZED (SELECT rid, doc_id, pos, n, concat_ws(chr(1), n, lead, p.i, p.j, array_to_string(list_transform(runs, lambda x, y: CASE WHEN y - 1 = p.i OR y - 1 = p.j THEN '' ELSE x END), chr(2))) AS key
      FROM (SELECT rid, doc_id, pos, n, lead, runs, unnest(masks) AS p FROM r)),
c AS MATERIALIZED (SELECT key, min(doc_id) AS first FROM (SELECT DISTINCT rid, doc_id, key, n FROM k) GROUP BY key, n HAVING count(*) >= CASE WHEN n >= {LONG_TOKENS} THEN {LONG_DOCS} ELSE {MIN_DOCS} END),
g AS MATERIALIZED (SELECT DISTINCT rid, pos FROM k JOIN c ON k.key = c.key WHERE doc_id IS DISTINCT FROM first),
s AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) AS text FROM (SELECT l.rid, l.pos, line FROM l ANTI JOIN g ON l.rid = g.rid AND l.pos = g.pos) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_dropped FROM g GROUP BY rid)
SELECT doc_id, coalesce(s.text, '') AS text, len(lines) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM d LEFT JOIN s ON d.rid = s.rid LEFT JOIN n ON d.rid = n.rid"""

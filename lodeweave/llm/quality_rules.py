"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Each rule compares one feature of a text with a cutoff. A cutoff is used only where labelled documents prove it safe: within
every stratum (language), the exact binomial tail of the good documents that it would reject must show, at a confidence that is
shared out over all (stratum, rule, cutoff) tests (Bonferroni), that it falsely rejects at most ``risk`` of good documents. A cutoff must also be
of use: more bad than good labelled documents are rejected by it. Of the safe and useful cutoffs of a rule the strictest is taken; a
rule without one in a stratum does nothing there. All rules together reject at most the number of rules times ``risk``.

Plan: one narrow pass computes features (no shuffle), one aggregate over the labelled rows gives a row per stratum, and that table
of a few rows, whose size is bounded by strata x rules x cutoffs, is joined back by stratum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, drop_columns, loose, read, text_of

SPACE = r"[ \t-\r]"
WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Reject where ``numerator * 100 > cutoff * denominator``, for one of the cutoffs (percent, strictest first)."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[int, ...]


#: The production rules: symbols per word, long words and repeated lines and windows, in percent.
RULES = (
    Rule("symbols", "n_symbols", "n_words", (10, 20, 50, 100, 150, 200, 300, 400)),
    Rule("dup_lines", "n_dup_lines", "n_words", (1, 2, 5, 10, 20, 30)),
    Rule("long_words", "word_chars", "n_words", (700, 800, 900, 1000, 1200, 1500, 2000)),
    Rule("repeats", "n_repeat_words", "n_words", (5, 10, 15, 20, 25)),
)
RISK, CONFIDENCE, MIN_WORDS, MAX_REPEAT = 0.05, 0.95, 20, 30
MOST_STRATA = 10_000


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts of ``text_col`` (null: no words); input columns of the same names are replaced.

    ``n_words``: runs of characters other than space and U+0009-U+000D. ``word_chars``: code points in words. ``n_symbols``:
    characters of ``#*$%&|<>``. ``n_dup_lines``: lines with a word that equal an earlier line. ``n_repeat_words``: words inside
    8-word windows that the text holds at least twice. An empty or null text has zeros.
    """
    words = "array_remove(split(__rules_t, '[ \\\\t-\\\\r]+'), '')"
    lines = F.filter(F.split("__rules_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    # windows of 8 words as 64-bit hashes: of pairs, then of pairs of pairs, then of those
    step = lambda a, gap: (
        f"CASE WHEN size({a}) > {gap} THEN transform(sequence(0, size({a}) - {gap + 1}), i -> xxhash64({a}[i], {a}[i + {gap}])) ELSE array() END"
    )
    d = drop_columns(docs, *FEATURES).withColumn("__rules_t", text_of(text_col)).withColumn("__rules_w", F.expr(words))
    d = d.withColumn("__rules_l", lines)
    d = d.withColumn("__rules_h", F.expr("CASE WHEN size(__rules_w) >= 8 THEN transform(__rules_w, x -> xxhash64(x)) ELSE cast(array() as array<bigint>) END"))
    for gap in (1, 2, 4):
        d = d.withColumn("__rules_h", F.expr(f"cast({step('__rules_h', gap)} as array<bigint>)"))
    # only a text with a repeated window pays for the sort that finds where its repeats are
    at = "transform(__rules_h, (x, i) -> struct(x AS h, i AS i))"
    d = d.withColumn("__rules_s", F.expr(f"CASE WHEN size(array_distinct(__rules_h)) < size(__rules_h) THEN sort_array({at}) END"))
    d = d.withColumn("__rules_p", F.expr("sort_array(transform(filter(__rules_s, (x, i) -> (i > 0 AND __rules_s[i - 1].h = x.h) OR (i + 1 < size(__rules_s) AND __rules_s[i + 1].h = x.h)), x -> x.i))"))
    d = d.withColumns(
        {
            # least(id, 0) is 0; but a filter isn't pushed below what isn't deterministic, where it would hold all of the above, many times over
            "n_words": F.size("__rules_w") + F.least(F.monotonically_increasing_id(), F.lit(0)),
            "word_chars": F.length(F.array_join("__rules_w", "")).cast("long"),
            "n_symbols": (F.length("__rules_t") - F.length(F.regexp_replace("__rules_t", r"[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("__rules_l") - F.size(F.array_distinct("__rules_l"))).cast("long"),
            "n_repeat_words": F.expr(f"CASE WHEN __rules_p IS NULL THEN 0L ELSE {WINDOW} + aggregate(transform(__rules_p, (x, i) -> CASE WHEN i = 0 THEN 0 ELSE least({WINDOW}, x - __rules_p[i - 1]) END), 0L, (a, x) -> a + x) END"),
        }
    )
    return d.drop("__rules_t", "__rules_w", "__rules_l", "__rules_h", "__rules_s", "__rules_p")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT * n_words)


def ln_gamma(x: str) -> str:
    """SQL for ln of the gamma function for x >= 1, to about 1e-13: the Stirling series at x + 8, carried back."""
    y = f"({x} + 8)"
    back = " + ".join(f"ln({x} + {i})" for i in range(8))
    return f"(({y} - 0.5D) * ln{y} - {y} + 0.9189385332046727D + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - 1 / (1680 * pow({y}, 7)) - ({back}))"


def with_ln_tail(df: DataFrame, k: str, n: str, p: float) -> DataFrame:
    """Add ``ln_tail``: ln P(X <= k) for X ~ Binomial(n, p) and k <= n*p, as the pmf at k times a falling sum.

    Terms below 1e-17 of the first are left out, which a double can't show; their number grows as the root of n.
    """
    d = df.withColumns({"_x": F.col(k).cast("double"), "_m": F.col(n).cast("double")})
    d = d.withColumn("_top", F.expr(f"{ln_gamma('(_m + 1)')} - {ln_gamma('(_x + 1)')} - {ln_gamma('(_m - _x + 1)')} + _x * ln({p}D) + (_m - _x) * ln(1 - {p}D)"))
    ratio = f"a.t * (_x - j + 1) / (_m - _x + j) * {(1 - p) / p!r}D"
    terms = "cast(least(_x, ceil(12 * sqrt(_m + 1) + 60)) as int)"
    total = f"aggregate(CASE WHEN _x >= 1 THEN sequence(1, {terms}) ELSE cast(array() as array<int>) END, named_struct('t', 1D, 's', 1D), (a, j) -> named_struct('t', {ratio}, 's', a.s + {ratio}), a -> a.s)"
    return d.withColumn("ln_tail", F.expr(f"_top + ln({total})")).drop("_x", "_m", "_top")


def certify(labelled: DataFrame, stratum: str, good: Column, rules: tuple[Rule, ...] = RULES, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """The cutoffs that the labelled rows prove safe: one row per stratum, a column ``__rules_cut_<rule>`` each (null: none is safe).

    A cutoff is safe if P(X <= rejected good | good rows, risk) is at most (1 - confidence) / (strata x cutoffs of all rules):
    then the Clopper-Pearson upper bound of its false rejections is at most ``risk``. Rows with a null stratum form one of their own.
    """
    from math import log

    flat = [(r, c) for r in rules for c in r.cutoffs]
    rejected = lambda r, c, of: F.sum((of & (100 * F.col(r.numerator) > c * F.col(r.denominator))).cast("long"))
    counts = labelled.groupBy(F.col(stratum).alias("__rules_stratum")).agg(F.sum(good.cast("long")).alias("_good"), *[rejected(r, c, of).alias(f"_{k}_{r.name}_{c}") for r, c in flat for k, of in (("k", good), ("b", ~good))])
    # from here on there are as many rows as strata x cutoffs, however large the corpus
    cells = ", ".join(f"'{r.name}', {c}, _k_{r.name}_{c}, _b_{r.name}_{c}" for r, c in flat)
    tests = counts.select("__rules_stratum", "_good", F.expr(f"stack({len(flat)}, {cells}) AS (_rule, _cut, _k, _bad)"))
    tests = tests.withColumn("_strata", F.count("*").over(Window.partitionBy("_rule", "_cut")))
    tested = with_ln_tail(tests.where((F.col("_k") <= F.col("_good") * risk) & (F.col("_bad") > F.col("_k"))), "_k", "_good", risk)
    safe = tested.where(F.col("ln_tail") <= F.lit(log(1 - confidence)) - F.ln(F.col("_strata") * len(flat)))
    return safe.groupBy("__rules_stratum").agg(*[F.min(F.when(F.col("_rule") == r.name, F.col("_cut"))).alias(f"__rules_cut_{r.name}") for r in rules])


def labelled(d: DataFrame, labels: DataFrame, id_col: str, stratum: str) -> DataFrame:
    """Counts, ``_group`` (the stratum) and ``_quality`` of the labelled documents that pass the base rules, without their texts."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    rows = d.where(~F.col("base_failed")).select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{stratum}`").alias("_group"), *FEATURES)
    return rows.join(marks, F.col("_doc") == F.col("_id"))


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", rules: tuple[Rule, ...] = RULES, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed`` and ``kept``.

    ``labels`` has ``doc_id`` and ``quality`` (1: good, 0: bad, null: ignored; ids that repeat count once, good only if all are).
    A document is rejected if the base rules fail, or any rule's certified cutoff of its stratum does. Without labels no cutoff is
    certified and the base rules alone decide. Null text has no words and fails the base rules; a null stratum is one of its own;
    rows that repeat are each judged alike.
    """
    return judge(count(docs, text_col), labels, id_col, stratum, rules, risk, confidence)


def count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``features`` and ``base_failed``."""
    return features(drop_columns(docs, "base_failed", "kept"), text_col).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def judge(d: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", rules: tuple[Rule, ...] = RULES, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """``apply_rules`` for rows that are counted already. They are read twice: for the cutoffs and for the verdicts."""
    cuts = certify(labelled(d, labels, id_col, stratum), "_group", F.col("_quality") == 1, rules, risk, confidence)
    # one row for each stratum, counted: a few go to every worker, or all rows would be dealt out by a handful of keys
    cuts = cut(cuts, "cutoffs")
    cuts = F.broadcast(cuts) if cuts.count() <= MOST_STRATA else loose(cuts)
    out = d.join(cuts, F.col(f"`{stratum}`").eqNullSafe(F.col("__rules_stratum")), "left")
    bad = F.col("base_failed")
    for r in rules:
        bad = bad | F.coalesce(100 * F.col(r.numerator) > F.col(f"__rules_cut_{r.name}") * F.col(r.denominator), F.lit(False))
    return out.withColumn("kept", ~bad).drop("__rules_stratum", *[f"__rules_cut_{r.name}" for r in rules])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text")
    d = judge(cut(counted, "quality_rules"), read(spark, sf_dir, "labels"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    tests = sum(len(r.cutoffs) for r in RULES)
    flat = [(r, c) for r in RULES for c in r.cutoffs]
    tail = "(lgamma(g + 1) - lgamma(k + 1) - lgamma(g - k + 1) + k * ln({p}) + (g - k) * ln(1 - {p}) + ln((SELECT sum(exp(lgamma(k + 1) - lgamma(j + 1) + lgamma(g - k + 1) - lgamma(g - j + 1) + (k - j) * ln((1 - {p}) / {p}))) FROM generate_series(0, k) s(j))))".format(p=RISK)
    return f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT rid, i, array_to_string(words[i : i + 7], ' ') AS h FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
f AS MATERIALIZED (SELECT w.rid, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')))) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM f),
m AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
s AS MATERIALIZED (SELECT b.*, quality FROM b JOIN m ON b.doc_id = m.doc_id WHERE NOT base_failed),
v(rule, c) AS (VALUES {", ".join(f"('{r.name}', {c})" for r, c in flat)}),
h AS (SELECT lang, rule, c, quality, {" OR ".join(f"rule = '{r.name}' AND 100 * {r.numerator} > c * {r.denominator}" for r in RULES)} AS hit FROM s, v),
c AS (SELECT lang, rule, c, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, sum(CASE WHEN quality = 1 AND hit THEN 1 ELSE 0 END) AS k, sum(CASE WHEN quality <> 1 AND hit THEN 1 ELSE 0 END) AS b FROM h GROUP BY lang, rule, c),
safe AS (SELECT lang, rule, min(c) AS c FROM (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT lang FROM s)) AS strata FROM (SELECT lang, rule, c, CAST(g AS BIGINT) AS g, CAST(k AS BIGINT) AS k, b FROM c))
         WHERE k <= g * {RISK} AND b > k AND {tail} <= ln({1 - CONFIDENCE}) - ln(strata * {tests}) GROUP BY lang, rule),
p AS (SELECT lang, {", ".join(f"max(CASE WHEN rule = '{r.name}' THEN c END) AS cut_{r.name}" for r in RULES)} FROM safe GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {" OR ".join(f"coalesce(100 * {r.numerator} > cut_{r.name} * {r.denominator}, false)" for r in RULES)}) AS kept
FROM b LEFT JOIN p ON b.lang IS NOT DISTINCT FROM p.lang"""

"""Collocations: phrases of two to four words that hold together, from merged count-min sketches and one exact count of what survives them.

Texts are cut into pieces at punctuation and line ends, pieces into words; everything is counted in each language apart. First pass: each task counts words and pairs in a count-min
sketch of its own (ROWS hash rows of one width), and the sketches are added up, each task's in proportion to what it has counted. A cell counts all that falls into it, so an estimate (the least of an n-gram's cells) is never below
the count. Second pass: the same for phrases of three and four words, but only those of which every pair may be frequent by the first sketch: a phrase is no more frequent than its parts. Third pass:
what both sketches let through is counted exactly, by its words, first in the task and then by a shuffle on (language, phrase); what stays below the least count goes. So nothing frequent is
lost, whatever the width: a sketch that is too full only lets more through to the exact count.

The width follows the number of words (a cell for every WORDS_PER_CELL words) up to 2^MOST_BITS cells; cells stop at the least count, so a byte or two each are broadcast, 64 MB at most.

Scores, parts and subsumption then work on frequent phrases only, with DataFrame joins. A phrase is cut after each of its words; the cut that scores least counts. A phrase that lies in a longer one of nearly
its count says nothing of its own and is dropped. Each language's best come from a window with a limit, which Spark applies in every partition first, so that a language of nearly all phrases is no single task's.
"""

from __future__ import annotations

import hashlib
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, loose, read, small_batches, text_of
from lodeweave.llm.near_duplicates import M3, mix
from lodeweave.llm.ngrams import CELLS, Cells, Words, byte_table, groups, merged, windows

LEAST, LONGEST, TOP, SUBSUMED_PCT, SCALE = 30, 4, 2000, 80, 2_000_000
NO_LANG = "und"
BREAKS = byte_table(b".,;:!?\n\x0b\x0c\r")
WORD = ~(BREAKS | byte_table(b" \t"))
ROWS, WORDS_PER_CELL, LEAST_BITS, MOST_BITS = 2, 16, 16, 25
#: Phrases whose counts a task holds before it hands them over.
HELD = 1_000_000
#: Bytes of text for a task, about.
TASK_BYTES = 128 << 20


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each key in a row of the sketch."""
    return (mix(keys + np.uint64((row + 1) * int(M3) & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


class Sketch(Cells):
    """A task's own sketch."""

    def __init__(self, bits: int, least: int):
        super().__init__(ROWS << bits, least)
        self.bits = bits

    def add_keys(self, keys: np.ndarray) -> None:
        for r in range(ROWS):
            self.add(cells(keys, r, self.bits) + (r << self.bits))


def estimates(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of each key: no less than its count, but where cells have stopped."""
    bits = int(table.shape[1]).bit_length() - 1
    return np.minimum.reduce([table[r][cells(keys, r, bits)] for r in range(ROWS)])


def sketched(parts: DataFrame, bits: int, least: int) -> np.ndarray:
    """The sum of the tasks' sketches."""
    return merged(parts, ROWS << bits, least).reshape(ROWS, -1)


def texts_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(text_of(text_col).alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"))


def lang_keys(langs: list[str]) -> np.ndarray:
    """A number for each language."""
    known: dict[str, int] = {}
    for x in langs:
        if x not in known:
            known[x] = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
    return np.array([known[x] for x in langs], np.uint64)


def grams(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[int, Words, list[np.ndarray], list[np.ndarray]]]:
    """Of groups of a batch's texts: the first text's number, the words, and for n = 1 .. ``longest`` the keys of all n words in a row and which of them lie in one piece."""
    langs = lang_keys(batch.column(1).to_pylist())
    for at, texts in groups(batch.column(0)):
        w = Words(texts, WORD, BREAKS)
        own = mix(w.hash + langs[at : at + len(texts)][w.text] * M3)
        yield at, w, [windows(own, n) for n in range(1, longest + 1)], [w.piece[: max(0, len(own) - n + 1)] == w.piece[n - 1 :] for n in range(1, longest + 1)]


def surviving(keys: list[np.ndarray], inside: list[np.ndarray], short: np.ndarray, least: int) -> list[np.ndarray]:
    """Which n words in a row may be frequent by the first sketch: those of which every word and pair may."""
    word = estimates(short, keys[0]) >= least
    pair = inside[1] & word[:-1] & word[1:] if len(keys[1]) else inside[1]
    at = np.flatnonzero(pair)
    pair[at] = estimates(short, keys[1][at]) >= least
    out = [word, pair]
    for n in range(3, len(keys) + 1):
        k = len(keys[n - 1])
        out.append(inside[n - 1] & np.logical_and.reduce([pair[i : i + k] for i in range(n - 1)]) if k else inside[n - 1])
    return out


class Held:
    """A task's exact counts by key, and what each key says: language, phrase and number of words."""

    def __init__(self):
        self.keys, self.counts, self.langs, self.phrases, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, object), np.zeros(0, np.int32)

    def add(self, keys: np.ndarray, counts: np.ndarray, tell) -> None:  # noqa: ANN001
        """``keys`` are ascending; ``tell(i)`` gives (lang, phrase, n_words) of the i-th."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        self.counts[at[known]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            told = [tell(i) for i in new.tolist()]
            columns = [np.empty(len(new), object) for _ in range(2)]
            for column, i in zip(columns, range(2), strict=True):
                column[:] = [x[i] for x in told]
            put = lambda have, more: np.insert(have, at[new], more)
            self.keys, self.counts, self.langs, self.phrases, self.sizes = put(self.keys, keys[new]), put(self.counts, counts[new]), put(self.langs, columns[0]), put(self.phrases, columns[1]), put(self.sizes, [x[2] for x in told])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.keys), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(self.langs[part], pa.string()), pa.array(self.phrases[part], pa.binary()), pa.array(self.sizes[part], pa.int32()), pa.array(self.counts[part])], names=["lang", "phrase", "n_words", "count"])
        self.__init__()


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int | None = None) -> DataFrame:
    """``lang``, ``phrase``, ``n_words`` and ``count`` of every phrase of up to ``longest`` words that occurs ``least`` times or more, exactly; and a row with an empty phrase for all words of a language."""
    if not 1 <= least < 1 << 31 or longest < 2:
        raise ValueError("a least count from 1 on, and phrases of two words or more")
    spark, rows = docs.sparkSession, texts_of(docs, text_col, lang_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # what a task counts in advance is the less to shuffle the more the task has read
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1))
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, int(size // 6 // WORDS_PER_CELL).bit_length()))  # about six bytes to a word

    def count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketch(bits, least)
        for b in batches:
            for _, _, keys, inside in grams(b, 2):
                s.add_keys(keys[0])
                s.add_keys(keys[1][inside[1]])
        yield from s.blocks()

    short = spark.sparkContext.broadcast(sketched(rows.mapInArrow(count_short, CELLS), bits, least))

    def count_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketch(bits, least)
        for b in batches:
            for _, _, keys, inside in grams(b, longest):
                for k, may in list(zip(keys, surviving(keys, inside, short.value, least), strict=True))[2:]:
                    s.add_keys(k[may])
        yield from s.blocks()

    long = spark.sparkContext.broadcast(sketched(rows.mapInArrow(count_long, CELLS), bits, least)) if longest > 2 else short

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = Held(), defaultdict(int)
        for b in batches:
            langs = [sys.intern(x) for x in b.column(1).to_pylist()]
            for at, w, keys, inside in grams(b, longest):
                for i, n in enumerate(np.diff(w.ends, prepend=0).tolist()):
                    words[langs[at + i]] += n
                found, first, size = [], [], []
                for n, (k, may) in enumerate(zip(keys, surviving(keys, inside, short.value, least), strict=True), 1):
                    places = np.flatnonzero(may)
                    if n > 2:
                        places = places[estimates(long.value, k[places]) >= least]
                    found.append(k[places])
                    first.append(places)
                    size.append(np.full(len(places), n))
                first, size = np.concatenate(first), np.concatenate(size)
                u, one, times = np.unique(np.concatenate(found), return_index=True, return_counts=True)

                def tell(i: int, w=w, one=one, first=first, size=size, at=at, langs=langs) -> tuple[str, bytes, int]:  # noqa: ANN001
                    i, n = int(first[one[i]]), int(size[one[i]])
                    return langs[at + int(w.text[i])], b" ".join(w.data[w.start[j] : w.stop[j]] for j in range(i, i + n)), n

                held.add(u, times, tell)
                if len(held.keys) >= HELD:
                    yield from held.batches()
        yield from held.batches()
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([b""] * len(words), pa.binary()), pa.array([0] * len(words), pa.int32()), pa.array(list(words.values()), pa.int64())], names=["lang", "phrase", "n_words", "count"])

    found = rows.mapInArrow(count, "lang string, phrase binary, n_words int, count long").groupBy("lang", "phrase", "n_words").agg(F.sum("count").alias("count"))
    return found.where((F.col("count") >= least) | (F.col("n_words") == 0)).select("lang", F.col("phrase").cast("string").alias("phrase"), "n_words", "count")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, subsumed_pct: int = SUBSUMED_PCT, bits: int | None = None) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (those of the parts of the cut that scores least), ``n`` (words of the language) and ``score``; the first ``top`` of each language.

    Null texts have no words; a null language is ``und``. Equal scores are ranked by count, then phrase; rows that repeat count each time. An empty table gives no rows. Other columns of the input don't matter.
    """
    counts = cut(phrase_counts(docs, text_col=text_col, lang_col=lang_col, least=least, longest=longest, bits=bits), "phrases")
    words = F.split("phrase", " ")
    part = lambda name, value: loose(counts.where("n_words > 0").select("lang", F.col("phrase").alias(name), F.col("count").alias(value)))
    c = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("count").alias("a"), words.alias("w"))
    # sums of products and quotients in decimals of 38 digits: 64 bits may not hold them
    cuts = c.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select("lang", "phrase", "n_words", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("n_words")), " ").alias("right"))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"))
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    # phrases inside a longer one of nearly their count
    longer = c.where("n_words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)))
    inner = longer.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(loose(inner), ["lang", "phrase"], "left").where(F.col("longer").isNull() | F.expr(f"CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {subsumed_pct}"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("n_words = 0").select("lang", F.col("count").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def oracle_sql() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {n} AS m, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS phrase FROM p WHERE len(w) >= {n}" for n in range(1, LONGEST + 1))
    return f"""
WITH t AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM ({grams}) GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, phrase, m, a, w, unnest(range(1, m)) AS cut FROM c),
s AS (SELECT k.lang, k.phrase, k.a, cut, x.a AS l, y.a AS r, CAST((CAST(k.a AS HUGEINT) * {SCALE}) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score FROM k
 JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : cut], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[cut + 1 : k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, w, m, unnest(range(2, m)) AS z FROM c WHERE m > 2),
j AS (SELECT lang, a, w, z, unnest(range(1, m - z + 2)) AS k FROM i),
g AS (SELECT lang, array_to_string(w[k : k + z - 1], ' ') AS phrase, max(a) AS longer FROM j GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN g ON g.lang = b.lang AND g.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < {SUBSUMED_PCT} * b.a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= {TOP}"""

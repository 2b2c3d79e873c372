r"""N-gram Jaccard self-join by token-combination prefixes, verified exactly; classes are the components of its links.

A text is its set of distinct four-word shingles. All shingles have one order: by the class of their frequency (from a count sketch of bounded size over all distinct sets), rare ones first, then by hash.
Two sets of sizes p <= q and Jaccard similarity t or more share at least t / (1 + t) * (p + q) shingles, so of a prefix of the smaller one at most p - ceil(2t / (1 + t) * p) are missing in the other, and of a
prefix of the larger one at most q - ceil(t * q): its errors e. A prefix of e + 1 shingles keeps a shared one. Where shingles are frequent, single ones would bring together all that share a template, so these are indexed by
combinations: the frequent shingles of a class are dealt by hash into small groups, and a group of m shingles in the prefix is indexed by its combinations of k (k = 1 for rare shingles, 2 for frequent and 3 for very
frequent ones). To lose all combinations of a group, m - k + 1 of its shingles must be missing. So the prefix is extended until the sum of these over all groups is above e; then one combination is shared. The number of groups
follows the size, in bands of sizes that a pair can span two of; sets are indexed for their own band and, as the larger one of a pair, for the one below. Groups are small, so signatures grow with a text and not with a power of it.

A pair is only formed where a signature is in the prefix of the smaller set as the smaller one, where sizes allow the threshold, and where what both have left after the shingle does.

Equal sets are one from the start. Signatures that two sets share are kept, and each round compares the members of a signature with one of them; links join classes, and what is in one class already needs no more comparison. After
PIVOT_ROUNDS rounds all pairs that share a signature, are still in two classes and may link are compared, so no link between classes is lost. A rare shingle's bucket is bounded by what makes it rare; buckets of combinations are not, and
texts made of the same few passages in ever new choices are compared nearly as often as they share combinations.

Plan: two passes over the distinct texts (sketch, signatures), one shuffle of signatures, of which those of one text end there, and joins of texts for pairs to verify. Hashes have 64 bits: that two different shingles of two
compared texts are taken for one has a probability below 10^-9 for texts of 10^5 words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, loose, read, small_batches, text_of
from lodeweave.llm.near_duplicates import M1, M2, M3, components, mix, text_key
from lodeweave.llm.ngrams import CELLS, Cells, Words, byte_table, groups, merged, windows

SHINGLE, THRESHOLD_PCT = 4, 85
WORD = ~byte_table(b" \t\n\x0b\x0c\r")
LEAST_BITS, MOST_BITS, PER_SLOT, MOST_COUNT = 16, 24, 64, 65535
#: Counts of slots are kept as steps of their logarithm, a byte each.
STEPS = 8
#: Shingles of which slots count more than these (times the mean count, and at least) are frequent and very frequent; sets below PLAIN shingles index single ones all the same.
FREQUENT, VERY_FREQUENT, PLAIN, GROUP = (4, 64), (64, 1024), 20, 12
PIVOT_ROUNDS = 3


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending: of all four words in a row, or of all words of a text of fewer; none for a text without words."""
    for _, group in groups(texts):
        w = Words(group, WORD)
        four, at = windows(w.hash, SHINGLE), 0
        for end in w.ends.tolist():
            n = end - at
            yield np.unique(four[at : end - SHINGLE + 1]) if n >= SHINGLE else windows(w.hash[at:end], n) if n else np.zeros(0, np.uint64)
            at = end


def set_key(h: np.ndarray) -> bytes:
    """128 bits for a set."""
    return int(mix(h ^ M1).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix((h + M3) * M2).sum(dtype=np.uint64)).to_bytes(8, "big")


def bands(largest: int, pct: int) -> np.ndarray:
    """Least sizes of bands: sets of which the smaller has ``pct`` % of the larger or more are in one band or in two that follow each other."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // pct + 1)
    return np.array(out, np.int64)


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Order:
    """The order of shingles: by the step of their slot's count, then by hash; ``second`` and ``third``: the first steps of frequent and very frequent ones."""

    def __init__(self, sketch: np.ndarray):
        self.bits = int(len(sketch)).bit_length() - 1
        mean = float(sketch.mean()) if len(sketch) else 0.0
        step = lambda c: np.floor(STEPS * np.log2(np.asarray(c, np.float64) + 1)).clip(0, 255).astype(np.uint8)
        self.steps = step(sketch)
        self.second, self.third = (int(step(max(x * mean, least))) + 1 for x, least in (FREQUENT, VERY_FREQUENT))


def signatures(h: np.ndarray, order: Order, pct: int, bounds: np.ndarray) -> tuple[list[int], list[int], list[bool]]:
    """Signatures of a set, what is left of it from each on, and whether each is in its prefix as the smaller set of a pair."""
    n = len(h)
    small, large = n - -(-2 * pct * n // (100 + pct)), n - -(-pct * n // 100)
    steps = order.steps[slot(h, order.bits)]
    by = np.lexsort((h, steps))
    h, steps = h[by], steps[by]
    rare = int(np.searchsorted(steps, order.second))
    k = min(rare, large + 1)
    sig, left, first = h[:k].view(np.int64).tolist(), list(range(n, n - k, -1)), [i <= small for i in range(k)]
    if rare > large:
        return sig, left, first
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    f, very = h[rare:], steps[rare:] >= order.third
    for band in (own, own - 1):
        if band < 0:
            continue
        plain = bounds[band] < PLAIN
        tag = int(mix(np.array([band + 1], np.uint64))[0])
        n_groups = max(1, int(bounds[band]) // GROUP)
        group = np.arange(len(f)) if plain else (mix(f ^ M3) % np.uint64(n_groups)).astype(np.int64) * 2 + very
        need = np.zeros(len(f), np.int64) if plain else np.where(very, 2, 1)
        # how many of its group stand before each
        at = np.argsort(group, kind="stable")
        sorted_group = group[at]
        begins = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
        before = np.empty(len(f), np.int64)
        before[at] = np.arange(len(f)) - np.repeat(begins, np.diff(begins, append=len(f)))
        gained = rare + np.cumsum(before >= need)
        stop = int(np.searchsorted(gained, large + 1)) + 1
        stop_small = int(np.searchsorted(gained, small + 1)) + 1 if rare <= small else 0
        members: dict[int, list[int]] = {}
        for i, g in enumerate(group[:stop].tolist()):
            members.setdefault(g, []).append(i)
        tokens = f[:stop].tolist()
        for ms in members.values():
            for combo in combinations(ms, int(need[ms[0]]) + 1):
                x = tag
                for i in combo:
                    x = ((x ^ tokens[i]) * 0x9E3779B97F4A7C15 + (x >> 29)) & (1 << 64) - 1
                sig.append(x - (1 << 64) if x >> 63 else x)
                left.append(n - rare)
                first.append(band == own and combo[-1] < stop_small)
    return sig, left, first


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text_key``, ``key`` (of the set) and ``n`` (its size) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [(set_key(h), len(h)) for h in shingle_sets(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k for k, _ in sets], pa.binary()), pa.array([n for _, n in sets], pa.int64())], names=["id", "text_key", "key", "n"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text_col).alias("text_key"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_key binary, key binary, n long")


def frequency_order(texts: DataFrame) -> Order:
    """The order by a sketch of how many distinct sets hold the shingles of each slot; a slot for every PER_SLOT shingles, up to 2^MOST_BITS of them, of which workers get a byte each."""
    total = texts.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(total // PER_SLOT).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cells(1 << bits, MOST_COUNT)
        for b in batches:
            for h in shingle_sets(b.column(0)):
                c.add(slot(h, bits))
        yield from c.blocks()

    return Order(merged(texts.select("text").mapInArrow(count, CELLS), 1 << bits, MOST_COUNT))


def index(texts: DataFrame, order, pct: int, largest: int) -> DataFrame:  # noqa: ANN001
    """``sig``, ``row``, ``n``, ``left`` and ``first`` of every signature."""
    bounds = bands(largest, pct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for row, h in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                sig, left, first = signatures(h, order.value, pct, bounds)
                for column, values in zip(out, (sig, [row] * len(sig), [len(h)] * len(sig), left, first), strict=True):
                    column += values
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["sig", "row", "n", "left", "first"])

    return texts.select("row", "text").mapInArrow(run, "sig long, row long, n int, left int, first boolean")


def may_link(pct: int) -> Column:
    """For two members of a signature, the second with columns of a 2: of two classes, the signature is in the smaller one's prefix as such, and sizes and what is left allow the threshold."""
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    first = (F.col("first") & (F.col("n") <= F.col("n2"))) | (F.col("first2") & (F.col("n2") <= F.col("n")))
    return (F.col("root") != F.col("root2")) & first & (small * 100 >= large * pct) & (F.least("left", "left2").cast("long") * (100 + pct) >= (F.col("n").cast("long") + F.col("n2")) * pct)


def verified(pairs: DataFrame, texts: DataFrame, pct: int) -> DataFrame:
    """Pairs (``a``, ``b``, ``root_a``, ``root_b``) of rows with ``linked``: whether 100 * intersection >= ``pct`` * union."""
    t = lambda name: texts.select(F.col("row").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(t("b"), "b").join(t("a"), "a").select("a", "b", "root_a", "root_b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            linked = []
            for a, text, y in zip(batch.column(0).to_pylist(), batch.column(4), shingle_sets(batch.column(5)), strict=True):
                if last[0] != a:
                    last = (a, next(shingle_sets(pa.array([text.as_py()], pa.string()))))
                x = last[1]
                same = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * same >= pct * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(linked, pa.bool_())], names=["a", "b", "root_a", "root_b", "linked"])

    return both.mapInArrow(run, "a long, b long, root_a long, root_b long, linked boolean")


def find_classes(texts: DataFrame, pct: int, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """``row`` and ``root`` (the smallest row of its class) of rows that links join, but of roots."""
    spark = texts.sparkSession
    largest = texts.agg(F.max("n")).first()[0] or 1
    order = spark.sparkContext.broadcast(frequency_order(texts))
    p = cut(index(texts, order, pct, largest), "index")
    # signatures of two sets or more, one of them as the smaller
    shared = p.groupBy("sig").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.max("first").alias("any")).where("low <> high AND any").select("sig")
    p = cut(p.join(loose(shared), "sig").withColumn("root", F.col("row")), "signatures")
    known = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "row long, root long")
    columns = ("row", "root", "n", "left", "first")
    for last in (*[False] * rounds, True):
        # the member that the others of a signature are compared with: that with the least of its own, which joins the members of a large class
        several = p.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct((F.col("left") / F.col("n")).alias("share"), *columns)).alias("top")).where("low <> high")
        p = cut(p.join(loose(several.select("sig", "top")), "sig"), "signatures")
        if last:
            other = p.select("sig", *[F.col(c).alias(f"{c}2") for c in columns])
            near = p.where("first").select("sig", *columns).join(other, "sig").where(may_link(pct))
        else:
            near = p.select("sig", *columns, *[F.col(f"top.{c}").alias(f"{c}2") for c in columns]).where(may_link(pct))
        turned = F.col("row") > F.col("row2")
        side = lambda x, name: [F.when(turned, F.col(f"{x}2")).otherwise(F.col(x)).alias(f"{name}a"), F.when(turned, F.col(x)).otherwise(F.col(f"{x}2")).alias(f"{name}b")]
        fresh = near.select(*side("row", ""), *side("root", "root_")).distinct().join(known, ["a", "b"], "left_anti")
        found = cut(verified(fresh, texts, pct), "verified")
        joined = components(found.where("linked").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        over = joined.select(F.col("key").alias("root"), F.col("root").alias("new"))
        relabel = lambda df: df.join(loose(over), "root", "left").withColumn("root", F.coalesce("new", "root")).select(*df.columns)
        roots = cut(relabel(roots).unionByName(joined.select(F.col("key").alias("row"), "root")), "roots")
        if not last:
            known = known.unionByName(found.select("a", "b"))
            p = relabel(p.where("row <> top.row").select("sig", *columns))
    return roots


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_shingles`` (distinct ones) and ``component_id``, the smallest id that links of ``threshold_pct`` % or more lead to, its own included.

    Texts without words (null, empty) have no shingles and are linked with nothing; their ``component_id`` is their id. Rows that repeat are each returned, and linked. A null id is ignored for the smallest, and is the
    class's id only where it has no other. An empty table gives no rows; other columns don't matter.
    """
    if not 50 <= threshold_pct <= 100:
        raise ValueError("a threshold of 50 to 100 %")
    sets = cut(sets_of(docs, id_col, text_col), "sets")
    chosen = sets.where("n > 0").groupBy("key").agg(F.min(F.struct("id", "text_key")).alias("at"), F.first("n").alias("n")).select("key", "n", F.col("at.id").alias("first_id"), F.col("at.text_key").alias("first_text"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text_col).alias("text_key"), text_of(text_col).alias("text"))
    texts = rows.join(chosen, (F.col("text_key") == F.col("first_text")) & F.col("id").eqNullSafe(F.col("first_id"))).select("key", "n", "text").dropDuplicates(["key"])
    texts = cut(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    roots = find_classes(texts.select("row", "n", "text"), threshold_pct)
    labelled = texts.select("key", "row").join(loose(roots), "row", "left").select("key", F.coalesce("root", "row").alias("root"))
    worded = sets.where("n > 0").join(loose(labelled), "key").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "root")
    smallest = worded.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = worded.join(loose(smallest), "root").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(sets.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return link(read(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle_sql() -> str:
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 2}, 2)), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) AS g FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT a.rid AS a, b.rid AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
k AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * same >= {THRESHOLD_PCT} * (x.n + y.n - same)),
l AS MATERIALIZED (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n ON n.rid = d.rid JOIN c ON c.rid = d.rid"""

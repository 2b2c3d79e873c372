"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Queries are taken in blocks of bounded size; what goes to workers is a block's terms and lists, however large the corpus. Of every document one row is written with the counts of the block's
terms that it holds, and from it the postings (term, impact, row), range-partitioned and sorted by term and falling impact, so that a list's head is a prefix and a common term's list is as many partitions long
as it needs. The impact is what one occurrence of the term in a query adds to the score; it depends on no query. Then

1. the heads: the k postings of most impact of every list. Scores of the documents in the heads of a query's lists are looked up, and the k-th of them, tau, bounds the k-th of the result from below;
2. one threshold for all lists of a query: a document that reaches tau has tau / m in one of its m lists at least. Lists are in the order of what they add at most, and the weakest may be left out: of j lists with
   ``rest`` left over, one adds (tau - rest) / j; the j of the highest threshold is taken. All postings above it are fetched, and a document stays if its sum, with the threshold for each list in which it
   wasn't seen and with the rest, reaches tau, which the exact scores of the highest sums have raised before;
3. exact scores of what stayed are looked up, and the best k are the result.

Lookups join (query, row) pairs with the documents' rows of counts; nothing is looked up by the driver, which only keeps a block's queries, tau of each and the highest impact of each term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, loose, read, small_batches
from lodeweave.llm.decontaminate import words_of

TOP = 10
#: Most terms of a block of queries (each query's repeats counted once); a longer query is a block of its own.
BLOCK_TERMS = 500_000
#: b and k1 of the score in hundredths, and the scale of a term's share.
B_PCT, SHARE = 75, 1_000_000_000
WIDEST = 1 << 62


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of each term."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


def share(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight 1 adds to a document of ``n`` terms that holds it ``tf`` times."""
    if len(n) and int(n.max()) * n_docs * B_PCT >= WIDEST:
        m = np.array([100 - B_PCT + B_PCT * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 100 - B_PCT + B_PCT * n * n_docs // max(1, n_terms)
    return SHARE * tf // (1000 * tf + 8 * m)


def document_rows(docs: DataFrame, id_col: str, text_col: str, terms: list[bytes]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), and ``terms`` (numbers, ascending) with ``counts`` of those of ``terms`` that the text holds; rows without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            ids, n, found = [], [], []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                words = words_of(text.as_py())
                if words:
                    c = Counter(map(number, words))
                    c.pop(None, None)
                    ids.append(doc.as_py())
                    n.append(len(words))
                    found.append(sorted(c.items()))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array([p[k] for x in found for p in x], pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>").withColumn("row", F.monotonically_increasing_id())


def flat(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From columns ``at``: n, terms, counts of rows: of each posting its row in the batch, the term and the count."""
    lists = b.column(at + 1)
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64), b.column(at + 2).flatten().to_numpy().astype(np.int64)


class Block:
    """A block's queries: of query q the distinct terms ``terms[starts[q] : starts[q + 1]]``, ascending, and how often each occurs in it."""

    def __init__(self, queries: list[list[bytes]]):
        self.words = sorted({w for q in queries for w in q})
        number = {w: i for i, w in enumerate(self.words)}
        lists = [sorted(Counter(number[w] for w in q).items()) for q in queries]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.terms = np.array([t for x in lists for t, _ in x], np.int64)
        self.times = np.array([c for x in lists for _, c in x], np.int64)

    def thresholds(self, tau: dict[int, int], most: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """By term: the queries that fetch its list, the times it counts in each, and the least impact of each; and of each query (needed, lists, rest): a document
        that reaches tau adds ``needed`` / ``lists`` in one of the fetched lists at least, and at most ``rest`` in all others."""
        fetch: dict[int, list[tuple[int, int, int]]] = {}
        bound = np.zeros((len(self.starts) - 1, 3), np.int64)
        for q in range(len(bound)):
            terms, times = self.terms[self.starts[q] : self.starts[q + 1]], self.times[self.starts[q] : self.starts[q + 1]]
            high = most[terms] * times
            order = np.argsort(-high, kind="stable")
            order = order[high[order] > 0]
            if not len(order):
                continue
            rest = np.concatenate([np.cumsum(high[order][::-1])[::-1][1:], [0]])
            need = np.maximum(tau.get(q, 0) - rest, 0)
            j = int(np.argmax(need / np.arange(1, len(order) + 1)))
            if need[j] <= 0:
                j = len(order) - 1
            bound[q] = need[j], j + 1, rest[j]
            for i in order[: j + 1]:
                fetch.setdefault(int(terms[i]), []).append((q, int(times[i]), max(1, -(-int(need[j]) // ((j + 1) * int(times[i]))))))
        return {t: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for t, rows in fetch.items()}, bound


def exact_scores(pairs: DataFrame, rows: DataFrame, block, weights, n_docs: int, n_terms: int) -> DataFrame:  # noqa: ANN001
    """``q``, ``row``, ``doc_id`` and ``score`` of distinct (q, row) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_, w = block.value, weights.value
        for b in batches:
            of, term, tf = flat(b, 3)
            n = b.column(3).to_numpy()
            add = w[term] * share(tf, n[of], n_docs, n_terms)
            ends, score = np.cumsum(np.bincount(of, minlength=b.num_rows)), []
            for i, (q, end) in enumerate(zip(b.column(0).to_pylist(), ends.tolist(), strict=True)):
                mine, got = b_.terms[b_.starts[q] : b_.starts[q + 1]], slice(int(ends[i - 1]) if i else 0, end)
                at = np.searchsorted(mine, term[got])
                at[at == len(mine)] = 0
                score.append(int((add[got] * np.where(mine[at] == term[got], b_.times[b_.starts[q] + at], 0)).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score, pa.int64())], names=["q", "row", "doc_id", "score"])

    return pairs.join(rows, "row").select("q", "row", "doc_id", "n", "terms", "counts").mapInArrow(run, "q int, row long, doc_id long, score long")


def search_block(docs: DataFrame, queries: list[list[bytes]], top: int, id_col: str, text_col: str) -> DataFrame | None:
    """``q`` (number in the block), ``rank``, ``doc_id`` and ``score``; None where no document has a term."""
    spark = docs.sparkSession
    own = Block(queries)
    rows = cut(document_rows(docs, id_col, text_col, own.words), "rows")
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not own.words:
        return None
    df = np.zeros(len(own.words), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # one row a term of the block
        df[r.t] = r["count"]
    sc = spark.sparkContext
    block, weights = sc.broadcast(own), sc.broadcast(weight(n_docs, df))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, term, tf = flat(b, 1)
            impact = weights.value[term] * share(tf, b.column(1).to_numpy()[of], n_docs, n_terms)
            keep = impact > 0
            yield pa.RecordBatch.from_arrays([pa.array(term[keep].astype(np.int32)), pa.array(impact[keep]), pa.array(b.column(0).to_numpy()[of][keep])], names=["term", "impact", "row"])

    flat_postings = rows.select("row", "n", "terms", "counts").mapInArrow(post, "term int, impact long, row long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows as a third key: a list of equal impacts is cut too
    postings = cut(flat_postings.repartitionByRange(parts, "term", F.desc("impact"), "row").sortWithinPartitions("term", F.desc("impact"), "row"), "postings")

    # 1: heads
    heads = cut(postings.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))).where(F.col("k") <= top), "heads")
    most = np.zeros(len(own.words), np.int64)
    for r in heads.where("k = 1").select("term", "impact").toLocalIterator():
        most[r.term] = r.impact
    lists = spark.createDataFrame(
        pa.table({"q": pa.array(np.repeat(np.arange(len(queries)), np.diff(own.starts)), pa.int32()), "term": pa.array(own.terms, pa.int32())})
    )  # no more rows than BLOCK_TERMS
    scored = exact_scores(loose(heads.join(F.broadcast(lists), "term").select("q", "row").distinct()), rows, block, weights, n_docs, n_terms)
    best = lambda df: df.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))).where(F.col("rank") <= top)
    tau = {r.q: r.score for r in best(scored).where(F.col("rank") == top).select("q", "score").toLocalIterator()}

    # 2: all postings above the threshold of a query
    fetch, bound = own.thresholds(tau, most)
    shared = sc.broadcast(fetch)

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, impact, row = (c.to_numpy() for c in b.columns)
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else []
            for s, e in zip(starts, [*starts[1:], len(term)], strict=True):
                if int(term[s]) in shared.value:
                    q, times, least = shared.value[int(term[s])]
                    ends = s + np.searchsorted(-impact[s:e], -least, side="right")  # impacts fall
                    for k in np.flatnonzero(ends > s).tolist():
                        got = slice(s, int(ends[k]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(got.stop - s, q[k], np.int32)), pa.array(row[got]), pa.array(impact[got] * times[k])], names=["q", "row", "added"])

    lowest = spark.createDataFrame(pa.table({"term": pa.array(list(fetch), pa.int32()), "lowest": pa.array([int(x[2].min()) for x in fetch.values()], pa.int64())}))
    above = postings.join(F.broadcast(lowest), "term").where("impact >= lowest").select("term", "impact", "row")
    seen = cut(above.mapInArrow(fetched, "q int, row long, added long").groupBy("q", "row").agg(F.sum("added").alias("sum"), F.count("*").alias("lists")), "seen")
    # the documents of the highest sums bound the k-th score from below once more
    high = seen.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sum"), "row"))).where(F.col("k") <= top).select("q", "row")
    for r in best(exact_scores(high, rows, block, weights, n_docs, n_terms)).where(F.col("rank") == top).select("q", "score").toLocalIterator():
        tau[r.q] = max(tau.get(r.q, 0), r.score)
    bounds = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(queries)), pa.int32()), "tau": pa.array([tau.get(q, 0) for q in range(len(queries))], pa.int64()), **{c: pa.array(bound[:, i]) for i, c in enumerate(("needed", "of", "rest"))}}))
    may = F.expr("CAST(sum AS DECIMAL(38, 0)) * of + CAST(of - lists AS DECIMAL(20, 0)) * needed >= CAST(tau - rest AS DECIMAL(38, 0)) * of")
    candidates = cut(seen.join(F.broadcast(bounds), "q").where(may).select("q", "row"), "candidates")

    # 3: exact scores
    return best(exact_scores(candidates, rows, block, weights, n_docs, n_terms)).select("q", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``top`` documents of each row of ``items``, and fewer where fewer have a score above 0.

    Null and empty texts have no terms: such a document isn't counted, such an item has no result. Rows that repeat are each ranked (of items: each a query of its own). Equal scores are
    ranked by id, null ids last. Empty tables give no rows. Other columns don't matter.
    """
    kind = items.schema[item_col].dataType
    out = docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    ids: list = []
    queries: list[list[bytes]] = []
    size = 0

    def done() -> None:
        nonlocal out, ids, queries, size
        if queries:
            found = search_block(docs, queries, top, id_col, text_col)
            if found is not None:
                names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"q int, item_id {kind.simpleString()}")
                out = out.unionByName(found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
        ids, queries, size = [], [], 0

    for r in items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).toLocalIterator():  # the stated queries, a block at a time
        words = words_of(r.text)
        if words:
            if queries and size + len(set(words)) > block_terms:
                done()
            ids.append(r.item)
            queries.append(words)
            size += len(set(words))
    done()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def oracle_sql() -> str:
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, w, len(w) AS n FROM (SELECT doc_id, {words} AS w FROM documents) WHERE len(w) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
q AS MATERIALIZED (SELECT iid, item_id, t, count(*) AS c FROM (SELECT row_number() OVER () AS iid, item_id, unnest({words}) AS t FROM benchmark) GROUP BY ALL),
p AS MATERIALIZED (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, CAST(count(*) AS BIGINT) AS df FROM p WHERE t IN (SELECT t FROM q) GROUP BY t), g),
i AS (SELECT p.rid, p.t, weight * (({SHARE} * tf) // (1000 * tf + 8 * ({100 - B_PCT} + (({B_PCT} * n * nd) // nt)))) AS impact FROM p JOIN w ON w.t = p.t JOIN d ON d.rid = p.rid, g),
s AS (SELECT iid, item_id, rid, CAST(sum(c * impact) AS BIGINT) AS score FROM i JOIN q ON q.t = i.t GROUP BY ALL HAVING sum(c * impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id, s.rid) AS rank, doc_id, score FROM s JOIN d ON d.rid = s.rid) WHERE rank <= {TOP}"""

"""Retrieval: exact vector search, keyword search by inverse document frequency, fusion, de-duplication, diversity and neighbours.

Searches take a frame of queries, so one query and a million are the same plan: keyword search joins postings by term, and vector search scores
blocks of the corpus against the queries. Only top candidates of a query (``fetch_k``, a few dozen) reach the greedy steps, one query to a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeweave.config import RetrievalOptions
from lodeweave.functions.stems import SIMPLE, stemmer
from lodeweave.functions.text import excerpt, fold_accents, lexemes, terms
from lodeweave.functions.vectors import cosine
from lodeweave.sources.filters import any_of, overlaps


def base_scan(chunks: DataFrame, *, source_keys: list[str] | None = None, document_ids: list | None = None, external_ids: list[str] | None = None, position_from: int | None = None, position_to: int | None = None, chunk_ids: list | None = None, constrain: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Embedded chunks that pass the allow-lists (None: all; empty: none), overlap the positions, and meet the constraint."""
    c = chunks.where(F.col("embedded_at").isNotNull()) if "embedded_at" in chunks.columns else chunks
    for name, values in (("source_key", source_keys), ("document_id", document_ids), ("external_id", external_ids), ("chunk_id", chunk_ids)):
        if values is not None:
            c = c.where(any_of(F.col(name), values))
    if position_from is not None or position_to is not None:
        c = c.where(overlaps(F.col("position_start"), F.col("position_end"), position_from, position_to))
    return constrain(c) if constrain else c


def vector_search(chunks: DataFrame, query: list[float], limit: int, min_score: float = 0.0, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The ``limit`` chunks nearest to one vector by cosine, then by id, with ``score``; a floor above 0 counts. Only ids and scores are sorted."""
    s = chunks.select(id_col, cosine(vector_col, query).alias("score"))
    if min_score > 0:
        s = s.where(F.col("score") >= min_score)
    return s.orderBy(F.col("score").desc(), id_col).limit(limit)


#: Bytes of query vectors, and queries, that one pass sends to every worker.
QUERY_BYTES, QUERY_ROWS = 32 << 20, 2048


def knn_join(queries: DataFrame, chunks: DataFrame, k: int, *, query_id: str = "query_id", id_col: str = "chunk_id", vector_col: str = "embedding", batch_rows: int = 2048, exclude_self: bool = False, lists: tuple[str, str] | None = None) -> DataFrame:
    """The k nearest chunks of each query by cosine, exactly: query_id, id, score, rank from 1 (ties by id).

    Queries are a stated set. As many of them as fit into QUERY_BYTES and QUERY_ROWS, both measured, are sent to every worker; the corpus passes by them as it is read, and each
    partition hands over its k best rows of a query. The corpus is never shuffled. More queries take more passes.
    ``lists``: a column of the queries with the lists that each one probes, and one of the chunks with the list that each is in; a query then meets the chunks of its lists alone.
    """
    q_type, i_type = queries.schema[query_id].dataType, chunks.schema[id_col].dataType.simpleString()
    probes = F.col(lists[0]) if lists else F.lit(None)
    rows = queries.select(F.col(query_id).alias("i"), F.col(vector_col).cast("array<double>").alias("v"), probes.cast("array<int>").alias("p")).where("v IS NOT NULL")
    size, many = rows.agg(F.coalesce(F.sum(F.size("v") * 8 + 64), F.lit(0)), F.count("*")).first()
    passes = max(1, -(-size // QUERY_BYTES), -(-many // QUERY_ROWS))
    found = None
    for n in range(passes):
        block = rows.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == n).collect()  # QUERY_BYTES, about
        if block:
            some = _nearest(chunks, [r.i for r in block], np.array([r.v for r in block]), k, q_type, query_id, id_col, i_type, vector_col, batch_rows, exclude_self, lists, [r.p for r in block] if lists else None)
            found = some if found is None else found.unionByName(some)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], f"{query_id} {q_type.simpleString()}, {id_col} {i_type}, score double")
    order = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(chunks: DataFrame, ids: list, vectors: np.ndarray, k: int, q_type, query_id: str, id_col: str, i_type: str, vector_col: str, batch_rows: int, exclude_self: bool, lists: tuple[str, str] | None = None, probes: list | None = None) -> DataFrame:  # noqa: ANN001
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    asked = None
    if probes is not None:
        asked = {one: np.array([n for n, p in enumerate(probes) if one in p]) for one in sorted({one for p in probes for one in p})}
        chunks = chunks.where(F.col(lists[1]).isin(list(asked)))
    sent = chunks.sparkSession.sparkContext.broadcast((ids, unit(vectors), asked))

    def best(frames):  # noqa: ANN001, ANN202
        qi, qv, probed = np.array(sent.value[0], dtype=object), sent.value[1], sent.value[2]
        kept_s, kept_i, empty = np.full((len(qi), k), -np.inf), np.empty((len(qi), k), dtype=object), True

        def add(which: object, vectors: np.ndarray, ci: np.ndarray) -> None:
            # the k best of a query by (rounded score, id), never more: equal vectors may be a million
            nonlocal empty
            if empty:
                kept_i[:], empty = ci[0], False  # an id that can be compared, where there is none yet
            scores, had = qv[which] @ vectors.T, kept_i[which]
            if exclude_self:
                scores = np.where(qi[which][:, None] == ci[None, :], -np.inf, scores)
            all_s = np.hstack([kept_s[which], scores])
            all_i = np.hstack([had, np.broadcast_to(ci, scores.shape)])
            score = np.round(all_s, 9)
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            place = np.zeros((1, 1), np.int64)
            if ((score >= kth).sum(axis=1) > k).any():
                ids = np.unique(np.concatenate([had.ravel(), ci]))
                place = np.hstack([np.searchsorted(ids, had.ravel()).reshape(had.shape), np.broadcast_to(np.searchsorted(ids, ci), scores.shape)])
            order = np.lexsort((np.broadcast_to(place, score.shape), -score), axis=1)[:, :k]
            kept_s[which], kept_i[which] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)

        for pdf in frames:
            for at in range(0, len(pdf), batch_rows):
                part = pdf.iloc[at : at + batch_rows]
                ci, vectors = part[id_col].to_numpy(dtype=object), unit(np.vstack(part[vector_col].to_numpy()).astype(float))
                if probed is None:
                    add(slice(None), vectors, ci)
                    continue
                own = part[lists[1]].to_numpy()
                for one in np.unique(own):
                    if one in probed:
                        rows = np.flatnonzero(own == one)
                        add(probed[one], vectors[rows], ci[rows])
        a, b = np.nonzero(np.isfinite(kept_s))
        if len(a):
            yield pd.DataFrame({query_id: qi[a], id_col: kept_i[a, b], "score": kept_s[a, b]})

    rows = chunks.select(id_col, vector_col, *(lists or ())[1:]).where(F.col(vector_col).isNotNull())
    return rows.mapInPandas(best, f"{query_id} {q_type.simpleString()}, {id_col} {i_type}, score double")


Stem = Callable[[Column], Column]


def index_words(text_col: str, language: str = SIMPLE) -> Column:
    """The list of what a text is found by: its different words, or their stems."""
    stems = stemmer(language)
    return lexemes(text_col) if stems is None else stems(lexemes(text_col))


def postings(chunks: DataFrame, text_col: str = "content", id_col: str = "chunk_id", stem: Stem | None = None, language: str = SIMPLE) -> DataFrame:
    """(term, id) of every distinct word: what a keyword index holds. Write it partitioned or bucketed by term to search it often.

    ``language``: whose stems and stop words count; that of the options of ``lexical_search`` must be the same. ``stem`` maps a column of words to stems of your own, and must be given to ``lexical_search`` too.
    """
    words = chunks.select(F.col(id_col), F.explode(index_words(text_col, language)).alias("term"))
    return words if stem is None else words.select(id_col, stem(F.col("term")).alias("term")).distinct()


def document_frequencies(index: DataFrame) -> DataFrame:
    """How many chunks have a term."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def matching(chunks: DataFrame, queries: DataFrame, o: RetrievalOptions, *, query_id: str = "query_id", text_col: str = "content", id_col: str = "chunk_id", stem: Stem | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, document frequencies) of the terms of a stated set of questions alone, for a corpus without an index: texts are cut into words once, no other word leaves the scan, and both come from one shuffle."""
    wanted = query_terms(queries, o, query_id, stem=stem).select("term").distinct()
    found = postings(chunks, text_col, id_col, stem, o.language).join(wanted, "term", "left_semi").select("term", id_col).repartition("term")
    return found, found.groupBy("term").agg(F.count(id_col).alias("df"))


def query_terms(queries: DataFrame, o: RetrievalOptions, query_id: str = "query_id", text_col: str = "question", stem: Stem | None = None) -> DataFrame:
    """(query, term): folded terms, distinct; stems without stop words, where the options name a language."""
    if (stems := stemmer(o.language)) is not None:
        folded = F.flatten(F.transform(terms(text_col, o.max_query_words), lambda t: F.split(fold_accents(t), "['’]")))
        return queries.select(query_id, F.explode(stems(F.filter(folded, lambda t: F.length(t) > 0))).alias("term")).distinct()
    words = queries.select(query_id, F.explode(terms(text_col, o.max_query_words)).alias("t")).select(query_id, F.explode(F.split(fold_accents("t"), "['’]")).alias("term")).where(F.length("term") > 0).distinct()
    return words if stem is None else words.select(query_id, stem(F.col("term")).alias("term")).distinct()


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5))."""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def lexical_search(queries: DataFrame, index: DataFrame, frequencies: DataFrame, n: int, o: RetrievalOptions, *, query_id: str = "query_id", id_col: str = "chunk_id", limit: int | None = None, stem: Stem | None = None) -> DataFrame:
    """The best chunks of each query by the summed idf of its distinct matching terms, then by id: query, id, score, rank from 1.

    In a corpus of ``common_from`` chunks or more, terms of more than ``common_share`` of them are left out; of the others the ``max_terms`` rarest count.
    """
    t = query_terms(queries, o, query_id, stem=stem).join(frequencies, "term")
    if n >= o.common_from:
        t = t.where(F.col("df") <= F.ceil(F.lit(o.common_share * n)))
    t = t.withColumn("idf", idf(F.lit(max(1, n)), F.col("df")))
    rare = Window.partitionBy(query_id).orderBy(F.col("idf").desc(), "term")
    t = t.withColumn("_n", F.row_number().over(rare)).where(F.col("_n") <= o.max_terms).select(query_id, "term", "idf")
    scored = index.join(t, "term")
    if "sign" in index.columns:  # postings that were added and taken away again cancel one another
        scored = scored.groupBy(query_id, id_col, "term").agg((F.first("idf") * F.sum("sign")).alias("idf")).where("idf <> 0")
    scored = scored.groupBy(query_id, id_col).agg(F.sum("idf").alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (limit or o.lexical_candidates))


def fuse(legs: DataFrame, k: int = 60, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of legs (query, id, ``leg`` number, ``weight``, ``rank`` from 1): ``fused`` is the sum of weight / (k + rank).

    Equal sums keep the order in which they are first seen: by leg, then by rank.
    """
    f = legs.groupBy(query_id, id_col).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("fused"), F.min(F.struct("leg", "rank")).alias("seen"))
    order = Window.partitionBy(query_id).orderBy(F.round("fused", 12).desc(), "seen")
    return f.withColumn("position", F.row_number().over(order)).drop("seen")


def relevance(fused: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Fused scores over the largest of their query."""
    return fused.withColumn("relevance", F.col("fused") / F.max("fused").over(Window.partitionBy(query_id)))


def best_of_legs(legs: DataFrame, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """Each candidate once, with its best score of all legs."""
    return legs.groupBy(query_id, id_col).agg(F.max("score").alias("score"))


def dedupe_order(hashes: list, vectors: list, threshold: float) -> list[int]:
    """Places that stay, in order: not one whose hash, or (threshold below 1) nearly whose vector, an earlier one that stays has."""
    kept: list[int] = []
    seen: set = set()
    for i, h in enumerate(hashes):
        if h is not None and h in seen:
            continue
        if threshold < 1 and vectors[i] is not None and any(vectors[j] is not None and float(np.dot(vectors[i], vectors[j])) >= threshold for j in kept):
            continue
        kept.append(i)
        if h is not None:
            seen.add(h)
    return kept


def mmr_order(scores: list[float], vectors: list, lam: float, k: int) -> list[int]:
    """Up to k places by maximal marginal relevance: lam * score - (1 - lam) * the largest product with one chosen before (0 at least); ties keep the order."""
    n = len(scores)
    if n <= 1 or k <= 1 or vectors[0] is None:
        return list(range(min(n, k)))
    chosen: list[int] = []
    nearest = [0.0] * n
    left = list(range(n))
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (lam * scores[i] - (1 - lam) * nearest[i], -i))
        chosen.append(best)
        left.remove(best)
        for i in left:
            if vectors[i] is not None and vectors[best] is not None:
                nearest[i] = max(nearest[i], float(np.dot(vectors[i], vectors[best])))
    return chosen


def select_diverse(hits: DataFrame, o: RetrievalOptions, *, query_id: str = "query_id", id_col: str = "chunk_id", score_col: str = "score") -> DataFrame:
    """De-duplication and MMR on each query's hits (position, content_hash, embedding): query, id, score, rank from 1."""
    q_type, i_type = hits.schema[query_id].dataType.simpleString(), hits.schema[id_col].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        vectors = [None if v is None else np.asarray(v, dtype="float64") for v in pdf["embedding"]]
        kept = dedupe_order(pdf["content_hash"].tolist(), vectors, o.dedupe_threshold)
        pdf, vectors = pdf.iloc[kept], [vectors[i] for i in kept]
        order = mmr_order(pdf[score_col].tolist(), vectors, o.mmr_lambda, o.top_k) if o.mmr else list(range(min(len(pdf), o.top_k)))
        pdf = pdf.iloc[order]
        return pd.DataFrame({query_id: pdf[query_id], id_col: pdf[id_col], "score": pdf[score_col].astype(float), "rank": range(1, len(pdf) + 1)})

    return hits.select(query_id, id_col, score_col, "position", "content_hash", "embedding").groupBy(query_id).applyInPandas(one, f"{query_id} {q_type}, {id_col} {i_type}, score double, rank int")


def rerank(hits: DataFrame, scored: Column, o: RetrievalOptions, query_id: str = "query_id") -> DataFrame:
    """The first ``rerank_candidates`` hits (2 at least) by new scores; a query with fewer than two hits, a missing score or no spread keeps its order.

    ``scored``: a column with the new score. Hits beyond the head are dropped.
    """
    w = Window.partitionBy(query_id)
    head = hits.where(F.col("position") <= max(2, o.rerank_candidates)).withColumn("_new", scored)
    ok = (F.count("*").over(w) >= 2) & (F.count("_new").over(w) == F.count("*").over(w)) & ((F.max("_new").over(w) - F.min("_new").over(w)) >= 1e-6)
    head = head.withColumn("_ok", ok)
    order = w.orderBy(F.when(F.col("_ok"), F.col("_new")).desc_nulls_last(), "position")
    return head.withColumns({"score": F.when(F.col("_ok"), F.col("_new")).otherwise(F.col("score")), "_position": F.row_number().over(order)}).drop("position", "_new", "_ok").withColumnRenamed("_position", "position")


def rerank_text(title: Column, passage: Column) -> Column:
    """What a reranker reads: the title, where there is one, and the passage below it."""
    return F.concat_ws("\n", F.when(F.length(F.trim(title)) > 0, title), passage)


def rated_scores(reply: Column, n: Column) -> Column:
    """Scores of 0 to 1 from a model's reply with whole numbers of 0 to 10, ``{"scores": [..]}`` or a plain list; null unless there are ``n`` of them."""
    found = F.coalesce(F.from_json(reply, "scores array<double>")["scores"], F.from_json(F.regexp_extract(reply, r"\[[^\]]*\]", 0), "array<double>"))
    return F.when(F.size(found) == n, F.transform(found, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(10.0)) / 10))


def with_documents(chunks: DataFrame, documents: DataFrame, key: list[str] | None = None, columns: tuple[str, ...] = ("title", "metadata")) -> DataFrame:
    """Chunks with columns of their document, ``document_`` before each; chunks without a document are left out."""
    k = key or ["source_key", "external_id"]
    return chunks.join(documents.select(*k, *[F.col(c).alias(f"document_{c}") for c in columns]), k)


def yes_probability(log_yes: Column, log_no: Column) -> Column:
    """The probability of yes against no from their log-probabilities; a missing one is -30; 0.5 if both are."""
    return 1 / (1 + F.exp(F.coalesce(log_no, F.lit(-30.0)) - F.coalesce(log_yes, F.lit(-30.0))))


def expand_neighbours(hits: DataFrame, chunks: DataFrame, reach: int, *, query_id: str = "query_id", id_col: str = "chunk_id", document: str = "document_id", per_first: float = 0.99) -> DataFrame:
    """Hits and the chunks within ``reach`` ordinals of one in its document. A neighbour scores 0.99 of the first hit of its document; by score, hits first."""
    h = hits.join(chunks.select(id_col, document, "ordinal"), id_col)
    first = h.groupBy(query_id, document).agg(F.min_by("score", "rank").alias("_first"))
    around = h.select(query_id, document, F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("ordinal")).distinct()
    near = around.join(chunks.select(id_col, document, "ordinal"), [document, "ordinal"]).join(hits.select(query_id, id_col), [query_id, id_col], "left_anti")
    near = near.join(first, [query_id, document]).select(query_id, id_col, (F.col("_first") * per_first).alias("score"), F.lit(True).alias("neighbour"), F.lit(1 << 30).alias("rank"))
    both = hits.select(query_id, id_col, F.col("score").cast("double").alias("score"), F.lit(False).alias("neighbour"), F.col("rank").cast("int").alias("rank")).unionByName(near)
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), "rank", id_col)
    return both.withColumn("position", F.row_number().over(order)).drop("rank")


def hybrid(queries: DataFrame, chunks: DataFrame, o: RetrievalOptions, *, index: DataFrame | None = None, frequencies: DataFrame | None = None, n: int | None = None, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """Candidates of vector and keyword search, fused: query, id, score (cosine to the question), fused, relevance, position.

    ``queries``: query_id, question, embedding, and optionally ``rewrite`` (0 for the question itself; rewrites weigh ``expansion_weight``).
    """
    q = queries if "rewrite" in queries.columns else queries.withColumn("rewrite", F.lit(0))
    q = q.withColumn("_leg", F.struct(query_id, "rewrite"))
    weight = F.when(F.col("rewrite") == 0, 1.0).otherwise(o.expansion_weight)
    share = 1 - o.lexical_weight if o.lexical else 1.0
    meta = q.select("_leg", query_id, "rewrite", weight.alias("w"))
    vec = knn_join(q.withColumn("_key", F.to_json("_leg")), chunks, o.fetch_k, query_id="_key", id_col=id_col)
    vec = vec.join(meta.withColumn("_key", F.to_json("_leg")), "_key").where((F.lit(o.min_score) <= 0) | (F.col("score") >= o.min_score))
    legs = vec.select(query_id, id_col, (F.col("rewrite") * 2).alias("leg"), (F.col("w") * share).alias("weight"), "rank")
    if o.lexical:
        index = index if index is not None else postings(chunks, id_col=id_col, language=o.language)
        frequencies = frequencies if frequencies is not None else document_frequencies(index)
        n = n if n is not None else chunks.count()
        lex = lexical_search(q.withColumn("_key", F.to_json("_leg")), index, frequencies, n, o, query_id="_key", id_col=id_col).join(meta.withColumn("_key", F.to_json("_leg")), "_key")
        legs = legs.unionByName(lex.select(query_id, id_col, (F.col("rewrite") * 2 + 1).alias("leg"), (F.col("w") * o.lexical_weight).alias("weight"), "rank"))
    f = relevance(fuse(legs, o.rrf_k, query_id, id_col).where(F.col("position") <= o.fetch_k), query_id)
    # hits of the keyword search alone are scored too, against the question and without a floor
    asked = q.where("rewrite = 0").select(query_id, F.col("embedding").alias("_q"))
    return f.join(asked, query_id).join(chunks, id_col).withColumn("score", cosine("embedding", "_q")).drop("_q")


def search(queries: DataFrame, chunks: DataFrame, o: RetrievalOptions, *, query_id: str = "query_id", id_col: str = "chunk_id", reranker: Callable[[DataFrame], DataFrame] | None = None, titles: DataFrame | None = None, document: str = "document_id", **index: object) -> DataFrame:
    """The pipeline: candidates, fusion, reranking, de-duplication, diversity, neighbours. Blank questions find nothing.

    ``reranker`` turns the candidates' head (the query, the id, ``question``, ``content``) into new scores: query, id, ``new_score``; pairs that it doesn't return have none. ``content`` is what it is to read: the title of
    the document (``titles``: document, title) and the part of the passage where the words of the question and its rewrites are.
    """
    asked = queries.where(F.length(F.trim("question")) > 0)
    hits = hybrid(asked, chunks, o, query_id=query_id, id_col=id_col, **index)
    hits = hits.withColumn("_by", F.col("relevance") if o.lexical or "rewrite" in queries.columns else F.col("score"))
    if reranker:
        ways = F.transform(F.array_sort(F.collect_list(F.struct("rewrite", "question"))), lambda x: x["question"])
        said = asked.groupBy(query_id).agg(ways.alias("_ways")) if "rewrite" in asked.columns else asked.select(query_id, F.array("question").alias("_ways"))
        head = hits.where(F.col("position") <= max(2, o.rerank_candidates)).join(said, query_id)
        if titles is not None:
            head = head.join(titles.select(document, F.col("title").alias("_title")), document, "left")
        read = rerank_text(F.col("_title") if titles is not None else F.lit(None).cast("string"), excerpt("content", F.array_join("_ways", " "), o.rerank_chars))
        head = head.withColumns({"question": F.col("_ways")[0], "content": read})
        hits = hits.join(reranker(head.select(query_id, id_col, "question", "content")).select(query_id, id_col, "new_score"), [query_id, id_col], "left")
        hits = rerank(hits.withColumn("score", F.col("_by")), F.col("new_score"), o, query_id).withColumn("_by", F.col("score"))
    best = select_diverse(hits, o, query_id=query_id, id_col=id_col, score_col="_by")
    return expand_neighbours(best, chunks, o.neighbours, query_id=query_id, id_col=id_col) if o.neighbours else best

r"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text is a set of five-word shingles with weights tf * idf. Document frequencies come from a count sketch of fixed size over all
documents, so what is sent to workers doesn't grow with the corpus; idf is damped to [0.9, 1], or the common text of a large group of
near copies would weigh so little that its members fall apart. Consistent weighted sampling draws SAMPLES (shingle, level) pairs of each text;
two texts agree in one draw with the probability of their weighted Jaccard similarity. ROWS draws make a band, and texts that share a
band are candidates: BANDS = 12 of 2 draws find a pair of similarity 0.8 with probability 1 - 0.36^12 > 0.99999.

Exact copies are one text from the start. In each bucket of a band every text is compared with one pivot (the smallest key), not with all
others, so a bucket costs as many comparisons as it has members, whatever its size; and pivots are the same across bands, so few pairs
are new. Similarity is then verified on whole texts, and connected components of the verified links are the classes.

A member that isn't in its pivot's class is open. The weighted Jaccard distance is a metric, so only members x with d(pivot, x) >= d(pivot, f) - 0.2 can be near an
open member f: these are the rest, and all links in it are found, by prefix filtering: with the shingles of every text in one order, rarest first, two texts of
similarity 0.8 share a shingle among the first of each, up to where what follows weighs too little for the overlap that they need. Shingles of a template that a large group shares come
last, so members that only the template makes alike share no prefix, and a large group of them costs what its texts cost and not its pairs. Texts that share a shingle are first
compared with the one of them that has the least of its own, which joins the members of a large class, and then all pairs that are still of two classes are. Nothing depends on a bucket's size.

Plan: texts are shuffled to the pairs that need them alone, every result that is used twice is written to the shared folder, and links of the rest join classes, not texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, loose, read, small_batches, text_of

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 12, 2
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 12
#: Bytes of text, and shingles, that are worked on at once, about.
GROUP_BYTES, GROUP_SHINGLES = 1 << 18, 40_000
#: Rounds in which texts that share a shingle are compared with one of them, another each time, before all pairs that are still of two classes are.
PIVOT_ROUNDS = 3
IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
Sets = tuple[np.ndarray, np.ndarray, np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * M3)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts (``data``, of which text i ends at ``ends[i]``) and the number of words before each end."""
    inside = IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = ends[:-1][ends[:-1] < len(data)]
    begins[borders] = inside[borders]
    starts = np.flatnonzero(begins)
    codes = BYTE_CODES[data[inside]]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    first = (np.cumsum(inside) - 1)[starts]  # of each word, among the bytes of words
    sizes = np.diff(first, append=len(codes))
    # a polynomial in an odd constant, modulo 2^64
    powers = np.full(int(sizes.max()), M2)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    codes *= powers[np.arange(len(codes)) - np.repeat(first, sizes)]
    return mix(np.add.reduceat(codes, first) + sizes.astype(np.uint64)), np.searchsorted(starts, ends)


def _window(w: np.ndarray, size: int) -> np.ndarray:
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = h * M3 + w[i : i + n]
    return mix(h)


def _group_sets(texts: pa.Array) -> Sets:
    low = pc.utf8_lower(texts)
    at = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    words, ends = word_hashes(data, (at[1:] - at[0]).astype(np.int64))
    n_words = np.diff(ends, prepend=0)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    stop = np.cumsum(n)
    start = stop - n
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    if len(words) >= SHINGLE:
        long = np.flatnonzero(n_words >= SHINGLE)
        of = np.repeat(long, n[long])
        k = np.arange(len(of)) - np.repeat(np.cumsum(n[long]) - n[long], n[long])
        out[start[of] + k] = _window(words, SHINGLE)[(ends - n_words)[of] + k]
    for i in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)).tolist():
        out[start[i]] = _window(words[ends[i] - n_words[i] : ends[i]], int(n_words[i]))[0]
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[start[n > 0]] = True
    kept = np.flatnonzero(new)
    return out[kept], np.diff(kept, append=len(out)), np.searchsorted(kept, stop)


def shingle_sets(texts: pa.Array) -> Iterator[Sets]:
    """Of groups of texts, in order: all distinct shingle hashes, sorted in each text, their counts, and where each text ends among them.

    Words are lower-cased runs of letters, digits and non-ASCII characters. A text of fewer than five words, but some, is one shingle; one without words has none.
    """
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
    at, size = 0, 0
    for i, k in enumerate(sizes.tolist()):
        if i > at and size + k > GROUP_BYTES:
            yield _group_sets(texts.slice(at, i - at))
            at, size = i, 0
        size += k
    if at < len(texts):
        yield _group_sets(texts.slice(at))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text, sorted, and their counts."""
    return _group_sets(pa.array([text]))[:2]


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """The sketch of how many rows hold a shingle of each slot, and the number of rows. Its size is fixed: 2^SKETCH_BITS counts.

    Each task adds up a sketch of its own and hands over its blocks; blocks of one number are summed together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << SKETCH_BITS, np.uint32), 0
        for b in batches:
            for h, _, _ in shingle_sets(b.column(0)):
                np.add.at(total, _slot(h), 1)
            rows += b.num_rows
        if rows:
            blocks = total.reshape(-1, SKETCH_BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_pydict({"block": pa.array([-1, *used.tolist()], pa.int32()), "counts": pa.array([np.array([rows], np.uint64).tobytes(), *[blocks[i].astype(np.uint64).tobytes() for i in used]], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = np.frombuffer(c.as_py(), np.uint64)
                sums[i] = sums[i] + c if i in sums else c
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})

    parts = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "block int, counts binary")
    # few tasks: there are at most 2^SKETCH_BITS / SKETCH_BLOCK + 1 different blocks, and each task of this stage keeps one sum for each of its own
    summed = parts.repartition(16, "block").mapInArrow(add, "block int, counts binary")
    sketch, n = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.uint64), 0
    for r in summed.collect():  # as many rows as the sketch has blocks
        if r.block < 0:
            n = int(np.frombuffer(r.counts, np.uint64)[0])
        else:
            sketch[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(r.counts, np.uint64)
    return sketch, n


def idf_table(sketch: np.ndarray, n: int) -> np.ndarray:
    """Damped inverse document frequency of each slot: 0.9 + 0.1 * ln(1 + n / df) / ln(1 + n)."""
    if not n:
        return np.ones(len(sketch), np.float32)
    return (0.9 + 0.1 * np.log1p(n / np.maximum(sketch, 1)) / np.log1p(n)).astype(np.float32)


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their tf * idf weights."""
    h, tf = shingles(text)
    return h, tf.astype(np.float32) * idf[_slot(h)]


def weighted_sets(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``weighted`` of each of some texts."""
    for h, tf, ends in shingle_sets(texts):
        w, at = tf.astype(np.float32) * idf[_slot(h)], 0
        for end in ends.tolist():
            yield h[at:end], w[at:end]
            at = end


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of smaller weights over the sum of larger ones; 0 if either text has no words."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    low = float(np.minimum(x, y).sum())
    return low / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - low)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes of non-empty weighted sets, one row each, by improved consistent weighted sampling.

    For each draw and shingle: r, c ~ Gamma(2, 1) and b ~ U(0, 1), all from a hash of both; t = floor(ln(weight) / r + b), and the shingle with
    the smallest ln c - r * (t - b) - r is drawn, at level t.
    """
    sizes = np.array([len(h) for h, _ in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h, log_w = np.concatenate([h for h, _ in sets]), np.log(np.concatenate([w for _, w in sets]))
    owner = np.repeat(np.arange(len(sets)), sizes)
    unit, low24 = np.float32(2.0**-24), np.uint64(0xFFFFFF)
    new = np.ones(1, bool)
    out = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands * rows):
        x = mix(h ^ np.uint64((k + 1) * int(M3) & (1 << 64) - 1))
        y = x * M1
        y ^= y >> np.uint64(29)
        half = np.float32(0.5)
        u = ((x & low24).astype(np.float32) + half) * unit
        u *= ((x >> np.uint64(24) & low24).astype(np.float32) + half) * unit
        r = -np.log(u)
        v = ((y >> np.uint64(40)).astype(np.float32) + half) * unit
        v *= ((y >> np.uint64(16) & low24).astype(np.float32) + half) * unit
        b = (x >> np.uint64(48)).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_w / r + b)
        score = np.log(-np.log(v)) - r * (t - b) - r
        best = np.minimum.reduceat(score, starts)
        at = np.flatnonzero(score == best[owner])
        of = owner[at]
        at = at[np.concatenate([new, of[1:] != of[:-1]])]  # of equal scores the first
        draw = mix(h[at] + (t[at].astype(np.int64).astype(np.uint64) + np.uint64(k + 1)) * M2)
        out[:, k // rows] = mix(out[:, k // rows] + draw)
    return out


def text_key(text_col: str) -> Column:
    """128 bits for a text, so that exact copies are one."""
    return F.unhex(F.md5(text_of(text_col)))


def sign(docs: DataFrame, id_col: str, text_col: str, idf) -> DataFrame:  # noqa: ANN001
    """``id``, ``key`` and ``bands`` (empty for a text without words) of every row; equal texts of a batch are sampled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for b in batches:
            keys = b.column(1).to_pylist()
            first = {k: i for i, k in reversed([*enumerate(keys)])}
            found: dict[bytes, np.ndarray] = {}
            group: list[tuple[bytes, tuple[np.ndarray, np.ndarray]]] = []
            size = 0
            for k, s in (*zip(first, weighted_sets(b.column(2).take(pa.array([*first.values()], pa.int64())), table), strict=True), (None, ((), ()))):
                if k is not None and len(s[0]):
                    group.append((k, s))
                    size += len(s[0])
                if group and (size > GROUP_SHINGLES or k is None):
                    found |= dict(zip([g[0] for g in group], signatures([g[1] for g in group]), strict=True))
                    group, size = [], 0
            bands = [found[k].astype(np.int64) if k in found else np.zeros(0, np.int64) for k in keys]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))], names=["id", "key", "bands"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text_col).alias("key"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, key binary, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:  # noqa: ANN001
    """``d``, the distance 1 - weighted Jaccard, of each pair ``a``, ``b`` of keys, of which ``a`` repeats; other columns are kept."""
    t = lambda name: texts.select(F.col("key").alias(name), F.col("text").alias(f"text_{name}"))
    more = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.join(t("b"), "b").join(t("a"), "a").select("a", "b", *more, "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = idf.value, (None, None)
        for batch in batches:
            out = []
            for a, text_a, y in zip(batch.column(0).to_pylist(), batch.column(len(more) + 2), weighted_sets(batch.column(len(more) + 3), table), strict=True):
                if last[0] != a:
                    last = (a, weighted(text_a.as_py(), table))
                out.append(1.0 - similarity(last[1], y))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(more) + 2], pa.array(out, pa.float64())], names=["a", "b", *more, "d"])

    return both.mapInArrow(run, ", ".join(f"{c} binary" for c in ("a", "b", *more)) + ", d double")


def components(links: DataFrame) -> DataFrame:
    """``key`` and ``root`` (the smallest key of its component) of every key in ``links`` (a, b), but of roots.

    Each key is a child of smaller ones. In a round a child keeps its smallest parent, its other parents become children of that one, and a parent that is
    a child itself is replaced by its own parent. A root that a third of all keys have is a parent only, never a key that rows are grouped by.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().hint("rebalance"), "edges")
    while True:
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"))
        other = edges.join(low.where("m <> top").select("u", "m").hint("rebalance"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("hooked"))
        flat = low.select("u", F.col("m").alias("v"), F.lit(False).alias("hooked")).unionByName(other)
        up = low.select(F.col("u").alias("v"), F.col("m").alias("above")).hint("rebalance")
        moved = flat.join(up, "v", "left").select("u", F.coalesce("above", "v").alias("v"), (F.col("hooked") | F.col("above").isNotNull()).alias("moved"))
        edges = cut(moved.groupBy("u", "v").agg(F.max("moved").alias("moved")).hint("rebalance"), "edges")
        if not edges.agg(F.max("moved")).first()[0]:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))


def prefixes(texts: DataFrame, idf, threshold: float) -> DataFrame:  # noqa: ANN001
    """From rows with a ``key`` and a ``text``: ``key``, ``shingle``, ``weight`` (of the text), ``left`` (from this shingle on) and ``first`` of the shingles of its prefix.

    Shingles are in the order of their document frequency, rarest first. Two texts of similarity t or more overlap by t of the heavier one's weight at least, and by 2t / (1 + t) of
    the lighter one's; so the first shingle that they share is one with at least that much left, in both: ``first`` says that it is so for the lighter one.
    """
    share = 2 * threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, parts, size = idf.value, [], 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*[x[1:] for x in parts], strict=True)]
            keys = pa.array([k for k, h, *_ in parts for _ in range(len(h))], pa.binary())
            parts.clear()
            return pa.RecordBatch.from_arrays([keys, *map(pa.array, columns)], names=["key", "shingle", "weight", "left", "first"])

        for b in batches:
            for key, (h, w) in zip(b.column(0).to_pylist(), weighted_sets(b.column(1), table), strict=True):
                if len(h):
                    order = np.lexsort((h, -table[_slot(h)]))
                    left = np.cumsum(w[order][::-1].astype(np.float64))[::-1]
                    n = int(np.searchsorted(-left, -(threshold * left[0] - 1e-6), side="right"))
                    parts.append((key, h[order[:n]].astype(np.int64), np.full(n, left[0]), left[:n], left[:n] >= share * left[0] - 1e-6))
                    size += n
                    if size >= GROUP_SHINGLES:
                        yield out()
                        size = 0
        if parts:
            yield out()

    return texts.select("key", "text").mapInArrow(run, "key binary, shingle long, weight double, left double, first boolean")


def find_classes(signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, idf, threshold: float) -> DataFrame:  # noqa: ANN001
    """``key`` and ``root`` (the smallest key of its class) of the keys that links join, but of roots."""
    limit = 1 - threshold + 1e-9
    first = signed.where(F.size("bands") > 0).groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    spread = first.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("bucket"))
    pivots = spread.groupBy("bucket").agg(F.min("key").alias("pivot"), F.max("key").alias("top")).where("pivot <> top").drop("top")
    members = cut(spread.join(loose(pivots), "bucket"), "members")
    # the text of one row for each key that is in a bucket with another; copies aren't read, as the id must fit too
    needed = first.join(members.select("key").distinct(), "key", "left_semi").select("key", F.col("id").alias("first_id"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text_col).alias("row_key"), text_of(text_col).alias("text"))
    texts = cut(rows.join(needed, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("row_key") == F.col("key"))).select("key", "id", "text").dropDuplicates(["id", "key"]).drop("id"), "texts")
    pairs = members.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    known = cut(verify(pairs, texts, idf), "verified")
    roots = components(known.where(F.col("d") <= limit))
    # what isn't in the class of its pivot yet, and what can be near it
    up = loose(roots)
    m = members.where("key <> pivot").join(known.select(F.col("a").alias("pivot"), F.col("b").alias("key"), "d"), ["pivot", "key"])
    m = m.join(up, "key", "left").join(up.select(F.col("key").alias("pivot"), F.col("root").alias("pivot_root")), "pivot", "left")
    m = m.withColumn("root", F.coalesce("root", "key")).withColumn("apart", F.col("root") != F.coalesce("pivot_root", "pivot"))
    m = cut(m.select("bucket", "key", "root", "d", "apart"), "rest")
    open_ = m.groupBy("bucket").agg(F.min(F.when(F.col("apart"), F.col("d"))).alias("low")).where("low IS NOT NULL")
    rest = m.join(loose(open_), "bucket").where(F.col("apart") | (F.col("d") >= F.col("low") - limit))
    rest = cut(rest.groupBy("key").agg(F.first("root").alias("root"), F.max("apart").alias("apart")), "rest")
    p = cut(prefixes(texts.join(rest.select("key"), "key", "left_semi"), idf, threshold).join(rest, "key"), "prefixes")
    for last in (*[False] * PIVOT_ROUNDS, True):
        # shingles whose texts are in several classes; the pivot is the text with the least of its own before the shingle
        several = p.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct((F.col("left") / F.col("weight")).alias("share"), "key", "root", "weight", "left")).alias("top")).where("low <> high")
        p = cut(p.join(loose(several.select("shingle", "top")), "shingle"), "prefixes")
        near = all_pairs(p, threshold) if last else p.select("key", "root", "weight", "left", *[F.col(f"top.{c}").alias(f"{c}2") for c in ("key", "root", "weight", "left")]).where(may_link(threshold))
        ordered = lambda c: [F.when(F.col("key") < F.col("key2"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in ((c, f"{c}2", "a" if c == "key" else "root_a"), (f"{c}2", c, "b" if c == "key" else "root_b"))]
        more = near.select(*ordered("key"), *ordered("root")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = cut(verify(more, texts, idf), "verified")
        known = known.select("a", "b", "d").unionByName(found.select("a", "b", "d"))
        # links between classes: the classes of a class are few, and their rounds short
        joined = components(found.where(F.col("d") <= limit).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        over = joined.select(F.col("key").alias("root"), F.col("root").alias("new"))
        relabel = lambda df: df.join(loose(over), "root", "left").withColumn("root", F.coalesce("new", "root")).select(*df.columns)
        roots = cut(relabel(roots).unionByName(joined.select("key", "root")), "roots")
        # the pivot has been compared with all of its group
        p = relabel(p.where("key <> top.key").select("key", "shingle", "weight", "left", "first", "root", "apart"))
    return roots


def may_link(threshold: float) -> Column:
    """Texts of two classes whose weights allow the threshold, if the shingle is the first that they share."""
    light, heavy = F.least("weight", "weight2"), F.greatest("weight", "weight2")
    return (F.col("root") != F.col("root2")) & (light >= threshold * heavy - 1e-6) & (F.least("left", "left2") >= threshold / (1 + threshold) * (light + heavy) - 1e-5)


def all_pairs(p: DataFrame, threshold: float) -> DataFrame:
    """Pairs of rows of ``prefixes`` that share a shingle and may link; one text of a pair is apart from a pivot of its bucket, and the lighter one's shingle is ``first``."""

    def meet(one: DataFrame, two: DataFrame) -> DataFrame:
        columns = ("key", "root", "weight", "left")
        other = two.select("shingle", *[F.col(c).alias(f"{c}2") for c in columns])
        return one.select("shingle", *columns).join(other, "shingle").where(may_link(threshold) & (F.col("weight") <= F.col("weight2"))).select("key", "root", "key2", "root2")

    return meet(p.where("first AND apart"), p).unionByName(meet(p.where("first"), p.where("apart")))


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``key``, ``class_id`` (the smallest id of its class) and ``n_class`` (rows in it).

    Rows are in one class if their texts are equal or joined by a chain of pairs of weighted Jaccard similarity of ``threshold`` or more. Texts
    without words (null, empty) are near nothing, but copies of one another; each of these rows is a class of its own. A null id is ignored for the
    smallest, and is the class id only where all ids of the class are null. Rows that repeat are each returned.
    """
    spark = docs.sparkSession
    sketch, n = document_frequencies(docs, text_col)
    idf = spark.sparkContext.broadcast(idf_table(sketch, n))
    signed = cut(sign(docs, id_col, text_col, idf), "signed")
    roots = find_classes(signed, docs, id_col, text_col, idf, threshold)
    worded = signed.where(F.size("bands") > 0).select("id", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = worded.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n_class"))
    out = worded.join(loose(classes), "root").select(F.col("id").alias("doc_id"), "key", "class_id", "n_class")
    return out.unionByName(signed.where(F.size("bands") == 0).select(F.col("id").alias("doc_id"), "key", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_class")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their class: those of the smallest id, and one row only where a row repeats."""
    c = classify(docs, id_col=id_col, text_col=text_col, threshold=threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    c = c.select(F.col("doc_id").alias("__kept_id"), F.col("key").alias("__kept_key")).distinct()
    d = docs.withColumn("__row_key", text_key(text_col))
    return d.join(c, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__kept_id")) & (F.col("__row_key") == F.col("__kept_key")), "left_semi").dropDuplicates([id_col, "__row_key"]).drop("__row_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classify(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_class")

"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of words of benchmark items. A text is searched from left to right with blocks of two words: the shift table
says how far the search may jump, because no pattern has that block nearer to its end; where it says zero, the bucket of patterns
that end with the block is opened (a bucket of several is divided by first blocks) and each of its test strings is compared directly
with the text. A jump is nine words for most blocks of a clean text, so the search looks at a ninth of the words. Windows of
different lengths have tables of their own.

Workers get the benchmark's words and build the tables themselves, where a pattern is an offset into one list of words. Their size
follows the benchmark, so it is measured first: items are cut into pieces of bounded length that overlap by a window less one word,
and what would take more than ``max_bytes`` in a worker is dealt by hash into shards of about that size, through which texts pass
one after another.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, drop_columns, read, small_batches

NGRAM = 10
#: What the tables of one shard may take in a worker.
MAX_BYTES = 512 << 20
#: What a word of the benchmark takes there besides its bytes: an entry of a table or two, its places, its share of a bucket.
WORD_BYTES = 400
PIECE_WORDS = 4096
#: A-Z become a-z, other ASCII than letters and digits becomes a space; bytes of other characters are parts of words.
FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
RANGES, ITEMS = "__hit_ranges", "__hit_items"
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters; none for null."""
    return text.encode("utf-8").translate(FOLD).split() if text else []


class WordTables:
    """Shift table and suffix buckets for patterns of one length in words.

    ``table`` maps a block to its shift if that is above zero, to ``-1 - pattern`` if one pattern ends with it, else to a dict from first
    blocks to patterns. Pattern p is ``flat[at[p] : at[p] + length]``; ``items[p]`` is where it stands, and ``more[p]`` where it stands too.
    """

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.table: dict[bytes, int | dict[bytes, list[int]]] = {}
        self.flat: list[bytes] = []
        self.at, self.items = array("q"), array("q")
        self.more: dict[int, set[int]] = {}

    def add(self, words: list[bytes], item: int, seen: dict[int, int]) -> None:
        """All windows of a piece; ``seen`` finds the pattern that an earlier one made (two windows of one hash are two patterns)."""
        base, length, block, table = len(self.flat), self.length, self.block, self.table
        self.flat += words
        # what blocks of the first window may jump; those of any other stand nearer to an end in the window before
        for end in range(block, length):
            key = b" ".join(words[end - block : end])
            jump = table.get(key, self.default)
            if type(jump) is int and jump > length - end:
                table[key] = length - end
        for i in range(len(words) - length + 1):
            window = b" ".join(words[i : i + length])
            known = seen.setdefault(hash(window), len(self.at))
            if known < len(self.at) and self.flat[self.at[known] : self.at[known] + length] == words[i : i + length]:
                if self.items[known] != item:
                    self.more.setdefault(known, set()).add(item)
                continue
            self._put(words[i : i + length], len(self.at))
            self.at.append(base + i)
            self.items.append(item)

    def _put(self, window: list[bytes], pattern: int) -> None:
        key = b" ".join(window[-self.block :])
        held = self.table.get(key, 1)
        if type(held) is int and held > 0:
            self.table[key] = -1 - pattern
            return
        if type(held) is int:
            start = self.at[-1 - held]
            held = self.table[key] = {b" ".join(self.flat[start : start + self.block]): [-1 - held]}
        held.setdefault(b" ".join(window[: self.block]), []).append(pattern)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence, from left to right."""
        get, default, length, pair, flat, places = self.table.get, self.default, self.length, self.block == 2, self.flat, self.at
        at, n = length, len(words)
        while at <= n:
            held = get(words[at - 2] + b" " + words[at - 1] if pair else words[at - 1], default)
            if type(held) is int:
                if held > 0:
                    at += held
                    continue
                patterns: Iterable[int] = (-1 - held,)
            else:
                start = at - length
                patterns = held.get(words[start] + b" " + words[start + 1] if pair else words[start], ())
            for p in patterns:
                start, place = at - length, places[p]
                if words[start] == flat[place] and words[start:at] == flat[place : place + length]:
                    yield start, p
            at += 1


class Tables:
    """The tables of all window lengths for (item id, words) pieces; an item whose id is null is searched for and not named."""

    def __init__(self, pieces: Iterable[tuple[str | None, list[bytes]]], ngram: int = NGRAM):
        self.names: list[str | None] = []
        self.by_length: dict[int, WordTables] = {}
        number: dict[str | None, int] = {}
        one: dict[bytes, bytes] = {}
        seen: dict[int, dict[int, int]] = {}
        for item, words in pieces:
            if not words:
                continue
            if item not in number:
                number[item] = len(self.names)
                self.names.append(item)
            length = min(ngram, len(words))
            tables = self.by_length.setdefault(length, WordTables(length))
            tables.add([one.setdefault(w, w) for w in words], number[item], seen.setdefault(length, {}))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Word ranges [start, end) flattened, as found, and the items that occur."""
        ranges: list[int] = []
        found: set[int] = set()
        for _, t in sorted(self.by_length.items()):
            for start, pattern in t.search(words):
                if ranges and ranges[-2] <= start <= ranges[-1]:
                    ranges[-1] = max(ranges[-1], start + t.length)
                else:
                    ranges += (start, start + t.length)
                found.add(t.items[pattern])
                found.update(t.more.get(pattern, ()))
        return ranges, {self.names[i] for i in found} - {None}


#: The tables that this worker built last, by the number of the broadcast.
_BUILT: dict[str, Tables] = {}


def tables_of(shared: Broadcast, key: str, ngram: int) -> Tables:
    """The tables of a shard, built once in a worker; those of the shard before are let go."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Tables(((item, words.split()) for item, words in shared.value), ngram)
    return _BUILT[key]


def covered(ranges: list[int]) -> int:
    """Words in the union of ranges."""
    total = last = 0
    for start, end in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        total += max(0, end - max(start, last))
        last = max(last, end)
    return total


def pieces_of(benchmark: DataFrame, item_col: str, text_col: str, ngram: int) -> DataFrame:
    """``item`` and ``words``: the folded words of items, in pieces of at most ``PIECE_WORDS`` new ones that overlap by ``ngram`` less one. Pieces that repeat are one."""
    step = max(PIECE_WORDS, ngram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str | None, bytes]] = []
            for item, text in zip(b.column(0), b.column(1), strict=True):
                words = words_of(text.as_py())
                # windows of a longer item have all ``ngram`` words, so no piece of it may be shorter
                if words:
                    out += [(item.as_py(), b" ".join(words[i : i + step + ngram - 1])) for i in range(0, max(1, len(words) - ngram + 1), step)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([w for _, w in out], pa.binary())], names=["item", "words"])

    named = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    return named.mapInArrow(run, "item string, words binary").distinct()


def _pass(df: DataFrame, text_col: str, pieces: list[tuple[str | None, bytes]], ngram: int, last: bool, clean_only: bool, keep_text: bool) -> DataFrame:
    """Search for one shard of the patterns; the last pass turns the columns ``RANGES`` and ``ITEMS`` into the result columns."""
    shared, key = df.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex
    names = df.columns
    carried = [c for c in names if c not in (RANGES, ITEMS) and (keep_text or c != text_col)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if not last or f.name in carried)
    if last:
        schema += ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(shared, key, ngram)
        for b in batches:
            col = dict(zip(names, b.columns, strict=True))
            n, ranges, items = [], col[RANGES].to_pylist(), col[ITEMS].to_pylist()
            for i, text in enumerate(col[text_col]):
                words = words_of(text.as_py())
                n.append(len(words))
                more, found = tables.scan(words)
                if more:
                    ranges[i], items[i] = (ranges[i] or []) + more, sorted({*(items[i] or []), *found})
            if not last:
                col |= {RANGES: pa.array(ranges, pa.list_(pa.int32())), ITEMS: pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([col[c] for c in names], names=names)
                continue
            n_hit = pa.array([covered(r) if r else 0 for r in ranges], pa.int64())
            out = {c: col[c] for c in carried} | {
                "n_words": pa.array(n, pa.int64()), "n_hit": n_hit, "n_items": pa.array([len(x or ()) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x or ()).encode()).hexdigest() for x in items], pa.string()), "contaminated": pc.greater(n_hit, 0),
            }
            b = pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
            yield b.filter(pc.equal(n_hit, 0)) if clean_only else b

    return df.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, clean_only: bool = False, keep_text: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``; ``clean_only``: without
    the rows that are hit; ``keep_text=False``: without the text, which then never returns from the workers.

    Null or empty texts have no words and are clean. Item rows that repeat count once; an item row whose id is null hits texts too, but
    has no id that ``n_items`` and ``items_sha256`` could name. An empty benchmark hits nothing. Input columns named like a result are replaced.
    """
    pieces = cut(pieces_of(benchmark, item_col, item_text_col, ngram), "benchmark")
    size = pieces.agg(F.sum(F.octet_length("words") + WORD_BYTES * F.size(F.split(F.col("words").cast("string"), " ")))).first()[0] or 0
    shards = max(1, -(-size // max_bytes))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)))
    d = drop_columns(docs, *RESULTS).withColumns({RANGES: F.lit(None).cast("array<int>"), ITEMS: F.lit(None).cast("array<string>")})
    for k in range(shards):
        shard = [(r.item, bytes(r.words)) for r in pieces.where(F.col("shard") == k).select("item", "words").toLocalIterator()]
        d = _pass(d, text_col, shard, ngram, k + 1 == shards, clean_only, keep_text)
        if k + 1 < shards:
            d = cut(d, "decontaminate")  # or the tables of all shards would be in memory together
    return d


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep_text=False).select("doc_id", *RESULTS)


def oracle_sql() -> str:
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
b AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item, least(len(w), {NGRAM}) AS n, array_to_string(w[i : i + least(len(w), {NGRAM}) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {NGRAM}) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT rid, x.n, i, item FROM x JOIN p ON x.n = p.n AND x.s = p.s),
k AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
t AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON d.rid = k.rid LEFT JOIN t ON d.rid = t.rid"""

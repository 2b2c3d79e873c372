"""Sentences and overlapping chunks of documents.

A window's extent depends on the tokens of the sentences in it, so documents are streams: their segments are dealt by document and sorted by position within a partition (a sort that spills), and pass a generator
that holds one window and one batch of results, whatever the length of a document; batches of Arrow rows end anywhere in a document. All else about a chunk (header, hash, tokens) is made of columns after it. Offsets
are characters of the normalised segments joined by line feeds. Segments of one position are in the order of their texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.config import ChunkingOptions
from lodeweave.functions.text import normalize_py, position_label, token_estimate, token_estimate_py

#: Fixed value: a text that ends with one of these doesn't run on across a page break.
TERMINATORS = ".!?…:;»\"')]"


@dataclass(frozen=True)
class Sentence:
    position: int
    position_end: int
    text: str
    start: int
    end: int
    tokens: int


def hard_split(text: str, limit: int) -> Iterator[tuple[str, int]]:
    """(piece, offset) of at most ``limit`` characters, cut at the last space where there is one."""
    at = 0
    while limit > 0 and len(text) - at > limit:
        space = text.rfind(" ", at, at + limit)
        to = space if space > at else at + limit
        yield text[at:to], at
        at = to
        while at < len(text) and text[at] == " ":
            at += 1
    if at < len(text) or at == 0:
        yield text[at:], at


def sentences(segments: Iterable[tuple[int, str]], o: ChunkingOptions) -> Iterator[Sentence]:
    """Sentences of (position, text) segments in order. One that a page break cuts is joined again if bridging is on."""
    splitter, offset, held = re.compile(o.sentence_regex), 0, None
    for position, raw in segments:
        text = normalize_py(raw or "", o.normalizers)
        if not text:
            continue
        cuts = [0, *(x for m in splitter.finditer(text) for x in m.span()), len(text)]
        for begin, end in zip(cuts[::2], cuts[1::2], strict=True):
            for part, at in hard_split(text[begin:end], o.hard_split_chars):
                if not (words := part.strip()):
                    continue
                start = offset + begin + at
                s = Sentence(position, position, words, start, start + len(words), token_estimate_py(words, o.chars_per_token))
                if held and held.position_end != position and o.bridge_segments and held.text[-1] not in TERMINATORS and re.match(r"[0-9]|[^\W\d_]", s.text) and (s.text[0].isdigit() or s.text[0].islower()):
                    both = f"{held.text} {s.text}"
                    held = Sentence(held.position, position, both, held.start, s.end, token_estimate_py(both, o.chars_per_token))
                    continue
                if held:
                    yield held
                held = s
        offset += len(text) + 1
    if held:
        yield held


def windows(found: Iterable[Sentence], o: ChunkingOptions) -> Iterator[list[Sentence]]:
    """Runs of sentences: until the target is reached or the next would pass the maximum; the next run begins ``overlap_tokens`` before the end of this one."""
    source, ready = iter(found), deque[Sentence]()
    ended = False

    def more() -> bool:
        nonlocal ended
        if not ended:
            s = next(source, None)
            ended = s is None
            if s is not None:
                ready.append(s)
        return not ended

    while ready or more():
        if ready[0].tokens > o.max_tokens:
            yield [ready.popleft()]
            continue
        run, total = [], 0
        while total < o.target_tokens and (len(run) < len(ready) or more()):
            s = ready[len(run)]
            if run and total + s.tokens > o.max_tokens:
                break
            run.append(s)
            total += s.tokens
        yield run
        if len(run) == len(ready) and not more():
            return
        keep, back = len(run), 0
        while keep > 1 and back < o.overlap_tokens:
            keep -= 1
            back += run[keep].tokens
        for _ in range(keep):
            ready.popleft()


def chunk_windows(found: Iterable[Sentence], o: ChunkingOptions) -> Iterator[list[Sentence]]:
    """``windows``, where a last one of fewer than ``min_tokens`` is merged into the one before."""
    last: list[Sentence] | None = None
    before: list[Sentence] | None = None
    for w in windows(found, o):
        if before is not None:
            yield before
        before, last = last, w
    if before is not None and last is not None and sum(s.tokens for s in last) < o.min_tokens:
        yield before + [s for s in last if s.start > before[-1].start]
        return
    yield from (w for w in (before, last) if w is not None)


SENTENCES = "source_key string, external_id string, ordinal int, position int, position_end int, text string, char_start int, char_end int, tokens int"
DRAFTS = "source_key string, external_id string, ordinal int, text string, position_start int, position_end int, char_start int, char_end int"


#: Rows of one batch that the generators return.
OUT_ROWS = 1024


def per_document(segments: DataFrame, one: Callable[[Iterator[tuple[int, str]]], Iterator[tuple]], schema: str, dealt: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """What ``one`` yields for the (position, text) segments of each document, in order, with the document's key before it; ``one`` needn't read them all.

    ``dealt``: the segments of a document share a partition already. ``carried``: columns that are the same in all segments of a document, which follow its key.
    """
    rows = segments.select("source_key", "external_id", F.col("position").cast("int").alias("position"), "text", *carried)
    rows = rows if dealt else rows.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_key", "external_id")
    rows = rows.sortWithinPartitions("source_key", "external_id", "position", "text")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for key, group in groupby(read, key=lambda r: r[:2]):
            first = next(group)
            for row in one((r[2], r[3]) for r in chain((first,), group)):
                out.append((*key, *first[4:], *row))
                if len(out) == OUT_ROWS:
                    yield batch()
        if out:
            yield batch()

    return rows.mapInArrow(run, schema)


def split_sentences(segments: DataFrame, o: ChunkingOptions) -> DataFrame:
    """Sentences of every document of a ``segments`` frame (source_key, external_id, position, text)."""
    return per_document(segments, lambda found: ((i, s.position, s.position_end, s.text, s.start, s.end, s.tokens) for i, s in enumerate(sentences(found, o))), SENTENCES)


def chunk_documents(segments: DataFrame, o: ChunkingOptions, titles: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Chunks of every document, with header, embedding input, content hash and tokens. ``titles``: source_key, external_id, title. ``dealt``: as ``per_document`` has it; such segments have their document's title with them."""

    def one(found: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        for i, w in enumerate(chunk_windows(sentences(found, o), o)):
            yield i, " ".join(s.text for s in w), w[0].position, max(w[-1].position_end, w[0].position), w[0].start, w[-1].end

    if dealt:
        return finish_drafts(per_document(segments, one, DRAFTS.replace("ordinal", "title string, ordinal", 1), True, ("title",)), o)
    drafts = per_document(segments, one, DRAFTS)
    if titles is not None:
        drafts = drafts.join(titles.select("source_key", "external_id", "title"), ["source_key", "external_id"], "left")
    else:
        drafts = drafts.withColumn("title", F.lit(None).cast("string"))
    return finish_drafts(drafts, o)


def finish_drafts(drafts: DataFrame, o: ChunkingOptions, label: Column | None = None) -> DataFrame:
    """Header (trimmed of spaces and hyphens; null if nothing is left), input (header, line feed, text), its SHA-256, and its tokens."""
    label = label if label is not None else position_label("position_start", "position_end", ":start", ":start-:end")
    header = F.replace(F.replace(F.lit(o.context_header), F.lit(":document_title"), F.coalesce("title", F.lit(""))), F.lit(":position_label"), label)
    header = F.regexp_replace(header, r"^[ \-]+|[ \-]+$", "")
    header = F.when(header != "", header) if o.embed_context_header else F.lit(None).cast("string")
    d = drafts.withColumn("header", header)
    d = d.withColumn("embedding_input", F.concat_ws("\n", "header", "text"))
    return d.withColumns({"content_hash": F.sha2("embedding_input", 256), "token_count": token_estimate("embedding_input", o.chars_per_token)}).drop("title")


def content_checksums(segments: DataFrame, normalized: Column, dealt: bool = False) -> DataFrame:
    """SHA-256 of each document's ``position:text`` lines in order, over normalised text; a digest that runs along the document, so nothing of it is held. A segment without position or text adds nothing."""

    def one(found: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        digest, n = hashlib.sha256(), 0
        for position, text in found:
            if position is not None and text is not None:
                digest.update(f"{position}:{text}\n".encode())
            n += 1
        yield digest.hexdigest(), n

    return per_document(segments.withColumn("text", normalized), one, "source_key string, external_id string, content_checksum string, segments long", dealt)

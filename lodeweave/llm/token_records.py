"""Token ids as length-delimited binary records, with an index beside each file for reads in any order.

A record is framed as: length (unsigned 64-bit), masked CRC-32C of the length, payload, masked CRC-32C of the payload; all numbers
little-endian. The payload holds a flag byte (1: the document has an id), the document id (signed 64-bit), the bytes per token (2 or 4)
and the token ids. The index of a file has one row of 24 bytes for each record: offset, length of the frame, ids before it in the file.

Documents are dealt by ranges of their id, so file k holds smaller ids than file k+1 and each file is sorted; a range that one
document id fills is cut further by a hash of the text. Files are written under a name of the attempt and then renamed, so a task that
runs twice leaves the same file. The table of files, one short row each, says where the ids of each file start in the whole.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, read, scratch_path, small_batches, text_of

END_ID = 2
#: Words in each of the two generations of the table of known codes, and chunks of other texts.
KEPT_WORDS, KEPT_CHUNKS = 400_000, 200_000
#: The tokenizer's own words for text below U+0100, with its letters, numbers and spaces listed. Such text is composed already, and lower-casing it takes letter to letter.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
HEAD, HEAD_SIZE = "<bqb", 10
LANE = 1024  # bytes of a checksum that are computed side by side


def _crc_tables() -> np.ndarray:
    """Tables to take 1 to 4 bytes at once through the CRC-32C polynomial (reflected 0x82F63B78)."""
    t = np.zeros((4, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 4):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 0xFF]
    return t


CRC = _crc_tables()
_X = np.arange(1 << 16, dtype=np.uint32)
#: The same for two bytes at once: the low half of a 32-bit word, and the high one.
LOW, HIGH = CRC[3][_X & 0xFF] ^ CRC[2][_X >> 8], CRC[1][_X & 0xFF] ^ CRC[0][_X >> 8]


def _step(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    halves = (state ^ words).astype("<u4").view("<u2").reshape(-1, 2)
    return LOW.take(halves[:, 0]) ^ HIGH.take(halves[:, 1])


@lru_cache(maxsize=1)
def _lane_shift() -> list[list[int]]:
    """What a checksum becomes when LANE zero bytes follow, by each of its four bytes."""
    unit = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    for _ in range(LANE // 4):
        unit = _step(unit, np.zeros(32, np.uint32))
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(256):
            bits = [unit[8 * k + j] for j in range(8) if b >> j & 1]
            tables[k, b] = np.bitwise_xor.reduce(np.array(bits, np.uint32)) if bits else 0
    return tables.tolist()


@lru_cache(maxsize=1)
def _start_bits() -> list[int]:
    """What the initial value 0xFFFFFFFF becomes when n zero bytes follow, for n below LANE."""
    out, table = [0xFFFFFFFF], CRC[0].tolist()
    for _ in range(LANE - 1):
        out.append(out[-1] >> 8 ^ table[out[-1] & 0xFF])
    return out


def _shift_bits(n: int) -> int:
    """What the initial value 0xFFFFFFFF becomes when n zero bytes follow."""
    state, (t0, t1, t2, t3) = _start_bits()[n % LANE], _lane_shift()
    for _ in range(n // LANE):
        state = t0[state & 0xFF] ^ t1[state >> 8 & 0xFF] ^ t2[state >> 16 & 0xFF] ^ t3[state >> 24]
    return state


def crc32c_lengths(sizes: list[bytes]) -> list[int]:
    """CRC-32C of some 8-byte fields."""
    words = np.frombuffer(b"".join(sizes), "<u4").reshape(-1, 2)
    state = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in (0, 1):
        state = _step(state, words[:, k])
    return (state ^ np.uint32(0xFFFFFFFF)).tolist()


def crc32c(parts: list[bytes]) -> list[int]:
    """CRC-32C of each part. Lanes of LANE bytes of all parts go side by side; a part's lanes are then joined in order."""
    lanes = [-(-len(p) // LANE) for p in parts]
    padded = b"".join(b"\0" * (k * LANE - len(p)) + p for k, p in zip(lanes, parts, strict=True))  # zeros in front change nothing
    words = np.frombuffer(padded, "<u4").reshape(-1, LANE // 4).T.copy()
    state = np.zeros(words.shape[1], np.uint32)
    for row in words:
        state = _step(state, row)
    state, at, out = state.tolist(), 0, []
    t0, t1, t2, t3 = _lane_shift()
    for k, p in zip(lanes, parts, strict=True):
        crc = 0
        for x in state[at : at + k]:
            crc = t0[crc & 0xFF] ^ t1[crc >> 8 & 0xFF] ^ t2[crc >> 16 & 0xFF] ^ t3[crc >> 24] ^ x
        at += k
        out.append(crc ^ _shift_bits(len(p)) ^ 0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    """Rotated and shifted by a constant, so that a checksum over data that holds checksums stays sound."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frames(payloads: list[bytes]) -> list[bytes]:
    """The framed records of some payloads."""
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    crcs = crc32c(payloads)
    heads = crc32c_lengths(sizes)
    return [b"".join((s, struct.pack("<I", masked(h)), p, struct.pack("<I", masked(c)))) for s, h, p, c in zip(sizes, heads, payloads, crcs, strict=True)]


def unframe(blob: bytes) -> list[bytes]:
    """The payloads of whole records one after another; ValueError where a length or checksum is wrong."""
    at, sizes, payloads, want = 0, [], [], []
    while at < len(blob):
        (size,) = struct.unpack_from("<Q", blob, at)
        if at + 16 + size > len(blob):
            raise ValueError("a record is cut off")
        sizes.append(blob[at : at + 8])
        payloads.append(blob[at + 12 : at + 12 + size])
        want.append((struct.unpack_from("<I", blob, at + 8)[0], struct.unpack_from("<I", blob, at + 12 + size)[0]))
        at += 16 + size
    for (h, c), a, b in zip(want, crc32c_lengths(sizes), crc32c(payloads), strict=True):
        if masked(a) != h or masked(b) != c:
            raise ValueError("a record's checksum is wrong")
    return payloads


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level model has for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class ChunkEncoder:
    """A tokenizer that drops white space, so that a text's ids are those of its words, one after another.

    Codes of words are kept in a table of two generations: what was used lately survives when one is full. Words that it lacks go through the
    tokenizer's model. Text with characters from U+0100 on or added tokens is cut at spaces alone, and its chunks go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.is_other = re.compile("|".join(["[^\x00-\xff]", *map(re.escape, added)])).search
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        """The ids of a word that isn't in the table yet."""
        found = self.older.get(w)
        if found is None:
            mapped = w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self.letters)
            found = array("H" if self.width == 2 else "I", [t.id for t in self.tokenize(mapped)]).tobytes()
        if len(w) <= 64:
            if len(self.words) >= KEPT_WORDS:
                self.words, self.older = {}, self.words
            self.words[w] = found
        return found

    def encode_other(self, text: str) -> bytes:
        """Any text, by its chunks: only these four are cut at, as str.split() would also cut at U+001C-U+001F, which the tokenizer keeps."""
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks.clear()
        new = list(set(parts).difference(self.chunks))
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.chunks[c] = np.array(e.ids, f"<u{self.width}").tobytes()
        return b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned integers of ``width`` bytes."""
        if self.is_other(text):
            return self.encode_other(text)
        words = LATIN_WORDS.findall(text.lower())
        out = [*map(self.words.get, words)]
        if None in out:
            for i, code in enumerate(out):
                if code is None:
                    out[i] = self.words.get(words[i]) or self.word(words[i])
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [*map(self.encode, texts)]


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(docs: DataFrame, out: str, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encode, sort and write all rows below ``out``, a URI that every machine can write; the table of files is the result.

    One row a file: ``file`` (its number), ``path``, ``records``, ``ids``. Rows are sorted by id (null first) and then by a hash of the
    text. Null or empty text has the end id alone. ``files``: how many at least; by default as many as shuffle partitions.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, k = chunk_encoder(path), TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        attempt = f"{root}/.{uuid.uuid4().hex}"
        kind, end = f"<u{encoder.width}", np.array([end_id], f"<u{encoder.width}").tobytes()
        index, records, ids, offset = io.BytesIO(), 0, 0, 0
        with fs.open_output_stream(attempt) as f:
            for b in batches:
                codes = encoder.encode_all(b.column(1).to_pylist())
                payloads = [struct.pack(HEAD, doc is not None, doc or 0, encoder.width) + c + end for doc, c in zip(b.column(0).to_pylist(), codes, strict=True)]
                for frame, p in zip(frames(payloads), payloads, strict=True):
                    f.write(frame)
                    index.write(struct.pack("<QQQ", offset, len(frame), ids))
                    offset, records, ids = offset + len(frame), records + 1, ids + (len(p) - HEAD_SIZE) // np.dtype(kind).itemsize
        name = f"{root}/part-{k:06d}.records"
        if records:
            with fs.open_output_stream(f"{attempt}.index") as f:
                f.write(index.getvalue())
            fs.move(f"{attempt}.index", f"{name}.index")
            fs.move(attempt, name)
            yield pa.RecordBatch.from_pydict({"file": [k], "path": [f"{out}/part-{k:06d}.records"], "records": [records], "ids": [ids]}, schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))
        else:
            fs.delete_file(attempt)

    return cut(dealt.mapInArrow(run, "file int, path string, records long, ids long"), "token_files")


def read_records(files: DataFrame, block: int = 8 << 20) -> DataFrame:
    """Read every record of a table of files: ``doc_id``, ``start`` (ids of all records before it), ``n_tokens``, ``ids_crc32``.

    Lengths and checksums are verified. ``ids_crc32`` is the CRC-32 of the ids as little-endian unsigned 32-bit integers. Files are read in
    blocks of about ``block`` bytes of whole records, as their index cuts them. The running sum is over one row for each file.
    """
    starts = files.withColumn("base", F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)))
    todo = starts.select("path", F.coalesce("base", F.lit(0)).cast("long").alias("base"))
    todo = todo.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(f"{name}.index") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 3)
                with fs.open_input_file(name) as f:
                    at = 0
                    while at < len(index):
                        to = max(at + 1, int(np.searchsorted(index[:, 0], index[at, 0] + block)))
                        first, size = int(index[at, 0]), int(index[to - 1, 0] + index[to - 1, 1] - index[at, 0])
                        f.seek(first)
                        payloads = unframe(f.read(size))
                        heads = [struct.unpack_from(HEAD, p) for p in payloads]
                        codes = [np.frombuffer(p, f"<u{h[2]}", offset=HEAD_SIZE) for p, h in zip(payloads, heads, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([h[1] if h[0] else None for h in heads], pa.int64()),
                                pa.array((index[at:to, 2] + np.uint64(base)).astype(np.int64)),
                                pa.array([len(c) for c in codes], pa.int64()),
                                pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in codes], pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = to

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return read_records(write(read(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "token_records")))

"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece of text, byte-pair encoding has one last token; the table of those tokens, followed from the end, is the
encoding. A token that ends at a prefix can only be its last one if it is compatible with the last token of the prefix before it:
no merge may cross the border between the two while they are built. The matcher (an automaton over all tokens) lists the
tokens that end at each position in one pass, and the compatibility test walks the borders of two merge trees, so the table takes a
time in proportion to the length of the piece, however long it is.

Pieces are what the tokenizer's own pre-tokenizer cuts a text into. They repeat, so workers keep the codes of those seen, in a table of
bounded size; nothing else depends on that table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from lodeweave.llm.common import drop_columns, read, small_batches, text_of

#: The byte-level pre-tokenizer: contractions, then letters, numbers and other marks with one space before them, then spaces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text below U+0100, with its letters, numbers and spaces listed, for the standard module, which is twice as fast.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PIECES = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
NOT_LATIN = re.compile("[^\x00-\xff]")
BEYOND = regex.compile("[\U00010000-\U0010ffff]")
#: Pieces in each of the two generations of the table of known codes; pairs of tokens whose compatibility is known.
KEPT_PIECES, KEPT_PAIRS = 300_000, 400_000
RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary file writes bytes as: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """A byte-level BPE vocabulary, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode("utf-8")
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(merges)}
        parts = {vocab[a + b]: (vocab[a], vocab[b], n) for n, (a, b) in reversed([*enumerate(merges)])}
        # the borders of each token's merge tree, from the leaf up: (ids, when the merge above takes each of them)
        self.right: dict[int, tuple[list[int], list[float]]] = {}
        self.left: dict[int, tuple[list[int], list[float]]] = {}
        self.matcher = ahocorasick.Automaton()
        order = [i for t, i in vocab.items() if len(t) == 1 and i not in parts]
        for i in order:
            self.right[i], self.left[i] = ([i], [inf]), ([i], [inf])
        for i, (a, b, n) in sorted(parts.items(), key=lambda x: x[1][2]):
            if a in self.left and b in self.right and self.compatible(a, b, n):
                self.left[i] = ([*self.left[a][0], i], [*self.left[a][1][:-1], n, inf])
                self.right[i] = ([*self.right[b][0], i], [*self.right[b][1][:-1], n, inf])
                order.append(i)
        for i in order:  # tokens that merging can reach
            self.matcher.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.matcher.make_automaton()
        self.split, self.split_latin = regex.compile(PIECES).findall, re.compile(LATIN_PIECES).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.own_splitter = Tokenizer.from_file(path).pre_tokenizer
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def compatible(self, a: int, b: int, until: float = inf) -> bool:
        """No merge crosses the border of a and b, next to each other, before the merge of rank ``until``."""
        xs, x_end = self.right[a]
        ys, y_end = self.left[b]
        i = j = 0
        while True:
            rank = self.rank.get((xs[i], ys[j]), inf)
            # of equal merges the left one comes first: left of the border it takes x before the crossing one can, right of it not
            if rank < until and rank < x_end[i] and rank <= y_end[j]:
                return False
            if x_end[i] == y_end[j] == inf:
                return True
            if x_end[i] <= y_end[j]:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one piece, as little-endian unsigned 32-bit integers."""
        text = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        # of the prefix that ends with each byte: its last token, and the byte before that
        last, before, pairs = [-1] * len(text), [-1] * len(text), self.pairs
        for end, (token, size) in self.matcher.iter(text):
            if last[end] < 0:
                start = end - size
                if start < 0:
                    last[end] = token
                elif (left := last[start]) >= 0:
                    key = left << 32 | token
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) > KEPT_PAIRS:
                            pairs.clear()
                        ok = pairs[key] = self.compatible(left, token)
                    if ok:
                        last[end], before[end] = token, start
        ids, at = array("I"), len(text) - 1
        while at >= 0:
            ids.append(last[at])  # every prefix has one, as every byte is a token
            at = before[at]
        ids.reverse()
        return ids.tobytes()

    def code(self, piece: str) -> bytes:
        """``encode_piece`` for a piece that isn't in the table yet. The table has two generations: what was used lately survives when one is full."""
        found = self.older.get(piece)
        if found is None:
            found = self.encode_piece(piece)
        if len(piece) <= 64:
            if len(self.known) >= KEPT_PIECES:
                self.known, self.older = {}, self.known
            self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.encode_plain(p) for p in parts if p)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        if not NOT_LATIN.search(text):
            pieces = self.split_latin(text)
        elif not BEYOND.search(text):
            pieces = self.split(text)
        else:  # letters of newer scripts: the tokenizer's own table of letters decides
            pieces = [text[a:b] for _, (a, b) in self.own_splitter.pre_tokenize_str(text)]
        out = [*map(self.known.get, pieces)]
        if None in out:
            known = self.known.get
            for i, code in enumerate(out):
                if code is None:
                    out[i] = known(pieces[i]) or self.code(pieces[i])
                    known = self.known.get
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary: str | None = None, *, text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Every row with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; ``keep_ids``: and ``ids`` (array of int).

    ``vocabulary``: a vocabulary file at the same path on every machine. Null or empty text has no ids. Strings of special tokens in
    a text become those tokens. Input columns named like a result are replaced. A narrow pass without a shuffle.
    """
    path = vocabulary or vocabulary_path()
    d = drop_columns(docs, *RESULTS, *["ids"] * keep_ids)
    names = d.columns
    carried = [c for c in names if keep_text or c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in carried)
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            col = dict(zip(names, b.columns, strict=True))
            n, ids_hash, text_hash, codes = [], [], [], []
            for text in col[text_col]:
                ids = e.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(e.decode(ids).encode("utf-8")).hexdigest())
                if keep_ids:
                    codes.append(ids)
            out = {c: col[c] for c in carried} | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if keep_ids:
                ends = [0]
                for k in n:
                    ends.append(ends[-1] + k)
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(codes))])
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return d.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    return encode(docs, keep_ids=False, keep_text=False).select("doc_id", *RESULTS)

"""Text functions as Column expressions: normalising, tokens, terms, snippets, readable text of pages.

All lengths are in characters. Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Callable, Iterable
from datetime import datetime
from math import ceil

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions.slices import by_slices

Text = Column | str

#: Ligatures that scanned text has, with their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}
#: Spaces (no-break, figure, narrow no-break, thin, ideographic), dashes and single quotes that become ASCII.
SPACES, DASHES, QUOTES = "    　", "‐‑‒–—−", "‘’‚‛′"
TO_ASCII = {c: to for group, to in ((SPACES, " "), (DASHES, "-"), (QUOTES, "'")) for c in group}
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{FFFD}]"
TERM = r"[\p{L}\p{N}]+(?:['’]\p{L}+)?"


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(at: datetime) -> Column:
    """A literal timestamp without a time zone, whatever zone the session or this machine is in."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def strip_control(c: Text) -> Column:
    """Without control characters (but tab, line feed and carriage return), zero-width characters and U+FFFD."""
    return F.regexp_replace(col(c), CONTROL, "")


def fix_ligatures(c: Text) -> Column:
    """Ligatures become letters; exotic spaces, dashes and single quotes become ASCII."""
    out = F.translate(col(c), "".join(TO_ASCII), "".join(TO_ASCII.values()))
    for glyph, letters in LIGATURES.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out


def dehyphenate(c: Text) -> Column:
    """Join a word that a line break cuts between two lower-case letters."""
    return F.regexp_replace(col(c), r"(\p{Ll})-\s*\R\s*(\p{Ll})", "$1$2")


def collapse_whitespace(c: Text) -> Column:
    """Any run of white space is one space, and none is at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


NORMALIZERS: dict[str, Callable[[Text], Column]] = {"strip_control": strip_control, "fix_ligatures": fix_ligatures, "dehyphenate": dehyphenate, "collapse_whitespace": collapse_whitespace}


def normalize(c: Text, steps: Iterable[str] = tuple(NORMALIZERS)) -> Column:
    """The steps in order; joining words must come before white space is collapsed."""
    out = col(c)
    for s in steps:
        out = NORMALIZERS[s](out)
    return out


def normalize_py(text: str, steps: Iterable[str] = tuple(NORMALIZERS)) -> str:
    """``normalize`` for grouped functions."""
    for s in steps:
        if s == "strip_control":
            text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f​‌‍⁠﻿�]", "", text)
        elif s == "fix_ligatures":
            text = text.translate(str.maketrans(LIGATURES | TO_ASCII))
        elif s == "dehyphenate":
            text = re.sub("([^\\W\\d_])-\\s*(?:\r\n|[\n\x0b\x0c\r\x85  ])\\s*([^\\W\\d_])", lambda m: m[1] + m[2] if m[1].islower() and m[2].islower() else m[0], text)
        elif s == "collapse_whitespace":
            text = re.sub(r"\s+", " ", text).strip()
        else:
            raise KeyError(s)
    return text


def token_estimate(c: Text, chars_per_token: float = 3.7) -> Column:
    """0 for an empty text, else characters by token, rounded up, at least 1."""
    n = F.length(col(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(chars_per_token)))).cast("int")


def token_estimate_py(text: str, chars_per_token: float = 3.7) -> int:
    return max(1, ceil(len(text) / chars_per_token)) if text else 0


def terms(c: Text, limit: int = 32) -> Column:
    """Distinct search terms in order, at most ``limit``: lower case, without an elided article before an apostrophe, of 2 characters at least."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(TERM), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"^\p{L}{1,4}['’]", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: F.length(t) >= 2)), F.lit(1), F.lit(limit))


def fold_accents(c: Text) -> Column:
    """Latin letters without their accents (U+00C0-U+017F)."""
    return F.translate(col(c), *_accents())


def _accents() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(i), d[0]) for i in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFKD", chr(i))) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def lexemes(c: Text) -> Column:
    """Distinct words of a document for keyword search: accents folded, lower case, letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(fold_accents(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def terms_py(text: str, limit: int = 32) -> list[str]:
    import regex

    found: dict[str, None] = {}
    for m in regex.finditer(TERM, text.lower()):
        t = regex.sub(r"^\p{L}{1,4}['’]", "", m[0])
        if len(t) >= 2:
            found[t] = None
        if len(found) == limit:
            break
    return list(found)


def snippet(c: Text, limit: int) -> Column:
    """The text without outer spaces if it is short enough; else its first ``limit`` characters, without spaces and .,;:- at the end, and '...'."""
    t = F.trim(col(c))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"[\s.,;:\-]+$", ""), F.lit("...")))


def title_of(c: Text, limit: int = 60) -> Column:
    """A question as a title: white space collapsed, cut to ``limit`` characters with an ellipsis."""
    t = collapse_whitespace(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("…")))


def position_label(start: Text, end: Text, single: str = "Page :start", several: str = "Pages :start-:end") -> Column:
    """The label of a position or a range of them."""
    put = lambda template: F.replace(F.replace(F.lit(template), F.lit(":start"), col(start).cast("string")), F.lit(":end"), col(end).cast("string"))
    return F.when(col(start) == col(end), put(single)).otherwise(put(several))


def external_id(c: Text, is_scalar: bool = True) -> Column:
    """An id as text: scalars as they print, others as JSON."""
    return col(c).cast("string") if is_scalar else F.to_json(col(c))


def readable_html(c: Text, limit: int | None = 6000) -> Column:
    """Readable text of a page: hidden elements go, ends of blocks are line breaks, tags go, references are decoded, spaces collapse; cut at ``limit``."""
    t = F.regexp_replace(col(c), r"(?is)<(script|style|noscript|svg|template)\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    t = decode_references(F.regexp_replace(t, r"(?s)<[^>]*>", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*\n\s*", "\n\n")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return t if limit is None else F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("\n[…]")))


def decode_references(c: Text) -> Column:
    """Character references become characters; only texts with an ampersand leave the JVM."""

    @F.pandas_udf("string")
    def decode(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)

    return decode(col(c))


def decode_body(body: Text, content_type: Text) -> Column:
    """The bytes of a response as text: by the charset that its content type declares, if there is such a charset, else as UTF-8. What can't be decoded becomes a question mark. Valid UTF-8 stays in the JVM."""
    declared = F.lower(F.regexp_extract(F.coalesce(col(content_type), F.lit("")), r"(?i)charset=\"?([\w-]+)", 1))
    as_is = declared.isin("", "utf-8", "utf8") & F.is_valid_utf8(col(body).cast("string"))

    @F.arrow_udf("string")
    def repair(raw: pa.Array, names: pa.Array) -> pa.Array:
        codecs.register_error("question_mark", lambda e: ("?", e.end))

        def one(b: bytes | None, name: str) -> str | None:
            if b is None:
                return None
            try:
                return b.decode(name or "utf-8", "question_mark")
            except (LookupError, UnicodeError):
                return b.decode("utf-8", "question_mark")

        some = lambda bodies, charsets: pa.array(map(one, bodies.to_pylist(), charsets.to_pylist()), pa.string())
        return by_slices(some, pa.string(), 64, raw, names)

    return F.when(as_is, col(body).cast("string")).otherwise(repair(F.when(~as_is, col(body)), declared))


def is_public_url(c: Text) -> Column:
    """False for schemes other than http(s), for local names and for literal addresses of private, loopback, link-local and reserved networks."""
    host = F.lower(F.coalesce(F.try_parse_url(col(c), F.lit("HOST")), F.lit("")))
    private = host.rlike(r"^(localhost|.*\.(localhost|local|internal|home|lan)|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|22[4-9]\..*|2[3-5]\d\..*|\[.*\]|\d+|0x.*)$")
    return F.coalesce(F.lower(F.coalesce(F.try_parse_url(col(c), F.lit("PROTOCOL")), F.lit(""))).isin("http", "https") & (host != "") & ~private, F.lit(False))


def excerpt_py(content: str, query: str, limit: int) -> str:
    """The window of a long text that holds most occurrences of the query's terms (prefixes of those of 4 characters or more), cut at words."""
    if len(content) <= limit:
        return content
    limit, low = max(200, limit), content.lower()
    hits: list[int] = []
    for t in terms_py(query):
        at = -1
        while len(t) >= 4 and (at := low.find(t[: max(4, len(t) - 2)], at + 1)) >= 0:
            hits.append(at)
    hits.sort()
    start, best, right = 0, 0, 0
    from bisect import bisect_left

    for at in hits:
        begin = max(0, at - limit // 4)
        inside = bisect_left(hits, begin + limit) - bisect_left(hits, begin)
        if inside > best:
            start, best = begin, inside
    start = min(start, max(0, len(content) - limit))
    if start > 0:
        start = content.rfind(" ", 0, start) + 1 or start
    part = content[start : start + limit]
    if start + limit < len(content) and (right := part.rfind(" ")) >= 0:
        part = part[:right]
    return ("… " if start > 0 else "") + part.strip() + (" …" if start + len(part) < len(content) else "")


def excerpt(content: Text, query: Text, limit: int = 1200) -> Column:
    """``excerpt_py`` for columns."""

    @F.pandas_udf("string")
    def cut(text, question):  # noqa: ANN001, ANN202
        return text.combine(question, lambda t, q: None if t is None else excerpt_py(t, q or "", limit))

    return cut(col(content), col(query))


def exact_tokens(c: Text, ranks_path: str, pattern: str) -> Column:
    """Tokens as a byte-pair vocabulary file counts them; ``ranks_path`` must be readable on every machine."""

    @F.pandas_udf("int")
    def count(s):  # noqa: ANN001, ANN202
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("exact", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return s.map(lambda x: None if x is None else len(e.encode_ordinary(x)))

    return count(col(c))

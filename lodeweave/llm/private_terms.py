r"""Personal data: exact patterns, and information-theoretic sanitisation of the terms that give them away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Protected entities are each distinct value and the parts of values that say whose they are
and that other values share: the domain of an address and the words of its local part, the network of an IP address, the issuer of a card, the area of a phone
number. A term of a text with an entity may reveal it as well: with corpus counts over whole documents, the pointwise mutual information PMI(entity; term) =
ln(P(entity, term) / (P(entity) P(term))) says how much of the entity's information content IC(entity) = -ln P(entity) the term gives away. A term
exceeds the disclosure threshold where PMI >= IC / ALPHA, and enough documents (MIN_JOINT) show the pair. Every occurrence of such a term is marked, in texts without
the entity too, and ``sanitise_texts`` takes it out: it is removed, or, where it reveals several entities, generalised to a word for the kind of data.

Plan: one pass finds the patterns, and notes the distinct words of the texts that have any; one counts the documents of every word, in tables that are flushed when
they are full and summed before the shuffle; only words of texts with an entity that enough documents share, without those too frequent to disclose it, make
pairs; and one searches all texts for the terms, by a bit table of fixed size whose finds are then joined with the terms. Nothing but spans, words and counts is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, loose, read, small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
ALPHA, MIN_JOINT, MIN_TERM = 1.25, 3, 3
#: Words that a worker counts before it hands them over, those whose bit it keeps, and words in one batch of its output.
FLUSH, KEPT_BITS, SLICE = 50_000, 200_000, 5_000
#: Bits, as a power of two, of the table that says which words may be disclosing terms.
TERM_BITS = 24
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\w+")
Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of an address that don't overlap; from each @ to the left as far as the local part goes, so the time is linear."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    """The check digit of a card number is right."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind as listed and then by start. Matches that fail their test are dropped, without another try inside them."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entities(kind: str, value: str) -> list[str]:
    """What a value reveals: itself as it is compared, and its parts that other values share."""
    if kind == "email":
        local, _, domain = value.lower().rpartition("@")
        return [f"email:{value.lower()}", f"domain:{domain}", *(f"name:{w}" for w in WORD.findall(local) if len(w) >= MIN_TERM and not w.isdigit())]
    if kind == "ip":
        return [f"ip:{value}", "net:" + ".".join(value.split(".")[:2])]
    digits = "".join(c for c in value if c.isdigit())
    return [f"{kind}:{digits}", f"issuer:{digits[:6]}" if kind == "card" else f"area:{digits[:4]}"]


def free_terms(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all words of a text that no span covers."""
    covered, k = sorted((a, b) for _, a, b in spans), 0
    end = 0
    for m in WORD.finditer(text):
        s, e = m.span()
        while k < len(covered) and covered[k][0] < e:
            end = max(end, covered[k][1])
            k += 1
        if e - s >= MIN_TERM and end <= s:
            yield m.group().lower(), s, e


def text_key(text_col: str) -> Column:
    """128 bits for a text: rows of equal texts have equal spans."""
    return F.unhex(F.md5(text_of(text_col)))


SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, spans string, held array<string>, words array<string>, text_key binary"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: its base spans, and, if there are any, their entities and the distinct words that no span covers."""
    strings = pa.list_(pa.string())
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("spans", pa.string()), ("held", strings), ("words", strings), ("text_key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            for text in b.column(1):
                t = text.as_py()
                s = base_spans(t)
                held = sorted({e for k, x, y in s for e in entities(k, t[x:y])})
                found.append((*(sum(x[0] == k for x in s) for k in KINDS), joined(s), held, sorted({w for w, _, _ in free_terms(t, s)}) if s else []))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), [*schema][1:-1], strict=True)] if found else [pa.nulls(0, f.type) for f in [*schema][1:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, b.column(2)], schema=schema)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"), text_key(text_col).alias("text_key")).mapInArrow(run, SCAN)


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``term``, ``n_term``: rows that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            while counts:
                some = [counts.popitem() for _ in range(min(SLICE, len(counts)))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.int64())], names=["term", "n"])

        words_in = WORD.findall
        for b in batches:
            for text in b.column(0):
                counts.update(w for w in set(words_in(text.as_py().lower())) if len(w) >= MIN_TERM)
                if len(counts) >= FLUSH:
                    yield from out()
        yield from out()

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def joint_counts(rows: DataFrame, with_entity: DataFrame, with_term: DataFrame, total: DataFrame, alpha: float, min_joint: int) -> DataFrame:
    """``entity``, ``term``, ``n_joint``: rows that have both anywhere, for pairs that may disclose.

    As n_joint is at most n_entity, a term of more than n_entity * (total / n_entity)^(1 - 1 / alpha) rows can't disclose the entity: such words make no pair.
    """
    held = rows.select("text_key", F.explode("held").alias("entity")).groupBy("text_key", "entity").agg(F.count("*").alias("copies"))  # rows of one text count as one with their number
    held = held.join(loose(with_entity.where(F.col("n_entity") >= min_joint)), "entity").crossJoin(F.broadcast(total))
    held = held.withColumn("most", F.col("n_entity") * F.pow(F.col("total") / F.col("n_entity"), F.lit(1 - 1 / alpha)) * (1 + 1e-9))
    held = cut(held.select("text_key", "entity", "copies", "most"), "private_held")
    words = rows.join(loose(held.groupBy("text_key").agg(F.max("most").alias("top"))), "text_key").select("text_key", "top", F.explode("words").alias("term")).distinct()
    rare = words.join(loose(with_term.where(F.col("n_term") >= min_joint)), "term").where(F.col("n_term") <= F.col("top"))
    pairs = rare.join(held, "text_key").where(F.col("n_term") <= F.col("most"))
    return pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_joint")).where(F.col("n_joint") >= min_joint)


def occurrences(docs: DataFrame, reach: DataFrame, text_col: str) -> DataFrame:
    """``text_key``, ``start``, ``end``, ``entities`` of every occurrence of a term of ``reach`` (term, entities) that no base span covers, in all texts.

    Workers get a bit table of fixed size with the terms' hashes; what passes it is joined with the terms.
    """
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("term"), F.lit(1 << TERM_BITS))
    parts = reach.select(slot.alias("s")).groupBy((F.col("s") / F.lit(1 << 15)).cast("int").alias("part")).agg(F.collect_set((F.col("s") % F.lit(1 << 15)).cast("int")).alias("at"))
    bits = bytearray(1 << TERM_BITS - 3)
    for r in parts.toLocalIterator():  # at most 2^TERM_BITS slots
        for x in r.at:
            k = (r.part << 15) + x
            bits[k >> 3] |= 1 << (k & 7)
    shared = spark.sparkContext.broadcast(bytes(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, mask = shared.value, {}, (1 << TERM_BITS) - 1
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                maybe = set()
                for w in set(WORD.findall(t.lower())):
                    if w not in known:
                        if len(known) >= KEPT_BITS:
                            known.clear()
                        k = xxhash.xxh64_intdigest(w.encode(), 42) & mask
                        known[w] = table[k >> 3] >> (k & 7) & 1
                    if known[w]:
                        maybe.add(w)
                if maybe:
                    out += ((key, *x) for x in free_terms(t, base_spans(t)) if x[0] in maybe)
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text_key", "term", "start", "end"])

    found = docs.select(text_key(text_col).alias("text_key"), text_of(text_col).alias("text")).mapInArrow(run, "text_key binary, term string, start int, end int")
    return found.join(loose(reach), "term").select("text_key", "start", "end", "entities").distinct()


def find_private(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_joint: int = MIN_JOINT) -> DataFrame:
    """Per row: ``doc_id``, counts of the base kinds, ``base`` and ``spans`` (kind:start:end in code points, comma-joined), ``terms`` and ``text_key``.

    ``spans`` has the base spans by kind, then those of disclosing terms as ``term``, by start. ``terms`` says for each of these whether it is to be
    removed or generalised (null: there are none). Null or empty text has none. Rows that repeat are each reported, and count as often as they occur. An
    entity that fewer than ``min_joint`` documents have can't be told from chance and makes no term spans.
    """
    rows = cut(scan(docs, id_col, text_col), "private_scan")
    total = rows.agg(F.count("*").alias("total"))  # one row
    with_entity = cut(rows.select(F.explode("held").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")), "private_entities")
    with_term = cut(term_counts(docs, text_col).where(F.col("n_term") >= min_joint), "private_counts")
    pairs = joint_counts(rows, with_entity, with_term, total, alpha, min_joint)
    judged = pairs.join(loose(with_entity), "entity").join(loose(with_term), "term").crossJoin(F.broadcast(total))
    # PMI >= IC / alpha, in counts: ln(n_joint * total / (n_entity * n_term)) * alpha >= ln(total / n_entity)
    pmi = F.ln(F.col("n_joint") * F.col("total") / (F.col("n_entity") * F.col("n_term")))
    reach = cut(judged.where(pmi * alpha >= F.ln(F.col("total") / F.col("n_entity"))).groupBy("term").agg(F.count("*").alias("entities")), "private_terms")
    action = F.when(F.col("entities") > 1, "generalise").otherwise("remove")
    hits = occurrences(docs, reach, text_col).groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", action.alias("action")))).alias("terms"))
    out = rows.drop("held", "words").join(loose(hits), "text_key", "left")
    more = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string"))), ",")
    spans = F.when(F.col("terms").isNull(), F.col("spans")).when(F.col("spans") == "", more).otherwise(F.concat_ws(",", "spans", more))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.col("spans").alias("base"), spans.alias("spans"), "terms", "text_key")


def sanitise(text: str, spans: str, actions: list[str] | None = None, generalised: str = "[{kind}]") -> str:
    """A text with its spans replaced by a word for their kind, but terms whose action is ``remove``, which go; overlaps are taken from left to right."""
    found = [(int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    terms = [x for x in found if x[2] == "term"]
    act = dict(zip(terms, actions or [], strict=False))
    cut_at, out = 0, []
    for a, minus_b, kind in sorted(found):
        if -minus_b > cut_at:
            out += (text[cut_at : max(a, cut_at)], "" if a < cut_at or act.get((a, minus_b, kind)) == "remove" else generalised.format(kind=kind))
            cut_at = -minus_b
    return "".join(out) + text[cut_at:]


def sanitise_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_joint: int = MIN_JOINT) -> DataFrame:
    """Every row of ``docs`` with its text sanitised: base spans and disclosing terms are replaced or removed. Null text becomes empty; columns stay."""
    found = find_private(docs, id_col=id_col, text_col=text_col, alpha=alpha, min_joint=min_joint).where("spans <> ''")
    found = found.groupBy(F.col("text_key").alias("__key")).agg(F.first("spans").alias("__spans"), F.first(F.transform("terms", lambda t: t["action"])).alias("__actions"))
    d = docs.join(loose(found), text_key(text_col) == F.col("__key"), "left").drop("__key").withColumn(text_col, text_of(text_col))
    names, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.withColumn(text_col, text_of(text_col)).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = dict(zip([*names, "__spans", "__actions"], b.columns, strict=True))
            col[text_col] = pa.array([sanitise(t, s or "", a) for t, s, a in zip(*(col[c].to_pylist() for c in (text_col, "__spans", "__actions")), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([col[c] for c in names], names=names)

    return d.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    d = find_private(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")

"""Tables in a shared folder as versioned snapshots: an upsert rewrites the buckets that its keys fall into, and one rename commits all tables of a change together.

A version is a small JSON file that names, for each table, the folders of each bucket; rows lie in Parquet files that are never changed once written. A writer that dies before its rename leaves files that no version names
(``vacuum`` removes them) and the version before as it was; of two writers on the same version, the second one's rename fails. What a version file holds grows with tables and buckets, not with rows.

A key's bucket is a hash of its columns. Reading by keys opens their buckets alone. A bucket that outgrows one task is split by Spark when it is written (a rebalance by bucket), so a hot one is no single task's.
Of the rows of a rewritten bucket only those that a bitmap of fixed size takes for rows of changed keys are shuffled, and compared with the keys; the others are copied by the tasks that read them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET, PIECE = "_store_bucket", "_store_piece"
#: Bits of the bitmap that says which stored rows may be of changed keys: at most 2^18 words of 64 bits go to the workers. With a million keys it takes 6 % of the other rows for such.
BITS = 1 << 24


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


@dataclass(frozen=True)
class Change:
    """For a table: all rows of ``keys`` (columns ``key``) go, and ``rows`` come in their place. Without ``keys`` rows are added to what is there, which isn't read. ``sort``: columns that files are sorted by. ``dealt``: ``rows`` lie as ``TableStore.dealt`` deals them, and aren't shuffled once more."""

    table: str
    key: tuple[str, ...]
    rows: DataFrame
    keys: DataFrame | None = None
    sort: tuple[str, ...] = ()
    dealt: bool = False


class TableStore:
    """Versioned tables below ``path``; ``buckets`` is fixed by the first version of each table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return max([0, *(int(n[:-5]) for n in self._names("_versions") if n.endswith(".json"))])

    def state(self, version: int | None = None) -> dict:
        """The tables and facts of a version."""
        v = self.version() if version is None else version
        return json.loads(self._text(f"_versions/{v:012d}.json")) if v else {"tables": {}, "facts": {}}

    def facts(self) -> dict:
        """What changes have recorded beside their rows."""
        return self.state()["facts"]

    def read(self, table: str, keys: DataFrame | None = None, version: int | None = None) -> DataFrame | None:
        """A table as it is in a version (the newest by default); with ``keys`` only the buckets that these fall into. None if there is no such table."""
        entry = self.state(version)["tables"].get(table)
        if entry is None:
            return None
        wanted = entry["at"] if keys is None else {str(b) for b in self._touched(keys, tuple(entry["key"]), entry["buckets"])}
        paths = [f"{self.path}/{table}/{p}" for b, ps in sorted(entry["at"].items()) if b in wanted for p in ps]
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def dealt(self, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """Rows shuffled once, so that those of a key share a partition and a partition has rows of one bucket (column ``PIECE``). For tables that the store makes anew."""
        return dealt(rows, key, self.buckets * -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets))

    def commit(self, changes: Iterable[Change], facts: dict | None = None, base: int | None = None) -> int:
        """The number of the version that has ``changes``, made from version ``base``. All of them are in it, or there is none."""
        base = self.version() if base is None else base
        state = self.state(base)
        for c in changes:
            state["tables"][c.table] = self._write(c, state["tables"].get(c.table), base)
        state["facts"] |= facts or {}
        self._publish(base + 1, json.dumps(state))
        return base + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove versions but the last ``keep``, and folders that none of these names (also those of writers that died; none may be at work)."""
        newest = self.version()
        kept = [v for v in range(max(1, newest - keep + 1), newest + 1)]
        named = {f"{t}/{p.split('/')[0]}" for v in kept for t, e in self.state(v)["tables"].items() for ps in e["at"].values() for p in ps}
        gone = [f"{t}/{d}" for t in self.state()["tables"] for d in self._names(t) if f"{t}/{d}" not in named]
        gone += [f"_versions/{n}" for n in self._names("_versions") if n.endswith(".json") and int(n[:-5]) < kept[0]]
        for p in gone:
            self._fs().delete(self._at(p), True)
        return gone

    def _write(self, c: Change, entry: dict | None, base: int) -> dict:
        buckets = entry["buckets"] if entry else self.buckets
        touched = set() if c.keys is None else self._touched(c.keys, c.key, buckets)
        rows, at, copied = c.rows, dict(entry["at"]) if entry else {}, None
        if any(str(b) in at for b in touched):
            copied, asked = apart(self.read(c.table, c.keys, base), c.keys, c.key)
            rows = asked.join(c.keys.select(*c.key).distinct(), list(c.key), "left_anti").unionByName(rows, allowMissingColumns=True)
        folder = uuid.uuid4().hex
        dealt = rows.withColumn(BUCKET, _bucket(c.key, buckets))
        dealt = dealt if c.dealt and copied is None else dealt.hint("rebalance", BUCKET)
        if copied is not None:
            dealt = dealt.unionByName(copied.withColumn(BUCKET, _bucket(c.key, buckets)), allowMissingColumns=True)
        dealt = dealt.sortWithinPartitions(BUCKET, *c.sort) if c.sort else dealt
        dealt.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{c.table}/{folder}")
        written = {n.partition("=")[2] for n in self._names(f"{c.table}/{folder}") if n.startswith(f"{BUCKET}=")}
        if c.keys is not None and not written <= {str(b) for b in touched}:
            raise ValueError(f"{c.table}: rows of other keys than those of the change")
        kept = {b: ps for b, ps in at.items() if int(b) not in touched}
        at = kept | {b: [*kept.get(b, []), f"{folder}/{BUCKET}={b}"] for b in written}
        return {"key": list(c.key), "buckets": buckets, "schema": json.loads(rows.schema.json()), "at": at}

    def _touched(self, keys: DataFrame, key: tuple[str, ...], buckets: int) -> set[int]:
        return {r.b for r in keys.select(_bucket(key, buckets).alias("b")).distinct().collect()}  # as many as buckets at most

    def _fs(self):  # noqa: ANN202
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _text(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, version: int, text: str) -> None:
        jvm, taken = self.spark._jvm, self._at(f"_versions/{version:012d}.json")
        draft = self._at(f"_versions/{uuid.uuid4().hex}.draft")
        stream = self._fs().create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        # FileContext's rename never replaces a file that is there
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, taken, none)
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if self._fs().exists(taken):
                raise Conflict(f"version {version} was committed by another writer") from e
            raise


def _bucket(key: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(buckets)).cast("int")


def dealt(rows: DataFrame, key: Iterable[str], pieces: int) -> DataFrame:
    """Rows shuffled once into ``pieces`` partitions by a hash of their key, which is their column ``PIECE``."""
    return rows.withColumn(PIECE, _bucket(tuple(key), pieces)).repartitionById(pieces, F.col(PIECE))


def beside(rows: DataFrame, facts: DataFrame, key: Iterable[str], deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with what ``facts`` says of their key (null where it says nothing), both dealt together by ``deal``, as ``dealt`` does: a left join after which rows lie as they were dealt. Rows without a key go."""
    key = tuple(key)
    both = rows.dropna(subset=list(key)).withColumn("_fact", F.lit(False)).unionByName(facts.withColumn("_fact", F.lit(True)), allowMissingColumns=True)
    of_key = Window.partitionBy(PIECE, *key)
    return deal(both).withColumns({c: F.max(c).over(of_key) for c in facts.columns if c not in key}).where(~F.col("_fact")).drop("_fact")


def apart(rows: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows that aren't of ``keys``, rows that may be), told apart where they are read, by a bitmap of the keys' hashes."""
    at = _bucket(key, BITS)
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)))
    words = keys.select(at.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word")).agg(F.bit_or(bit(F.col("_p"))).alias("_bits"))
    marked = rows.withColumn("_p", at).withColumn("_word", F.shiftright("_p", 6)).join(F.broadcast(words), "_word", "left")  # BITS / 64 rows at most
    maybe = F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_p"))) != 0, F.lit(False))
    return marked.where(~maybe).select(*rows.columns), marked.where(maybe).select(*rows.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; under a local master a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='lodeweave-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")

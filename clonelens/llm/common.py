"""Helpers that the operators share: shared-folder tables, whole-word rules, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII lower-casing and word separation for the ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` rule, on UTF-8 bytes.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty; lone surrogates cannot come out of Spark but do not crash."""
    return b"" if text is None else text.encode("utf-8", "replace")


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() splits at exactly these six characters."""
    return utf8(text).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return utf8(text).translate(ALNUM_TABLE).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: ``spark.checkpoint.dir``. Where it is unset, one of our own in local mode (tests);
    on a cluster a machine's own folder would be read by nobody else, so that raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: the operators need a folder that all machines share")
        base = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Where the shared folder is a mounted file system, Hadoop's raw local writer: no checksum file beside each part and
#: no child process for that file's permissions (without Hadoop's native library, every file and folder takes one), and
#: no mark of success, which nothing reads. Other file systems ignore the first two.
WRITE_OPTIONS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


class Scratch:
    """The tables that calls under ``with scratch:`` write. ``delete`` removes those that are left; only for callers
    that have stored all results that read them. Tables written outside any scratch stay until the folder is cleared."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._token = _scratch.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scratch.reset(self._token)

    def delete(self, spark: SparkSession) -> None:
        while self.paths:
            _delete(spark, self.paths.pop())


_scratch: ContextVar[Scratch | None] = ContextVar("clonelens_scratch", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clonelens/{name}-{uuid.uuid4().hex}"
    own = _scratch.get()
    if own is not None:
        own.paths.append(path)
    df.write.options(**WRITE_OPTIONS).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._clonelens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` whose readers are all stored."""
    for table in tables:
        path = table._clonelens_path
        own = _scratch.get()
        if own is not None and path in own.paths:
            own.paths.remove(path)
        _delete(table.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what one Arrow batch of whole texts holds; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


#: Bits of a table that carries keys to a map-only pass: 16 for each key, between these bounds. Such a table only saves
#: work: a fuller one lets more rows through, which fall out of the exact join that follows.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of a column of 64-bit keys, by key modulo their number; the driver gets a word for each 64 of them."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    slot = F.pmod(F.col(column), F.lit(bits))
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which signed 64-bit keys a bit table holds."""
    slot = keys % (len(table) * 64)
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)`` for every node of an edge, root the smallest node.

    Alternating large-star / small-star steps. Each step is two groupBy-min with map-side combining and a join
    that adaptive execution may split, so a node with a third of all edges is no single task. Every round is
    written to the shared folder, and the one before it is deleted; rounds grow with the logarithm of the longest
    chain. Raises when ``max_rounds`` do not suffice.
    """

    def norm(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialise(norm(edges.select("a", "b")), "cc")
    seen = mark(now)
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        last, now = now, materialise(norm(small), "cc")
        discard(last)
        was, seen = seen, mark(now)
        if was == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "cc-out")
    discard(now)
    return out


#: Edges that the driver settles by itself: 16 bytes each, 4 MB. A round of ``components`` is some ten stages, whatever it
#: holds, and the driver keeps records of all their tasks.
DIRECT_EDGES = 1 << 18


def settle(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a, b and the smallest node of the component of each. A round hangs the larger root of every
    edge below the smaller and cuts all paths short; it leaves half of the roots that still have edges, at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def classes(edges: DataFrame) -> DataFrame:
    """``components`` of a stored table of edges: the same rows, on the driver for up to DIRECT_EDGES edges."""
    if edges.count() > DIRECT_EDGES:
        return components(edges)
    held = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").toArrow()
    nodes, roots = settle(held.column("a").to_numpy(), held.column("b").to_numpy())
    found = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())})
    return materialise(edges.sparkSession.createDataFrame(found), "cc-out")

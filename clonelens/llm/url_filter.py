"""URL filters: longest-rule verdicts and a Bloom filter cascade for listed keys.

The cascade is built over the corpus's complete key universe (every distinct host). Level 1 encodes the listed
keys, level 2 the unlisted keys that level 1 lets pass by mistake, level 3 the listed keys that level 2 holds by
mistake, and so on until no mistake is left: membership is then exact for every key of the universe, and a page
is judged by probing bits, without a join. Keys are dealt to shards by hash, so each shard's cascade has a bounded
size and is built in one task from distinct keys only (a hot host is one key).

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is no listed key
(verdict allow); repeated rows are judged alike; an empty table gives no rows; an empty list lists nothing; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]
SHARD_KEYS = 200_000
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the fitting rule with the longest name (ties by host, then name), else null; one CASE."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _probe(keys: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    """Which 64-bit keys a level's bits hold. The level salts the two hashes, so that levels err independently."""
    size = np.uint64(len(bits) * 8)
    return np.all([(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for at in _places(keys, level, size)], axis=0)


def _places(keys: np.ndarray, level: int, size: np.uint64) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        return [(x + np.uint64(i) * y) % size for i in range(_HASHES[min(level, 1)])]


#: Hash functions of level 1 (wide: it meets the whole universe) and of the later levels.
_HASHES = (4, 2)
_BITS = (8, 4)


def build_levels(listed: np.ndarray, others: np.ndarray, max_levels: int = 200) -> list[np.ndarray]:
    """The cascade for 64-bit hashes: levels[0] holds the listed keys, levels[1] the others it passes, and so on."""
    levels: list[np.ndarray] = []
    inside, outside = listed, others
    while len(inside) and len(levels) < max_levels:
        level = len(levels)
        bits = np.zeros(max(8, len(inside) * _BITS[min(level, 1)] // 8 + 1), dtype=np.uint8)
        for at in _places(inside, level, np.uint64(len(bits) * 8)):
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        levels.append(bits)
        inside, outside = outside[_probe(outside, level, bits)] if len(outside) else outside, inside
    if len(inside):
        raise ValueError("two keys of the universe share a 64-bit hash")
    return levels


def is_member(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Exact for keys of the universe: the first level that lacks the key decides by its parity."""
    member = np.zeros(len(keys), dtype=bool)
    open_at = np.arange(len(keys))
    for level, bits in enumerate(levels):
        held = _probe(keys[open_at], level, bits).astype(bool)
        member[open_at[~held]] = level % 2 == 1
        open_at = open_at[held]
    member[open_at] = len(levels) % 2 == 1
    return member


def build_cascade(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """``universe(key)`` and ``listed(key)`` (any rows, repeats allowed) to ``shard, levels`` (array of binary).

    Listed keys outside the universe are encoded too. One groupBy over keys with map-side combining, no join.
    """
    rows = universe.select("key", F.lit(0).alias("on")).union(listed.select("key", F.lit(1).alias("on")))
    keys = materialise(rows.where("key is not null").groupBy("key").agg(F.max("on").alias("on")), "url-keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes = _hash(table.column("key").to_pylist())
        on = table.column("on").to_numpy() == 1
        levels = [b.tobytes() for b in build_levels(hashes[on], hashes[~on])]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n_shards": pa.array([shards], pa.int64()), "levels": pa.array([levels], pa.list_(pa.binary()))})

    dealt = keys.select("key", "on", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    return materialise(dealt.groupBy("shard").applyInArrow(run, "shard bigint, n_shards bigint, levels array<binary>"), "url-cascade")


def _hash(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8", "replace")) for k in keys), dtype=np.uint64, count=len(keys))


def probe_cascade(rows: DataFrame, cascade: DataFrame, key: str) -> DataFrame:
    """Add ``listed`` boolean to rows. The cascade is broadcast only when its measured size is under
    BROADCAST_BYTES; beyond it, shards are taken in blocks of that size, each block judging its own rows."""
    sizes = cascade.select("shard", "n_shards", F.aggregate("levels", F.lit(0), lambda a, x: a + F.length(x)).alias("bytes")).orderBy("shard").collect()
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, listed boolean"
    if not sizes:
        return rows.withColumn("listed", F.lit(False))
    blocks: list[list[int]] = [[]]
    held = 0
    for s in sizes:
        if blocks[-1] and held + s["bytes"] > BROADCAST_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append(s["shard"])
        held += s["bytes"]
    shards = sizes[0]["n_shards"]
    shard = F.pmod(F.xxhash64(key), F.lit(shards))
    out = None
    for block in blocks:
        part = cascade if len(blocks) == 1 else cascade.where(F.col("shard").between(block[0], block[-1]))
        sent = rows.sparkSession.sparkContext.broadcast({r["shard"]: [bytes(b) for b in r["levels"]] for r in part.collect()})
        own = rows.withColumn("url_shard", F.coalesce(shard, F.lit(block[0])))
        if len(blocks) > 1:
            # a shard number that got no keys belongs to the block whose range it falls in
            low = 0 if block is blocks[0] else block[0]
            high = shards if block is blocks[-1] else blocks[blocks.index(block) + 1][0]
            own = own.where((F.col("url_shard") >= low) & (F.col("url_shard") < high))
        judged = own.mapInArrow(_prober(sent, key), schema)
        out = judged if out is None else out.union(judged)
    return out


def _prober(sent, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascades = {s: [np.frombuffer(b, dtype=np.uint8) for b in levels] for s, levels in sent.value.items()}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            encoded = table.column(key).combine_chunks().dictionary_encode()
            if isinstance(encoded, pa.ChunkedArray):
                encoded = encoded.combine_chunks()
            shard = table.column("url_shard").to_numpy()
            words = encoded.dictionary.to_pylist()
            codes = np.array(encoded.indices.fill_null(len(words)))
            hashes = np.append(_hash(words), np.uint64(0))
            listed = np.zeros(len(codes), dtype=bool)
            for s in np.unique(shard):
                rows = np.flatnonzero(shard == s)
                if s in cascades:
                    listed[rows] = is_member(hashes[codes[rows]], cascades[s])
            listed &= codes < len(words)
            yield from table.drop_columns(["url_shard"]).append_column("listed", pa.array(listed)).to_batches()

    return run


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``pages(id, url)`` to id, host, path, rule, verdict: the longest rule, else block for listed hosts."""
    parts = pages.select(F.col(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    universe = parts.where("host <> ''").select(F.col("host").alias("key"))
    probed = probe_cascade(parts, build_cascade(universe, listed), "host")
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return probed.select(
        id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
    )


def insecure_hosts(pages: DataFrame) -> DataFrame:
    """The list that the query uses: hosts that serve more than half of their pages without TLS."""
    url = F.col("url")
    hosts = pages.select(host_of(url).alias("key"), F.lower(url).startswith("http://").cast("int").alias("plain")).where("key <> ''")
    return hosts.groupBy("key").agg(F.sum("plain").alias("plain"), F.count(F.lit(1)).alias("n")).where("2 * plain > n").select("key")


def oracle_sql() -> str:
    """The query's result in DuckDB SQL."""
    rows = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {rows}),
rest AS (SELECT row_number() OVER () AS r, page_id, starts_with(lower(url), 'http://') AS plain, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
parts AS (SELECT r, page_id, plain, translate(regexp_extract(t, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
listed AS (SELECT host FROM parts WHERE host <> '' GROUP BY host HAVING 2 * sum(CASE WHEN plain THEN 1 ELSE 0 END) > count(*)),
fit AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS v FROM parts, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM parts LEFT JOIN fit USING (r)"""

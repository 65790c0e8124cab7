"""N-gram Jaccard join with a token-group matrix.

A text's set are its distinct word shingles. Texts of equal sets are one node. Two nodes link when their Jaccard
similarity reaches num / den; the join finds the connected components of all links, exactly:

1. Order: shingles that are frequent (counted over all texts) come last, the others by hash. A node's prefix are its
   first n - need + 1 shingles, ``need`` being the least overlap that any link of it has; linked nodes share one. At
   their first common shingle the places in the two prefixes add up to no more than ``stray``, so a shingle that no
   two holders have early enough is dropped.
2. Groups: of the nodes that hold a prefix shingle, one leads (that with the most frequent shingles in its prefix, as an
   original among its edited copies has). Nodes are compared with their leaders; linked ones form groups of similar
   documents. This is linear in the nodes, whatever the size of a family of copies.
3. Matrix: for every prefix shingle, the groups that hold it; for every group, the union of its members' shingles, as a
   bit table. A node outside a group that meets it at a first common shingle is a query: its overlap with any member is
   at most its size less the shingles that the union lacks. Only groups whose bound reaches the needed overlap are
   opened, and their members are compared.

Comparisons are cut short by signatures (a bit table of a set in which every shingle flips a bit: two sets differ in at
least as many shingles as their tables in bits); what is left is computed on the whole sets, which are read again for
these nodes only. Pairs inside a group need no comparison: their link changes no component. Work beyond the linear part
comes from nodes that share early shingles without a link: their signatures are compared, in blocks, but no row is
made for a pair that differs too much.

Sets are identified by 128-bit hashes of their content, shingles by 62 bits.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; a text
of fewer words than a shingle has its whole word sequence as its only shingle; repeated rows are one node; ties are
broken by node; a null doc_id is carried, and its component's id is the smallest doc_id that is not null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bit_table, classes, discard, free_names, in_table, materialise, utf8

#: Frequent shingles kept for the order, at most: it is a fixed bound on what is broadcast, not on what is joined.
FREQUENT = 1 << 18
FREQUENT_LEAST = 3
#: Shingles seen this often are joined by plain joins, which adaptive execution may split, and not by one task each.
HOT = 10_000
#: Groups up to this size are opened by a join; larger ones in blocks of members, against blocks of queries.
SMALL_GROUP, MEMBERS, ASKERS = 8, 4096, 4096
#: Bits of a signature, at least and at most; in between, the power of two from the set's size on.
LEAST_BITS, MOST_BITS = 256, 1 << 17
#: Sets up to this size carry the folded signature (LEAST_BITS) through the matrix: larger ones flip all of its bits.
FOLDED = 1500
FOLD = [f"f{i}" for i in range(LEAST_BITS // 64)]
PREFIX_SCHEMA = "doc_id bigint, text_key bigint, n_shingles bigint, key binary, frequent int, prefix array<bigint>, flips binary, held binary"


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` words; a link needs den * intersection >= num * union."""

    words: int = 3
    num: int = 90
    den: int = 100

    def need(self, n):
        """Least overlap of a set of n shingles with any set it links with."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.need(n) + 1


_BASE = 0x9E3779B97F4A7C15
_TRUE = np.array([True])


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)  # arrays wrap around silently
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text, A-Z lower-cased; 62 bits each."""
    own = utf8(text).lower().split()  # bytes: lower() changes A-Z only, split() parts at the six white-space characters
    if not own:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, own), dtype=np.uint64, count=len(own))
    size = min(words, len(own))
    last = len(own) - size + 1
    factor, out = _BASE + 2 * size, np.full(last, size, dtype=np.uint64)
    for i in range(size):
        out += hashes[i : i + last] * np.uint64(pow(factor, i + 1, 1 << 64))
    out = _mix(out) >> np.uint64(2)
    out.sort()
    return out[np.concatenate([_TRUE, out[1:] != out[:-1]])]


def key_of(tokens: np.ndarray) -> bytes:
    """Identity of a set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def signatures(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """Bit tables of a set: one whose bits every shingle flips, and one, twice as wide, whose bits are set where a
    shingle falls."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length()))
    low = tokens.astype(np.int64)
    flips = np.bincount(low & (bits - 1), minlength=bits) & 1
    held = np.bincount(low & (2 * bits - 1), minlength=2 * bits) > 0
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes(), np.packbits(held, bitorder="little").tobytes()


def folded(table: np.ndarray, size: int, flips: bool) -> np.ndarray:
    """A bit table (words in the last axis) brought to ``size`` words."""
    while table.shape[-1] > size:
        half = table.shape[-1] // 2
        table = table[..., :half] ^ table[..., half:] if flips else table[..., :half] | table[..., half:]
    return table


def words_of(table: pa.Scalar | bytes) -> np.ndarray:
    return np.frombuffer(table.as_buffer() if isinstance(table, pa.Scalar) else table, dtype="<u8")


def frequent_shingles(docs: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent shingles, rarest first, eighths of the logarithm of their counts, and the rank of the first that
    is hot. Every text is counted, in chunks of 2 million shingles a task; a
    chunk passes on what it holds FREQUENT_LEAST times. The order they give is used by both sides of the join, so
    its precision affects the work only, never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            on = n >= FREQUENT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(keys[on].astype(np.int64)), pa.array(n[on].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), join.words))
                size += len(held[-1])
                if size > 2_000_000:
                    yield counts()
                    held, size = [], 0
        if held:
            yield counts()

    rows = docs.select("text").mapInArrow(run, "token bigint, n bigint")
    counts = materialise(rows.groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    step = F.floor(F.log2("n") * 8).cast("int")  # a histogram of counts gives the cut; no task sorts all tokens
    steps = sorted(((r["step"], r["k"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, cut = 0, None
    for at, k in steps:
        total += k
        if total > FREQUENT:
            break
        cut = at
    tokens, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if cut is not None:
        top = counts.where(step >= cut).toArrow()
        tokens, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    discard(counts)
    order = np.lexsort((tokens, n))
    logs = np.minimum(255, 8 * np.log2(np.maximum(1, n[order]))).astype(np.uint8)
    return tokens[order].astype(np.uint64), logs, (1 << 62) + int(np.searchsorted(n[order], HOT))


class Order:
    """Ranks of shingles: hash order below 2**62, the frequent ones above it by frequency."""

    def __init__(self, frequent: np.ndarray, logs: np.ndarray):
        by = np.argsort(frequent, kind="stable")
        self.keys, self.places, self.logs = frequent[by], by.astype(np.uint64), logs

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """Sorted ranks of sorted tokens."""
        if not len(self.keys) or not len(tokens):
            return tokens
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        on = self.keys[at] == tokens
        return np.concatenate([tokens[~on], np.sort(self.places[at[on]]) + np.uint64(1 << 62)])

    def frequency(self, ranks: np.ndarray) -> int:
        """How frequent the shingles of some ranks are, all together: the sum of their logarithms."""
        on = ranks[ranks >= np.uint64(1 << 62)]
        return int(self.logs[(on - np.uint64(1 << 62)).astype(np.int64)].sum(dtype=np.int64))


def prefixes(docs: DataFrame, order, join: Join) -> DataFrame:
    """doc_id, set size, key, prefix and signatures of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Order(*order.value)
        for batch in batches:
            rows = []
            for doc_id, text_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens = shingles(text.as_py(), join.words)
                if not len(tokens):
                    rows.append((doc_id, text_key, 0, None, 0, [], None, None))
                    continue
                prefix = rank.ranks(tokens)[: join.prefix(len(tokens))]
                rows.append((doc_id, text_key, len(tokens), key_of(tokens), rank.frequency(prefix), prefix.astype(np.int64), *signatures(tokens)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["doc_id", "text_key", "n_shingles", "key", "frequent", "prefix", "flips", "held"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), text_key().alias("text_key"), "text").mapInArrow(run, PREFIX_SCHEMA)


def needed(a: Column, b: Column, join: Join) -> Column:
    """Least intersection with which sets of sizes a and b link: den * i >= num * (a + b - i)."""
    return F.ceil((join.num * (a + b)).cast("double") / float(join.num + join.den))


def sizes_fit(a: Column, b: Column, join: Join) -> Column:
    return join.den * F.least(a, b) >= join.num * F.greatest(a, b)


def stray(a, b, join: Join):
    """Most shingles that two linked sets of sizes a and b hold alone, both together. At their first common prefix
    shingle the shingles before it are such, so the two places there add up to no more."""
    most = (join.den - join.num) / (join.den + join.num) * (a + b) + 1e-6
    return F.floor(most) if isinstance(most, Column) else np.floor(most)


def near_pairs(pairs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """The pairs a, b whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i) for i in range(4))
            most = stray(n_a.to_numpy(), n_b.to_numpy(), join)
            differ = np.zeros(len(a), dtype=np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = words_of(x), words_of(y)
                size = min(len(x), len(y))
                differ[i] = np.bitwise_count(folded(x, size, True) ^ folded(y, size, True)).sum()
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(differ <= most))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("flips").alias("f_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("flips").alias("f_b"))
    both = pairs.join(left, "a").join(right, "b").where(sizes_fit(F.col("n_a"), F.col("n_b"), join))
    return both.select("a", "b", "n_a", "n_b", "f_a", "f_b").mapInArrow(run, "a bigint, b bigint")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """The pairs a, b whose whole sets reach the similarity, as a table. Sets are built again for the texts of these
    nodes only (others that share a bit with them fall out of the joins)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(nodes.select("node", "key", "text_key").join(ends, "node", "left_semi"), "wanted")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "text_key"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = table.value, set()
        for batch in batches:
            rows = []
            for i in np.flatnonzero(in_table(bits, batch.column(0).to_numpy())).tolist():
                tokens = shingles(batch.column(1)[i].as_py(), join.words)
                if not len(tokens):
                    continue
                key = key_of(tokens)
                if key not in seen:
                    seen.add(key)
                    rows.append((key, tokens.tobytes()))
            if len(seen) > 500_000:
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["key", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            on = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = words_of(x), words_of(y)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                on.append(join.den * shared >= join.num * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

    read = docs.select(text_key().alias("text_key"), "text").mapInArrow(sets, "key binary, tokens binary").dropDuplicates(["key"])
    keys = wanted.select("node", "key")
    named = pairs.join(keys.select(F.col("node").alias("a"), F.col("key").alias("k_a")), "a").join(keys.select(F.col("node").alias("b"), F.col("key").alias("k_b")), "b")
    left = named.join(read.select(F.col("key").alias("k_a"), F.col("tokens").alias("t_a")), "k_a").select("a", "b", "k_b", "t_a")
    both = left.join(read.select(F.col("key").alias("k_b"), F.col("tokens").alias("t_b")), "k_b").select("a", "b", "t_a", "t_b")
    out = materialise(both.mapInArrow(compare, "a bigint, b bigint"), "links")
    discard(wanted)
    return out


def shared_rows(nodes: DataFrame, hot: int, join: Join) -> DataFrame:
    """token, pos, node, n and the token's leader, of the prefix shingles at which a node can meet another one first,
    as a table. Most shingles have one holder and leave here, after the one shuffle of all prefixes."""
    share = F.lit((join.den - join.num) / (join.den + join.num))
    rows = nodes.select(F.posexplode("prefix").alias("pos", "token"), "node", "n", "frequent")
    late = F.col("pos") - share * F.col("n")
    lead = F.max(F.struct("frequent", "node", "n", "pos"))
    own = W.partitionBy("token").orderBy("late").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    usual = rows.where(F.col("token") < hot).repartition("token").withColumn("late", late).select("*", lead.over(own).alias("lead"), F.first("late").over(own).alias("first"), F.nth_value("late", 2).over(own).alias("second"))
    usual = usual.where(F.col("late") + F.when(F.col("late") == F.col("first"), F.col("second")).otherwise(F.col("first")) <= 1e-5)
    many = rows.where(F.col("token") >= hot)
    leads = many.groupBy("token").agg(lead.alias("lead"), F.count(F.lit(1)).alias("held")).where("held > 1")  # FREQUENT rows at most
    columns = ["token", "pos", "node", "n", "lead"]
    return materialise(usual.select(*columns).union(many.join(F.broadcast(leads), "token").select(*columns)), "shared-rows")


def leader_pairs(rows: DataFrame, join: Join) -> DataFrame:
    """Every node with the leader of each prefix shingle at which the two can meet first."""
    fit = rows.where("node <> lead.node").where(sizes_fit(F.col("n"), F.col("lead.n"), join) & (F.col("pos") + F.col("lead.pos") <= stray(F.col("n"), F.col("lead.n"), join)))
    return fit.select(F.greatest("node", "lead.node").alias("a"), F.least("node", "lead.node").alias("b")).distinct()


def matrix_pairs(rows: DataFrame, nodes: DataFrame, groups: DataFrame, hot: int, join: Join) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pairs of nodes of different groups, behind the bound of the token-group matrix; the queries(node, n, grp, size) of
    large groups, of whose members only the most alike are among the pairs; and the stored tables that these read.

    A node asks about another group at shingles that can be the first common one of a link (see ``stray``). Where the
    group is one node, their folded signatures must allow a link at once: this keeps edited copies that are too far
    from each other from meeting at the shingles of their common original, or at edits they share. Where it is more,
    the union of the group's shingles decides.
    """
    grouped = nodes.select("node", "n", *FOLD).join(groups, "node", "left").withColumn("grp", F.coalesce("root", "node"))
    stats = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))
    member = grouped.select("node", "grp", *FOLD).join(stats, "grp")
    told = rows.select("token", "pos", "node", "n").join(member, "node")

    def met(told: DataFrame) -> DataFrame:
        matrix = told.groupBy("token", "grp").agg(F.min("pos").alias("pos"), *(F.first(c).alias(c) for c in ("size", "least", "most", *FOLD)))
        q, g = told.alias("q"), matrix.alias("g")
        # the node of the smaller group asks (ties: smaller group id), so every pair of groups is asked from one side
        asks = (F.col("q.size") < F.col("g.size")) | ((F.col("q.size") == F.col("g.size")) & (F.col("q.grp") < F.col("g.grp")))
        fits = (join.den * F.col("q.n") >= join.num * F.col("g.least")) & (join.den * F.col("g.most") >= join.num * F.col("q.n"))
        largest = F.least(F.col("g.most"), F.floor(F.col("q.n") * join.den / join.num))
        first = F.col("q.pos") + F.col("g.pos") <= stray(F.col("q.n"), largest, join)
        differ = sum((F.bit_count(F.col(f"q.{f}").bitwiseXOR(F.col(f"g.{f}"))) for f in FOLD), F.lit(0))
        alike = (F.col("g.size") > 1) | F.coalesce(differ <= stray(F.col("q.n"), F.col("g.most"), join), F.lit(True))
        return q.join(g, (F.col("q.token") == F.col("g.token")) & asks & fits & first & alike).select("q.node", "q.n", "g.grp", "g.size", "g.least")

    # usual shingles: rows, matrix and join on one shuffle by shingle; hot ones: joins that can be split
    asked = met(told.where(F.col("token") < hot).repartition("token")).union(met(told.where(F.col("token") >= hot)))
    asked = materialise(asked.distinct(), "asked")
    alone = asked.where("size = 1").select(F.greatest("node", "grp").alias("a"), F.least("node", "grp").alias("b"))
    open_groups = materialise(opened(asked.where("size > 1"), nodes, groups, join), "open-groups")
    inside = open_groups.where(F.col("size") <= SMALL_GROUP).select(F.col("node").alias("x"), "grp").join(groups.select(F.col("node").alias("y"), F.col("root").alias("grp")), "grp")
    pairs = near_pairs(alone.union(inside.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))), nodes, join)
    large = open_groups.where(F.col("size") > SMALL_GROUP)
    if not large.isEmpty():
        pairs = pairs.union(open_large(large, nodes, groups, join, True))
    return pairs.distinct(), large, [asked, open_groups]


def unions(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """grp and the union of its members' shingles as a bit table; each task sums up its own before the shuffle."""

    def merged(tables: list[np.ndarray]) -> np.ndarray:
        size = min(len(t) for t in tables)
        return np.bitwise_or.reduce([folded(t, size, False) for t in tables])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([t.tobytes() for t in sums.values()], pa.binary())], names=["grp", "held"])

        for batch in batches:
            for grp, table in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words_of(table)
                size += 0 if grp in sums else own.nbytes
                sums[grp] = merged([sums[grp], own]) if grp in sums else own.copy()
            if size > 32 << 20:
                yield told()
                sums, size = {}, 0
        if sums:
            yield told()

    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int64()), "held": pa.array([merged([words_of(x) for x in table.column("held")]).tobytes()], pa.binary())})

    members = groups.join(nodes.select("node", "held"), "node").select(F.col("root").alias("grp"), "held")
    kind = "grp bigint, held binary"
    return members.mapInArrow(partial, kind).groupBy("grp").applyInArrow(whole, kind)


def opened(asked: DataFrame, nodes: DataFrame, groups: DataFrame, join: Join) -> DataFrame:
    """The queries asked(node, n, grp, size, least) whose shingles in the group's union suffice for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, least = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            partner = np.maximum(least, -(-join.num * n // join.den))
            need = -(-join.num * (n + partner) // (join.num + join.den))
            lack = np.zeros(len(n), dtype=np.int64)
            for i, (own, union) in enumerate(zip(batch.column(5), batch.column(6))):
                own, union = words_of(own), words_of(union)
                size = min(len(own), len(union))
                lack[i] = np.bitwise_count(folded(own, size, False) & ~folded(union, size, False)).sum()
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["node", "n", "grp", "size"]).filter(pa.array(n - lack >= need))

    wanted = groups.join(asked.select(F.col("grp").alias("root")).distinct(), "root", "left_semi")
    union = unions(wanted, nodes).withColumnRenamed("held", "union")
    both = asked.join(nodes.select("node", "held"), "node").join(union, "grp").select("node", "n", "grp", "size", "least", "held", "union")
    return both.mapInArrow(run, "node bigint, n bigint, grp bigint, size bigint")


def open_large(large: DataFrame, nodes: DataFrame, groups: DataFrame, join: Join, nearest: bool) -> DataFrame:
    """Pairs of queries large(node, grp, size) and members of their groups whose signatures allow a link; ``nearest``: of
    every block, the member that differs least only. One link of a query with a group is enough, so the others are looked
    at for queries only that the first did not bring in.

    Blocks of at most about MEMBERS members meet blocks of about ASKERS queries in one task each; only pairs that
    pass leave it, so no row is made for a pair that does not.
    """

    def run(key: tuple[pa.Scalar, ...], asking: pa.Table, members: pa.Table) -> pa.Table:
        found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if asking.num_rows and members.num_rows:
            ids, sizes = members.column("member_node").to_numpy(), members.column("member_n").to_numpy()
            tables = [words_of(x) for x in members.column("member_flips")]
            width = min(map(len, tables))
            block = np.stack([folded(t, width, True) for t in tables])
            by_width = {width: block}
            for node, n, own in zip(asking.column("node").to_pylist(), asking.column("n").to_pylist(), asking.column("flips")):
                own = words_of(own)
                size = min(width, len(own))
                if size not in by_width:
                    by_width[size] = folded(block, size, True)
                differ = np.bitwise_count(by_width[size] ^ folded(own, size, True)).sum(axis=1)
                fits = (join.den * np.minimum(n, sizes) >= join.num * np.maximum(n, sizes)) & (differ <= stray(n, sizes, join)) & (ids != node)
                met = ids[fits]
                if nearest and len(met):
                    met = met[[np.argmin(differ[fits])]]
                found_a.append(np.maximum(met, node))
                found_b.append(np.minimum(met, node))
        return pa.table({"a": pa.array(np.concatenate(found_a)), "b": pa.array(np.concatenate(found_b))})

    counts = large.groupBy("grp").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("askers"))
    blocks = counts.select("grp", F.ceil(F.col("size") / MEMBERS).cast("int").alias("m"), F.ceil(F.col("askers") / ASKERS).cast("int").alias("q"))
    inside = groups.select("node", F.col("root").alias("grp")).join(blocks, "grp")
    asked = large.select("node", "grp").join(blocks, "grp")
    near = nodes.select("node", "n", "flips")
    place = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = asked.join(near, "node").select("grp", every("m").alias("mb"), place("q").alias("qb"), "node", "n", "flips")
    right = inside.join(near, "node").select("grp", place("m").alias("mb"), every("q").alias("qb"), "node", "n", "flips")
    right = right.toDF(*(f"member_{c}" for c in right.columns))  # the two sides must not share columns
    return left.groupBy("grp", "mb", "qb").cogroup(right.groupBy("member_grp", "member_mb", "member_qb")).applyInArrow(run, "a bigint, b bigint")


def with_fold(nodes: DataFrame) -> DataFrame:
    """nodes with the signature folded to LEAST_BITS, in signed words; nulls for sets so large that it tells nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("n")).to_pylist()
            flips = batch.column(batch.schema.get_field_index("flips"))
            none = [None] * len(FOLD)
            rows = [none if n > FOLDED else folded(words_of(x), len(FOLD), True).view("<i8").tolist() for x, n in zip(flips, sizes)]
            added = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(FOLD))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *FOLD])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, f"{kinds}, {', '.join(f'{x} bigint' for x in FOLD)}")


def similarity_classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, text_key (hash of the text), n_shingles, class (of an equal set or a component;
    null for an empty set)."""
    docs = docs.select("doc_id", "text")
    tokens, logs, hot = frequent_shingles(docs, join)
    sets = materialise(prefixes(docs, docs.sparkSession.sparkContext.broadcast((tokens, logs)), join), "prefixes")
    once = sets.where("key is not null").select("key", F.col("n_shingles").alias("n"), "frequent", "prefix", "flips", "held", "text_key").dropDuplicates(["key"])
    nodes = materialise(with_fold(once).withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = shared_rows(nodes, hot, join)
    near = materialise(near_pairs(leader_pairs(rows, join), nodes, join), "leader-pairs")
    first = links(docs, near, nodes, join)
    groups = classes(first)
    pairs, large, read = matrix_pairs(rows, nodes, groups, hot, join)
    rest = materialise(pairs.join(near, ["a", "b"], "left_anti"), "matrix-pairs")
    discard(rows)
    found, roots = first, groups
    if not rest.isEmpty():
        found = materialise(first.union(links(docs, rest, nodes, join)), "links-so-far")
        roots = classes(found)
    now = roots.select(F.col("node").alias("x"), F.col("root").alias("own"))
    apart = large.join(now, F.col("node") == F.col("x"), "left").drop("x").join(now.withColumnRenamed("own", "theirs"), F.col("grp") == F.col("x"), "left")
    apart = materialise(apart.where(F.coalesce("own", "node") != F.coalesce("theirs", "grp")).select("node", "grp", "size"), "apart")
    if not apart.isEmpty():
        tried = near.union(rest)
        again = materialise(open_large(apart, nodes, groups, join, False).distinct().join(tried, ["a", "b"], "left_anti"), "matrix-pairs")
        if not again.isEmpty():
            roots = classes(found.union(links(docs, again, nodes, join)))
    named = nodes.select("node", "key").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("class"))
    out = materialise(sets.select("doc_id", "text_key", "n_shingles", "key").join(named, "key", "left").drop("key"), "classes")
    discard(near, rest, apart, nodes, sets, *read)
    return out


def component_report(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The columns of the join contract: doc_id, n_shingles, component_id."""
    told = similarity_classes(docs, join)
    # stored, so that both sides of the join below are plain shuffles, which adaptive execution may split for a hot class
    lowest = materialise(told.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id")), "lowest")
    empty = told.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.where("class is not null").join(lowest, "class").select("doc_id", "n_shingles", "component_id").union(empty)


def one_per_class(docs: DataFrame, join: Join) -> DataFrame:
    """The row of smallest doc_id of every class, with all its columns; rows of empty sets stay. Of equal rows of a
    class one stays. Rows are told apart by doc_id and a hash of the text."""
    told = similarity_classes(docs, join).where("class is not null")
    first = told.groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.col("text_key"))).alias("stays"), F.count(F.lit(1)).alias("rows"))
    first = materialise(first.where("rows > 1"), "first")
    own = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.col("text_key"))
    dropped = told.join(first, "class").select(own.alias("own"), (own == F.col("stays")).alias("stays"))
    # grouped by row, not by class: a class of any size is spread over all tasks
    dropped = materialise(dropped.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.max("stays").alias("stays")), "dropped")
    near_id, near_key, slot = free_names(docs, "near_id", "near_key", "near_slot")
    named = dropped.select(F.col("own.doc_id").alias(near_id), F.col("own.text_key").alias(near_key), "stays", "n")
    named = named.withColumn(slot, F.xxhash64(near_id, near_key))
    keyed = docs.withColumn(near_id, F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).withColumn(near_key, text_key())
    keyed = keyed.withColumn(slot, F.xxhash64(near_id, near_key))
    # most rows are in no class of several: only the others are shuffled with their texts
    table = docs.sparkSession.sparkContext.broadcast(bit_table(named.where("not stays or n > 1"), slot))

    def split(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = batch.column(batch.schema.get_field_index(slot)).to_numpy()
                yield batch.filter(pa.array(in_table(table.value, slots) == inside))

        return keyed.mapInArrow(run, keyed.schema)

    kept = split(True).join(named.where("not stays").select(near_id, near_key), [near_id, near_key], "left_anti").select(*keyed.columns)
    again = named.where("stays and n > 1").select(near_id, near_key)
    if not again.isEmpty():  # equal rows: one of them
        once = kept.join(again, [near_id, near_key], "left_semi").dropDuplicates([near_id, near_key])
        kept = kept.join(again, [near_id, near_key], "left_anti").select(*keyed.columns).union(once.select(*keyed.columns))
    return split(False).select(*docs.columns).union(kept.select(*docs.columns))

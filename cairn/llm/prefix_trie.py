"""The tree of beginnings that conversations share.

A node is a distinct sequence of first turns (role and text); its members are the
conversations that begin with it, and the least of them owns it. A conversation that
owns a node owns all further ones on its way, so its nodes are one chain from a first
owned depth to its end. That depth is found by binary search, all conversations at
once: a round with step s looks at one depth of each, whose digest is joined with the
table of digests and their least members. Depths of a round are odd multiples of s, so
each of both tables' rows, kept by powers of two in their depth, is read in one round.

Chains hang on each other at the depth before their first own one. The sums of what
hangs on a chain go bottom-up by doubling: after k rounds a chain holds all that lies
less than 2^k chains below it. Along a chain, sums run from its end upwards in blocks.

A turn's digest is the SHA-256 of its role and text; a beginning's digest is the sum,
over its turns, of four 32-bit words of the SHA-256 of place and turn digest. Equal
digests of 128 bits are taken for equal beginnings: among n nodes the chance of one false
match is about n^2 / 2^129 (1e-15 for 1e12 nodes). Texts are not moved.

Turns are numbered by sorted ranges, so that one conversation may lie in many tasks, and
sums over depths run in blocks of BLOCK. The conversations that end at one node are
written as ranges of decimal numbers by many tasks, and hashed as a stream.

Defined cases: turns are ordered by turn, null first, equal ones by their digest; a null
role or text is empty; rows without a conv_id belong to no conversation and are left out;
repeated rows are turns of their own; an empty table has no root and gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import cut, scratch_path

#: Depths that one task sums, and bytes of conversation numbers in one row.
BLOCK, CHUNK_BYTES = 4096, 1 << 16
#: Turns that a conversation takes over at most, plus one; and conversations that share a base.
SHARED, FAMILY = 9, 5
LANES = [f"s{i}" for i in range(4)]
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _stored(df: DataFrame, name: str, by: str) -> DataFrame:
    """df as a table in the shared folder, in a folder for each value of a column."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, k (from 1), digest, bytes: the turns of each conversation in order."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(held(role)).cast("string").cast("binary"), F.lit(":").cast("binary"), held(role), held(text)), 256))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(held(text)).cast("long").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    # numbered inside sorted ranges; a conversation that lies in several is put together by their counts
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    rows = cut(rows, "sorted_turns")
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("low") + 1).alias("shift"))
    return cut(rows.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("k"), "digest", "bytes"), "turns")


def lengths(turns: DataFrame) -> DataFrame:
    """conv_id, len of every conversation."""
    return cut(turns.groupBy("conv_id").agg(F.count("*").alias("len")), "lengths")


def with_shared_starts(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of the base c - c % 5, then their own after their first h, h = crc32(c) % 9."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    plan = convs.select("conv_id", "len", base.alias("base"), h.alias("h"))
    plan = plan.join(convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len")), "base", "left")
    plan = cut(plan.withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0)))), "plan")
    starts = turns.where(F.col("k") < SHARED).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "taken"), "base").where("k <= taken")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("k > h").withColumn("k", F.col("k") - F.col("h") + F.col("taken"))
    both = starts.select("conv_id", "k", "digest", "bytes").unionByName(own.select("conv_id", "k", "digest", "bytes"))
    return cut(both, "rebuilt"), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len"))


def running(rows: DataFrame, by: str, depth: str, values: list[str], down: bool = True) -> DataFrame:
    """rows with the sums of values up to each depth of a group (down), or from it to the end, in blocks of BLOCK depths."""
    rows = rows.withColumn("_block", F.floor(F.col(depth) / BLOCK))
    order = (lambda c: F.asc(c)) if down else (lambda c: F.desc(c))
    totals = rows.groupBy(by, "_block").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy(by).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(totals.select(by, "_block", *(F.sum(v).over(earlier).alias(f"_{v}") for v in values)).where(F.col(f"_{values[0]}").isNotNull()), "offsets")
    inside = Window.partitionBy(by, "_block").orderBy(order(depth)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({v: F.sum(v).over(inside) for v in values}).join(offsets, [by, "_block"], "left")
    return rows.withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop("_block", *(f"_{v}" for v in values))


def _twos(depth: Column) -> Column:
    """How often two divides a depth."""
    return F.bit_count(depth.bitwiseAND(-depth) - 1).cast("int")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, hi, lo, bytes, twos: the digest of every beginning."""
    word = F.sha2(F.concat(F.col("k").cast("string").cast("binary"), F.lit(":").cast("binary"), "digest"), 256)
    rows = turns.select("conv_id", F.col("k").alias("depth"), "bytes", word.alias("word"))
    rows = rows.select("conv_id", "depth", "bytes", *(F.conv(F.substring("word", 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(LANES)))
    rows = running(rows, "conv_id", "depth", LANES)
    pair = lambda a, b: F.shiftleft(F.col(a).bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(F.col(b).bitwiseAND(0xFFFFFFFF))
    return _stored(rows.select("conv_id", "depth", pair("s0", "s1").alias("hi"), pair("s2", "s3").alias("lo"), "bytes", _twos(F.col("depth")).alias("twos")), "prefixes", "twos")


def minima(starts: DataFrame) -> DataFrame:
    """depth, hi, lo, owner, n_convs, bytes, twos: a row a node but the root."""
    nodes = starts.groupBy("twos", "depth", "hi", "lo").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    return _stored(nodes.select("depth", "hi", "lo", "owner", "n_convs", "bytes", "twos"), "minima", "twos")


def first_owned(convs: DataFrame, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, len, pos, parent: the greatest depth that a conversation does not own (0: all but the root), and who owns that."""
    state = cut(convs.select("conv_id", "len", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("parent")), "search")
    longest = convs.agg(F.max("len")).first()[0] or 0
    for twos in reversed(range(int(longest).bit_length())):
        probe = state.where(F.col("pos") + (1 << twos) <= F.col("len")).select("conv_id", (F.col("pos") + (1 << twos)).alias("depth"))
        probe = probe.join(starts.where(F.col("twos") == twos).select("conv_id", "depth", "hi", "lo"), ["conv_id", "depth"])
        met = probe.join(nodes.where(F.col("twos") == twos).select("depth", "hi", "lo", "owner"), ["depth", "hi", "lo"])
        met = met.where("owner <> conv_id").select("conv_id", "depth", "owner")
        state = cut(state.join(met, "conv_id", "left").select("conv_id", "len", F.coalesce("depth", "pos").alias("pos"), F.coalesce("owner", "parent").alias("parent")), "search")
    return state


def chain_totals(chains: DataFrame) -> DataFrame:
    """chains (conv_id, up, leaves, saved) with the sums over themselves and all chains below, by doubling."""
    while chains.where("up is not null").take(1):
        below = chains.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("also"))
        above = chains.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        rows = chains.join(below, "conv_id", "left").join(above, "up", "left")
        chains = cut(rows.select("conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("also", F.lit(0))).alias("saved")), "totals")
    return chains


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (owner, depth, conv_id) as lists of decimal numbers, each of one node."""
    node, first, held, size = None, 0, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"owner": [node[0]], "depth": [node[1]], "first": [first], "list": [",".join(held)]})

    for b in batches:
        for owner, depth, conv in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if node != (owner, depth) or size > CHUNK_BYTES:
                if held:
                    yield out()
                node, first, held, size = (owner, depth), conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's lists, which come in order."""
    node, state = None, None
    for b in batches:
        done: list[tuple[int, int, str]] = []
        for owner, depth, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if node == (owner, depth):
                state.update(b"," + text.encode())
                continue
            if node:
                done.append((*node, state.hexdigest()))
            node, state = (owner, depth), hashlib.sha256(text.encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("owner", "depth", "ends_sha256"), map(list, zip(*done, strict=True)), strict=True)))
    if node:
        yield pa.RecordBatch.from_pydict({"owner": [node[0]], "depth": [node[1]], "ends_sha256": [state.hexdigest()]})


def end_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of ends (owner, depth, conv_id): the numbers of a node in order, joined by commas."""
    order = ["owner", "depth", "conv_id"]
    rows = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_listed, "owner long, depth long, first long, list string")
    return rows.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(_hashed, "owner long, depth long, ends_sha256 string")


def trie(spark: SparkSession, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations given as turns (conv_id, k, digest, bytes) and convs (conv_id, len)."""
    top = convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    if not top.n:
        return spark.createDataFrame([], SCHEMA)
    root = F.lit(top.least).cast("long")
    starts = prefixes(turns)
    nodes = minima(starts)
    found = first_owned(convs, starts, nodes).withColumn("parent", F.coalesce("parent", root))
    chains = found.where((F.col("pos") < F.col("len")) | (F.col("conv_id") == root))
    hung = chains.where(F.col("conv_id") != root)
    places = hung.groupBy(F.col("parent").alias("conv_id"), F.col("pos").alias("depth")).agg(F.count("*").alias("n"))
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    goes_on = places.withColumnRenamed("depth", "len").select("conv_id", "len", F.lit(0).alias("leaf"))
    chains = chains.join(goes_on, ["conv_id", "len"], "left").join(own, "conv_id", "left")
    chains = cut(chains.select("conv_id", "len", "pos", "parent", F.coalesce("leaf", F.lit(1)).cast("long").alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved")), "chains")
    # what hangs on the root's own chain needs no sum of that chain, whose pointer would be everyone's
    below = chains.where(F.col("conv_id") != root)
    up = F.when(F.col("parent") != root, F.col("parent"))
    totals = chain_totals(cut(below.select("conv_id", up.alias("up"), F.col("leaf").alias("leaves"), "saved"), "totals"))
    hanging = below.select("conv_id", "parent", "pos").join(totals.select("conv_id", "leaves", "saved"), "conv_id")
    hanging = hanging.groupBy(F.col("parent").alias("owner"), F.col("pos").alias("depth")).agg(F.count("*").alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    whole = nodes.select("owner", "depth", "n_convs", "bytes").unionByName(spark.range(1).select(root.alias("owner"), F.lit(0).cast("long").alias("depth"), F.lit(top.n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes")))
    whole = whole.join(chains.select(F.col("conv_id").alias("owner"), "len", "pos", "parent", "leaf"), "owner").join(hanging, ["owner", "depth"], "left")
    zero = F.lit(0).cast("long")
    ending = F.when(F.col("depth") == F.col("len"), F.col("leaf")).otherwise(zero)
    whole = whole.select("owner", "depth", F.when(F.col("depth") > 0, F.when(F.col("depth") == F.col("pos") + 1, F.col("parent")).otherwise(F.col("owner"))).alias("parent_conv_id"), "n_convs", (F.coalesce("hung", zero) + (F.col("depth") < F.col("len")).cast("long")).alias("n_children"), (F.coalesce("hung_leaves", zero) + ending).alias("n_leaves"), (F.coalesce("hung_saved", zero) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    summed = running(cut(whole, "nodes"), "owner", "depth", ["n_leaves", "saved_tokens"], down=False)
    ends = found.select(F.when((F.col("pos") < F.col("len")) | (F.col("len") == 0) & (F.col("conv_id") == root), F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("len").alias("depth"), "conv_id")
    summed = summed.join(end_digests(ends), ["owner", "depth"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, rebuild: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a node, SCHEMA; rebuild may turn (turns, lengths) into others first."""
    turns = turns_of(conversations, conv_id, turn, role, text)
    convs = lengths(turns)
    if rebuild:
        turns, convs = rebuild(turns, convs)
    return trie(conversations.sparkSession, turns, convs)


SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, strlen(text) AS bytes, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS BIGINT) AS k, sha256(strlen(role) || ':' || role || text) AS g FROM t),
n AS (SELECT conv_id, count(*) AS len FROM o GROUP BY conv_id),
bits AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, len FROM n),
crc(conv_id, s, i, c) AS (SELECT conv_id, s, 0, 4294967295::BIGINT FROM bits UNION ALL
  SELECT conv_id, s, i + 1, list_reduce(list_prepend(xor(c, ascii(substr(s, i + 1, 1))::BIGINT), range(8)::BIGINT[]), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM crc WHERE i < length(s)),
h AS (SELECT conv_id, xor(c, 4294967295) % {SHARED} AS h, conv_id - conv_id % {FAMILY} AS base FROM crc WHERE i = length(s)),
p AS (SELECT h.conv_id, h.h, h.base, n.len, least(h.h, coalesce(b.len, 0)) AS taken FROM h JOIN n USING (conv_id) LEFT JOIN n b ON b.conv_id = h.base),
r AS (SELECT p.conv_id, o.k, o.g, o.bytes FROM p JOIN o ON o.conv_id = p.base AND o.k <= p.taken UNION ALL SELECT p.conv_id, o.k - p.h + p.taken, o.g, o.bytes FROM p JOIN o ON o.conv_id = p.conv_id AND o.k > p.h),
l AS (SELECT p.conv_id, count(r.k) AS len FROM p LEFT JOIN r USING (conv_id) GROUP BY p.conv_id),
f AS (SELECT conv_id, k AS depth, bytes, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY k)) AS key FROM r UNION ALL SELECT conv_id, 0, 0, 'root' FROM l),
d AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM f GROUP BY key, depth),
e AS (SELECT DISTINCT a.key, b.key AS parent FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
c AS (SELECT parent AS key, count(*) AS n FROM e GROUP BY parent),
u AS (SELECT DISTINCT a.key, b.key AS below FROM f a JOIN f b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
w AS (SELECT u.key, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved FROM u JOIN d ON d.key = u.below LEFT JOIN c ON c.key = u.below GROUP BY u.key),
x AS (SELECT f.key, string_agg(CAST(l.conv_id AS VARCHAR), ',' ORDER BY l.conv_id) AS ends FROM l JOIN f ON f.conv_id = l.conv_id AND f.depth = l.len GROUP BY f.key)
SELECT d.conv_id, CAST(d.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, d.n_convs, coalesce(c.n, 0) AS n_children, w.n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM d LEFT JOIN e USING (key) LEFT JOIN d q ON q.key = e.parent LEFT JOIN c ON c.key = d.key JOIN w ON w.key = d.key LEFT JOIN x ON x.key = d.key"""

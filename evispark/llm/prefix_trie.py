"""The prefix trie of conversations, grouped by multi-turn block digests first.

A turn at a position has two 64-bit hashes, and a prefix is the exclusive or of its turns' hashes, so a prefix's digest
comes from a scan along the conversation. Conversations are cut into blocks of ``BLOCK_TURNS`` turns, and conversations
that agree in a block and all before it are one bundle from there on. Where all conversations that reach a block share it,
its turns are nodes with the bundle's members as they are; turn boundaries are looked at only in blocks where siblings
differ.

The smallest member owns a node. What a conversation owns is one stretch of its path, from some depth to its end. So
sums over a subtree are sums over members: each member adds what it owns, and the owner of the top what it owns
from there on. No step follows the trie level by level, and nothing grows with the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evispark.llm.scratch import Scratch, written
from evispark.llm.ship import with_code
from evispark.operators.windows import positions

#: Turns of a block.
BLOCK_TURNS = 4
#: Rows of a conversation that a window orders at a time; longer conversations are scanned in pieces.
SCAN_ROWS = 4_096
#: Range of conversation ids whose digest text is made in one piece: so many ids are in it at most.
PIECE_IDS = 8_192
#: Conversations that share a start, and the turns of it that a rebuilt conversation takes at most.
FAMILY, LONGEST_START = 100, 6


def canonical_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` from 0, a turn's ``digest`` and the code points of its text, ``chars``.

    Turns are ordered by ``turn`` with null first; turns of equal number by the digest of role and text. A null role or text is
    empty. Rows without a conv_id are no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    return positions(turns, ["conv_id"], ["turn", "digest", "chars"], "pos").drop("turn")


def start_turns(conv_id: Column) -> Column:
    """Turns that a rebuilt conversation takes from its family's first conversation."""
    return F.crc32(conv_id.cast("string").cast("binary")) % LONGEST_START


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their family, if there is one.

    Takes and returns ``conv_id``, ``pos``, ``digest``, ``chars``. A family has ``FAMILY`` ids, so a first turn is never copied
    more often than that.
    """
    own = turns.withColumn("start", start_turns(F.col("conv_id")))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = own.groupBy("conv_id").agg(F.first("start").alias("start")).withColumn("first", first)
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < LONGEST_START))
    listed = F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("heads")
    heads = heads.groupBy(F.col("conv_id").alias("first")).agg(listed)
    convs = convs.join(heads, "first", "left").select("conv_id", "start", F.coalesce(F.size("heads"), F.lit(0)).alias("n"), "heads")
    taken = convs.select("conv_id", F.explode(F.slice("heads", 1, F.col("start").cast("int"))).alias("t")).select("conv_id", "t.*")
    convs = convs.select("conv_id", F.least("n", "start").alias("taken"))
    rest = own.filter(F.col("pos") >= F.col("start")).join(convs, "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("start") + F.col("taken")).alias("pos"), "digest", "chars")
    return taken.unionByName(rest)


def scanned(df: DataFrame, part: str, pos: str, kind: str, columns: Sequence[str], back: bool = False, rows: int = SCAN_ROWS) -> DataFrame:
    """Add ``run_`` columns: running aggregates along ``part`` up to and including each row, or from it on with ``back``.

    ``kind`` is ``bit_xor`` or ``sum``, ``columns`` are longs. ``pos`` is a number that settles the order. A long ``part`` is
    scanned in pieces of ``rows`` positions, and the pieces' totals are scanned after.
    """
    run = getattr(F, kind)
    order = F.desc if back else F.asc
    df = df.withColumn("_piece", F.floor(F.col(pos) / rows))
    totals = df.groupBy(part, "_piece").agg(*[run(c).alias(c) for c in columns])
    before = Window.partitionBy(part).orderBy(order("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(part, "_piece", *[run(c).over(before).alias(f"_b_{c}") for c in columns])
    inside = Window.partitionBy(part, "_piece").orderBy(order(pos)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.select("*", *[run(c).over(inside).alias(f"_r_{c}") for c in columns])
    joined = local.join(totals, [part, "_piece"])

    def merged(c: str) -> Column:
        here, earlier = F.col(f"_r_{c}"), F.coalesce(f"_b_{c}", F.lit(0).cast("long"))
        return (here.bitwiseXOR(earlier) if kind == "bit_xor" else here + earlier).alias(f"run_{c}")

    return joined.select(*[c for c in df.columns if c != "_piece"], *map(merged, columns))


def blocks_of(turns: DataFrame, size: int = BLOCK_TURNS) -> DataFrame:
    """A row per conversation and block: ``k``, the digest before it (``s1``, ``s2``), behind it (``e1``, ``e2``), and its turns."""
    hashed = turns.select(
        "conv_id", "pos", "chars", F.xxhash64(F.lit(1), "pos", "digest").alias("z1"), F.xxhash64(F.lit(2), "digest", "pos").alias("z2"),
    )
    grouped = hashed.groupBy("conv_id", F.floor(F.col("pos") / size).alias("k")).agg(
        F.bit_xor("z1").alias("x1"),
        F.bit_xor("z2").alias("x2"),
        F.sort_array(F.collect_list(F.struct("pos", "z1", "z2", "chars"))).alias("turns"),
    )
    run = scanned(grouped, "conv_id", "k", "bit_xor", ["x1", "x2"])
    return run.select(
        "conv_id", "k", F.col("run_x1").bitwiseXOR(F.col("x1")).alias("s1"), F.col("run_x2").bitwiseXOR(F.col("x2")).alias("s2"),
        F.col("run_x1").alias("e1"), F.col("run_x2").alias("e2"), "turns",
    )


def _prefixes() -> Column:
    """The turns of a block with their depth and the digests before (``q1``, ``q2``) and behind (``p1``, ``p2``) them."""

    def upto(n: Column, start: str, name: str) -> Column:
        return F.aggregate(F.slice("turns", 1, n), F.col(start), lambda a, t: a.bitwiseXOR(t[name]))

    return F.transform(
        F.col("turns"),
        lambda t, i: F.struct(
            (t["pos"] + 1).alias("depth"), t["chars"].alias("chars"), upto(i, "s1", "z1").alias("q1"), upto(i, "s2", "z2").alias("q2"),
            upto(i + 1, "s1", "z1").alias("p1"), upto(i + 1, "s2", "z2").alias("p2"),
        ),
    )


BUNDLE = ["k", "s1", "s2", "e1", "e2"]
NODE = ["depth", "p1", "p2"]


def _diverging(bundles: DataFrame) -> DataFrame:
    """Add ``apart``: whether conversations that agree up to a block differ in it. The first block always counts as such."""
    parents = bundles.filter("k > 0").groupBy("k", "s1", "s2").agg(F.count("*").alias("n")).filter("n > 1").select("k", "s1", "s2", F.lit(True).alias("_apart"))
    return bundles.join(parents, ["k", "s1", "s2"], "left").withColumn("apart", (F.col("k") == 0) | F.col("_apart").isNotNull()).drop("_apart")


def _nodes(bundles: DataFrame, aggregates: list[Column], kept: list[str]) -> DataFrame:
    """A row per node: turns of a bundle without siblings as they are, others grouped by their prefix."""
    turns = bundles.withColumn("t", F.explode(_prefixes())).select("apart", "t.*", *kept)
    whole = turns.filter(~F.col("apart")).drop("apart")
    met = turns.filter("apart").groupBy(*NODE).agg(F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("chars").alias("chars"), *aggregates)
    return whole.unionByName(met)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of each node, which come in order; a node's pieces are never held together."""
    current, digest = None, None
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, "ends"])

    for batch in batches:
        for *node, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if node != current:
                if current is not None:
                    out.append((*current, digest.hexdigest()))
                current, digest = node, hashlib.sha256()
                digest.update(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield table()
        out.clear()
    if current is not None:
        out.append((*current, digest.hexdigest()))
    yield table()


def _ends(last: DataFrame) -> DataFrame:
    """Per node the digest of the ascending ids of the conversations that end there (``conv_id`` and the node's key)."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = last.groupBy(*NODE, F.floor(F.col("conv_id") / PIECE_IDS).alias("piece")).agg(joined.alias("text"))
    # Nodes with one piece are done where they are; only those with more are ordered and read piece by piece.
    count = pieces.groupBy(*NODE).agg(F.count("*").alias("n"), F.first("text").alias("text"))
    one = count.filter("n = 1").select(*NODE, F.sha2(F.col("text").cast("binary"), 256).alias("ends"))
    more = pieces.join(count.filter("n > 1").select(*NODE), NODE)
    ranked = more.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "text")
    return one.unionByName(ranked.mapInArrow(_streamed, "depth long, p1 long, p2 long, ends string"))


def prefix_trie(turns: DataFrame, conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of conversations; ``turns`` has ``conv_id``, ``pos``, ``digest`` and ``chars``.

    ``conversations`` has the distinct ``conv_id`` of all members, with and without turns. Positions of a conversation are
    0 to n-1. A node is a distinct sequence of first turns, the root the empty one, and a row per node tells:
    ``conv_id`` (smallest member) and ``depth``, which identify it, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, members but one times the code points of the last text) and ``ends_sha256``.

    Without conversations there is no node. Two prefixes are equal when 128 bits of hashes are.
    """
    spark = with_code(turns.sparkSession)
    with Scratch(spark) as scratch:
        blocks = scratch.table(blocks_of(turns, block_turns))
        bundles = blocks.groupBy(*BUNDLE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
        bundles = scratch.table(_diverging(bundles))
        sums = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")]
        nodes = _nodes(bundles, sums, ["n_convs", "conv_id"])
        root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
        zero = F.lit(0).cast("long")
        root = root.select(*[zero.alias(c) for c in NODE], *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")], zero.alias("chars"), "n_convs", "conv_id")
        nodes = nodes.unionByName(root)
        children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
        nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
        nodes = scratch.table(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))

        owned = nodes.groupBy("conv_id").agg(
            F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves")
        )
        owned = scratch.table(owned)
        added = blocks.drop("turns").join(owned.drop("top"), "conv_id").groupBy(*BUNDLE).agg(F.sum("saved").alias("m_saved"), F.sum("leaves").alias("m_leaves"))
        added = bundles.drop("n_convs", "conv_id").join(added, BUNDLE, "left").fillna(0, ["m_saved", "m_leaves"])
        members = _nodes(added, [F.sum("m_saved").alias("m_saved"), F.sum("m_leaves").alias("m_leaves")], ["m_saved", "m_leaves"])
        members = members.select(*NODE, "m_saved", "m_leaves")
        whole = owned.agg(F.sum("saved").alias("m_saved"), F.sum("leaves").alias("m_leaves")).filter("m_leaves IS NOT NULL")
        members = members.unionByName(whole.select(*[zero.alias(c) for c in NODE], "m_saved", "m_leaves"))

        tops = nodes.join(owned.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).filter("depth > 0")
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
        tops = tops.select("conv_id", "depth", "q1", "q2").join(above, ["depth", "q1", "q2"]).select("conv_id", "depth", "parent_conv_id")

        ended = blocks.groupBy("conv_id").agg(F.max_by(F.struct("e1", "e2", F.element_at("turns", -1)["pos"].alias("pos")), "k").alias("e"))
        ended = conversations.select("conv_id").join(ended, "conv_id", "left")
        ended = ended.select("conv_id", F.coalesce(F.col("e.pos") + 1, zero).alias("depth"), F.coalesce("e.e1", zero).alias("p1"), F.coalesce("e.e2", zero).alias("p2"))

        own = scanned(nodes, "conv_id", "depth", "sum", ["saved"], back=True)
        result = own.join(members, NODE).join(_ends(ended), NODE, "left").join(owned.select("conv_id", "top", F.col("saved").alias("all_saved")), "conv_id")
        result = result.join(tops, ["conv_id", "depth"], "left")
        parent = F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id"))
        none = hashlib.sha256().hexdigest()
        return written(
            result.select(
                "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("m_leaves").alias("n_leaves"),
                (F.col("m_saved") - F.col("all_saved") + F.col("run_saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
            )
        )


def op11_prefix_trie(spark, sf: str) -> DataFrame:
    """Query: the prefix trie of all conversations, rebuilt so that families share their first turns."""
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    ids = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return prefix_trie(rebuilt(canonical_turns(conversations)), ids)


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS body, turn
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(body)) - 1 AS pos FROM t),
ids AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS first,
    list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS state
  FROM (SELECT DISTINCT conv_id FROM t)),
starts AS (SELECT conv_id, first, xor(state, 4294967295::BIGINT) % {LONGEST_START} AS start FROM ids),
joined AS (
  SELECT s.conv_id, 0 AS part, n.pos, n.body, n.chars FROM starts s JOIN numbered n ON n.conv_id = s.first AND n.pos < s.start
  UNION ALL SELECT s.conv_id, 1, n.pos, n.body, n.chars FROM starts s JOIN numbered n ON n.conv_id = s.conv_id AND n.pos >= s.start),
turns AS (SELECT conv_id, chars, body, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM joined),
paths AS (
  SELECT conv_id, depth, chars, list(body) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, [] FROM starts),
longest AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, min(p.conv_id) AS conv_id, depth, any_value(chars) AS chars, count(*) AS n_convs,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = l.n), '')) AS ends_sha256
  FROM paths p JOIN longest l USING (conv_id) GROUP BY path, depth),
member AS (SELECT p.conv_id AS c, n.conv_id, n.depth, n.n_convs, n.chars FROM paths p JOIN nodes n ON p.path = n.path AND p.depth = n.depth),
kids AS (SELECT a.conv_id, a.depth, count(DISTINCT b.conv_id) AS n_children FROM member a JOIN member b ON a.c = b.c AND b.depth = a.depth + 1 GROUP BY ALL),
below AS (
  SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS x, b.depth AS xd, (b.n_convs - 1) * b.chars AS saved, coalesce(k.n_children, 0) AS kids
  FROM member a JOIN member b ON a.c = b.c AND b.depth >= a.depth LEFT JOIN kids k ON k.conv_id = b.conv_id AND k.depth = b.depth),
summed AS (SELECT conv_id, depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (kids = 0) AS n_leaves FROM below GROUP BY conv_id, depth),
parents AS (SELECT DISTINCT b.conv_id, b.depth, a.conv_id AS parent_conv_id FROM member a JOIN member b ON a.c = b.c AND b.depth = a.depth + 1)
SELECT n.conv_id, n.depth, p.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN summed s USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth) LEFT JOIN parents p USING (conv_id, depth)
"""

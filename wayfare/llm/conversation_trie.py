"""Prefix trie of conversations, with totals of every subtree, by a rollup in bands of depth.

A node is a distinct sequence of first turns. It is named by its depth and a 128-bit hash: the exclusive or of a hash of each turn
with its place, which a running value along the conversation gives. Places and running values come from range partitions
(``wayfare.operators.ordered``), so a conversation of any length is dealt over many tasks, and texts are read once and never shuffle.

Totals of subtrees: depths are cut into bands of ``BAND``. A node explodes to its ancestors within its band only, at most ``BAND``
rows, and sums by ancestor give each node the total of its subtree within the band. The tops of bands form a trie themselves, with
depths a ``BAND``-th of the old ones; the same rollup completes their totals, and a completed total goes from a band's top to the
node above it and that node's ancestors in its band. So the rounds are the logarithm of the greatest depth to the base ``BAND``.

The conversations that end in a node are hashed in numeric order. Ids are first joined to texts by block of ``BLOCK`` consecutive ids,
and the digest then runs over a node's blocks in turn, holding one of them at a time; a digest of one stream has no parallel form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.llm.tables import hold, text_of
from wayfare.operators.ordered import running, with_place

BAND = 16
BLOCK = 1 << 15
KEY = ["k1", "k2", "depth"]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: Two independent hashes: the second sees the fields in another order, behind a number.
_SALT = 0x5EED


def _hashes(*fields: Column) -> tuple[Column, Column]:
    return F.xxhash64(*fields), F.xxhash64(F.lit(_SALT), *reversed(fields))


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``turn``, the hash ``t1``, ``t2`` of role and text, and ``bytes`` of the text, for turns that have a conversation."""
    role, text = text_of(role_col), text_of(text_col)
    t1, t2 = _hashes(F.octet_length(role), role, text)
    ident, turn = F.col(f"`{conv_col}`").cast("long"), F.col(f"`{turn_col}`")
    return conversations.select(ident.alias("conv"), turn.alias("turn"), t1.alias("t1"), t2.alias("t2"), F.octet_length(text).cast("long").alias("bytes")).where("conv is not null")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: their turns (``conv``, ``depth``, ``t1``, ``t2``, ``bytes``) and their lengths (``conv``, ``length``).

    Conversation c takes the first h turns of conversation c - c % 5, and its own after its first h, where h = crc32(c) % 9.
    """
    placed = with_place(turns, ["conv"], ["turn", "t1", "t2", "bytes"])
    counts = hold(placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "conversations")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    bases = counts.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = counts.withColumns({"h": head, "base": F.col("conv") - F.col("conv") % 5}).join(bases, "base", "left")
    plan = hold(plan.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv", "n", "h", "base", "taken"), "plan")
    shape = ["depth", "t1", "t2", "bytes"]
    own = placed.join(plan, "conv").where("position >= h").select("conv", (F.col("taken") + F.col("position") - F.col("h") + 1).alias("depth"), *shape[1:])
    borrowed = placed.where("position < 8").withColumnRenamed("conv", "base").join(plan, "base").where("position < taken")
    turns = own.unionByName(borrowed.select("conv", (F.col("position") + 1).alias("depth"), *shape[1:]))
    lengths = plan.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return turns, lengths


def paths_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for every rebuilt conversation and node it passes, the root included: ``conv``, ``depth``, key, parent's key, ``bytes``, ``ends``."""
    p1, p2 = _hashes(F.col("depth"), F.col("t1"), F.col("t2"))
    chained = running(turns.select("conv", "depth", "bytes", p1.alias("p1"), p2.alias("p2")), ["conv"], ["depth"], xors={"k1": F.col("p1"), "k2": F.col("p2")})
    up = [F.col(k).bitwiseXOR(F.col(p)).alias(u) for k, p, u in (("k1", "p1", "u1"), ("k2", "p2", "u2"))]
    below = chained.join(lengths, "conv").select("conv", "depth", "k1", "k2", *up, "bytes", (F.col("depth") == F.col("length")).alias("ends"))
    nothing, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = lengths.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), nothing.alias("u1"), nothing.alias("u2"), zero.alias("bytes"), (F.col("length") == 0).alias("ends"))
    return below.unionByName(root)


def _lineage(paths: DataFrame) -> DataFrame:
    """``up``: the keys of a node and its ancestors within its band, from each path through it."""
    band = Window.partitionBy("conv", F.col("depth") - F.col("depth") % BAND).orderBy("depth")
    return paths.withColumn("up", F.collect_list(F.struct(*KEY)).over(band))


def _tops(paths: DataFrame) -> DataFrame:
    """The first level of every band, with depths counted in bands."""
    return paths.where(F.col("depth") % BAND == 0).withColumn("depth", F.floor(F.col("depth") / BAND))


def _above(paths: DataFrame) -> DataFrame:
    """For the top of each band but the first: the key of the node above it."""
    top = paths.where((F.col("depth") % BAND == 0) & (F.col("depth") > 0)).select("conv", *KEY)
    over = paths.where(F.col("depth") % BAND == BAND - 1).select("conv", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    return top.join(over, ["conv", "depth"]).groupBy(*KEY).agg(F.min("u1").alias("u1"), F.min("u2").alias("u2"))


def _sums(values: DataFrame, names: list[str]) -> DataFrame:
    return values.groupBy(*KEY).agg(*[F.sum(n).alias(n) for n in names])


def _spread(lines: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Sums by node of ``values``, each counted for its node and that node's ancestors within the band."""
    return _sums(values.join(lines, KEY).select(F.explode("up").alias("a"), *names).select("a.*", *names), names)


def rollup(paths: DataFrame, lines: DataFrame, values: DataFrame, names: list[str], deepest: int) -> DataFrame:
    """The sums of ``names`` over the subtree of every node (key and ``names``).

    ``paths`` (``conv`` and key) pass every node, ``lines`` gives each node its lineage ``up`` within the band, ``values`` its own numbers.
    """
    inside = _spread(lines, values, names)
    if deepest < BAND:
        return inside
    inside = hold(inside, "inside")
    tops = hold(_tops(paths.select("conv", *KEY)), "tops")
    top_lines = hold(_lineage(tops).groupBy(*KEY).agg(F.first("up").alias("up")), "top-lines")
    complete = rollup(tops, top_lines, _tops(inside), names, deepest // BAND)
    below = complete.withColumn("depth", F.col("depth") * BAND).join(_above(paths), KEY)
    handed = hold(_sums(below.select(F.col("u1").alias("k1"), F.col("u2").alias("k2"), (F.col("depth") - 1).alias("depth"), *names), names), "handed")
    return _sums(inside.unionByName(_spread(lines, handed, names)), names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key from its blocks in order; a block of texts is all that is held."""
    key, digest = None, hashlib.sha256()

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(KEY, key), ends_sha256=digest.hexdigest())])

    for batch in batches:
        for *now, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*KEY, "text"))):
            if now == key:
                digest.update(b",")
            else:
                if key is not None:
                    yield closed()
                key, digest = now, hashlib.sha256()
            digest.update(text.encode())
    if key is not None:
        yield closed()


def _ends(paths: DataFrame) -> DataFrame:
    """Key and ``ends_sha256`` of the nodes in which conversations end."""
    ended = paths.where("ends").select(*KEY, "conv", F.floor(F.col("conv") / BLOCK).alias("block"))
    texts = ended.groupBy(*KEY, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    ordered = texts.repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return ordered.mapInArrow(_digests, "k1 long, k2 long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, with ``COLUMNS`` and the key ``k1``, ``k2`` (root: 0, 0).

    ``turns`` has ``conv``, ``depth`` (1 to the conversation's length), the hash ``t1``, ``t2`` of a turn and its ``bytes``; ``lengths`` has
    ``conv`` and ``length`` of every conversation, also of those without turns. No conversations: no nodes.
    """
    paths = hold(paths_of(turns, lengths), "paths")
    seen = _lineage(paths).groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("u1").alias("u1"), F.first("u2").alias("u2"),
        F.first("bytes").alias("bytes"), F.first("up").alias("up"),
    )
    nodes = hold(seen, "nodes")
    parent = [F.col("u1").alias("k1"), F.col("u2").alias("k2"), (F.col("depth") - 1).alias("depth")]
    kids = nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = hold(known.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}).drop("bytes", "up"), "known")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = rollup(paths, nodes.select(*KEY, "up"), known.select(*KEY, "leaf", "saved"), ["leaf", "saved"], deepest)
    totals = totals.select(*KEY, F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    above = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    joined = known.drop("leaf", "saved").join(above, ["u1", "u2", "depth"], "left").join(totals, KEY).join(_ends(paths), KEY, "left")
    return joined.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))).select(*COLUMNS, "k1", "k2")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations once they are rebuilt, see ``rebuilt`` and ``prefix_trie``.

    * Turns go by ``turn``, null first; turns of equal number go by a hash of role and text, so runs agree. Repeated rows are turns of their own.
    * A null role or text counts as empty. Rows without a conversation id belong to none and are left out.
    * Texts of any length are hashed where they are read and go no further. Other columns, whatever their names, are not read.
    * An empty table has no conversations and gives no nodes.
    """
    return prefix_trie(*rebuilt(turns_of(conversations, conv_col, turn_col, role_col, text_col)))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{folder}/conversations.parquet")).select(*COLUMNS)


SQL = """
with recursive given as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as place, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
ids as (select conv_id, count(*) as n from given group by 1),
heads as (
  select conv_id, n, conv_id - conv_id % 5 as base, xor(list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 as h from ids),
plan as (select p.*, least(h, coalesce(b.n, 0)) as taken from heads p left join ids b on p.base = b.conv_id),
turns as (
  select p.conv_id, taken + place - h as depth, role, text from plan p join given g using (conv_id) where place > h
  union all select p.conv_id, place as depth, role, text from plan p join given g on g.conv_id = p.base where place <= taken),
chain as (
  select conv_id, 0::bigint as depth, '' as key, null::varchar as up, 0::bigint as bytes from plan
  union all select c.conv_id, t.depth, sha256(c.key || length(t.role) || ':' || t.role || t.text) as key, c.key as up, strlen(t.text) as bytes
  from chain c join turns t on t.conv_id = c.conv_id and t.depth = c.depth + 1),
lengths as (select conv_id, max(depth) as depth from chain group by 1),
ended as (select c.depth, c.key, string_agg(c.conv_id, ',' order by c.conv_id) as convs from chain c join lengths l on c.conv_id = l.conv_id and c.depth = l.depth group by 1, 2),
nodes as (select depth, key, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes from chain group by 1, 2),
known as (
  select n.*, p.conv_id as parent_conv_id, coalesce(k.n_children, 0) as n_children from nodes n
  left join nodes p on p.depth = n.depth - 1 and p.key = n.up
  left join (select depth - 1 as depth, up as key, count(*) as n_children from nodes where depth > 0 group by 1, 2) k on k.depth = n.depth and k.key = n.key),
below as (select distinct a.depth, a.key, b.depth as d, b.key as k from chain a join chain b on a.conv_id = b.conv_id and b.depth >= a.depth),
totals as (
  select b.depth, b.key, count(*) filter (where x.n_children = 0) as n_leaves, sum((x.n_convs - 1) * x.bytes)::bigint as saved_tokens
  from below b join known x on x.depth = b.d and x.key = b.k group by 1, 2)
select n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(e.convs, '')) as ends_sha256
from known n join totals t on t.depth = n.depth and t.key = n.key left join ended e on e.depth = n.depth and e.key = n.key
"""

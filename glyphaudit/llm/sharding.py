"""Operator 4: shards by a hierarchical weighted hash tree.

A document descends from the root to a region, a rack and a shard. At every level each child
draws ``-ln(u) / weight`` with ``u`` hashed from the document's key and the child's name, and
the least draw wins, so a child gets its weight's share. A draw depends on nothing but key,
child and weight: when weights change, documents move only into or out of the subtrees whose
weights changed. A further shard gets a region of its own, so it takes documents from all
others and nothing else moves. A weight of 0 drains a shard: nothing is placed there.

The law held is ``key``: doc_id and the number of shards decide. A null doc_id is a key of its
own, null texts have size 1 and the checksum of no bytes, repeated rows go to one shard, and
extra columns are not read. An empty table gives no rows. Slots are gapless in each shard, in
the order of bucket, doc_id, size and checksum; rows equal in all of these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shards of the layout that a cluster starts with; each later shard opens a region.
BASE = 8
#: Slots are counted for each shard and bucket, so no shard is sorted by one task.
BUCKETS = 1024

#: (region, rack, shard, weight)
Leaf = tuple[int, int, int, float]


def tree(n_shards: int, weights: dict[int, float] | None = None, base: int = BASE) -> list[Leaf]:
    """Two shards a rack and two racks a region for the first ``base`` shards, then a region for each."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    weight = {s: 1.0 for s in range(n_shards)} | (weights or {})
    if min(weight.values()) < 0 or not any(weight[s] for s in range(n_shards)):
        raise ValueError("weights can't be negative, nor all be 0")
    regions = -(-base // 4)
    return [(s // 4, s // 2, s, weight[s]) if s < base else (regions + s - base, -(-base // 2) + s - base, s, weight[s]) for s in range(n_shards)]


def _children(leaves: list[Leaf], level: int, parent: int | None) -> dict[int, float]:
    out: dict[int, float] = {}
    for leaf in leaves:
        if leaf[3] > 0 and (parent is None or leaf[level - 1] == parent):
            out[leaf[level]] = out.get(leaf[level], 0.0) + leaf[3]
    return out


LEVELS = ("region", "rack", "shard")


def _draw(key: Column, level: int, child: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{LEVELS[level]}|{child}")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(weight)


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key, as a column without any Python on the executors."""

    def descend(level: int, parent: int | None) -> Column:
        children = _children(leaves, level, parent)
        names = sorted(children)
        if len(names) == 1:
            chosen = F.lit(names[0])
        else:
            chosen = F.array_min(F.array(*[F.struct(_draw(key, level, c, children[c]).alias("draw"), F.lit(c).alias("child")) for c in names]))["child"]
        if level == 2:
            return chosen
        out = descend(level + 1, names[-1])
        for c in names[-2::-1]:
            out = F.when(chosen == c, descend(level + 1, c)).otherwise(out)
        return out

    return descend(0, None)


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def shard(docs: DataFrame, n_shards: int = BASE, weights: dict[int, float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, bucket`` for every row."""
    key, data = key_of(F.col("doc_id")), F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, tree(n_shards, weights)).alias("shard"),
        place(key, tree(n_shards + 1, weights)).alias("grown_shard"),
        F.pmod(F.conv(F.substring(F.md5(F.concat(key, F.lit("|bucket|"), F.crc32(data).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most n_shards * buckets rows, whatever the input: safe to broadcast.
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), "grown_shard", "bucket")


# -- the same in DuckDB -----------------------------------------------------------------------


def _sql_draw(level: int, child: int, weight: float) -> str:
    return f"(-ln((('0x' || substr(md5(k || '|{LEVELS[level]}|{child}'), 1, 13))::BIGINT::DOUBLE + 1.0) / {float(1 << 52)!r}) / {weight!r})"


def _sql_place(leaves: list[Leaf], level: int = 0, parent: int | None = None) -> str:
    children = _children(leaves, level, parent)
    names = sorted(children)
    below = {c: str(c) if level == 2 else _sql_place(leaves, level + 1, c) for c in names}
    if len(names) == 1:
        return below[names[0]]
    draws = {c: _sql_draw(level, c, children[c]) for c in names}
    cases = [f"WHEN {draws[c]} <= least({', '.join(draws[x] for x in names[i + 1 :])}) THEN {below[c]}" for i, c in enumerate(names[:-1])]
    return f"CASE {' '.join(cases)} ELSE {below[names[-1]]} END"


def sql(n_shards: int = BASE, buckets: int = BUCKETS) -> str:
    table = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
    return f"""
WITH crc AS (SELECT {table} AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS x FROM documents),
r AS (SELECT doc_id, k, (strlen(x) + 1)::BIGINT AS size,
  xor(list_reduce(list_transform(range(strlen(x)), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32,
  'key' AS law, ({_sql_place(tree(n_shards))})::INT AS shard, ({_sql_place(tree(n_shards + 1))})::INT AS grown_shard FROM d, crc),
b AS (SELECT *, (('0x' || substr(md5(k || '|bucket|' || text_crc32), 1, 8))::BIGINT % {buckets})::INT AS bucket FROM r)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard, bucket FROM b"""

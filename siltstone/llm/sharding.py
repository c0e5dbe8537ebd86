"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Law ``key``: a record goes to the shard with the highest score
``-weight / ln(u)``, where ``u`` in (0, 1) is a hash of the record's key and
the shard's number.  A shard that is added takes records only into itself, a
shard that is taken away gives only its own records to the others.

Slots number each shard's rows from 0 without gaps, by the key's hash.  Hash
ranges are ranked apart and joined by running totals, so no task holds a whole
shard; how many ranges there are does not change a slot.

Defined results: a null key hashes as the empty string; a null text has 16
bytes; rows with one key go to one shard and get slots in the order of their
text's checksum and size, so equal rows swap slots without a visible change;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

ROW_OVERHEAD = 16
SHARDS = 40
#: Rows that one task ranks, about; more rows make more ranges.
ROWS_PER_RANGE = 100_000
_BITS = 52


def _unit(key: Column, salt: Column) -> Column:
    """52 bits of a hash of key and salt, as an integer."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), salt)), 1, _BITS // 4), 16, 10).cast("long")


def best(key: Column, weights: list[float]) -> Column:
    """The best score of a string key and its shard, as a struct; ties go to the lower number."""
    scores = [
        F.struct((F.lit(-float(w)) / F.log((_unit(key, F.lit(str(s))) + F.lit(0.5)) / F.lit(float(1 << _BITS)))).alias("score"), F.lit(-s).alias("minus"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def key_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def shard(docs: DataFrame, weights: list[float], key_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot and grown_shard (the shard if one more of weight 1 joined)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = key_of(F.col(key_col))
    rows = docs.select(
        F.col(key_col).alias("doc_id"),
        key.alias("k"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _unit(key, F.lit("slot")).alias("h"),
    )
    ranges = max(1, docs.count() // (rows_per_range * sum(w > 0 for w in weights)))
    bits = min(max(ranges - 1, 0).bit_length(), _BITS)
    scored = rows.select("*", F.shiftright("h", _BITS - bits).alias("part"), best(F.col("k"), weights).alias("now"), best(F.col("k"), [0.0] * len(weights) + [1.0]).alias("new"))
    return _slots(scored.withColumns({"shard": (-F.col("now.minus")).cast("int"), "grown_shard": (-F.greatest("now", "new")["minus"]).cast("int")}).drop("now", "new"))


def _slots(placed: DataFrame) -> DataFrame:
    each = Window.partitionBy("shard", "part").orderBy("h", "k", "text_crc32", "size")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return (
        placed.withColumn("rank", F.row_number().over(each) - 1)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), [1.0] * SHARDS)


def _sql_crc_step(c: str, bits: int = 4) -> str:
    """``bits`` steps of CRC-32 (reflected polynomial 0xEDB88320) in SQL."""
    for _ in range(bits):
        c = f"xor(({c}) >> 1, (({c}) & 1) * {0xEDB88320})"
    return c


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS hx FROM documents),
b AS (
  SELECT doc_id, k, (length(hx) // 2 + {ROW_OVERHEAD})::BIGINT AS size,
    ('0x' || substr(md5(k || ':slot'), 1, {_BITS // 4}))::BIGINT AS h,
    list_prepend(4294967295::BIGINT, CASE WHEN hx = '' THEN []::BIGINT[] ELSE
      list_transform(string_split(regexp_replace(hx, '(.)(.)', '\\2\\1', 'g'), ''), lambda x: instr('0123456789ABCDEF', x) - 1) END) AS nibbles FROM d),
p AS (
  SELECT doc_id, k, size, h, xor(list_reduce(nibbles, lambda a, y: {_sql_crc_step("xor(a, y)")}), 4294967295::BIGINT) AS text_crc32 FROM b),
u AS (
  SELECT p.k, s, -1.0 / ln((('0x' || substr(md5(p.k || ':' || s), 1, {_BITS // 4}))::BIGINT + 0.5) / {1 << _BITS}.0) AS score
  FROM (SELECT DISTINCT k FROM p) p, range({SHARDS + 1}) r(s)),
a AS (
  SELECT k, arg_max(s, score) FILTER (s < {SHARDS}) AS shard, arg_max(s, score) AS grown_shard FROM u GROUP BY k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY h, k, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard
FROM p JOIN a USING (k)
"""

r"""Benchmark decontamination by spaced-seed hashing.

Texts become tokens: runs of letters, marks and numbers, in lower case.  A
mask names the token positions that a seed looks at and passes over the rest,
so a substitution there leaves the seed alone.  Every position of every text
is hashed under each mask and joined with the hashes of the benchmark items;
a hit fixes an alignment (item, shift).  Around the hit a window of 16 item
tokens is compared token by token with the text, and the hit counts when at
least 75 of 100 tokens agree, whatever the substitutions between.

Items shorter than the longest mask (10 tokens) have one seed, all of their
tokens, and are found as exact runs: an item of one word takes every document
with that word.  Their lengths (nine at most) are those that occur.

Only hits leave the map side: with the benchmark's hashes below a checked size
they are broadcast, beyond it the join shuffles.  Verified texts are read again
for the documents with hits alone: the hits are counted, and while they are
few they go to the documents by broadcast, else both meet by a shuffle of the
documents that a first semi join with the hits leaves.

Defined results: null or empty texts match nothing; documents are told apart
by id (null is a value) and text, so repeated rows give one result; a text of
any length is searched whole, and its hits are rows, never one array; a window
that runs over an end of the text is compared there as no agreement, and the
tokens reported are the text's; an empty table on either side gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, let, read, written

#: Token positions that each seed compares.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 2, 3, 6, 8, 9))
SPAN = max(m[-1] for m in MASKS) + 1
WINDOW = 16
LEAD = 4
MIN_PERCENT = 75
#: Benchmark hashes up to this many rows (32 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000
#: Hits up to this many rows (about 200 bytes each) are broadcast.
BROADCAST_HITS = 100_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", -1), "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _seeds(hashes: Column) -> Column:
    """The seeds of all positions: those of the first mask, then those of the second, and so on."""

    def under(w: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - SPAN), lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + o) for o in MASKS[k]]))

    def of(w: Column) -> Column:
        each = [under(w, k) for k in range(len(MASKS))]
        return F.when(F.size(w) >= SPAN, F.concat(*each)).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, of)


def _runs(w: Column, sizes: list[int]) -> Column:
    """Position and hash of every run of tokens of the given lengths."""
    none = F.array().cast("array<struct<p:int,h:bigint>>")
    of = lambda n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("p"), F.xxhash64(F.lit(-n), F.slice(w, i + 1, F.lit(n))).alias("h")))
    return F.concat(*[F.when(F.size(w) >= n, of(n)).otherwise(none) for n in sizes])


def _hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Distinct (document, item, window start in the item, shift) of all seed hits."""
    positions = F.size("w") - (SPAN - 1)
    place = lambda n: F.col("p") % n
    items = (
        bench.select("item_id", "w", F.posexplode(_seeds(F.col("w"))).alias("p", "h"))
        .select("item_id", "h", place(positions).cast("int").alias("ip"), F.greatest(F.least(place(positions) - LEAD, F.size("w") - WINDOW), F.lit(0)).cast("int").alias("from"))
        .distinct()
    )
    # n: how many positions, so that the seed's number gives its position
    seeds = docs.select("id", "t", (F.size("w") - (SPAN - 1)).alias("n"), _seeds(F.col("w")).alias("s")).select("id", "t", "n", F.posexplode("s").alias("p", "h"))
    found = seeds.join(few(items, BROADCAST_ROWS), "h").select("id", "t", "item_id", "from", (place(F.col("n")).cast("int") - F.col("ip")).alias("shift")).distinct()
    sizes = sorted(r[0] for r in bench.filter(F.size("w") < SPAN).select(F.size("w")).distinct().collect())  # nine at most
    if sizes:
        short = bench.filter(F.size("w") < SPAN).select("item_id", F.xxhash64(-F.size("w"), "w").alias("h")).distinct()
        runs = docs.select("id", "t", F.explode(_runs(F.col("w"), sizes)).alias("x")).select("id", "t", F.col("x.p").alias("p"), F.col("x.h").alias("h"))
        found = found.union(runs.join(few(short, BROADCAST_ROWS), "h").select("id", "t", "item_id", F.lit(0).alias("from"), F.col("p").alias("shift")).distinct())
    return found


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _verified(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """id, t (the text's hash), item_id, at, size, matches and tokens (of the text) of every hit that counts."""
    keyed = docs.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("t"), F.col(text_col).alias("text"))
    items = bench.select(F.col(item_col).alias("item_id"), token_hashes(F.col(item_text_col)).alias("w")).filter(F.size("w") > 0).distinct()
    hits = _hits(keyed.select("id", "t", token_hashes(F.col("text")).alias("w")), items)
    parts = hits.join(items.withColumnRenamed("w", "iw"), hits["item_id"].eqNullSafe(items["item_id"])).select(
        hits["id"].alias("hid"), hits["t"].alias("ht"), hits["item_id"], (F.col("from") + F.col("shift")).alias("at"), F.slice("iw", F.col("from") + 1, F.lit(WINDOW)).alias("part"), (F.size("iw") < SPAN).alias("whole")
    )
    parts = written(parts.distinct(), "hits")
    parts = few(parts, BROADCAST_HITS)
    named = parts.select("hid", "ht").distinct()
    mine = lambda other: keyed["id"].eqNullSafe(other["hid"]) & (keyed["t"] == other["ht"])
    # Only texts with hits are cut into tokens again.
    texts = keyed.join(few(named, BROADCAST_HITS), mine(named), "left_semi").distinct().select("id", "t", token_hashes(F.col("text")).alias("w"))
    both = texts.join(parts, texts["id"].eqNullSafe(parts["hid"]) & (texts["t"] == parts["ht"]))
    same = F.filter("part", lambda v, j: (F.col("at") + j >= 0) & F.coalesce(F.get("w", F.col("at") + j) == v, F.lit(False)))
    seen = both.select("id", "t", "item_id", "at", "whole", F.size("part").alias("size"), F.size(same).alias("matches"), F.size("w").alias("tokens"))
    return seen.filter(f"if(whole, matches = size, 100 * matches >= {MIN_PERCENT} * size)").drop("whole")


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per contaminated document (id and text) and item: doc_id, item_id, n_windows, best_matches, first_token and end_token (exclusive)."""
    seen = _verified(docs, bench, id_col, text_col, item_col, item_text_col)
    return (
        seen.groupBy("id", "t", "item_id")
        .agg(
            F.count_distinct("at").alias("n_windows"),
            F.max("matches").cast("long").alias("best_matches"),
            F.min(F.greatest("at", F.lit(0))).cast("long").alias("first_token"),
            F.max(F.least(F.col("at") + F.col("size"), "tokens")).cast("long").alias("end_token"),
        )
        .withColumnRenamed("id", "doc_id")
        .drop("t")
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no verified overlap with the benchmark, with the columns they came with."""
    bad = written(_verified(docs, bench, id_col, text_col, item_col, item_text_col).select("id", "t").distinct(), "contaminated")
    return docs.join(few(bad, BROADCAST_HITS), docs[id_col].eqNullSafe(bad["id"]) & (_text_hash(text_col) == bad["t"]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SQL_SEED = " UNION ALL ".join(
    f"SELECT *, i AS pos, {k} AS mask, concat_ws(' ', {', '.join(f'w[i + {o + 1}]' for o in m)}) AS seed FROM (SELECT *, unnest(range(len(w) - {SPAN - 1})) AS i FROM {{0}} WHERE len(w) >= {SPAN})" for k, m in enumerate(MASKS)
)
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS ({_SQL_SEED.format("d")}),
bs AS ({_SQL_SEED.format("b")}),
hits AS (
  SELECT DISTINCT doc_id, item_id, greatest(least(bs.pos - {LEAD}, len(bs.w) - {WINDOW}), 0) AS f, ds.pos - bs.pos AS shift
  FROM ds JOIN bs USING (mask, seed)),
brief AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS run FROM b WHERE len(w) BETWEEN 1 AND {SPAN - 1}),
runs AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM brief) WHERE len(w) >= n)),
v AS (
  SELECT doc_id, item_id, f + shift AS place, len(b.w[f + 1:f + {WINDOW}]) AS size, len(d.w) AS tokens,
    len(list_filter(range(f, least(f + {WINDOW}, len(b.w))), lambda j: j + shift >= 0 AND j + shift < len(d.w) AND d.w[j + shift + 1] = b.w[j + 1])) AS matches
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
  UNION ALL SELECT doc_id, item_id, i, n, i + n, n FROM runs JOIN brief USING (n, run))
SELECT doc_id, item_id, count(DISTINCT place) AS n_windows, max(matches)::BIGINT AS best_matches,
  min(greatest(place, 0))::BIGINT AS first_token, max(least(place + size, tokens))::BIGINT AS end_token
FROM v WHERE 100 * matches >= {MIN_PERCENT} * size GROUP BY doc_id, item_id
"""

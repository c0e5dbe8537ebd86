"""Item similarity: exact cosine, its features, and SimHash with banding."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .evaluation import values_by

FEATURES = ("itemcf_max_sim", "itemcf_top3_mean_sim", "itemcf_has_neighbor")


def incidence(train: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Distinct (userId, movieId) of liked ratings."""
    return train.filter(F.col("rating") >= threshold).select("userId", "movieId").distinct()


def busiest(liked: DataFrame, max_users: int | None, max_items: int | None) -> DataFrame:
    """The rows of the users with most likes, then of their most liked items."""
    for key, most in (("userId", max_users), ("movieId", max_items)):
        if most is not None:
            top = liked.groupBy(key).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), key).limit(most)
            liked = liked.join(top.select(key), key, "left_semi")
    return liked


def cosine(liked: DataFrame) -> DataFrame:
    """src, dst, sim of all pairs of items with a user in common: count / sqrt(c_src * c_dst), both directions."""
    counts = written(liked.groupBy("movieId").agg(F.count(F.lit(1)).alias("c")), "likes")
    one = lambda side: liked.select("userId", F.col("movieId").alias(side))
    # Each unordered pair is counted once, then mirrored.
    both = one("src").join(one("dst"), "userId").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    sized = both
    for side, name in (("src", "cs"), ("dst", "cd")):  # pairs are not shuffled again for the counts
        sized = values_by(sized.withColumnRenamed(side, "movieId"), counts.withColumnRenamed("c", name)).withColumnRenamed("movieId", side)
    half = sized.select("src", "dst", (F.col("k") / F.sqrt((F.col("cs") * F.col("cd")).cast("double"))).alias("sim"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))


def cosine_of(liked: DataFrame, queries: DataFrame) -> DataFrame:
    """``cosine`` with src among the ``queries`` (movieId); pairs of two other items are never made."""
    counts = liked.groupBy("movieId").agg(F.count(F.lit(1)).alias("c"))
    asked = liked.join(queries.select("movieId"), "movieId", "left_semi").select("userId", F.col("movieId").alias("src"))
    both = asked.join(liked.select("userId", F.col("movieId").alias("dst")), "userId").filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    sized = both.join(counts.toDF("src", "cs"), "src").join(counts.toDF("dst", "cd"), "dst")
    return sized.select("src", "dst", (F.col("k") / F.sqrt((F.col("cs") * F.col("cd")).cast("double"))).alias("sim"))


def brute_force(liked: DataFrame, queries: DataFrame, top_k: int = 50) -> DataFrame:
    """The exact neighbours of the ``queries`` (movieId) against all items."""
    return neighbours(cosine_of(liked, queries), top_k)


def neighbours(sims: DataFrame, top_k: int = 50) -> DataFrame:
    """The ``top_k`` most similar of each item, with their rank; ties go to the lower id."""
    ranked = sims.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst")))
    return ranked.filter(F.col("rank") <= top_k)


def mirrored(edges: DataFrame) -> DataFrame:
    """Edges and their mirror images, a row for each; no loops."""
    return edges.select("src", "dst", "sim").union(edges.select("dst", "src", "sim")).filter("src <> dst")


def symmetric(edges: DataFrame, how: str = "max") -> DataFrame:
    """Edges with their mirror images, the larger or the sum of the two; no loops."""
    return mirrored(edges).groupBy("src", "dst").agg((F.max if how == "max" else F.sum)("sim").alias("sim"))


def normalize_columns(columns: tuple[str, ...] | list[str] | str | None) -> list[str]:
    names = [columns] if isinstance(columns, str) else list(columns or FEATURES)
    unknown = [c for c in names if c not in FEATURES]
    if unknown:
        raise ValueError(f"unknown item similarity columns: {unknown}")
    return names


#: Bits of a user's filter for each pair, and the most words of 64 bits.
FILTER_BITS, FILTER_WORDS = 10, 4096


def _probes(movie: Column, words: Column) -> Column:
    """The two bits of a movie in a filter of so many words."""
    h = F.xxhash64(movie.cast("long"))
    return F.array(F.pmod(h, words * 64), F.pmod(F.shiftrightunsigned(h, 32), words * 64))


def met(pairs: DataFrame, liked: DataFrame, edges: DataFrame) -> DataFrame:
    """userId, movieId, j, sim: edges from a user's liked j to a movie, all that end in one of the user's ``pairs`` and some that do not.

    From the history, not from the pairs: a user's likes are few, and each goes
    to its edges with a Bloom filter of the user's pairs, so neither pairs times
    edges nor likes times edges are ever shuffled.  A join with the pairs takes
    out what the filter lets through in error.
    """
    listed = pairs.groupBy("userId").agg(F.collect_list("movieId").alias("m"))
    words = F.greatest(F.lit(1), F.least(F.ceil(F.size("m") * FILTER_BITS / 64), F.lit(FILTER_WORDS))).cast("long")
    bits = listed.select("userId", words.alias("words"), F.explode("m").alias("m")).select("userId", "words", F.explode(_probes(F.col("m"), F.col("words"))).alias("x"))
    masks = bits.groupBy("userId", "words", F.floor(F.col("x") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 64 as int))")).alias("mask"))
    by_word = masks.groupBy("userId", "words").agg(F.map_from_entries(F.collect_list(F.struct("at", "mask"))).alias("masks"))
    filters = by_word.select("userId", "words", F.transform(F.sequence(F.lit(0).cast("long"), F.col("words") - 1), lambda i: F.coalesce(F.col("masks")[i], F.lit(0).cast("long"))).alias("filter"))
    asked = liked.select("userId", F.col("movieId").alias("j")).join(filters, "userId")
    reached = asked.join(edges.select(F.col("src").alias("j"), F.col("dst").alias("movieId"), "sim"), "j")
    x = _probes(F.col("movieId"), F.col("words"))
    on = lambda i: F.expr("shiftrightunsigned(get(filter, cast(floor(_x[{0}] / 64) as int)), cast(_x[{0}] % 64 as int)) & 1 = 1".format(i))
    return reached.withColumn("_x", x).filter(on(0) & on(1)).select("userId", "movieId", "j", "sim")


def itemcf_features(pairs: DataFrame, liked: DataFrame, sims: DataFrame, leave_out: bool = True, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Similarity of the movie to the user's liked movies: the largest, the mean of the best three, and whether any.

    Of several ``sims`` of one src and dst the largest counts, so the rows of
    ``mirrored`` do.  With ``leave_out`` the user's own co-occurrences are taken out of counts and
    products.  Similarities that the top lists do not hold count as zero, the
    movie itself too; no history gives zeros.
    """
    names = normalize_columns(columns)
    counts = liked.groupBy("movieId").agg(F.count(F.lit(1)).alias("c"))
    reached = met(pairs, liked, sims.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    found = (
        reached.groupBy("userId", "movieId", "j").agg(F.max("sim").alias("sim"))
        .join(liked.withColumn("h", F.lit(1)), ["userId", "movieId"], "left")
        .withColumn("h", F.coalesce("h", F.lit(0)))
        .join(counts.toDF("movieId", "ci"), "movieId")
        .join(counts.toDF("j", "cj"), "j")
    )
    if leave_out:
        product = F.sqrt((F.col("ci") * F.col("cj")).cast("double"))
        left = F.greatest(F.col("cj") - 1, F.lit(1)) * F.greatest(F.col("ci") - F.col("h"), F.lit(1))
        found = found.withColumn("sim", F.greatest(F.col("sim") * product - F.col("h"), F.lit(0.0)) / F.sqrt(left.cast("double")))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("userId", "movieId").orderBy(F.desc("sim"), "j"))).filter("r <= 3")
    top = best.groupBy("userId", "movieId").agg(F.max("sim").alias("mx"), F.sum("sim").alias("s3"))
    sizes = liked.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    best_of = top.join(sizes, "userId").select("userId", "movieId", "mx", (F.col("s3") / F.least(F.lit(3), F.col("n"))).alias("m3"))
    values = {
        "itemcf_max_sim": F.coalesce("mx", F.lit(0.0)),
        "itemcf_top3_mean_sim": F.coalesce("m3", F.lit(0.0)),
        "itemcf_has_neighbor": (F.coalesce("mx", F.lit(0.0)) > 0).cast("int"),
    }
    return pairs.join(best_of, ["userId", "movieId"], "left").select(*pairs.columns, *[values[c].alias(c) for c in names])


#: An item of more likes is hot: its sums are begun where its likes are.
HOT_LIKES = 100_000


def sign_bits(liked: DataFrame, n_bits: int, seed: int) -> DataFrame:
    """movieId, bits: the signs of the sums of its users' random +1 and -1 (zero is on); 128 bits a digest."""
    words = range(-(-n_bits // 64))
    hexes = lambda w: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("simhash"), F.col("userId").cast("string"), F.lit(str(w // 2))))
    of = [F.conv(F.substring(hexes(w), w % 2 * 16 + 1, 16), 16, -10).cast("long").alias(f"h{w}") for w in words]
    # A long counts the users that have bit s of a word in its lower half, and those that have bit s + 32 in its upper half.
    counts = [F.sum(F.shiftrightunsigned(f"h{w}", s).bitwiseAND(F.lit(1 << 32 | 1))).alias(f"n{w}_{s}") for w in words for s in range(32)]
    # A like is shuffled as its user's words, not as its item's sums, which are a row for nearly each like; sums of hot items are.
    hot = liked.groupBy("movieId").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT_LIKES).select("movieId")
    cold, rest = (liked.join(F.broadcast(hot), "movieId", how).select("movieId", *of) for how in ("left_anti", "left_semi"))
    cold, rest = (likes.groupBy("movieId").agg(F.count(F.lit(1)).alias("n"), *counts) for likes in (cold.repartition("movieId"), rest))
    sums = cold.unionByName(rest)

    def on(b: int) -> Column:
        half, s = divmod(63 - b % 64, 32)  # the first bit is a word's highest
        both = F.col(f"n{b // 64}_{s}")
        users = F.shiftrightunsigned(both, 32) if half else both.bitwiseAND(F.lit((1 << 32) - 1))
        return (users * 2 >= F.col("n")).cast("long")

    return sums.select("movieId", F.array(*[on(b) for b in range(n_bits)]).alias("bits"))


def band_keys(liked: DataFrame, n_bits: int = 64, band_size: int = 8, seed: int = 0) -> DataFrame:
    """movieId, band, key: the bits of each band packed, the first bit lowest."""
    if n_bits % band_size:
        raise ValueError("n_bits must be a multiple of band_size")
    bits = sign_bits(liked, n_bits, seed)
    packed = [sum((F.shiftleft(F.get("bits", F.lit(b * band_size + i)), i) for i in range(band_size)), F.lit(0).cast("long")) for b in range(n_bits // band_size)]
    return bits.select("movieId", F.posexplode(F.array(*packed)).alias("band", "key"))


class _Lanes:
    """Items' band keys side by side in words of 62 bits, to compare all bands of two items by a few integer operations.

    A lane of ``x`` (the two words' difference) is zero, and the band shared, where
    neither the lane nor its lower bits plus all ones reach the lane's high bit.
    """

    def __init__(self, keys: DataFrame):
        row = keys.agg(F.max("band").alias("band"), F.max("key").alias("key")).first()
        self.bands, self.width = (row["band"] or 0) + 1, max((row["key"] or 0).bit_length(), 1)
        self.per = max(62 // self.width, 1)
        self.words = -(-self.bands // self.per)
        at = F.expr(f"shiftleft(key, cast((band % {self.per}) * {self.width} as int))")
        self.items = keys.groupBy("movieId").agg(*[F.sum(F.when(F.floor(F.col("band") / self.per) == w, at).otherwise(0)).alias(f"w{w}") for w in range(self.words)])

    def by_band(self, items: DataFrame, side: str) -> DataFrame:
        """The ``items`` with their words, a row for each band and its key, which the words hold."""
        key = lambda b: F.shiftrightunsigned(f"{side}{b // self.per}", b % self.per * self.width).bitwiseAND(F.lit((1 << self.width) - 1).cast("long"))
        return items.select("*", F.posexplode(F.array(*[key(b) for b in range(self.bands)])).alias("band", "key"))

    def high(self, w: int, below: int | None = None) -> int:
        """The high bits of a word's lanes, of the bands before ``below`` alone if it is given."""
        end = min(self.bands, self.bands if below is None else below)
        return sum(1 << (i * self.width + self.width - 1) for i in range(self.per) if w * self.per + i < end)

    def of(self, side: str) -> DataFrame:
        return self.items.toDF(side, *[f"{side}{w}" for w in range(self.words)])

    def shared(self, w: int) -> Column:
        """The high bits of the lanes in which src and dst have the same key."""
        x, high = F.col(f"src{w}").bitwiseXOR(F.col(f"dst{w}")), self.high(w)
        low = ((1 << self.width * self.per) - 1) & ~sum(1 << (i * self.width + self.width - 1) for i in range(self.per))
        return F.bitwise_not((x.bitwiseAND(F.lit(low).cast("long")) + F.lit(low).cast("long")).bitwiseOR(x)).bitwiseAND(F.lit(high).cast("long"))

    def any(self) -> Column:
        return reduce(or_, [self.shared(w) != 0 for w in range(self.words)])


#: So many items, or rows of their bands, that are asked with are broadcast; more are shuffled.
BROADCAST_ASKED = 500_000


def lsh_candidates(keys: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) of items with a band key in common; ``queries`` (movieId) limits src.

    Every item has a key in each band (``band_keys``).  A pair is made once, or in
    the first band that its items share, so pairs are never shuffled.  The items
    that are asked with go to all others, which are not shuffled by band either;
    with so few keys that most pairs share one, pairs are compared whole.
    """
    lanes = _Lanes(keys)
    asked = keys if queries is None else queries
    n = asked.select("movieId").distinct().count()
    src = lanes.of("src") if queries is None else lanes.of("src").join(queries.select(F.col("movieId").alias("src")).distinct(), "src", "left_semi")
    # By number and no key: adaptive execution would make few tasks of the items' few bytes, for many pairs each.
    dst = lanes.of("dst").repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if lanes.bands >= 1 << lanes.width and n <= BROADCAST_ASKED:
        return dst.join(F.broadcast(src), (F.col("src") != F.col("dst")) & lanes.any()).select("src", "dst")
    earlier = [F.element_at(F.array(*[F.lit(lanes.high(w, b)).cast("long") for b in range(lanes.bands)]), F.col("band") + 1).alias(f"m{w}") for w in range(lanes.words)]
    one = lanes.by_band(src, "src")
    found = lanes.by_band(dst, "dst").select("*", *earlier).join(F.broadcast(one) if n * lanes.bands <= BROADCAST_ASKED else one, ["band", "key"]).filter("src <> dst")
    first = reduce(and_, [lanes.shared(w).bitwiseAND(F.col(f"m{w}")) == 0 for w in range(lanes.words)])
    return found.filter(first).select("src", "dst")


def lsh_found(keys: DataFrame, sims: DataFrame) -> DataFrame:
    """The ``sims`` (src, dst, sim) of pairs with a band key in common, without making the other candidates."""
    lanes = _Lanes(keys)
    return sims.join(lanes.of("src"), "src").join(lanes.of("dst"), "dst").filter(lanes.any()).select(*sims.columns)


def lsh_neighbours(candidates: DataFrame, sims: DataFrame, top_k: int = 50) -> DataFrame:
    """Candidates ranked by exact cosine; those without a user in common leave."""
    return neighbours(candidates.join(sims, ["src", "dst"]), top_k)


def recall(found: DataFrame, exact: DataFrame, queries: DataFrame, candidates: DataFrame, n_items: int, top_k: int = 50) -> DataFrame:
    """One row: recall_at_10, recall_at_k (denominators 10 and ``top_k``) and candidate_ratio, over the queries."""
    asked = queries.select(F.col("movieId").alias("src"))
    both = found.select("src", "dst", F.col("rank").alias("rf")).join(exact.select("src", "dst", F.col("rank").alias("re")), ["src", "dst"])
    hits = both.groupBy("src").agg(F.count_if((F.col("rf") <= 10) & (F.col("re") <= 10)).alias("h10"), F.count_if((F.col("rf") <= top_k) & (F.col("re") <= top_k)).alias("hk"))
    sizes = candidates.groupBy("src").agg(F.count(F.lit(1)).alias("nc"))
    per = asked.join(hits, "src", "left").join(sizes, "src", "left").na.fill(0, ["h10", "hk", "nc"])
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.col("h10") / 10.0).alias("recall_at_10"),
        F.avg(F.col("hk") / float(top_k)).alias("recall_at_k"),
        (F.avg("nc") / float(n_items)).alias("candidate_ratio"),
    )

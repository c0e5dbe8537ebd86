r"""Near-duplicate detection: a signature-coordinate inverted join.

A document's set is its distinct word shingles.  Texts with one set are one
class; a class has a MinHash signature of ``K`` coordinates and is posted under
its coordinate-value pairs.  Two sets of similarity 0.8 collide in fewer than
``T`` coordinates with a chance below one in a million, so a pair matters only
with ``T`` collisions or more, and then:

* skip: a class needs ``T`` values that occur elsewhere, or it is never posted;
* prefix: of its values, rarest first, all but the last ``T - 1`` are posted,
  for two classes with ``T`` in common share one of those.  A very common value
  is posted only by classes that have hardly any other.

Groups of copies are linked without making their pairs.  In each posting list
all classes meet the one whose values are the commonest (the text that the
copies were made from, as a rule); links are contracted to components, and
lists of one component are done.  Short lists are compared pair by pair.  In
the others, classes that share too few shingles with any other component
leave, then all meet one from outside the list's main component.  What is left
then is compared inside a join: classes outside the main component with all
that are not of their own, where the shared shingles allow it.  So every pair with a
common posting is in one component, or compared, or too far apart for certain.
One rule links pairs, whatever list they come from: ``T`` collisions of the
signatures, and the similarity of the full sets.

Defined results: null and empty texts have the empty set, a component of their
own and are kept; a null id never names a component unless all its members'
ids are null; repeated rows are members of one class, each with a row of its
own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import drop_written, giving_back, key_name, read, ship, written

#: Coordinates of a signature, and the collisions that a candidate pair needs.
K, T = 24, 9
#: Posting lists of so many classes or fewer are compared pair by pair, longer ones inside a join; the rule is the same.
SHORT = 16
#: So many edges or fewer are made components by one task, more by steps over all; the result is the same.
FEW_EDGES = 500_000
#: Classes of a list that one task of the last join meets with the strays.
SALTED = 256
#: Texts are worked on in blocks of so many characters.
BLOCK_CHARS = 500_000

_rng = np.random.default_rng(20150608)
_TIMES = _rng.integers(1, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Similarity:
    """Shingle size in words, and the least similarity in percent."""

    words: int = 5
    percent: int = 80


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``BLOCK_CHARS`` characters; a longer text is a block by itself."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BLOCK_CHARS or i + 1 == len(texts):
            yield begin, [x or "" for x in texts[begin : i + 1]]
            begin, chars = i + 1, 0


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, end to end, and their offsets."""
    cp, offsets = spans.code_points(texts)
    upper = (cp >= 65) & (cp <= 90)
    cp = cp + (upper * np.uint32(32)).astype(np.uint32)
    starts, ends, first = spans.words(cp, offsets)
    with np.errstate(over="ignore"):
        word = spans.span_hash(cp, starts, ends)
        n = len(word)
        joined = np.zeros(max(n - size + 1, 0), np.uint64)
        for i in range(size):
            joined += word[i : n - size + 1 + i] * _WORD[i] if n >= size else 0
        joined = spans.mix(joined)
        out, bounds = [], np.zeros(len(texts) + 1, np.int64)
        for i in range(len(texts)):
            a, b = first[i], first[i + 1]
            if b - a >= size:
                made = np.unique(joined[a : b - size + 1])
            elif b > a:  # a short text is one shingle
                made = spans.mix(((word[a:b] * _WORD[: b - a]).sum(keepdims=True) + np.uint64(b - a)) * _WORD[63])
            else:
                made = joined[:0]
            out.append(made)
            bounds[i + 1] = bounds[i] + len(made)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), bounds


def _set_ids(flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits that stand for each set."""
    with np.errstate(over="ignore"):
        sums = [np.zeros(len(flat) + 1, np.uint64) for _ in range(2)]
        np.cumsum(spans.mix(flat * _WORD[62]), out=sums[0][1:])
        np.cumsum(spans.mix(flat ^ _WORD[61]), out=sums[1][1:])
        both = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], 1)
    raw = both.astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    sig = np.zeros((len(bounds) - 1, K), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            if len(full):
                sig[full, k] = np.minimum.reduceat(flat * _TIMES[k], bounds[:-1][full])
    return sig


def _sign(size: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in blocks(texts):
                flat, bounds = shingle_sets(part, size)
                sig = _signatures(flat, bounds).view(np.int64)
                full = (bounds[1:] > bounds[:-1])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * K)]).astype(np.int32)), pa.array(sig[full].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(bounds[1:] - bounds[:-1]), pa.array(_set_ids(flat, bounds), pa.binary()), lists], names=["id", "n", "node", "sig"]
                )

    return work


def _sets(size: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in blocks(batch.column(0).to_pylist()):
                flat, bounds = shingle_sets(part, size)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(flat, bounds), pa.binary()), lists], names=["node", "set"])

    return work


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """id, n (set size), node (the set's 128-bit name) and sig (empty for the empty set), one row per document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(giving_back(_sign(size)), f"id {kind}, n bigint, node binary, sig array<bigint>")


def postings(classes: DataFrame) -> DataFrame:
    """token, node, n and score (how common the class's values are): the prefix of each class with enough shared values."""
    values = classes.select("node", "n", F.posexplode("sig").alias("k", "v")).select("node", "n", F.xxhash64("k", "v").alias("token"))
    shared = values.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1")
    per = values.join(shared, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("list"), F.sum("freq").alias("score"))
    prefix = F.slice("list", F.lit(1), F.size("list") - (T - 1))
    return per.filter(F.size("list") >= T).select("node", "n", "score", F.explode(F.transform(prefix, lambda x: x["token"])).alias("token"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of all edges (a, b) of a task: trees hang themselves on lower ones that an edge leads to."""
    found = list(batches)
    if not found:
        return
    edges = pa.Table.from_batches(found)
    both = pa.concat_arrays([c for side in ("a", "b") for c in edges[side].chunks])
    nodes = pc.unique(both)
    nodes = nodes.take(pc.sort_indices(nodes))
    at = pc.index_in(both, nodes).to_numpy(zero_copy_only=False)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    label, was = np.arange(len(nodes)), None
    while was is None or (label != was).any():
        was, x, y = label, label[a], label[b]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield from pa.table({"node": nodes, "label": nodes.take(pa.array(label))}).to_batches(max_chunksize=10_000)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label (the component's least node) of all nodes of ``edges`` (a, b).

    A few edges are joined by one task, which spares the driver the stages of the
    loop; more are, by alternating large and small stars.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    if now.count() <= FEW_EDGES:
        kind = now.schema["a"].dataType.simpleString()
        labels = written(now.coalesce(1).mapInArrow(giving_back(_joined), f"node {kind}, label {kind}"), name)
        drop_written(now)
        return labels
    state = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Dealt by the node once: the steps below group and join by it.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").repartition("a").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "m").union(down.select("a", "m")).toDF("a", "b").filter("a <> b").distinct()
        last, now = now, written(small, name)
        drop_written(last)
        was, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _similar(percent: int, n: Column, m: Column, both: Column) -> Column:
    """Whether sets of ``n`` and ``m`` with ``both`` in common are similar."""
    return 100 * both >= percent * (n + m - both)


def _main(posts: DataFrame) -> DataFrame:
    """The component with the most classes in each list."""
    sizes = posts.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    return sizes.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"))


def _within_reach(posts: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``posts`` with ``shared``, the shingles of a class that one of another component has too, and ``weight``, how common those are; and those shingles (node, own).

    A pair to be compared has no more in common than either's ``shared``:
    classes that differ too much from all other components (copies changed too
    far to be linked, as a rule) leave, and the rest have a bound for each pair.
    """
    nodes = posts.select("node", "label").distinct()
    shingles = sets.join(nodes, "node").select("node", "label", F.explode("set").alias("s"))
    common = shingles.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("c")).filter("x <> y").select("s", "c")
    reach = written(shingles.join(common, "s").groupBy("node").agg(F.collect_list("s").alias("own"), F.sum("c").alias("weight")), "reach")
    shared = reach.select("node", F.size("own").cast("bigint").alias("shared"), "weight")
    return written(posts.drop("shared", "weight").join(shared, "node").filter(f"100 * shared >= {percent} * n"), "postings"), reach


def _beside_hubs(posts: DataFrame, sets: DataFrame, reach: DataFrame) -> DataFrame:
    """``posts`` with ``inside``, how many of a class's shared shingles the hub of its list has, and ``outside``, the others.

    The hub is the class with the commonest shingles: the text that copies were
    made from.  Copies share with each other what both have kept of it and what
    both have put in, so no more than the lesser ``inside`` and the lesser
    ``outside``.  Short lists need no hub: all is ``outside`` there.
    """
    hubs = posts.groupBy("token").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"), F.count(F.lit(1)).alias("c")).filter(F.col("c") > SHORT).drop("c")
    named = posts.join(hubs, "token", "left")
    met = named.filter("hub is not null").select("node", "hub").distinct().join(reach.select("node", "own"), "node")
    both = met.join(sets.toDF("hub", "of_hub"), "hub").select("node", "hub", F.size(F.array_intersect("own", "of_hub")).alias("inside"))
    return named.join(both, ["node", "hub"], "left").withColumn("inside", F.coalesce("inside", F.lit(0))).withColumn("outside", F.col("shared") - F.col("inside"))


class _Linker:
    """Compares pairs of classes; keeps what has been compared and linked."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes.select("node", "n", "sig"), sets, percent
        self.links: DataFrame | None = None  # between classes at first, then of classes to their components

    def compare(self, pairs: DataFrame) -> None:
        """Adds the linked ones of ``pairs`` (a, b)."""
        of = lambda side: self.classes.toDF(side, f"n{side}", f"s{side}")
        collisions = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
        close = pairs.join(of("a"), "a").join(of("b"), "b").filter(_similar(self.percent, F.col("na"), F.col("nb"), F.least("na", "nb"))).filter(collisions >= T).select("a", "b")
        both = F.size(F.array_intersect("xa", "xb"))
        full = close.join(self.sets.toDF("b", "xb"), "b").join(self.sets.toDF("a", "xa"), "a")
        found = written(full.filter(_similar(self.percent, F.size("xa"), F.size("xb"), both)).select("a", "b"), "links")
        self.links = found if self.links is None else self.links.union(found)

    def contract(self) -> DataFrame:
        """node, label of all linked classes; from here on the links are those labels, which later rounds begin with."""
        labels = components(self.links)
        self.links = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        return labels

    def meet_strays(self, posts: DataFrame) -> None:
        """Adds the links between classes outside a list's main component and all that are not of their own.

        The join has no sets in it and yields the pairs whose bound allows
        similarity, each in the first of the lists that it has in common.  Long
        lists are split by a salt.
        """
        lists = posts.groupBy("node").agg(F.collect_list("token").alias("tokens"))
        parts = posts.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALTED)).cast("int").alias("parts")).join(_main(posts), "token")
        kept = ("node", "label", "n", "inside", "outside", "tokens")
        of = lambda rows, side: rows.select("token", "salt", *[F.col(c).alias(f"{c}_{side}") for c in kept], *(["main"] if side == "a" else []))
        named = posts.join(lists, "node").select("token", *kept).join(parts, "token")
        stray = of(named.filter("label <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "a")
        rest = stray.join(of(named.withColumn("salt", F.pmod(F.xxhash64("node"), "parts").cast("int")), "b"), ["token", "salt"])
        once = (F.col("label_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
        near = _similar(self.percent, F.col("n_a"), F.col("n_b"), F.least("inside_a", "inside_b") + F.least("outside_a", "outside_b"))
        first = F.array_min(F.array_intersect("tokens_a", "tokens_b")) == F.col("token")
        pairs = rest.filter((F.col("label_a") != F.col("label_b")) & once & near & first).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        self.compare(written(pairs, "near-pairs"))  # written, as is ``posts``: one plan of all would weigh on the driver

    def label(self, posts: DataFrame) -> DataFrame:
        """``posts`` with the component of each node, of lists with more than one."""
        named = posts.drop("label").join(self.contract(), "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token")
        return written(named.join(open_, "token", "left_semi"), "postings")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Similarity | None = None) -> DataFrame:
    """One row per document: id, n (set size), node (class) and component_id (the least id of its component)."""
    like = similarity or Similarity()
    ship(docs.sparkSession)
    signed = written(signatures(docs, id_col, text_col, like.words), "signatures")
    classes = written(signed.filter("n > 0").groupBy("node", "n").agg(F.first("sig").alias("sig"), F.min("id").alias("rep")), "classes")
    posts = written(postings(classes).withColumn("label", F.col("node")), "postings")
    wanted = posts.select("node").distinct().join(classes.select("node", "rep"), "node")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # One document's text for each posted class; a repeated id may bring others, which the class's name tells apart.
    chosen = texts.join(wanted, texts["id"].eqNullSafe(wanted["rep"]), "left_semi").select("text")
    made = chosen.mapInArrow(giving_back(_sets(like.words)), "node binary, set array<bigint>")
    sets = written(made.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")), "sets")
    linker = _Linker(classes, sets, like.percent)

    node = lambda side: F.col("node").alias(side)

    def meet(hubs: DataFrame, by: str = "score") -> DataFrame:
        hub = hubs.groupBy("token").agg(F.max_by(F.struct("node", "label"), F.struct(by, "node")).alias("hub"))
        return posts.join(hub, "token").filter("label <> hub.label").select(node("a"), F.col("hub.node").alias("b")).distinct()

    linker.compare(meet(posts))
    posts = linker.label(posts)
    short = posts.join(posts.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= SHORT), "token", "left_semi")
    linker.compare(short.select("token", node("a"), F.col("label").alias("la")).join(short.select("token", node("b"), F.col("label").alias("lb")), "token").filter("a < b and la <> lb").select("a", "b").distinct())
    posts, _ = _within_reach(linker.label(posts), sets, like.percent)
    linker.compare(meet(posts, "weight").union(meet(posts.join(_main(posts), "token").filter("label <> main"))).distinct())
    posts, reach = _within_reach(linker.label(posts), sets, like.percent)
    linker.meet_strays(written(_beside_hubs(posts, sets, reach), "beside-hubs"))

    labels = linker.contract()
    per = classes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    named = per.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = per.join(named, "label").select("node", "component_id")
    linked = signed.filter("n > 0").select("id", "n", "node").join(named, "node").select("id", "n", "node", "component_id")
    return linked.union(signed.filter("n = 0").select("id", "n", "node", F.col("id").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Similarity | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's least id), one row per document."""
    found = link(docs, id_col, text_col, similarity)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Similarity | None = None) -> DataFrame:
    """One row of ``docs`` for each component: the one of the least id (null last), then of the least hash of all columns."""
    key = key_name(docs, "row_key")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash")))
    kept = near_duplicates(keyed, key, text_col, similarity).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), similarity=Similarity(words=4, percent=80))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e2 AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

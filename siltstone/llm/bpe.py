r"""Byte-level BPE by a global shuffle of distinct words, and decoding.

Texts are packed into units of bounded size.  Within a unit the pre-tokens are
found with their positions and the distinct ones go, in packed rows, to the
partition that their hash names; there each distinct word is encoded once.
The ids come back to the unit, which puts them in the order of the positions.
Rows are packed (one per unit and partition, compressed), for a row per
pre-token would be several times the input; a word comes once from a unit, so
no word is hot however frequent it is.  Decoding joins ids with the table of
token bytes, whose size is the vocabulary's.

Unit names are a partition and a number within it, so the input's partitions
must replay alike if an executor is lost.  Scans of files do; any other input
is first written to the shared folder.

Growth: a worker remembers the distinct words of its part up to
``REMEMBERED`` and then begins anew, so its memory is bounded and a word beyond
that may be encoded again.  A unit makes one row for each part that its words
go to; ``parts`` is the number of shuffle partitions, which a cluster sets by
the size of its input.

Defined results: null and empty texts have no ids and decode to no bytes;
repeated rows and null ids are rows of their own; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import give_back, giving_back, read, ship, vocabulary_path, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters in a unit, about, and in a block of texts that is cut at a time; a longer text is one by itself.
UNIT_CHARS = 12_000_000
BLOCK_CHARS = 1_000_000
#: Ids that one output batch holds, about.
BATCH_IDS = 250_000
#: Words that a worker remembers with their ids.
REMEMBERED = 2_000_000
#: Operators of a plan whose partitions replay alike.
_REPLAYED = ("Project", "Filter", "Relation", "SubqueryAlias", "LocalRelation", "Range")


@lru_cache(maxsize=2)
def ranks(name: str) -> dict[bytes, int]:
    with open(vocabulary_path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(name: str):  # noqa: ANN201  tiktoken's class
    import tiktoken

    # The pattern takes the whole text: pre-tokens are found before.
    return tiktoken.Encoding(name, pat_str=r"(?s).+", mergeable_ranks=ranks(name), special_tokens={})


@lru_cache(maxsize=2)
def token_table(name: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, and their offsets by id."""
    table = ranks(name)
    size = max(table.values()) + 1
    tokens = [b""] * size
    for token, rank in table.items():
        tokens[rank] = token
    offsets = np.zeros(size + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=offsets[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), offsets


def merge(word: bytes, table: dict[bytes, int]) -> list[int]:
    """BPE by its definition: the pair of least rank is merged, again and again (for tests)."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((table.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [table[p] for p in parts]


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.int64(len(a)).tobytes() + a.dtype.char.encode() + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=6).compress(raw)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, kind = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(chr(raw[at + 8]))
        out.append(np.frombuffer(raw, kind, n, at + 9))
        at += 9 + n * kind.itemsize
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned values in the narrowest type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _steps(rising: np.ndarray) -> np.ndarray:
    """The steps between rising numbers; their running sum gives the numbers back."""
    return _narrow(np.diff(rising, prepend=0))


def _planes(codes: np.ndarray) -> list[np.ndarray]:
    """The low and high bytes apart, which compress better than together."""
    raw = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(raw[:, i]) for i in range(4 if len(codes) and codes.max() >= 1 << 16 else 2)]


def _codes(planes: list[np.ndarray]) -> np.ndarray:
    raw = np.zeros((len(planes[0]), 4), np.uint8)
    for i, plane in enumerate(planes):
        raw[:, i] = plane
    return raw.reshape(-1).view("<u4")


class _Unit:
    """The distinct words of a unit, and the sequence of their numbers."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.chars = 0

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        cp, offsets = spans.code_points(texts)
        starts, first = spans.pre_tokens(cp, offsets)
        ends = np.append(starts[1:], len(cp))
        codes, seen = spans.number(cp, starts, ends)
        text, known = "".join(texts), self.known
        before = len(known)
        own = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(starts[seen].tolist(), ends[seen].tolist(), strict=True)], np.uint32)
        fresh = seen[own >= before]
        self.hashes.append(spans.span_hash(cp, starts[fresh], ends[fresh]))
        self.codes.append(own[codes])
        self.counts.append(np.diff(first))
        self.ids.append(ids)
        self.chars += len(cp)

    def rows(self, unit: int, parts: int, id_type: pa.DataType) -> pa.RecordBatch:
        """part, unit, kind, ids, data: words by part (kind 0), and the sequence (kind 1)."""
        codes, hashes = np.concatenate(self.codes), np.concatenate(self.hashes)
        self.codes, self.hashes = [], []
        # Words are numbered by frequency: small numbers are the common ones.
        order = np.argsort(-np.bincount(codes, minlength=len(self.known)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words, home = list(self.known), (hashes % np.uint64(parts)).astype(np.int64)[order]
        rows = []
        by_part = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[by_part], np.arange(parts + 1))
        for p in range(parts):
            own = by_part[edges[p] : edges[p + 1]]
            if len(own):
                raw = [words[i].encode() for i in order[own].tolist()]
                rows.append((p, 0, _pack(_steps(own), _narrow(np.array([len(w) for w in raw])), np.frombuffer(b"".join(raw), np.uint8))))
        rows.append((zlib.crc32(unit.to_bytes(8, "little")) % parts, 1, _pack(np.concatenate(self.counts).astype(np.uint32), *_planes(rank[codes]))))
        ids = pa.concat_arrays(self.ids)
        empty = pa.nulls(len(rows) - 1, pa.list_(id_type))
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(empty.type)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([unit] * len(rows)), pa.array([r[1] for r in rows], pa.int32()), pa.concat_arrays([empty, listed]), pa.array([r[2] for r in rows], pa.binary())],
            names=["part", "unit", "kind", "ids", "data"],
        )


def _spread(parts: int, id_type: pa.DataType) -> Callable:
    """Texts to packed rows (part, unit, kind, ids, data)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, unit = TaskContext.get().partitionId() << 32, _Unit()
        for batch in batches:
            ids, texts, a, chars = batch.column(0), batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars >= BLOCK_CHARS or i + 1 == len(texts):
                    unit.add(ids.slice(a, i + 1 - a), [x or "" for x in texts[a : i + 1]])
                    a, chars = i + 1, 0
                    if unit.chars >= UNIT_CHARS:
                        made = unit.rows(name, parts, id_type)
                        name, unit = name + 1, _Unit()  # the old one goes before its rows are sent
                        yield made
                        del made
        if unit.ids:
            yield unit.rows(name, parts, id_type)

    return work


def _encode(name: str) -> Callable:
    """Words to ids, each distinct word of a part once; sequences pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        flat = np.zeros(1 << 16, np.uint16 if max(ranks(name).values()) < 1 << 16 else np.uint32)
        bounds, used = np.zeros(1 << 12, np.int64), 0
        for batch in batches:
            out = []
            if len(known) > REMEMBERED:
                known, used = {}, 0
            for kind, data in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if kind:
                    out.append(data)
                    continue
                own, sizes, raw = _unpack(data)
                raw, ends = raw.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
                words, at = [], 0
                for end in ends:
                    words.append(raw[at:end])
                    at = end
                fresh = [w for w in words if w not in known]
                for word in fresh:
                    ids = encoding(name).encode_ordinary(word.decode())
                    n = len(known)
                    if n + 2 > len(bounds):
                        bounds = np.concatenate([bounds, np.zeros(len(bounds), np.int64)])
                    while used + len(ids) > len(flat):
                        flat = np.concatenate([flat, np.zeros(len(flat), flat.dtype)])
                    flat[used : used + len(ids)] = ids
                    used += len(ids)
                    bounds[n + 1] = used
                    known[word] = n
                at = np.array([known[w] for w in words], np.int64)
                ids, ends = spans.take(flat, bounds[: len(known) + 1], at)
                out.append(_pack(own, _narrow(np.diff(ends)), *_planes(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(out, pa.binary())], names=["part", "unit", "kind", "ids", "data"])

    return work


def _assemble(finish: Callable | None = None) -> Callable:
    """The ids of a unit's documents, by position, or what ``finish`` makes of them; what it took to make them goes back after each unit."""

    def work(unit: pa.Table) -> pa.Table:
        made = _in_order(unit)
        if finish:
            made = pa.Table.from_batches(list(finish(made.to_batches())))
        give_back()
        return made

    return work


def _in_order(unit: pa.Table) -> pa.Table:
    owns, sizes, flats, sequence, ids = [], [], [], None, None
    for kind, listed, data in zip(unit.column("kind").to_pylist(), range(unit.num_rows), unit.column("data").to_pylist(), strict=True):
        arrays = _unpack(data)
        if kind:
            sequence, ids = arrays, unit.column("ids").combine_chunks()
            ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).slice(listed, 1).flatten()
        else:
            owns.append(np.cumsum(arrays[0], dtype=np.int64))
            sizes.append(arrays[1].astype(np.int64))
            flats.append(_codes(arrays[2:]))
    counts, codes = sequence[0], _codes(sequence[1:])
    flat = np.zeros(0, np.uint32)
    ends = np.zeros(len(codes) + 1, np.int64)
    if owns:
        own, size = np.concatenate(owns), np.concatenate(sizes)
        bounds = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        at = np.empty(len(own), np.int64)
        at[own] = np.arange(len(own))
        flat, ends = spans.take(np.concatenate(flats), bounds, at[codes])
    of_docs = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    return pa.table({"id": ids, "ids": pa.ListArray.from_arrays(pa.array(of_docs.astype(np.int32)), pa.array(flat.astype(np.int32)))})


def _replays(df: DataFrame) -> bool:
    """Whether the plan is a scan of files, or of rows that the driver holds, with projections and filters alone."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return all(line.lstrip(" :+-").startswith(_REPLAYED) for line in lines if line.strip())


def _packed(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """Rows (part, unit, kind, ids, data) of encoded words, and of sequences."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not _replays(rows):
        rows = written(rows, "texts")
    kind = rows.schema["id"].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = f"part int, unit bigint, kind int, ids array<{kind.simpleString()}>, data binary"
    from pyspark.sql.pandas.types import to_arrow_type

    spread = rows.mapInArrow(giving_back(_spread(parts, to_arrow_type(kind))), packed).repartitionById(parts, "part")
    return spread.mapInArrow(giving_back(_encode(vocabulary)), packed)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id`` and ``ids`` (array of int), one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _packed(docs, id_col, text_col, vocabulary).groupBy("unit").applyInArrow(_assemble(), f"id {kind}, ids array<int>")


def decode_ids(flat: np.ndarray, ends: np.ndarray, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lists of ids that lie end to end, and their offsets."""
    table, offsets = token_table(vocabulary)
    raw, at = spans.take(table, offsets, flat)
    return raw, at[ends]


def _decode(vocabulary: str, summary: bool, with_ids: bool = False) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = np.asarray(batch.column(1).offsets).astype(np.int64)
            sizes = np.diff(bounds)
            begin = 0
            while begin < batch.num_rows:  # by pieces of bounded size
                end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + BATCH_IDS, "right")) - 1)
                flat = np.asarray(batch.column(1).values)[bounds[begin] : bounds[end]]
                ends = bounds[begin : end + 1] - bounds[begin]
                raw, at = decode_ids(flat, ends, vocabulary)
                ids = batch.column(0).slice(begin, end - begin)
                if summary:
                    words, data = memoryview(flat.astype("<u4").tobytes()), memoryview(raw.tobytes())
                    kept = [batch.column(1).slice(begin, end - begin)] if with_ids else []
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array(sizes[begin:end]),
                            pa.array([hashlib.sha256(words[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]),
                            pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]),
                            *kept,
                        ],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids,
                    )
                else:
                    data = raw.tobytes()
                    yield pa.RecordBatch.from_arrays([ids, pa.array([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["id", "bytes"])
                begin = end

    return work


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id`` and ``bytes`` of the rows (id, ids)."""
    ship(encoded.sparkSession)
    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(giving_back(_decode(vocabulary, False)), f"id {kind}, bytes binary")


def _digest_columns(kind: str, with_ids: bool) -> str:
    return f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids


def digests(encoded: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and ids) of the rows (id, ids): the ids are decoded for the last digest."""
    ship(encoded.sparkSession)
    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(giving_back(_decode(vocabulary, True, with_ids)), _digest_columns(kind, with_ids))


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``digests`` of ``encode``, by the worker that puts a unit's ids in order: a task holds one worker, not two."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _packed(docs, id_col, text_col, vocabulary).groupBy("unit").applyInArrow(_assemble(_decode(vocabulary, True, with_ids)), _digest_columns(kind, with_ids))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"))

r"""Token ids in word-aligned binary blocks (Simple-8b).

A 64-bit word holds a selector in its upper four bits and as many ids as fit in
the other sixty at the selector's width.  Ids of more than sixty bits are kept
in an escape table, and their words hold the place in it.  Ids are packed in
chunks of ``CHUNK``; a block stores where each chunk's words begin and where
each document ends, so any chunk decodes by itself and with array operations.

A block is (all numbers little-endian):

    b"S8B1" | u32 documents | u64 ids | u64 words | u64 escapes
    | u64 document end x documents | u64 first word x chunks | u64 word x words | u64 escape x escapes

Documents are ranged over partitions in ascending order of their id and each
partition writes its blocks in that order; the table of blocks is written with
Spark's commit protocol in the shared folder, so a lost executor's files are
written anew.

Defined results: null and empty texts are the end id alone; rows with null ids
come first; rows of one id follow each other by text; an empty table gives an
empty table.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spans
from .common import read, ship, vocabulary_path, written

VOCABULARY = "byte_bpe_50k.json"
END = 0
CHUNK = 8192
#: Characters that a block's texts hold, about; a longer text is a block by itself.
BLOCK_CHARS = 1_500_000
#: Words whose ids a worker remembers between blocks: 32 bytes each, and 4 for each id.
REMEMBERED = 2_000_000
#: New words that are encoded as one text.
JOINED = 256

#: Ids per word and bits per id by selector; selector 0 is an escape.
PACKINGS = [(1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNTS = np.array([c for c, _ in PACKINGS])
_MAGIC = b"S8B1"


def _choose(ids: np.ndarray) -> np.ndarray:
    """Per id, the selector that a word starting with it would have: the one of most ids that fit before the chunk's end."""
    choice = np.full(len(ids), 15, np.int64)
    widest = next((i for i in range(2, 16) if PACKINGS[i][1] >= int(ids.max()).bit_length()), 16) if len(ids) else 0
    at = np.arange(len(ids))
    for selector in range(min(widest, 14), 0, -1):
        count, bits = PACKINGS[selector]
        at = at[ids[at] < np.uint64(1 << bits)]
        if len(at) < count:
            break
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (at[1:] % CHUNK == 0)
        first = np.flatnonzero(new)
        after = np.append(first[1:], len(at))
        fits = np.repeat(at[after - 1] + 1, after - first) - at >= count
        if not fits.any():
            break  # nor does a longer run of narrower ids
        choice[at[fits]] = selector
    choice[ids >= np.uint64(1 << 60)] = 0
    return choice


def _reached(follow: np.ndarray, n: int) -> np.ndarray:
    """The places that are reached from 0 by ``follow``, where no step passes a chunk's end: chunks advance side by side, in doubled steps."""
    at = np.arange(0, n, CHUNK)
    stop = np.minimum(at + CHUNK, n)
    hit = np.zeros(n + 1, bool)
    hit[at] = True
    at, own = at.astype(np.int64), np.arange(len(at))
    for _ in range(14):  # 2 ** 14 steps are more than a chunk's words
        to = follow[at]
        ahead = to < stop[own]
        if not ahead.any():
            break
        at, own = np.concatenate([at, to[ahead]]), np.concatenate([own, own[ahead]])
        hit[to[ahead]] = True
        follow = follow[follow]
    return np.flatnonzero(hit[:n])


def pack(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A block of ids (unsigned, up to 64 bits); ``ends``: where each document ends."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    choice = np.concatenate([_choose(ids[i : i + 8 * CHUNK]) for i in range(0, n, 8 * CHUNK)] or [np.zeros(0, np.int64)])
    at = _reached(np.append(np.minimum(np.arange(n) + _COUNTS[choice], n), n), n)
    kinds, escapes = choice[at], ids[:0]
    words = kinds.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(kinds).tolist():
        count, bits = PACKINGS[selector]
        own = np.flatnonzero(kinds == selector)
        if selector == 0:
            words[own] |= np.arange(len(own), dtype=np.uint64)
            escapes = ids[at[own]]
        else:
            for k in range(count if bits else 0):
                words[own] |= ids[at[own] + k] << np.uint64(k * bits)
    firsts = np.searchsorted(at, np.arange(0, n, CHUNK))
    head = _MAGIC + struct.pack("<IQQQ", len(ends), n, len(words), len(escapes))
    return head + b"".join(np.asarray(a).astype("<u8").tobytes() for a in (ends, firsts, words, escapes))


def unpack(block: bytes, chunks: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids (of the given chunks alone, if any) and the document ends of a block."""
    if block[:4] != _MAGIC:
        raise ValueError("not a block of packed ids")
    n_docs, n_ids, n_words, n_escapes = struct.unpack_from("<IQQQ", block, 4)
    sizes = [n_docs, -(-n_ids // CHUNK), n_words, n_escapes]
    at, parts = 32, []
    for size in sizes:
        parts.append(np.frombuffer(block, "<u8", size, at))
        at += 8 * size
    ends, firsts, words, escapes = parts
    if chunks is not None:
        begin, end, _ = chunks.indices(len(firsts))
        bounds = np.append(firsts, n_words).astype(np.int64)
        words = words[bounds[begin] : bounds[max(begin, end)]]
    kinds = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[kinds]
    to = np.zeros(len(words) + 1, np.int64)
    np.cumsum(counts, out=to[1:])
    out = np.zeros(to[-1], np.uint64)
    for selector in np.unique(kinds).tolist():
        count, bits = PACKINGS[selector]
        own = np.flatnonzero(kinds == selector)
        if selector == 0:
            out[to[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif bits:
            values = words[own][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[to[own][:, None] + np.arange(count)] = values & np.uint64((1 << bits) - 1)
    return out, ends.astype(np.int64)


@lru_cache(maxsize=2)
def tokenizer(name: str):  # noqa: ANN201  the tokenizers library's class
    # One thread for each task: idle threads of the library's pool spin.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(vocabulary_path(name))
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    return loaded


@lru_cache(maxsize=2)
def _token_bytes(name: str) -> np.ndarray:
    """How many bytes each id of a byte-level vocabulary stands for: a token has one character for each."""
    sizes = tokenizer(name).get_vocab()
    out = np.zeros(max(sizes.values()) + 1, np.int64)
    out[np.fromiter(sizes.values(), np.int64, len(sizes))] = np.fromiter(map(len, sizes), np.int64, len(sizes))
    return out


class _Words:
    """The tokenizers library's ids of pre-tokens; each word is encoded once as long as it is remembered.

    Words are known by two 64-bit hashes of their characters; the first ones are
    kept in order beside the word's row.
    """

    def __init__(self, name: str):
        self.name = name
        self.forget()

    def forget(self) -> None:
        self.hashes, self.others, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.bounds, self.used, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0, 0

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids end to end, and how many each has.

        Words that begin with a blank are encoded as one text, ``JOINED`` at a time:
        the pattern cuts it at the blanks again, and tokens' bytes tell where.
        """
        sizes = np.zeros(len(words), np.int64)
        led = [i for i, w in enumerate(words) if w[0] == " " and len(w) > 1 and not w[1].isspace()]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        texts = ["".join([words[i] for i in led[at : at + JOINED]]) for at in range(0, len(led), JOINED)]
        apart = set(range(len(words))).difference(led)
        for k, made in enumerate(tokenizer(self.name).encode_batch_fast(texts, add_special_tokens=False)):
            own, ids = led[k * JOINED : (k + 1) * JOINED], np.array(made.ids, np.int64)
            ends = np.cumsum([len(words[i].encode("utf-8", "surrogatepass")) for i in own])
            reached = np.cumsum(_token_bytes(self.name)[ids])
            stop = np.searchsorted(reached, ends)
            if len(reached) and reached[-1] == ends[-1] and np.array_equal(reached[stop], ends):
                sizes[own] = np.diff(stop + 1, prepend=0)
                parts.append((np.array(own), ids))
            else:  # not cut as expected: each by itself
                apart.update(own)
        rest = sorted(apart)
        single = [e.ids for e in tokenizer(self.name).encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
        if rest:
            sizes[rest] = np.fromiter(map(len, single), np.int64, len(single))
            parts.append((np.array(rest), np.fromiter(chain.from_iterable(single), np.int64, int(sizes[rest].sum()))))
        order = np.concatenate([own for own, _ in parts])
        starts = np.append(0, np.cumsum(sizes[order]))
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return spans.take(np.concatenate([ids for _, ids in parts]).astype(np.uint32), starts, back)[0], sizes

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rows of the words of these hashes, -1 for new ones."""
        at = np.minimum(np.searchsorted(self.hashes, first), max(len(self.hashes) - 1, 0))
        if not len(self.hashes):
            return np.full(len(first), -1)
        return np.where((self.hashes[at] == first) & (self.others[at] == second), self.rows[at], -1)

    def ids(self, first: np.ndarray, second: np.ndarray, word: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of these hashes end to end, and their offsets; ``word`` gives the texts of places among them."""
        if self.n > REMEMBERED:
            self.forget()
        rows = self.find(first, second)
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            flat, sizes = self.encode(word(fresh))
            while self.n + len(fresh) >= len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros(len(self.bounds), np.int64)])
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.bounds[self.n + 1 : self.n + 1 + len(fresh)] = self.used + np.cumsum(sizes)
            self.used += len(flat)
            rows[fresh] = self.n + np.arange(len(fresh))
            self.n += len(fresh)
            # Of words with one first hash the one that is kept is found, the others are encoded each time.
            order = np.argsort(first[fresh], kind="stable")
            to = np.searchsorted(self.hashes, first[fresh][order])
            self.hashes, self.others, self.rows = (np.insert(a, to, b[fresh][order]) for a, b in ((self.hashes, first), (self.others, second), (self.rows, rows)))
        return spans.take(self.flat, self.bounds[: self.n + 1], rows)


@lru_cache(maxsize=2)
def _words(name: str) -> _Words:
    return _Words(name)


def token_ids(texts: list[str], name: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids end to end, ``end`` after each, and where each text's ids end."""
    cp, offsets = spans.code_points(texts)
    starts, first = spans.pre_tokens(cp, offsets)
    ends = np.append(starts[1:], len(cp))
    codes, seen, first_hash, second_hash = spans.number(cp, starts, ends, hashes=True)
    whole = "".join(texts)

    def word(at: np.ndarray) -> list[str]:
        return [whole[a:b] for a, b in zip(starts[seen[at]].tolist(), ends[seen[at]].tolist(), strict=True)]

    flat, bounds = _words(name).ids(first_hash, second_hash, word)
    ids, at = spans.take(flat, bounds, codes)
    stop = at[first[1:]]
    return np.insert(ids, stop, end), stop + np.arange(1, len(texts) + 1)


def _write(name: str, end: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids, texts, a, chars = batch.column(0), batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars < BLOCK_CHARS and i + 1 < len(texts):
                    continue
                flat, ends = token_ids([t or "" for t in texts[a : i + 1]], name, end)
                listed = pa.ListArray.from_arrays(pa.array([0, i + 1 - a], pa.int32()), ids.slice(a, i + 1 - a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([len(flat)]), listed, pa.array([pack(flat, ends)], pa.binary())],
                    names=["part", "seq", "before", "n_ids", "ids", "block"],
                )
                seq, before, a, chars = seq + 1, before + len(flat), i + 1, 0

    return work


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """The written table of blocks: part, seq, before (ids of earlier blocks of the part), n_ids, ids (document ids) and block."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    return written(ordered.mapInArrow(_write(vocabulary, end), f"part int, seq int, before bigint, n_ids bigint, ids array<{kind}>, block binary"), "token-blocks")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            flat, ends = unpack(batch.column("block")[i].as_py())
            data, begin = memoryview(flat.astype("<u4").tobytes()), 0
            at = np.concatenate([[0], ends])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ids").slice(i, 1).flatten(),
                    pa.array(at[:-1] + batch.column("start")[i].as_py()),
                    pa.array(np.diff(at)),
                    pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def placed(blocks: DataFrame) -> DataFrame:
    """Blocks with ``start``, the ids of all earlier blocks; the parts' totals are one short row for each partition."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return blocks.join(F.broadcast(offsets), "part").select("ids", "block", (F.col("offset") + F.col("before")).alias("start"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the blocks."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return placed(blocks).mapInArrow(_read, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_blocks(read(spark, sf_dir, "documents")))

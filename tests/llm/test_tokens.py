"""Spans, BPE and packed ids against the libraries and plain code."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import regex

pytest.importorskip("siltstone.llm")
from siltstone.llm import bpe, simple8b, spans  # noqa: E402
from siltstone.llm.common import vocabulary_path  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
LONG = "word " * 30000 + "é" * 5000
TEXTS = ["", None, " ", "a", "It's we're 'S 's ''s x'll  y\n\n z", "naïve 中文 😀 ²³ Ⅷ\t\x1c_!", "the the the", LONG, "the the the", "<|endoftext|> </s>"]


def odd_texts(n=3000):
    rng = random.Random(5)
    parts = ["a", "b", "s", "t", "re", "ll", "'", "'", " ", " ", "\n", "\t", "1", "²", "é", "!", "_", "中", " ", "😀", "ve", "\x1c", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_pre_tokens_are_the_pattern_s_matches():
    texts = odd_texts() + [t or "" for t in TEXTS]
    pattern = regex.compile(public_tokenizers.PATTERN)
    cp, offsets = spans.code_points(texts)
    starts, first = spans.pre_tokens(cp, offsets)
    ends, whole = np.append(starts[1:], len(cp)).tolist(), "".join(texts)
    for i, t in enumerate(texts):
        assert [whole[a:b] for a, b in zip(starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]], strict=True)] == pattern.findall(t)


def test_words_and_numbers_of_spans():
    texts = odd_texts(500)
    cp, offsets = spans.code_points(texts)
    a, b, first = spans.words(cp, offsets)
    whole = "".join(texts)
    for i, t in enumerate(texts):
        assert [whole[x:y] for x, y in zip(a[first[i] : first[i + 1]].tolist(), b[first[i] : first[i + 1]].tolist(), strict=True)] == regex.findall(r"[^\x20\x09-\x0D]+", t)
    codes, seen = spans.number(cp, a, b)
    said = [whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert [said[seen[c]] for c in codes] == said and len(seen) == len(set(said))


def documents(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_bpe_equals_tiktoken_and_decodes(spark):
    import tiktoken

    texts = TEXTS + odd_texts(200)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})
    docs = documents(spark, texts).repartition(3)
    encoded = bpe.encode(docs).cache()
    want = sorted(str(((i if i != 3 else None), library.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    assert sorted(str((r["id"], list(r["ids"]))) for r in encoded.collect()) == want
    assert sorted(bytes(r["bytes"]) for r in bpe.decode(encoded).collect()) == sorted((t or "").encode() for t in texts)
    got = {r["doc_id"]: r for r in bpe.digests(encoded).collect()}
    ids = library.encode_ordinary(LONG)
    assert (got[7]["n_tokens"], got[7]["ids_sha256"], got[7]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LONG.encode()).hexdigest())


def test_merges_by_definition():
    table = bpe.ranks(bpe.VOCABULARY)
    for word in [" the", "naïve", "tokenization", "中文", "  ", "zzzzzz"]:
        assert bpe.encoding(bpe.VOCABULARY)._encode_single_piece(word.encode()) == bpe.merge(word.encode(), table)


def test_bpe_of_an_empty_table(spark):
    assert bpe.digests(bpe.encode(documents(spark, []))).count() == 0


def test_ids_are_ordered_and_digested_by_one_worker(spark, monkeypatch):
    docs = documents(spark, TEXTS + odd_texts(200)).repartition(3)
    monkeypatch.setattr(bpe, "BATCH_IDS", 1000)
    rows = lambda df: sorted(str(r) for r in df.collect())
    for with_ids in (False, True):
        made = bpe.encode_digests(docs, with_ids=with_ids)
        assert rows(made) == rows(bpe.digests(bpe.encode(docs), with_ids=with_ids))
        last = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert "FlatMapGroupsInArrow" in last[0]  # no MapInArrow above it
    assert bpe.encode_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 59, 8191, 8192, 8193, 20000])
@pytest.mark.parametrize("high", [1, 2, 70, 50257, 1 << 31, 1 << 63])
def test_packed_ids_come_back(n, high):
    rng = np.random.default_rng(n + high % 97)
    ids = rng.integers(0, high, n, np.uint64)
    if high == 1 << 63:
        ids[::7] = np.uint64(2**64 - 1)
    ends = np.sort(rng.integers(0, n + 1, 3))
    block = simple8b.pack(ids, ends)
    back, at = simple8b.unpack(block)
    assert np.array_equal(back, ids) and np.array_equal(at, ends)
    if n > 2 * simple8b.CHUNK:
        assert np.array_equal(simple8b.unpack(block, slice(1, 2))[0], ids[simple8b.CHUNK : 2 * simple8b.CHUNK])


def test_blocks_hold_the_library_s_ids_in_order(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(simple8b.VOCABULARY))
    library.encode_special_tokens = True
    texts = [t for t in TEXTS if t != "a"] + odd_texts(50)
    docs = spark.createDataFrame([(1000 - i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in simple8b.read_documents(simple8b.write_blocks(docs)).collect()}
    at = 0
    for i in range(len(texts) - 1, -1, -1):
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        assert got[1000 - i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert simple8b.read_documents(simple8b.write_blocks(docs.limit(0))).count() == 0


def test_new_words_are_encoded_together_with_the_same_ids(monkeypatch):
    texts = ["".join(f" w{chr(97 + i % 26)}{'e' * (i % 7)}{chr(233 + i % 5)}" for i in range(2000)), " 's don't 12 a b 　 c\n\n  d  e  \U0001f600 \x1c x", "", "end"]
    plain, given = simple8b.tokenizer(simple8b.VOCABULARY), []

    class Counting:
        def encode_batch_fast(self, batch, **how):
            given.extend(batch)
            return plain.encode_batch_fast(batch, **how)

        get_vocab = plain.get_vocab

    monkeypatch.setattr(simple8b, "tokenizer", lambda name: Counting())
    simple8b._words.cache_clear()
    for _ in range(2):  # new words, then remembered ones
        flat, ends = simple8b.token_ids(texts, simple8b.VOCABULARY, 0)
        want = [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert flat.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    simple8b._words.cache_clear()
    assert len(given) < 60  # one text for many words; there are over 400 distinct ones

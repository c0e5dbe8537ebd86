"""Near copies, benchmark passages and the whole pipeline against brute force."""

import hashlib
import random

import pytest

pytest.importorskip("siltstone.llm")
import corpus_pipeline  # noqa: E402
from siltstone.llm import bpe, decontam, minhash, quality, secrets  # noqa: E402

RNG = random.Random(11)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("b", "d", "f", "g", "l", "n", "r", "s", "t", "z")]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def changed(base, times):
    words = base.split()
    for _ in range(times):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS) + "x"
    return " ".join(words)


def shingles(t, k):
    w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, k=4, percent=80):
    sets, least = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            moved |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def corpus():
    base, short = text(120), text(60)
    many = [base] * 5 + [changed(base, i % 9) for i in range(60)] + [short] + [changed(short, i % 4) for i in range(20)]
    shared = text(40)
    many += [f"{text(30)} {shared} {text(30)}" for _ in range(25)] + [text(50) for _ in range(30)]
    return many + ["", None, "One", "one", "two words", " ", "a b c", "a b c d", text(3000), base.upper()]


def test_components_equal_brute_force(spark):
    texts = dict(enumerate(corpus()))
    docs = spark.createDataFrame([(i, t, "n") for i, t in texts.items()], "doc_id long, text string, node string").repartition(3)
    want = components(texts)
    got = minhash.near_duplicates(docs, similarity=minhash.Similarity(4, 80)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, 4)) for i, t in texts.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_few_edges_are_joined_in_two_tables_and_as_by_the_loop(spark, monkeypatch):
    made, written = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: made.append(name) or written(df, name))
    rows = [(bytes([255 - i]), bytes([254 - i])) for i in range(60)] + [(b"\x01", b"\x02"), (b"\x03", b"\x02"), (b"\x05", b"\x05")]
    edges = spark.createDataFrame(rows, "a binary, b binary")
    got = {(bytes(r["node"]), bytes(r["label"])) for r in minhash.components(edges).collect()}
    assert len(made) == 2
    assert got == {(bytes([255 - i]), bytes([195])) for i in range(61)} | {(bytes([i]), b"\x01") for i in (1, 2, 3)}
    monkeypatch.setattr(minhash, "FEW_EDGES", -1)
    assert {(bytes(r["node"]), bytes(r["label"])) for r in minhash.components(edges).collect()} == got
    assert minhash.components(edges.limit(0)).collect() == []


def test_far_copies_are_told_apart_by_bounds(spark, monkeypatch):
    """Copies changed too far meet no one set by set; those that are similar to the base alone are linked before the last join."""
    base = text(200)
    texts = {i: changed(base, 3 + i % 20) for i in range(120)} | {120: base}
    met, compare, strays = [], minhash._Linker.compare, minhash._Linker.meet_strays

    def meet_strays(self, posts):
        labels = {bytes(r["node"]): bytes(r["label"]) for r in posts.select("node", "label").distinct().collect()}
        self.compare = lambda pairs: (met.append((len(labels), len(set(labels.values())), pairs.count())), compare(self, pairs))
        strays(self, posts)

    monkeypatch.setattr(minhash._Linker, "meet_strays", meet_strays)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, similarity=minhash.Similarity(4, 80)).collect()}
    assert got == components(texts)
    [(classes, labels, pairs)] = met
    assert labels > 20 and pairs < (labels - 1) * classes / 10


def test_repeated_ids_nulls_and_no_rows(spark):
    base = text(80)
    rows = [(1, base, "a"), (1, base, "a"), (2, changed(base, 1), "b"), (None, base, "c"), (None, "other words here now", "d"), (1, text(30), "e"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["row_key"]) for r in kept.collect()) == ["None", "a", "d", "e"]
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def leaks(texts, items):
    """Pairs with a window that agrees, seeds or not: every alignment is tried; short items as exact runs."""
    found = set()
    for d, t in texts.items():
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
        for i, item in items.items():
            v = item.lower().split()
            if len(v) < decontam.SPAN:
                found |= {(d, i) for at in range(len(w) - len(v) + 1) if v and w[at : at + len(v)] == v}
                continue
            for shift in range(-len(v), len(w)):
                for begin in range(max(len(v) - decontam.WINDOW, 0) + 1):
                    part = range(begin, min(begin + decontam.WINDOW, len(v)))
                    same = sum(0 <= j + shift < len(w) and w[j + shift] == v[j] for j in part)
                    if 100 * same >= 90 * len(part):
                        found.add((d, i))
    return found


def test_passages_are_found_with_substitutions(spark):
    items = {i: text(n) for i, n in enumerate((15, 20, 40, 57, 9))} | {9: None}
    texts = {i: f"{text(20)} {items[i % 4]}, {text(20)}" for i in range(8)}
    for i in range(8, 24):
        words = items[i % 4].split()
        for at in range(i % 3, len(words), 9):
            words[at] = "zzz"
        texts[i] = f"{text(15)}\n{' '.join(words).title()} {text(15)}"
    texts |= {i: text(60) for i in range(24, 40)} | {40: None, 41: "", 42: items[2] * 1, 43: items[4]}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(0, texts[0], 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs, bench).collect()}
    assert got >= leaks({i: t for i, t in texts.items()}, {i: t for i, t in items.items() if t})
    assert all(i < 24 or i in (42, 43) for i, _ in got) and (43, 4) in got
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(texts) - {i for i, _ in got}
    assert decontam.overlaps(docs.limit(0), bench).count() == 0 and decontam.overlaps(docs, bench.limit(0)).count() == 0


def test_short_items_are_searched_whole(spark, tmp_path):
    items = {0: text(9), 1: text(4), 2: "solo", 3: None, 4: "", 5: text(9), 6: text(20)}
    nine = items[5].split()
    texts = {0: f"{text(20)} {items[0].title()}, {text(20)}", 1: items[1], 2: f"a Solo {text(3)}", 3: f"{text(5)} solos", 4: " ".join(nine[:8]), 5: " ".join([*nine[:4], "zzz", *nine[4:]]), 6: None, 7: "", 8: f"{items[6]} {text(9)}", None: items[5]}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(1, items[1], 1)], "doc_id long, text string, part int").repartition(3)
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    plain = {(d, i) for d, i in leaks({d: t for d, t in texts.items() if d is not None}, {i: t for i, t in items.items() if t})}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs.filter("doc_id is not null"), bench).collect()} == plain
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {3, 4, 5, 6, 7}
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, bench.filter("item_id = 6")).collect()} == set(texts) - {8}
    assert decontam.drop_contaminated(docs.limit(0), bench).count() == 0


def test_long_texts_ends_and_texts_of_one_id(spark, monkeypatch):
    item, gap = text(30), text(2000)
    near = f"{gap} {item[: len(item) // 2].rsplit(' ', 1)[0]}"  # ends inside the item
    rows = [(1, f"{text(40000)} {item} {text(40000)}"), (1, text(50)), (2, near), (2, item), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.overlaps(docs, bench).collect())
    assert [r[0] for r in got] == [1, 2, 2] and got[0][4:] == (40000, 40030) and (0, 30) in [r[4:] for r in got]
    assert max(r[5] for r in got[1:]) == len(near.split())
    assert sorted((r[0], len(r[1] or "")) for r in decontam.drop_contaminated(docs, bench).collect()) == [(1, len(rows[1][1])), (3, 0)]
    for name in ("BROADCAST_ROWS", "BROADCAST_HITS"):  # beyond the checked sizes the joins shuffle, with the same result
        monkeypatch.setattr(decontam, name, 0)
    assert sorted(tuple(r) for r in decontam.overlaps(docs, bench).collect()) == got


def test_pipeline_equals_brute_force(spark, tmp_path):
    good = lambda n: " ".join(RNG.choice(WORDS if i % 4 else ["the", "of", "and", "to"]) for i in range(n))
    item = good(40)
    base = good(90)
    texts = {i: good(60) for i in range(10)} | {10: base, 11: base, 12: base + " end", 13: f"{good(20)} {item} {good(20)}", 14: "too short", 15: None, 16: "# $ " * 60, 17: f"{good(40)} password: hunter2hunter2 {good(10)}"}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stop = set(quality._stop_list())
    kept = {i: t for i, t in texts.items() if t and len(t.split()) >= 20 and 100 * sum(c in quality.SYMBOLS for c in t) <= 10 * len(t.split()) and 100 * sum(w in stop for w in t.split()) >= 6 * len(t.split())}
    kept = {i: t for i, t in kept.items() if components(kept, 5)[i] == i}
    kept = {i: secrets.redacted(t) for i, t in kept.items() if not leaks({i: t}, {0: item})}
    assert sorted(kept) == [*range(11), 17] and "[ASSIGN]" in kept[17]
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(rows) == sorted(kept)
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})
    for i, t in kept.items():
        assert list(rows[i]["ids"]) == library.encode_ordinary(t) and rows[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()

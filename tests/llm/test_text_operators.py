import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontamination, near_duplicates, sharding
from tidemill.llm.components import connected_components
from tidemill.llm.words import ALNUM, NON_SPACE, hash_words


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = [b"One two  THREE\nfour", b"", b"  ", "é-1 two".encode(), b"x" * 300]
    one, bounds = hash_words(texts, NON_SPACE)
    monkeypatch.setattr("tidemill.llm.words.BLOCK", 7)
    two, again = hash_words(texts, NON_SPACE)
    assert (one == two).all() and (bounds == again).all()
    assert np.diff(bounds).tolist() == [4, 0, 0, 2, 1]
    assert one[1] == one[5]  # the same word
    assert np.diff(hash_words(texts, ALNUM)[1]).tolist() == [4, 0, 0, 3, 1]


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                label[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_against_brute_force(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    got = sorted(map(tuple, near_duplicates.near_duplicate_classes(corpus).collect()))
    assert got == brute_classes(rows_of(corpus))
    assert any(not r[3] for r in got)


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_in_chains_and_large_buckets(spark, monkeypatch, block):
    """Copies that drift away from the first one, so that most pairs of a bucket are no links and components need the second pass."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows, n = [], 0
    for chain in range(4):
        words = [f"c{chain}w{i}" for i in range(120)]
        for step in range(25):
            rows.append((n, " ".join(words)))
            n += 1
            for k in range(5):  # a run of words, so few shingles change
                words[(step * 5 + k) % 120] = f"c{chain}s{step}k{k}"
    rows = rows[::-1] + [(n, rows[3][1]), (n + 1, rows[3][1])]
    got = sorted(map(tuple, near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()))
    assert got == brute_classes(rows)
    assert len({r[2] for r in got}) < 20


def test_near_duplicates_of_a_doc_id_with_several_texts(spark):
    text = lambda k, n=12: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(3, text(1)), (5, text(1)), (4, text(2)), (5, text(2)), (9, text(3)), (9, text(4)), (10, text(3)), (11, text(4)), (12, text(5)), (12, None), (12, text(5))]
    got = sorted(map(tuple, near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").distinct().collect()))
    assert got == [(3, 3), (4, 3), (5, 3), (9, 9), (10, 9), (11, 9), (12, 12)]


def test_near_duplicates_without_rows_or_ids(spark, corpus, empty):
    assert near_duplicates.near_duplicate_classes(empty).count() == 0
    anonymous = corpus.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert {(r.component_id, r.kept) for r in near_duplicates.near_duplicate_classes(anonymous).collect()} == {(None, None)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 120)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 120: 120, 150: 120, 200: 120}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    star = [(5, i) for i in range(6, 400)] + [(399, 2), (1000, 1001)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert got == {**{i: 2 for i in (2, *range(5, 400))}, 1000: 1000, 1001: 1000}


def brute_hits(rows, items):
    out = []
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        ids = sorted(found)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_decontamination_against_brute_force(spark, corpus, monkeypatch, small):
    if small:  # hashed terms share bits and counters
        monkeypatch.setattr(decontamination, "MAP_BITS", 8)
        monkeypatch.setattr(decontamination, "COUNTERS", 2)
    rows = [r for r in rows_of(corpus) if r[1] is None or len(r[1]) < 20_000]
    long = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(k, " ".join(t.split()[5 : 5 + n])) for k, (t, n) in enumerate(zip(long, [12, 30, 10, 25, 3, 14]))] + [(50, ""), (51, None), (9, "four words"), (10, "Four, WORDS!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, window string, shard int")
    got = decontamination.contamination(docs, bench)
    assert sorted(map(tuple, got.drop("n_near").collect())) == brute_hits(rows, items)
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_near_phrases(spark):
    docs = spark.createDataFrame([(1, "one two three uh four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten"), (3, "ten nine")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontamination.contamination(docs, bench).collect()}
    assert got == {1: (0, 1), 2: (1, 0), 3: (0, 0)}


def test_near_phrases_against_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 30, n)]
    items = [(k, draw(n)) for k, n in enumerate([12, 10, 4, 3, 11])]
    rows = []
    for i in range(60):
        words = draw(int(rng.integers(0, 40)))
        _, item = items[i % 5]
        part = list(item[: int(rng.integers(3, 13))])
        for _ in range(int(rng.integers(0, 3))):
            part.insert(int(rng.integers(0, len(part) + 1)), "zz")
        at = int(rng.integers(0, len(words) + 1))
        rows.append((i, words[:at] + part + words[at:]))

    def near(w):
        found = set()
        for k, b in items:
            n = min(10, len(b))
            windows = [b[j : j + n] for j in range(len(b) - n + 1)]
            if any(w[p : p + n] == v for v in windows for p in range(len(w))):
                continue
            if any(all(any(0 <= q < len(w) and w[q] == v[j] for q in range(s + j - 3, s + j + 4)) for j in range(n)) for v in windows for s in range(-3, len(w) + 3)):
                found.add(k)
        return len(found)

    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(b)) for k, b in items], "item_id long, text string")
    got = {r.doc_id: r.n_near for r in decontamination.contamination(docs, bench).collect()}
    assert got == {i: near(w) for i, w in rows} and sum(got.values()) > 5


def test_bpe_against_the_library(spark, corpus, empty):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.VOCABULARY)
    want = {}
    for i, t in rows_of(corpus):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(corpus).collect()}
    assert got == want
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(corpus)).collect()}
    assert back == {i: t or "" for i, t in rows_of(corpus)}
    assert bpe.digests(empty).count() == 0


def test_bpe_round_trip_property():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(bpe.VOCABULARY), bpe.codec(bpe.VOCABULARY)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("aeinrst hTHE.,'!\n\t é漢😀0123 ") | st.characters(codec="utf-8"), max_size=60))
    def check(text):
        ids = np.frombuffer(mine.encode(text), "<u4")
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids
        assert mine.decode(ids).decode() == text

    check()


def brute_shards(rows, shards):
    sized = sorted(((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows))
    total, at, slots, out = sum(s for _, _, s in sized), 0, [0] * shards, []
    for i, crc, size in sized:
        shard = min(shards - 1, (2 * at + size) * shards // (2 * total))
        out.append((i, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        at += size
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [1, 24, 500])
def test_shards_against_brute_force(corpus, empty, shards):
    got = sorted(map(tuple, sharding.byte_shards(corpus, shards).collect()), key=str)
    assert got == brute_shards(rows_of(corpus), shards)
    assert sharding.byte_shards(empty, shards).count() == 0

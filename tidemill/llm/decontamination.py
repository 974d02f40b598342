"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: each row of the stored table, a shard,
holds for a run of documents the sorted positions of every occurrence of every
test term. The benchmark's windows are a table too. A window goes to the shards
that have its rarest term, as counted over all shards, by a join on that term;
there that term's positions are intersected with the other terms' lists, each
shifted by the term's place in the window. No posting leaves its shard, so a
frequent term or a large document burdens only the shard that holds it, and
neither windows nor terms pass through the driver: it sees two tables of fixed
size, a bitmap of test terms and counts of hashed terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import frugal, store
from .words import ALNUM, hash_words, spark_int, texts_of

#: Words in a window.
WINDOW = 10
#: Words by which each word of a near match may be off its place.
SLOP = 3
#: Positions between documents of a shard, so that no window reaches from one into the next.
GAP = 64
#: Bits of the map of test terms; what it lets through beside them costs room in the index, not results.
MAP_BITS = 1 << 21
#: Counters of hashed terms that decide which term of a window is the rarest.
COUNTERS = 1 << 18

_WINDOWS = "item string, terms array<long>"
_INDEX = "keys array<long>, bounds binary, terms binary, offsets binary, positions binary"
_HITS = "shard long, place int, key long, n_words long, n_hit long, exact array<long>, near array<long>"


def _windows(batches):
    """Each test item's windows as lists of term hashes; an item of fewer words, but not none, is one window."""
    for rows, texts in texts_of(batches):
        words, bounds = hash_words(texts, ALNUM)
        words, items = spark_int(words), rows.column(0)
        for i in range(len(texts)):
            own = words[bounds[i] : bounds[i + 1]]
            if len(own):
                wide = np.lib.stride_tricks.sliding_window_view(own, min(WINDOW, len(own)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, wide.size + 1, wide.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(wide).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([items[i].as_py()] * len(wide), pa.string()), lists], names=["item", "terms"])


def _slot(terms: np.ndarray, size: int) -> np.ndarray:
    return (terms.view(np.uint64) % np.uint64(size)).astype(np.int64)


def _bits(size: int):
    """The places of test terms in the map."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column(0).flatten().to_numpy(), size)))], names=["bit"])

    return run


def _ranked(counts: np.ndarray):
    """Windows with their rarest term and its place among their terms."""

    def run(batches):
        for batch in batches:
            terms = [np.asarray(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
            first = [int(np.argmin(counts[_slot(t, len(counts))])) for t in terms]
            rarest = [int(t[k]) for t, k in zip(terms, first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(rarest, pa.int64())], names=["window", "window_terms", "first", "term"])

    return run


def _index(bitmap: np.ndarray):
    def run(batches):
        for rows, texts in texts_of(batches):
            words, bounds = hash_words(texts, ALNUM)
            at = np.flatnonzero(bitmap[_slot(words, len(bitmap))])
            place = at + GAP * (np.searchsorted(bounds, at, side="right") - 1)
            term = spark_int(words)[at]
            order = np.argsort(term, kind="stable")
            terms, first = np.unique(term[order], return_index=True)
            offsets = np.append(first, len(order))
            blobs = [bounds.astype(np.int64), terms, offsets.astype(np.int64), place[order].astype(np.int64 if len(words) > 1 << 30 else np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)],
                names=["keys", "bounds", "terms", "offsets", "positions"],
            )

    return run


def _listed(counters: int):
    """(shard, term, its counter, n) of all shards."""

    def run(batches):
        for batch in batches:
            for shard, terms, offsets in zip(*(batch.column(k).to_pylist() for k in range(3))):
                terms = np.frombuffer(terms, np.int64)
                columns = [np.full(len(terms), shard), terms, _slot(terms, counters), np.diff(np.frombuffer(offsets, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "term", "slot", "n"])

    return run


def _within(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether some value lies in each [low, high]."""
    at = np.searchsorted(values, low)
    return (at < len(values)) & (values[np.minimum(at, len(values) - 1)] <= high)


def occurrences_of(lists: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of exact occurrences, places of the rarest term in near ones) from the terms' offset-adjusted lists, the rarest term's, at ``first``, taken first.

    Near: for some start every term has an occurrence within SLOP words of its
    place. Exact occurrences are near as well.
    """
    rarest = lists[first]
    exact = rarest - first
    shift = np.arange(-SLOP, SLOP + 1)
    near = (exact[:, None] + shift).ravel()
    own = np.repeat(rarest, len(shift))
    for j in sorted((j for j in range(len(lists)) if j != first), key=lambda j: len(lists[j])):
        listed = lists[j]
        exact = exact[_within(listed, exact + j, exact + j)]
        there = _within(listed, near + j - SLOP, near + j + SLOP)
        near, own = near[there], own[there]
        if not len(near):
            break
    return exact, np.unique(own)


class Shard:
    """One row of the index; ``meet`` looks windows up in it, ``hits`` sums up."""

    def __init__(self, row: dict):
        self.keys = row["keys"]
        self.bounds, self.terms, self.offsets = (np.frombuffer(row[k], np.int64) for k in ("bounds", "terms", "offsets"))
        self.places = np.frombuffer(row["positions"], np.int32 if len(row["positions"]) == 4 * int(self.offsets[-1]) else np.int64).astype(np.int64)
        self.start = self.bounds[:-1] + GAP * np.arange(len(self.keys))
        self.covered: dict[int, list[tuple[int, int]]] = {}
        self.exact: dict[int, set] = {}
        self.near: dict[int, set] = {}

    def _document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, side="right") - 1

    def meet(self, names: list[int], windows: list[list[int]], firsts: list[int]) -> None:
        flat = np.array([t for w in windows for t in w], dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, flat), max(len(self.terms) - 1, 0))
        here = self.terms[at] == flat if len(self.terms) else np.zeros(len(flat), dtype=bool)
        ends = np.cumsum([len(w) for w in windows])
        whole = np.logical_and.reduceat(here, np.concatenate([[0], ends[:-1]])) if len(windows) else here
        for k in np.flatnonzero(whole).tolist():
            own = at[ends[k] - len(windows[k]) : ends[k]]
            exact, near = occurrences_of([self.places[self.offsets[i] : self.offsets[i + 1]] for i in own], firsts[k])
            for d, a in zip(self._document(exact).tolist(), exact.tolist()):
                self.covered.setdefault(d, []).append((a, a + len(own)))
                self.exact.setdefault(d, set()).add(names[k])
            for d in set(self._document(near).tolist()):
                self.near.setdefault(d, set()).add(names[k])

    def hits(self, shard: int) -> pa.RecordBatch:
        n_hit, exact, near = [], [], []
        for d in range(len(self.keys)):
            covered = reach = 0
            for a, b in sorted(self.covered.get(d, ())):
                covered += max(0, b - max(a, reach))
                reach = max(reach, b)
            n_hit.append(covered)
            exact.append(sorted(self.exact.get(d, ())))
            near.append(sorted(self.near.get(d, set()) - self.exact.get(d, set())))
        n = len(self.keys)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, shard)), pa.array(np.arange(n, dtype=np.int32)), pa.array(self.keys, pa.int64()), pa.array(np.diff(self.bounds)), pa.array(n_hit, pa.int64()),
                pa.array(exact, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64())),
            ],
            names=["shard", "place", "key", "n_words", "n_hit", "exact", "near"],
        )


def _search(batches):
    """Rows sorted by shard, the shard itself first, then the windows that are looked up in it."""
    shard, number = None, None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if part.num_rows and numbers[a] != number:
                if shard:
                    yield shard.hits(number)
                number = int(numbers[a])
                shard = Shard(part.slice(0, 1).to_pylist()[0])
                part = part.slice(1)
            if part.num_rows:
                names, terms, first = (part.column(part.schema.get_field_index(k)).to_pylist() for k in ("window", "window_terms", "first"))
                shard.meet(names, terms, first)
    if shard:
        yield shard.hits(number)


def hits_of(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(hits, owners): per row of ``docs`` its key, n_words, n_hit and the numbers of windows found exactly and only nearly; and the items of each window."""
    tests = frugal(benchmark).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    every = store(tests.mapInArrow(_windows, _WINDOWS).distinct(), "windows")
    # a window's number: a hash of its terms
    number = F.xxhash64("terms").alias("window")
    owners = every.select(number, "item").distinct()
    windows = store(every.select(number, "terms").distinct(), "distinct")
    bitmap = np.zeros(MAP_BITS, dtype=bool)
    bitmap[windows.select("terms").mapInArrow(_bits(MAP_BITS), "bit long").distinct().toArrow()["bit"].to_numpy()] = True  # MAP_BITS rows at most
    texts = frugal(docs).select(F.col(key).alias("key"), F.col("text").cast("binary").alias("text"))
    index = store(texts.mapInArrow(_index(bitmap), _INDEX).withColumn("shard", F.monotonically_increasing_id()), "postings")
    listed = index.select("shard", "terms", "offsets").mapInArrow(_listed(COUNTERS), "shard long, term long, slot long, n long")
    # COUNTERS rows at most; an overfull counter makes a term look more frequent, which changes only where a lookup begins
    counted = listed.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    ranked = windows.mapInArrow(_ranked(counts), "window long, window_terms array<long>, first int, term long")
    lookups = ranked.join(listed.select("shard", "term"), "term").select("shard", "window", "window_terms", "first")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    head = index.select("shard", "keys", "bounds", "terms", "offsets", "positions", none("window", "long"), none("window_terms", "array<long>"), none("first", "int"))
    tail = lookups.select("shard", none("keys", "array<long>"), *(none(c, "binary") for c in ("bounds", "terms", "offsets", "positions")), "window", "window_terms", "first")
    met = head.unionByName(tail).repartition("shard").sortWithinPartitions("shard", F.isnotnull("window"))
    return met.mapInArrow(_search, _HITS), owners


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near.

    A word is hit if it lies inside an occurrence of a window: ten words of an
    item in a row, or all of a shorter item. n_near counts items without such
    an occurrence of which a window occurs with every word within SLOP words of
    its place. Null texts and texts without words have zero counts and the
    digest of no items. Texts of any length are indexed whole, each in one
    shard. Repeated rows are judged each by itself; an item without item_id
    hits words but isn't counted. Empty tables give an empty or an all-clean
    result.
    """
    hits, owners = hits_of(docs, benchmark)
    hits = store(hits, "hits")
    quiet = "size(exact) = 0 and size(near) = 0"
    row = ["shard", "place", "key", "n_words", "n_hit"]
    loud = hits.filter(f"not ({quiet})").select(*row, F.explode(F.concat(F.transform("exact", lambda w: F.struct(w.alias("window"), F.lit(True).alias("whole"))), F.transform("near", lambda w: F.struct(w.alias("window"), F.lit(False).alias("whole"))))).alias("x"))
    named = loud.select(*row, "x.*").join(owners, "window").groupBy(*row, "item").agg(F.max("whole").alias("whole"))
    items = named.groupBy(*row).agg(F.array_sort(F.collect_list(F.when(F.col("whole"), F.col("item")))).alias("items"), F.count(F.when(~F.col("whole"), F.col("item"))).alias("n_near"))
    clean = hits.filter(quiet).select(*row, F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_near"))
    return items.unionByName(clean).select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near"
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All windows of all items against all windows of all documents.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS a FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS a FROM benchmark
), w AS (
  SELECT DISTINCT item_id, n, array_to_string(a[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, a, least(10, len(a)) AS n, unnest(range(1, len(a) - least(10, len(a)) + 2)) AS i FROM b WHERE len(a) > 0)
), l AS (SELECT DISTINCT n FROM w),
p AS (SELECT doc_id, n, i, array_to_string(a[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, a, n, unnest(range(1, len(a) - n + 2)) AS i FROM d, l WHERE len(a) >= n)),
h AS (SELECT doc_id, p.n, i, item_id FROM p JOIN w ON p.g = w.g AND p.n = w.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
v AS (SELECT n, g, unnest(string_split(g, ' ')) AS t, unnest(range(1, n + 1)) AS j FROM (SELECT DISTINCT n, g FROM w)),
vc AS (SELECT n, g, count(DISTINCT t) AS c FROM v GROUP BY ALL),
dp AS (SELECT doc_id, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS k FROM d),
pr AS (SELECT doc_id, n, g FROM (SELECT DISTINCT doc_id, t FROM dp) JOIN (SELECT DISTINCT n, g, t FROM v) USING (t) JOIN vc USING (n, g) GROUP BY doc_id, n, g, c HAVING count(*) = c),
ns AS (SELECT DISTINCT doc_id, n, g FROM (SELECT pr.doc_id, v.n, v.g, v.j, unnest(range(k - j - 3, k - j + 4)) AS s FROM pr JOIN v ON v.n = pr.n AND v.g = pr.g JOIN dp ON dp.doc_id = pr.doc_id AND dp.t = v.t)
  GROUP BY doc_id, n, g, s HAVING count(DISTINCT j) = n),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM ns JOIN w USING (n, g) WHERE (doc_id, item_id) NOT IN (SELECT doc_id, item_id FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN nn ON nn.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

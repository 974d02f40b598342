"""MinHash near-duplicate classes of documents.

Each text's set of distinct word shingles gets ``BANDS * ROWS`` universal hash
minima. Texts with equal sets form one class from the start. Classes that
share all minima of a band share a bucket; buckets with the same members in
several bands are looked at once. Pairs within a bucket are verified on
signatures, then confirmed on the full sets, and the classes' connected
components are found by alternating large-star and small-star.

A bucket is searched in two passes, whatever its size. First every member
meets two of them, the pivots; most copies of one text are tied together by
this, with work linear in their number. Then the members outside the bucket's
largest component so far meet all members of other components. Members meet in
cells of ``BLOCK`` by ``BLOCK``, so no bucket has to fit into one task and none
is cut, and a cell gives a spanning forest of its confirmed links, never pairs.
Tables that grow with the corpus are joined by merging, never by broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import MinHasher, shingle_sets
from .storage import discard, frugal, store
from .words import mix, spark_int, texts_of

#: Words in a shingle and the share, in hundredths, that two sets must have in common.
WIDTH, PERCENT = 5, 75
#: 32 bands of 4 minima: a pair at the threshold shares no bucket with probability 5e-6.
BANDS, ROWS = 32, 4
#: Pairs whose signatures agree in fewer of the 128 minima are not confirmed: 5.4 standard deviations below the threshold, or 1e-7.
LEAST_AGREEING = 70
#: Members of a bucket on either side of a cell.
BLOCK = 512
#: Bits of the filter that picks the texts to read a second time: some for each text that is wanted, within bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 26

_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"


def _sign(batches):
    hasher = MinHasher(BANDS * ROWS)
    for rows, texts in texts_of(batches):
        values, bounds = shingle_sets(texts, WIDTH)
        n, sig = np.diff(bounds), hasher.sign(values, bounds)
        with np.errstate(over="ignore"):
            key = np.zeros((len(texts), BANDS), dtype=np.uint64)
            for r in range(ROWS):
                key = mix(key + sig[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
            key = mix(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        s1, s2 = _digests(values, bounds)
        low = (sig & 0xFF).astype(np.uint8)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * BANDS + 1, BANDS), pa.int32()), pa.array(spark_int(key).ravel()))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(n, pa.int64()), pa.array(spark_int(s1)), pa.array(spark_int(s2)), bands, pa.array([x.tobytes() for x in low], pa.binary())],
            names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"],
        )


def _digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of hashes that identify each set."""
    with np.errstate(over="ignore"):
        ends = np.concatenate([[np.uint64(0)], np.cumsum(mix(values))])
        others = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)))])
        return ends[bounds[1:]] - ends[bounds[:-1]], others[bounds[1:]] - others[bounds[:-1]]


def _sets(batches):
    for rows, texts in texts_of(batches):
        values, bounds = shingle_sets(texts, WIDTH)
        s1, _ = _digests(values, bounds)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(spark_int(s1)), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(texts))], pa.binary())], names=["rep", "s1", "shingles"]
        )


def _grouped(batches, keys: int):
    """Runs of rows with equal values in the first ``keys`` columns; the input is sorted by them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


#: A cell's key; whether the row stands on its right side; the class, by its least doc_id and a digest; its component so far, at first that doc_id.
_CELL = "a long, b long, c long, right boolean, rep long, s1 long, part long"
_KEYS = ["a", "b", "c"]


def _cells(batches):
    """(key, right, rep, s1, part, payload arrays) of each cell; the input is sorted by the key."""
    for key, parts in _grouped(batches, 3):
        right = np.concatenate([p.column(3).to_numpy(zero_copy_only=False) for p in parts])
        rep, s1, part = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (4, 5, 6))
        yield key, right.astype(bool), rep, s1, part, [x for p in parts for x in p.column(7).to_pylist()]


def _verify(batches):
    """The rows of each cell that have a partner on the other side by their signatures."""
    for key, right, rep, s1, part, sketches in _cells(batches):
        sketch = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(rep), -1)
        left, other = np.flatnonzero(~right), np.flatnonzero(right)
        stay = np.zeros(len(rep), dtype=bool)
        for i in left:  # by rows, to bound memory
            near = other[((sketch[other] == sketch[i]).sum(axis=1, dtype=np.int32) >= LEAST_AGREEING) & (part[other] != part[i])]
            stay[near] = True
            stay[i] |= len(near) > 0
        if stay.any():
            n = int(stay.sum())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.full(n, k)) for k in key), pa.array(right[stay]), pa.array(rep[stay]), pa.array(s1[stay]), pa.array(part[stay])], names=["a", "b", "c", "right", "rep", "s1", "part"]
            )


def _shared(lefts: list[np.ndarray], rights: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of left and right sets, by products of indicator matrices over runs of the values on both sides."""
    if len(lefts) == 1:
        return np.array([[np.isin(x, lefts[0], assume_unique=True).sum() for x in rights]])
    total, step = np.zeros((len(lefts), len(rights)), dtype=np.int64), 2048
    values = np.intersect1d(np.concatenate(lefts), np.concatenate(rights))
    sides = []
    for sets in (lefts, rights):
        every = np.concatenate(sets)
        column = np.minimum(np.searchsorted(values, every), max(len(values) - 1, 0))
        use = values[column] == every if len(values) else np.zeros(len(every), dtype=bool)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[use]
        order = np.argsort(column[use], kind="stable")
        sides.append((owner[order], column[use][order], len(sets)))
    for at in range(0, len(values), step):
        blocks = []
        for owner, column, m in sides:
            lo, hi = np.searchsorted(column, (at, at + step))
            block = np.zeros((m, step), dtype=np.float32)
            block[owner[lo:hi], column[lo:hi] - at] = 1
            blocks.append(block)
        total += np.rint(blocks[0] @ blocks[1].T).astype(np.int64)
    return total


def _confirm(batches):
    """Per cell, a spanning forest of the links between its sides that hold on the full sets, as pairs of components."""
    for _, right, _, _, part, blobs in _cells(batches):
        sets = [np.frombuffer(x, dtype=np.uint64) for x in blobs]
        left, other = np.flatnonzero(~right), np.flatnonzero(right)
        if not len(left) or not len(other):
            continue
        n = np.array([len(s) for s in sets])
        both = _shared([sets[i] for i in left], [sets[i] for i in other])
        link = (100 * both >= PERCENT * (n[left][:, None] + n[other][None, :] - both)) & (part[left][:, None] != part[other][None, :])
        out, open_left, open_right = [], np.ones(len(left), dtype=bool), np.ones(len(other), dtype=bool)
        for root in range(len(left)):
            front = [root] if open_left[root] else []
            open_left[root] = False
            while front:
                found = np.flatnonzero(link[front].any(axis=0) & open_right)
                open_right[found] = False
                front = np.flatnonzero(link[:, found].any(axis=1) & open_left) if len(found) else []
                open_left[front] = False
                out += [(part[left[root]], x) for x in (*part[other[found]], *part[left[front]])]
                front = list(front)
        if out:
            u, v = np.array(out, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _maybe(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents among ``wanted``'s classes and, rarely, others: a Bloom filter keeps the texts from being shuffled.

    The filter is a table of MOST_BITS / 64 rows at most, whatever the input,
    which bounds what is broadcast; a corpus of which hundreds of millions of
    texts are wanted passes it almost whole. The join with the members decides.
    """
    # a class that stands in several cells is counted with each, which only lengthens the filter
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * wanted.count()).bit_length()))

    def place(c):
        bit = F.pmod(F.xxhash64(c), F.lit(size))
        return F.floor(bit / 64).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))

    word, mask = place("rep")
    bits = wanted.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    word, mask = place("doc_id")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), word.alias("word"), mask.alias("mask"))
    return texts.join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(F.col("mask")) != 0).select("doc_id", "text")


def _links(docs: DataFrame, classes: DataFrame, cells: DataFrame) -> DataFrame:
    """The links (u, v) between the sides of ``cells``: verified on signatures, then confirmed on sets read from the texts."""
    sketched = cells.join(classes.select("rep", "s1", "sketch").hint("merge"), ["rep", "s1"]).select(*_KEYS, "right", "rep", "s1", "part", "sketch")
    near = store(sketched.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_verify, _CELL), "verified")
    sets = _maybe(docs, near.select("rep")).mapInArrow(_sets, "rep long, s1 long, shingles binary").dropDuplicates(["rep", "s1"])
    dealt = near.join(sets.hint("merge"), ["rep", "s1"]).select(*_KEYS, "right", "rep", "s1", "part", "shingles")
    links = store(dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_confirm, "u long, v long").distinct(), "links")
    discard(near)
    return links


def _with_pivots(members: DataFrame) -> DataFrame:
    """Cells of the first pass: a pivot on the left, members of its buckets on the right; pairs in several buckets meet once.

    Classes that share their least doc_id are one node and need no link.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    pairs = members.select(F.explode(F.array("low", "high")).alias("pivot"), "rep", "s1", blocks.alias("k")).filter("pivot.rep <> rep")
    pairs = pairs.groupBy("pivot", "rep", "s1").agg(F.max("k").alias("k"))
    pairs = pairs.select(F.xxhash64("pivot").alias("a"), F.col("k").alias("b"), F.pmod(F.xxhash64("rep", "s1"), F.col("k")).alias("c"), "pivot", "rep", "s1")
    left = pairs.select(*_KEYS, F.lit(False).alias("right"), F.col("pivot.rep").alias("rep"), F.col("pivot.s1").alias("s1"), F.col("pivot.rep").alias("part")).distinct()
    return left.unionByName(pairs.select(*_KEYS, F.lit(True).alias("right"), "rep", "s1", F.col("rep").alias("part")))


def _with_others(members: DataFrame, found: DataFrame) -> DataFrame | None:
    """Cells of the second pass: members outside the largest component of their bucket on the left, all of its members on the right.

    None if no bucket has members that may still have to meet.
    """
    parted = members.select("bucket", "rep", "s1").join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("bucket", "rep", "s1", F.coalesce("component", "rep").alias("part"))
    parted = store(parted, "parted")
    sizes = parted.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    # the size and, to break ties, the component's own number, in one comparable value
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("parts"))
    mixed = largest.filter("parts > 1 and m > 3").select("bucket", F.col("top.part").alias("top"), F.ceil((F.col("m") - F.col("top.n")) / BLOCK).cast("long").alias("lefts"), F.ceil(F.col("m") / BLOCK).cast("long").alias("rights"))
    mixed = store(mixed, "mixed")
    if mixed.isEmpty():
        return None
    rows = parted.join(mixed.hint("merge"), "bucket")
    own = lambda k: F.pmod(F.xxhash64("rep", "s1"), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    left = rows.filter("part <> top").select(F.col("bucket").alias("a"), own("lefts").alias("b"), every("rights").alias("c"), F.lit(False).alias("right"), "rep", "s1", "part")
    right = rows.select(F.col("bucket").alias("a"), every("lefts").alias("b"), own("rights").alias("c"), F.lit(True).alias("right"), "rep", "s1", "part")
    return left.unionByName(right)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set size, two digests of the set, its bands' keys and one byte of each minimum."""
    return frugal(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_sign, _SIGNED)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and wordless texts have empty sets and link with nothing. Rows with
    the same doc_id are one node, linked by any of its texts. A row without
    doc_id links with nothing and has a null component_id and kept; a wordless
    row is alone even if its doc_id has another row. Texts of any length are hashed whole, in blocks; a text's own set has to fit into a
    task. An empty table gives an empty result.
    """
    table = store(signatures(docs), "signatures")
    full = table.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("x")).select("s1", "s2", "rep", "x.bands", "x.sketch")
    classes = store(classes, "classes")
    banded = classes.select("rep", "s1", F.explode("bands").alias("bucket"))
    member = F.struct("rep", "s1")
    # together a fingerprint of a bucket's members, of which each is there once
    xors = [F.expr("bit_xor(xxhash64(rep, s1))").alias("f1"), F.expr("bit_xor(xxhash64(rep, s1, 1))").alias("f2")]
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), *xors).filter("m > 1")
    once = buckets.groupBy("m", "f1", "f2").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    members = store(banded.join(once.hint("merge"), "bucket"), "members")
    # classes that share their least doc_id are told apart by the digest
    # written, so that the join reads both sides from exchanges of their own and can deal a large bucket out
    pivots = store(members.groupBy("bucket").agg(F.min(member).alias("low"), F.max(member).alias("high")), "pivots")
    first = _links(docs, classes, _with_pivots(members.join(pivots.hint("merge"), "bucket")))
    # rows of one doc_id with different texts tie their classes together
    torn = full.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("a"), F.max(F.struct("s1", "s2")).alias("b")).filter("a <> b").select("doc_id")
    torn = store(torn, "torn")
    if not torn.isEmpty():
        ties = full.select("doc_id", "s1", "s2").join(torn, "doc_id").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
        first = first.unionByName(ties)
    found = connected_components(first)
    cells = _with_others(members, found)
    if cells is not None:
        second = _links(docs, classes, cells)
        if not second.isEmpty():
            found = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second))
    labels = classes.select("s1", "s2", "rep").join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("c"))
    rows = table.select("doc_id", "n_shingles", "s1", "s2")
    per_row = rows.filter("n_shingles > 0").join(labels.hint("merge"), ["s1", "s2"], "left")
    per_row = per_row.unionByName(rows.filter("n_shingles = 0").withColumn("c", F.col("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return per_row.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Shingle sets, all pairs that share a shingle, and reachability, for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS a FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node AND r.low < e.v),
m AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.node = d.doc_id
"""

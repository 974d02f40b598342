"""Vectorised word hashing over batches of texts.

Words are hashed to 64 bits by a polynomial over random byte values, computed
for a whole block with one prefix sum, so no Python object is made per word.
The hash of a word does not depend on where it stands, which lets long texts
be hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; longer texts go through in several blocks.
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_SPACE = 32
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i up to n."""
    if "p" not in _tables or len(_tables["p"]) <= n:
        size = max(n, BLOCK) + 1024
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 2**64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _tables[key] = np.multiply.accumulate(steps)
    return _tables["p"], _tables["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_table(is_word) -> np.ndarray:
    """256 bytes: A-Z lower-cased, bytes outside words become a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for b in range(256):
        if not is_word(int(table[b])):
            table[b] = _SPACE
    return table


#: Words are runs of anything but ASCII white space.
NON_SPACE = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
#: Words are runs of 0-9, a-z and every byte of a non-ASCII character.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def _blocks(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Cut a normalised buffer after separators, near every BLOCK bytes."""
    at = 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(raw[at:end] == _SPACE)
            while not len(gaps) and end < len(raw):
                end = min(end + BLOCK, len(raw))
                gaps = np.flatnonzero(raw[at:end] == _SPACE)
            if end < len(raw) or len(gaps):
                end = at + int(gaps[-1]) + 1 if len(gaps) else end
        yield raw[at:end]
        at = end


def hash_words(texts: list[bytes], table: np.ndarray, prefixes: tuple[int, ...] = ()):
    """Hash all words of ``texts``.

    Returns (hashes, bounds): text i owns ``hashes[bounds[i]:bounds[i + 1]]``,
    in order. With ``prefixes``, a third item holds for each length k an array
    of hashes of the words' first k bytes (0 for shorter words).
    """
    raw = table[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    text_end = np.cumsum(lengths + 1)
    hashes, starts, more, base = [], [], [[] for _ in prefixes], 0
    for block in _blocks(raw):
        gap = block == _SPACE
        edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(end) < len(start):
            end = np.append(end, len(block))
        power, inverse = _powers(len(block))
        with np.errstate(over="ignore"):
            total = np.zeros(len(block) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[block] * power[: len(block)], out=total[1:])
            at = inverse[start]
            size = end - start
            hashes.append(mix((total[end] - total[start]) * at + size.astype(np.uint64)))
            for k, out in zip(prefixes, more):
                long = size >= k
                stop = np.where(long, start + k, start)
                out.append(np.where(long, mix((total[stop] - total[start]) * at + np.uint64(1000 + k)), np.uint64(0)))
        starts.append(start + base)
        base += len(block)
    joined = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, *more)]
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.searchsorted(start, text_end)]).astype(np.int64)
    return (joined[0], bounds, joined[1:]) if prefixes else (joined[0], bounds)


def slices(sizes, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to about ``limit``; one row at least."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def texts_of(batches, column: str = "text", limit: int = BLOCK):
    """(rows, texts) for runs of rows of Arrow batches whose column ``column``, binary or string, holds about ``limit`` bytes; nulls give empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        col = col if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else col.cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        for a, b in slices(sizes.tolist(), limit):
            rows = pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns], schema=batch.schema)
            yield rows, [x or b"" for x in col.slice(a, b - a).to_pylist()]


def spark_int(x: np.ndarray) -> np.ndarray:
    """64-bit patterns as the signed integers that Spark has."""
    return np.ascontiguousarray(x).view(np.int64)

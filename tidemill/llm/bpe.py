"""Byte-pair encoding by backtracking, and decoding by an offset table.

The encoder never runs the merge loop. It takes the longest vocabulary token at
each position, found by an Aho-Corasick automaton's trie, and keeps it only if
it may stand after the token before it; otherwise it falls back to the token's
longest proper prefix token, or gives up the token before. Two tokens may stand
side by side when merging their bytes on their own, and thus within any text,
leaves the border between them alone. Positions found to be dead ends are never
tried again, so the work is linear in the length of the text, and the result is
what the ranked merges give.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import os
import struct

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .storage import frugal
from .words import slices

#: The vocabulary file; the folder that has it can be set by this variable of the environment.
_NAME = "byte_bpe_50k.json"
VOCABULARY = f"{os.environ['TIDEMILL_TOKENIZERS']}/{_NAME}" if "TIDEMILL_TOKENIZERS" in os.environ else public_tokenizers.path(_NAME)
#: Words whose tokens a worker remembers before it starts over.
REMEMBERED = 120_000
#: Ids decoded at once.
AT_ONCE = 1 << 18
#: Longer words aren't remembered.
LONG = 64

#: Fixed pattern of the vocabulary: how texts are cut into words before merging.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: Spaces at an end of the text or beside white space.
RUNS = regex.compile(r"\s | \s|^ | $")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes in vocabulary files: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level vocabulary with ranked merges; ``encode`` and ``decode`` are exact inverses on UTF-8 texts."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = {token: bytes(alphabet[c] for c in token) for token in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token[i] = raw[token]
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.blob = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.token])]).astype(np.int64)
        self.id = {raw[token]: i for token, i in ids.items()}
        # a merge's rank orders it; the parts of a token are those of its merge
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = ids[left], ids[right]
            whole = ids[left + right]
            self.merged[a, b] = (rank, whole)
            self.parts.setdefault(whole, (a, b))
        self.rank = {whole: self.merged[p][0] for whole, p in self.parts.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for word, i in self.id.items():
            self.automaton.add_word(word.decode("latin-1"), (i, len(word) - 1))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for word, i in self.id.items():
            text = word.decode("latin-1")[:-1]
            n = self.automaton.longest_prefix(text)
            while n and word[:n] not in self.id:
                n -= 1
            self.shorter[i] = self.id[word[:n]] if n else -1
        self.bad = self._unreachable()
        self.can_follow: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _border_holds(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge ranked before ``limit`` crosses the border of two tokens.

        The tokens are unfolded towards the border from their last merges
        back. A pair there that merges earlier than the step just undone would
        have been made first; of two equal merges the left one is.
        """
        strict = True
        while True:
            merge = self.merged.get((left, right))
            if merge and (merge[0] < limit or not strict and merge[0] == limit):
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            strict = a > b
            if strict:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b, self.parts[right][0]

    def _compatible(self, a: int, b: int) -> bool:
        if len(self.can_follow) >= 2 * REMEMBERED:
            self.can_follow.clear()
        found = self.can_follow[a << 32 | b] = self._border_holds(a, b, 1 << 60)
        return found

    def _unreachable(self) -> set[int]:
        """Tokens that merging their own bytes does not give; the vocabulary has them, but no encoding does."""
        bad: set[int] = set()
        for token in sorted(self.parts, key=self.rank.get):
            a, b = self.parts[token]
            rank = self.rank[token]
            if a in bad or b in bad or max(self.rank.get(a, -1), self.rank.get(b, -1)) > rank or not self._border_holds(a, b, rank):
                bad.add(token)
        return bad | {i for i in self.id.values() if i not in self.parts and len(self.token[i]) > 1}

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one word, by backtracking over longest matches."""
        whole = self.id.get(word)
        if whole is not None and whole not in self.bad:
            return [whole]
        longest: dict[int, int] = {}
        for last, (i, back) in self.automaton.iter(word.decode("latin-1")):
            longest[last - back] = i  # of the matches from a place the longest ends last
        token, size, can_follow = self.token, len(word), self.can_follow
        at, out, dead, before, now = 0, [], set(), -1, longest[0]
        while True:
            end = at + len(token[now])
            ok = before < 0 or can_follow.get(before << 32 | now)
            if ok is None:
                ok = self._compatible(before, now)
            if ok and end not in dead and now not in self.bad:
                out.append(now)
                if end == size:
                    return out
                at, before, now = end, now, longest[end]
                continue
            now = self.shorter[now]
            if now < 0:
                dead.add(at)
                now = out.pop()
                at -= len(token[now])
                before = out[-1] if out else -1

    def _remember(self, word: str) -> bytes:
        ids = self.encode_word(word.encode())
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def _words(self, text: str) -> bytes:
        get = self.known.get
        return b"".join([get(w) or self._remember(w) for w in SPLIT.findall(text)])

    def _after_space(self, chunk: str) -> bytes:
        if chunk.isalpha():  # one word, as is what stands before a last stop or comma
            ids = self._remember(" " + chunk)
        elif chunk[:-1].isalpha() and chunk[-1] in ".,":
            word = " " + chunk[:-1]
            ids = (self.known.get(word) or self._remember(word)) + (self.known.get(chunk[-1]) or self._remember(chunk[-1]))
        else:
            ids = self._words(" " + chunk)
        if len(chunk) <= LONG:
            if len(self.spaced) >= 2 * REMEMBERED:
                self.spaced.clear()
            self.spaced[chunk] = ids
        return ids

    def _piece(self, text: str) -> bytes:
        """A space between other characters than white space starts a word, so what stands between such spaces is cut on its own."""
        if RUNS.search(text):
            return self._words(text)
        first, *rest = text.split(" ")
        get = self.spaced.get
        return self._words(first) + b"".join([get(x) or self._after_space(x) for x in rest])

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; special tokens' strings give their ids."""
        if not self.cut:
            return self._piece(text)
        pieces = self.cut.split(text)
        return b"".join(self.special[x].to_bytes(4, "little") if k % 2 else self._piece(x) for k, x in enumerate(pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered from one blob by the table of offsets."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        at, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        step = np.arange(ends[-1], dtype=np.int64) + np.repeat(at - (ends - size), size)
        return self.blob[step].tobytes()


@functools.cache
def codec(path: str) -> Codec:
    made = Codec(path)
    gc.freeze()  # the tables stay; later collections needn't walk them
    return made


def _encoded(path: str, with_ids: bool):
    def run(batches):
        c = codec(path)
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                n, ids_hash, text_hash, kept = [], [], [], []
                for text in column.slice(a, b - a).to_pylist():
                    ids = c.encode(text or "")
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    back = hashlib.sha256()
                    numbers = np.frombuffer(ids, dtype="<u4")
                    for k in range(0, len(numbers), AT_ONCE):
                        back.update(c.decode(numbers[k : k + AT_ONCE]))
                    text_hash.append(back.hexdigest())
                    kept.append(ids)
                out = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.binary())] if with_ids else out, names=[*names, "ids"] if with_ids else names)

    return run


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``digests`` with the column ids: the token ids as little-endian unsigned 32-bit integers."""
    return frugal(docs).select("doc_id", "text").mapInArrow(_encoded(path, True), _DIGESTS + ", ids binary")


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows with doc_id and ids, as ``encoded`` makes them."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.frombuffer(x or b"", dtype="<u4")).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return frugal(tokens).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts as empty: no tokens, and the digests of no bytes. Rows
    are independent, so repeated rows give repeated results; an empty table
    gives an empty result. Texts of any length are encoded whole, a text's ids
    being held at once. Ids and decoded texts never leave the task.
    """
    return frugal(docs).select("doc_id", "text").mapInArrow(_encoded(path, False), _DIGESTS)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

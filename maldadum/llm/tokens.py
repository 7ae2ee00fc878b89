"""Encoding with a public byte-level BPE vocabulary by prefix-sharing trie traversal (p8).

The distinct words (pieces of the vocabulary's split pattern) of a batch form a trie of bytes. Every prefix of a word has
one last token: the token that ends there and may follow the last token of the prefix before it. A depth-first walk finds the
last token of each trie node once, from the nodes above it, for all words that share the prefix; a word's ids are read backwards
along the last tokens. Two tokens may be neighbours if merging the bytes of both would not have crossed their border, which is told from
how each was merged.

Defined results: a null and an empty text give the empty list; a blank text is encoded as it stands; special tokens are
ordinary text; texts are taken whole. Repeated ids and extra columns are passed through or left out, never merged. No rows give
no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folder of the public vocabularies, unless a call names one (``folder``) or the session does (``spark.maldadum.tokenizers``).
TOKENIZER_DIR = "/opt/tokenizers"
#: The split pattern that belongs to the rank files (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept encoded per Python worker; when full, the memory is emptied and filled anew.
CACHE_WORDS = 300_000
#: Pairs of tokens of which it is known whether they may be neighbours; emptied when full.
CACHE_PAIRS = 1_000_000


class Vocabulary:
    """Ranks, and how each token was merged."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        self.left = list(range(size))
        self.right = list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in self.rank.items():
            if len(token) > 1:
                a, b = self._last_merge(token, rank)
                self.left[rank], self.right[rank] = a, b
                self.merged[a, b] = rank
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.ends_with: dict = {}  # trie of reversed tokens, the token's rank under -1
        for token, rank in self.rank.items():
            node = self.ends_with
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes and b's bytes together is a, b."""
        known = self.neighbours.get((a, b))
        if known is None:
            if len(self.neighbours) >= CACHE_PAIRS:
                self.neighbours.clear()
            known = self.neighbours[a, b] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        # undo merges, the latest first; a merge across the border that is due before a merge at hand takes its bytes away
        limit = 1 << 60
        while True:
            cross = self.merged.get((a, b))
            if cross is not None and cross < limit:
                return False
            if a > b:
                limit = a
                a = self.right[a]
                if a == limit:
                    limit = b + 1
                    b = self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.left[b]
                if b + 1 == limit:
                    limit = a
                    a = self.right[a]
                    if a == limit:
                        return True


class TrieEncoder:
    """Encodes words by a depth-first walk over the trie of the words that are new."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.words: dict[str, int] = {}  # word -> row of the encoded words
        self.ids: list[np.ndarray] = []
        self.counts = np.zeros(0, np.int32)

    def add(self, new: list[str]) -> None:
        """Encode words. In sorted order they are the leaves of their trie from left to right, so the path from the root to
        the current leaf is all of the trie that has to be kept: on it ``last[d]`` is the last token of the prefix of d bytes
        and ``begin[d]`` where that token begins."""
        ends_with, may_follow = self.vocabulary.ends_with, self.vocabulary.may_follow
        last, begin, before = [-1], [0], b""
        for raw, word in sorted((w.encode("utf-8"), w) for w in new):
            shared, most = 0, min(len(raw), len(before))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for depth in range(shared, len(raw)):
                # tokens that end here, shortest first, from a trie of reversed tokens
                node, found, at = ends_with, [], depth
                while at >= 0:
                    node = node.get(raw[at])
                    if node is None:
                        break
                    token = node.get(-1)
                    if token is not None:
                        found.append((token, at))
                    at -= 1
                # the longest that may follow the last token of what is before it
                for token, at in reversed(found):
                    if at == 0 or may_follow(last[at], token):
                        last.append(token)
                        begin.append(at)
                        break
            before = raw
            ids, at = [], len(raw)
            while at:
                ids.append(last[at])
                at = begin[at]
            self.words[word] = len(self.ids)
            self.ids.append(np.array(ids[::-1], np.int32))
        fresh = self.ids[len(self.counts) :]
        self.counts = np.concatenate([self.counts, np.fromiter(map(len, fresh), np.int32, len(fresh))])

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``ids``, encoding those not met before."""
        rows = list(map(self.words.get, words))
        if None in rows:
            new = {w for w, r in zip(words, rows) if r is None}
            if len(self.words) + len(new) > CACHE_WORDS:
                self.words, self.ids, self.counts, new = {}, [], np.zeros(0, np.int32), set(words)
            self.add(list(new))
            rows = list(map(self.words.get, words))
        return np.array(rows, np.int64)


_WORKER: dict[str, tuple[TrieEncoder, object]] = {}


def encoder(path: str) -> tuple[TrieEncoder, object]:
    """The worker's encoder of a rank file, and its split."""
    if path not in _WORKER:
        _WORKER[path] = TrieEncoder(Vocabulary(path)), regex.compile(PATTERN).findall
    return _WORKER[path]


def _pieces(texts: list[str | None], path: str) -> tuple[TrieEncoder, np.ndarray, np.ndarray]:
    """(encoder, row of each piece, pieces per text)."""
    trie, split = encoder(path)
    words: list[str] = []
    per_text = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            before = len(words)
            words += split(text)
            per_text[i] = len(words) - before
    return trie, trie.rows(words), per_text


def encode_batch(texts: list[str | None], path: str) -> pa.ListArray:
    trie, rows, per_text = _pieces(texts, path)
    counts = trie.counts[rows].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    flat = np.concatenate([trie.ids[r] for r in rows.tolist()]) if len(rows) else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(per_text)] if len(texts) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))


def count_batch(texts: list[str | None], path: str) -> np.ndarray:
    trie, rows, per_text = _pieces(texts, path)
    sums = np.concatenate([[0], np.cumsum(trie.counts[rows], dtype=np.int64)]) if len(rows) else np.zeros(1, np.int64)
    ends = np.cumsum(per_text)
    return sums[ends] - sums[ends - per_text]


def text_runs(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``chars`` characters, so that a batch of long texts is not held at once."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def rank_file(spark: SparkSession, vocabulary: str, folder: str | None = None) -> str:
    """Where a vocabulary is: in ``folder``, else where the session says, else in TOKENIZER_DIR."""
    return os.path.join(folder or spark.conf.get("spark.maldadum.tokenizers", None) or TOKENIZER_DIR, f"{vocabulary}.tiktoken")


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``key`` and ``ids`` ARRAY<INT> of each row; one pass, no shuffle."""
    path = rank_file(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in text_runs(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), encode_batch(texts[lo:hi], path)], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids ARRAY<INT>")


def token_counts(df: DataFrame, text: str, *keep: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` BIGINT of each row; 0 for null and empty texts."""
    path = rank_file(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in text_runs(texts):
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(count_batch(texts[lo:hi], path), pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*[F.col(k) for k in keep], F.col(text)).mapInArrow(run, f"{schema}, n_tokens BIGINT")

"""Problem 6: encoding a whole corpus with a public byte-level BPE vocabulary.

Corpus-level merge replay. Spark carries the work in three stages:

1. Tasks cut blocks of documents into words (vectorised, on arrays of code points) and keep of each block its
   distinct words and, for each document, numbers of words. The blocks are a table in the shared folder.
2. The distinct words of the whole corpus are spread over tasks by hash. A task lays the words of each Arrow batch out as
   one sequence of symbols and replays the merges: an inverted index from pair to positions applies each merge in
   order of rank, touching only the neighbours of the places merged. Words never meet, so batches of the
   vocabulary are independent and the result is exact. Each distinct word of the corpus is merged once.
3. Ids of words are joined to the blocks' words, gathered by block and laid out by document with array indexing.

The corpus's words are never broadcast and no word of a document is a row of a shuffle; what travels are each block's
distinct words (about one row in a hundred words) and the packed numbers. The public vocabulary is read by the driver
and broadcast to the tasks, so that executors need no file.

Defined results: null and empty texts have no ids (an empty list); strings that look like special tokens are
ordinary text; every document gives one row, repeated and null doc_id included.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_CHARS = 2_000_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points of Unicode's White_Space, and the endings that the split pattern cuts off.
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def split_points(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Start of each word in ``cp``, the code points of documents laid end to end; ``bounds`` has each document's
    first position and the total length. Splits as the pattern of the public vocabulary does."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start |= edge
    # white space before text keeps all but its last character; a last blank joins the text behind it
    white = kind == SPACE
    last = np.flatnonzero(white & start[1:] & ~edge[1:])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # an apostrophe that starts a word takes a contraction's letters with it
    quote = np.flatnonzero((cp == 39) & start[:n])
    for end in CONTRACTIONS:
        k = len(end)
        at = quote[quote + k < n]
        for j, ch in enumerate(end, 1):
            at = at[cp[at + j] == ord(ch)]
        inside = ~np.logical_or.reduce([edge[at + j] for j in range(1, k + 1)]) if len(at) else np.zeros(0, bool)
        at = at[inside]
        start[at + 1] = False
        start[at + 1 + k] = True
    return np.flatnonzero(start[:n])


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = 0x5851F42D4C957F2D
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, p, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(p, -1, 1 << 64), np.uint64)])
    return up, down


def number_words(text: str, cp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Number of each word, and the distinct words in order of number.

    Words are told apart by a rolling hash of 64 bits, and each word is then compared with the first of its number,
    so the result is exact.
    """
    n = len(cp)
    stop = np.append(start[1:], n)
    up, down = _powers(1 << max(n, 1).bit_length())
    with np.errstate(over="ignore"):
        mixed = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * up[:n], out=total[1:])
        code = (total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)
    number, _ = pd.factorize(code)
    first = np.empty(number.max() + 1 if len(number) else 0, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    size = stop - start
    same = size == size[first[number]] if len(number) else np.zeros(0, bool)
    if same.all() and (cp == cp[np.arange(n) + np.repeat(start[first[number]] - start, size)]).all():
        return number, [text[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
    known: dict[str, int] = {}
    number = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(start.tolist(), stop.tolist())])
    return number, list(known)


_BLOCKS = "block_id long, doc_ids array<long>, n_words array<int>, numbers binary, words array<string>"


def _block(block_id: int, ids: list, texts: list[str]) -> pa.RecordBatch:
    text = "".join(texts)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    start = split_points(cp, bounds)
    number, words = number_words(text, cp, start)
    per_doc = np.diff(np.searchsorted(start, bounds))
    packed = number.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32).tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block_id], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([per_doc.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([packed], pa.binary()),
            pa.array([words], pa.list_(pa.string())),
        ],
        ["block_id", "doc_ids", "n_words", "numbers", "words"],
    )


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, count = TaskContext.get().partitionId() << 32, itertools.count()
    ids: list = []
    texts: list[str] = []
    chars = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = t or ""
            if texts and chars + len(t) > BLOCK_CHARS:
                yield _block(task + next(count), ids, texts)
                ids, texts, chars = [], [], 0
            ids.append(i)
            texts.append(t)
            chars += len(t)
    if texts:
        yield _block(task + next(count), ids, texts)


@functools.lru_cache(2)
def ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token to rank, of a vocabulary file's content."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def replay(words: list[bytes], rank: dict[bytes, int]) -> list[list[int]]:
    """Token ids of each word, by replaying the merges over all of them at once."""
    token = {r: b for b, r in rank.items()}
    byte_id = [rank[bytes([b])] for b in range(256)]
    sym: list[int] = []
    nxt: list[int] = []
    prv: list[int] = []
    heads: list[int] = []
    for w in words:
        at = len(sym)
        heads.append(at)
        sym.extend([byte_id[b] for b in w])
        nxt.extend(range(at + 1, at + len(w) + 1))
        prv.extend(range(at - 1, at + len(w) - 1))
        if w:
            nxt[-1] = prv[at] = -1
    merged: dict[tuple[int, int], int | None] = {}
    where: dict[tuple[int, int], list[int]] = {}
    heap: list[tuple[int, tuple[int, int]]] = []

    def index(at: int) -> None:
        pair = (sym[at], sym[nxt[at]])
        if pair not in merged:
            merged[pair] = rank.get(token[pair[0]] + token[pair[1]])
        if (r := merged[pair]) is not None:
            if pair in where:
                where[pair].append(at)
            else:
                where[pair] = [at]
                heapq.heappush(heap, (r, pair))

    for at in range(len(sym)):
        if nxt[at] >= 0:
            index(at)
    while heap:
        r, pair = heapq.heappop(heap)
        a, b = pair
        for at in sorted(where.pop(pair)):
            to = nxt[at]
            if sym[at] != a or to < 0 or sym[to] != b:
                continue  # an earlier merge took one of the two
            sym[at], sym[to] = r, -1
            after = nxt[at] = nxt[to]
            if after >= 0:
                prv[after] = at
                index(at)
            if prv[at] >= 0:
                index(prv[at])
    out = []
    for w, at in zip(words, heads):
        ids = []
        while w and at >= 0:
            ids.append(sym[at])
            at = nxt[at]
        out.append(ids)
    return out


def _replay_words(vocabulary):
    """``vocabulary``: a broadcast of the file's content, whose size does not grow with the corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replay([w.encode() for w in words], ranks(vocabulary.value)), pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _lay_out(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_ids, offsets of each document, ids) of each block."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            doc_ids, n_words = one.column("doc_ids").flatten(), one.column("n_words").flatten().to_numpy()
            per_word = one.column("word_ids").flatten()
            length = per_word.value_lengths().to_numpy().astype(np.int64)
            begin = np.cumsum(length) - length
            values = per_word.flatten().to_numpy()
            packed = one.column("numbers")[0].as_py()
            number = np.frombuffer(packed, np.uint16 if len(length) <= 1 << 16 else np.uint32)
            size = length[number]
            stop = np.cumsum(size)
            ids = values[np.repeat(begin[number] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
            offsets = np.r_[0, stop][np.r_[0, np.cumsum(n_words)]]
            yield doc_ids, offsets, ids


def _ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_ids, offsets, ids in _lay_out(batches):
        yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_ids, offsets, _ in _lay_out(batches):
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(offsets).astype(np.int64))], ["doc_id", "n_tokens"])


def _blocks_with_ids(documents: DataFrame, path: str) -> DataFrame:
    spark = documents.sparkSession
    blocks = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut, _BLOCKS), "blocks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.rdd.getNumPartitions())  # follows the input
    words = blocks.select(F.explode("words").alias("word")).distinct().repartition(parts, "word")
    merged = words.mapInArrow(_replay_words(spark.sparkContext.broadcast(read_vocabulary(path))), "word string, ids array<int>")
    placed = blocks.select("block_id", F.posexplode("words").alias("number", "word")).join(merged, "word")
    gathered = placed.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("number", "ids"))).alias("w"))  # a block's distinct words: bounded by its size
    gathered = gathered.select("block_id", F.col("w.ids").alias("word_ids"))
    return blocks.select("block_id", "doc_ids", "n_words", "numbers").join(gathered, "block_id", "left").withColumn("word_ids", F.coalesce("word_ids", F.array().cast("array<array<int>>")))


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of each document."""
    return _blocks_with_ids(documents, path).mapInArrow(_ids, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of each document."""
    return _blocks_with_ids(documents, path).mapInArrow(_counts, "doc_id long, n_tokens long")

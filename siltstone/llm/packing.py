"""Texts into containers of a fixed number of tokens (problem 8).

Linear grouping scheme, run on blocks of items that are independent of each other (each block wastes at most
a container or so, so blocks of ``BLOCK_ITEMS`` items cost a tiny share). In a block:

1. a text above the capacity is divided into full pieces and a rest, nothing else is divided;
2. items above ``SMALL`` of the capacity are large; sorted by size they form groups of equal cardinality,
   and each is rounded up to the largest of its group, which leaves few sizes;
3. the fractional optimum over configurations (multisets of those sizes that fit) is found by the simplex
   method with column generation, and its whole part is taken;
4. actual items take the places of their group's rounded ones, the largest first;
5. what remains, in falling order of size, goes to the container whose free space fits best.

Defined results: null and empty texts have no tokens and take no container (null). Equal texts and repeated
rows are items of their own, repeated ids are kept. The containers depend on the rows alone, not on how they lie in
files. An empty table gives no row.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stage
from siltstone.workers import with_code

CAPACITY = 2048
BLOCK_ITEMS = 40_000
SMALL = 1 / 8
GROUPS = 48


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """Byte-level BPE from a file of ranks. Special strings in a text are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: (doc_id, text) to (doc_id, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return run


class _Knapsack:
    """The multiset of sizes within the capacity that is worth most, by layers: the best of up to k items from that of k - 1."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.layers = capacity // int(sizes.min())
        rest = np.arange(capacity + 1) - sizes[:, None]
        self.fits, self.rest = rest >= 0, np.maximum(rest, 0)

    def best(self, prices: np.ndarray) -> np.ndarray:
        worth, took = np.zeros(self.capacity + 1), []
        every = np.arange(self.capacity + 1)
        for _ in range(self.layers):
            one_more = np.where(self.fits, worth[self.rest] + prices[:, None], -1.0)
            item = one_more.argmax(axis=0)
            more = one_more[item, every]
            better = more > worth + 1e-12
            took.append(np.where(better, item, -1))
            worth = np.where(better, more, worth)
        out, c = np.zeros(len(self.sizes)), self.capacity
        for layer in reversed(took):
            if layer[c] >= 0:
                out[layer[c]] += 1
                c -= int(self.sizes[layer[c]])
        return out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often the fractional optimum takes each.

    The counts are told apart by tiny amounts, so every step gains something and the search ends at the optimum.
    """
    knapsack = _Knapsack(sizes, capacity)
    counts = counts + 1e-5 * np.arange(1, len(sizes) + 1) / len(sizes)
    basis = np.diag(np.floor(capacity / sizes))
    amounts = counts / np.diag(basis)
    while True:
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = knapsack.best(np.maximum(prices, 0))
        if column @ prices <= 1 + 1e-7:
            return basis, amounts
        step = np.linalg.solve(basis, column)
        ratio = np.divide(amounts, step, out=np.full(len(sizes), np.inf), where=step > 1e-9)
        leaves = int(ratio.argmin())
        if ratio[leaves] * (column @ prices - 1) <= 1e-13 * amounts.sum():
            return basis, amounts  # what is left to gain is below what these numbers can hold
        basis[:, leaves] = column
        amounts = np.maximum(np.linalg.solve(basis, counts), 0)


class _Bins:
    """Containers by free space; the best fitting one is found through a bit set of the spaces that occur."""

    def __init__(self, capacity: int):
        self.capacity, self.free = capacity, []
        self.by_space: dict[int, list[int]] = {}
        self.spaces = 0

    def open(self, used: int) -> int:
        self.free.append(self.capacity - used)
        self._put(len(self.free) - 1)
        return len(self.free) - 1

    def _put(self, b: int) -> None:
        space = self.free[b]
        self.by_space.setdefault(space, []).append(b)
        self.spaces |= 1 << space

    def best_fit(self, size: int) -> int:
        fits = self.spaces >> size
        if not fits:
            return self.open(size)
        space = size + (fits & -fits).bit_length() - 1
        same = self.by_space[space]
        b = same.pop()
        if not same:
            self.spaces &= ~(1 << space)
        self.free[b] -= size
        self._put(b)
        return b


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes are from 1 to the capacity."""
    bins = _Bins(capacity)
    out = np.full(len(sizes), -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    large = order[sizes[order] > capacity * SMALL]
    if len(large):
        groups = np.array_split(large, min(GROUPS, len(large)))  # equal cardinality, the largest first
        rounded = np.array([sizes[g[0]] for g in groups])
        same = np.unique(-rounded, return_inverse=True)[1]
        groups = [np.concatenate([g for g, s in zip(groups, same) if s == k]) for k in range(same.max() + 1)]
        rounded = np.array([sizes[g[0]] for g in groups])
        columns, amounts = configurations(rounded, np.array([float(len(g)) for g in groups]), capacity)
        queues = [list(g[::-1]) for g in groups]
        for j in np.argsort(-amounts, kind="stable"):
            for _ in range(int(amounts[j] + 1e-4)):
                taken = [queues[i].pop() for i in range(len(groups)) for _ in range(int(columns[i, j])) if queues[i]]
                if not taken:
                    break
                b = bins.open(int(sizes[taken].sum()))
                out[taken] = b
    for i in order:
        if out[i] < 0:
            out[i] = bins.best_fit(int(sizes[i]))
    return out


def containers(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """container, doc_id, piece, first_token, n_tokens of every piece; ``items`` has doc_id and n_tokens.

    ``container`` is unique over all blocks.
    """
    n = items.count()
    blocks = max(1, -(-n // block_items))
    kind = items.schema["doc_id"].dataType.simpleString()
    # Rows that agree are numbered, so that the block of each follows from the rows alone and not from files or tasks.
    equal = items.where("n_tokens > 0").groupBy("doc_id", "n_tokens").count()
    numbered = equal.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("row"))
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens", "row"], ignore_index=True)
        tokens = pdf["n_tokens"].to_numpy()
        full, tail = tokens // capacity, tokens % capacity  # full pieces need no packing, only a number
        source = np.concatenate([np.repeat(np.arange(len(pdf)), full), np.flatnonzero(tail)])
        piece = np.concatenate([np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), full[tail > 0]])
        size = np.concatenate([np.full(full.sum(), capacity), tail[tail > 0]]).astype(np.int64)
        number = np.concatenate([np.arange(full.sum()), full.sum() + pack(tail[tail > 0], capacity)]).astype(np.int64)
        return pd.DataFrame(
            {
                "container": number * blocks + pdf["block"].iloc[0],
                "doc_id": pdf["doc_id"].to_numpy()[source],
                "piece": piece.astype(np.int32),
                "first_token": piece.astype(np.int64) * capacity,
                "n_tokens": size,
            }
        )

    # A number of partitions of its own: by bytes, which are few, whole runs of blocks would share a task.
    packed = with_code(numbered).repartition(blocks, "block").groupBy("block").applyInPandas(run, f"container long, doc_id {kind}, piece int, first_token long, n_tokens long")
    empty = items.where("n_tokens = 0").select(F.lit(None).cast("long").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "n_tokens")
    return packed.unionByName(empty)


def measure(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and n_tokens of each row, written once since packing reads it several times."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stage(with_code(docs).select("doc_id", "text").mapInArrow(count_tokens(tokenizer_path), f"doc_id {kind}, n_tokens long"), "token-counts")

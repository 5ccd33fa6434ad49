"""Containers of fixed capacity filled with items, by Karmarkar-Karp multiway differencing.

Items are hashed by their key into blocks of about ``BLOCK`` items; each block is packed by itself in one task, so the
work grows with the rows and no task holds more than a block, however skewed sources or lengths are. In a block every
item starts as a partial partition into m windows, all but one empty. The two partitions with the largest imbalance are
merged, the fullest window of one with the emptiest of the other, until one is left, whose windows are nearly equal. m
starts at the least count that could hold the block and rises whenever a window exceeds the capacity; a block loses
about a window that way, which is what bounds the room unused.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.engine.batches import keyed, restored
from millrace.engine.session import cut

CAPACITY = 2_048
BLOCK = 2_048
#: Tasks that fill windows from blocks at most; beyond, a task takes several blocks.
MOST_TASKS = 4_096
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer splits text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def tokenizer(folder: str = TOKENIZERS, memo: dict = {}):
    """The public byte-level BPE tokenizer, loaded once a worker."""
    path = os.path.join(folder, VOCABULARY)
    if path not in memo:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        memo[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return memo[path]


def count_tokens(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS) -> DataFrame:
    """(id, tokens) of the documents with more than blanks in them."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            encode = tokenizer(folder).encode_ordinary
            yield pd.DataFrame({"id_": b["id_"], "tokens": [len(encode(t)) for t in b["text_"]]})

    some = df.where(F.col(text_col).rlike(r"\S")).select(keyed(id_col), F.col(text_col).alias("text_"))
    return restored(some.mapInPandas(run, f"id_ string, tokens bigint"), id_col, kind)


def difference(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sums of the windows) of the differencing partition into ``m`` windows."""
    n = len(sizes)
    # A window is a tree of items: node i < n is an item, later ones join two nodes.
    left, right, nodes = [], [], n
    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        s, ids = np.zeros(m, np.int64), np.full(m, -1)
        s[0], ids[0] = sizes[i], i
        heap.append((-int(sizes[i]) if m > 1 else 0, int(i), s, ids))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        y = y[::-1]
        sums = a + b[::-1]
        ids = np.where(x < 0, y, x)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            left.append(x[both])
            right.append(y[both])
            ids[both] = np.arange(nodes, nodes + len(both))
            nodes += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, ids = sums[order], ids[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), first, sums, ids))
    _, _, sums, ids = heap[0]
    window = np.full(nodes, -1)
    window[ids[ids >= 0]] = np.flatnonzero(ids >= 0)
    if left:
        l, r = np.concatenate(left), np.concatenate(right)
        for k in range(nodes - n - 1, -1, -1):
            window[l[k]] = window[r[k]] = window[n + k]
    return window[:n], sums


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item (sizes at most ``capacity``), in as few windows as differencing can keep within it."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    m, step = max(1, -(-int(sizes.sum()) // capacity)), 1
    while True:
        window, sums = difference(sizes, m) if m < len(sizes) else (np.arange(len(sizes)), sizes)
        if sums.max() <= capacity:
            return window
        m, step = m + step, step + (m > 64) * (step // 2)


def fill(sizes: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(id, piece, container, place, start, size): where each item, or piece of an item above the capacity, lies.

    Pieces count from 1; only an item that alone exceeds the capacity has more than one, all but the last as large as a
    container and alone in theirs. start is where the piece begins in its item, place its position in the container from
    1. Items without a size or of size 0 or less are in no container. Of several rows with one id the largest counts;
    null ids are one id. Equal sizes are told apart by id. An empty table gives an empty one.
    """
    kind = sizes.schema[id_col].dataType.simpleString()
    items = sizes.select(keyed(id_col), F.col(size_col).cast("long").alias("size_")).where("size_ > 0").groupBy("id_").agg(F.max("size_").alias("size_"))
    items = cut(items)
    count = items.select(F.sum((F.col("size_") % capacity > 0).cast("long"))).first()[0] or 0
    blocks = max(1, round(count / block))
    full = items.where(F.col("size_") >= capacity).select("id_", F.explode(F.expr(f"sequence(1L, size_ div {capacity})")).alias("piece"))
    full = full.select(
        "id_", "piece", F.concat(F.lit("f-"), F.coalesce(F.col("id_").cast("string"), F.lit("null")), F.lit("-"), F.col("piece").cast("string")).alias("container"),
        F.lit(1).cast("long").alias("place"), ((F.col("piece") - 1) * capacity).alias("start"), F.lit(capacity).cast("long").alias("size"),
    )
    rest = items.where(F.col("size_") % capacity > 0).select("id_", F.expr(f"size_ div {capacity} + 1").alias("piece"), F.expr(f"size_ - size_ % {capacity}").alias("start"), F.expr(f"size_ % {capacity}").alias("size"))
    rest = rest.withColumn("block_", F.pmod(F.xxhash64("id_"), F.lit(blocks)))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(order_=g["id_"].astype(str)).sort_values(["size", "order_"], ascending=[False, True], kind="stable")
        window = pack(g["size"].to_numpy(), capacity)
        g["container"] = [f"b-{key[0]}-{w}" for w in window]
        g["place"] = g.groupby("container").cumcount() + 1
        return g[["id_", "piece", "container", "place", "start", "size"]]

    # By number, or adaptive execution would see few bytes and leave the work to few tasks.
    packed = rest.repartition(min(blocks, MOST_TASKS), "block_").groupBy("block_").applyInPandas(one, f"id_ string, piece bigint, container string, place bigint, start bigint, size bigint")
    return restored(full.unionByName(packed), id_col, kind)


def fill_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """``fill`` with the tokens of each document's text; null and blank documents are in no container."""
    return fill(count_tokens(df, id_col, text_col, folder), id_col, "tokens", capacity)

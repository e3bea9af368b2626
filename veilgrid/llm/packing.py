"""Packing documents into fixed-length token sequences: best-fit in each partition, then a tree of merges.

Each round deals the open bins (at first: the pieces of documents) to groups of bounded size, packs each group by
best-fit decreasing and emits the bins that are nearly full. The others go into the next round as single items. A
round has fewer items than the one before, so the tree ends with one group, or with a round that no longer helps.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import MEMO, Bpe, Encoder, load
from .common import documents, in_batches, staged, texts_of

PIECE = "struct<doc:{id},piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"


class RankMemo(dict):
    """Chunks of text to their ids as bytes; the vocabulary in rank form does new ones. Full, it keeps what it has."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.new = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.new(chunk)).tobytes()
        if len(self) < MEMO:
            self[chunk] = ids
        return ids


class RankEncoder(Encoder):
    """An Encoder that does new chunks by the same vocabulary in rank form."""

    def __init__(self, bpe: Bpe):
        import tiktoken

        super().__init__(bpe)
        ranks = {bytes(t): i for i, t in bpe.decode_table().items() if i not in bpe.special.values()}
        self.chunks = RankMemo(tiktoken.Encoding("ranks", pat_str=bpe.words.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        get, cut = self.chunks.__getitem__, self.bpe.chunks
        return [self.encode(t) if "<|" in t or (chunks := cut(t)) is None else b"".join(map(get, chunks)) for t in texts]


@functools.lru_cache(1)
def rank_encoder(tokenizer: str) -> RankEncoder:
    """The worker's encoder, with what it has learned in earlier tasks."""
    return RankEncoder(load(tokenizer))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, piece, start, length, ids_crc32): the ids of each document and its end id, in pieces of at most `capacity`.

    Only documents of over `capacity` ids are cut; their first piece takes the remainder. A null text is empty and
    still has its end id; repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = rank_encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoder.encode_batch(texts_of(batch))):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                at, part = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if at == 0 else capacity
                    row.append(k)
                    piece.append(part)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, part = at + size, part + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item by best-fit decreasing: each goes where it leaves the least room, else opens a bin.

    Bins of equal room share a stack, and the bits of one integer say which rooms have bins, so an item is placed in
    constant time whatever the number of bins.
    """
    bins = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[k] = b
        left = room - size
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins


def pack_round(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """One round: items (key, size, pieces) dealt to `groups` by their key, and packed in each."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable", ignore_index=True)
        again = pdf.groupby("key").cumcount().to_numpy()  # only rows repeated in full share a key, in the first round
        pdf["key"] = [f"{key}#{n}" if n else key for key, n in zip(pdf["key"], again.tolist(), strict=True)]
        bins = best_fit(pdf["size"].to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        keys, sizes, pieces, last = [], [], [], -1
        for k in order.tolist():
            if bins[k] != last:
                keys.append(pdf.at[k, "key"])
                sizes.append(0)
                pieces.append([])
                last = bins[k]
            moved = [dict(p) if isinstance(p, dict) else p.asDict() for p in pdf.at[k, "pieces"]]
            for p in moved:
                p["offset"] += sizes[-1]
            pieces[-1] += moved
            sizes[-1] += int(pdf.at[k, "size"])
        return pd.DataFrame({"key": keys, "size": sizes, "pieces": pieces})

    return items.groupBy(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g")).applyInPandas(lambda pdf: pack(pdf[["key", "size", "pieces"]]), items.schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    nearly_full: float = 0.995,
    group_items: int = 20_000,
    rounds: int = 20,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (its place in the sequence).

    A null text is empty and still has its end id; a null id is passed on; repeated rows are packed each by itself; an
    empty table gives an empty result; other columns aren't used. A text of any length is encoded whole by one worker.

    No group holds more than about group_items items, and a
    round takes only what the round before left open, so that no task grows with the corpus. Rounds end when one group
    held everything, or when a round closes fewer than 2 % of its bins. An item's key, and so its group and place,
    depend on its document and, so that rows repeated in full are dealt to many groups, its place in the table of pieces.
    """
    pieces = staged(token_pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col))
    kind = pieces.schema["doc"].dataType.simpleString()
    piece = F.struct("doc", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset")).cast(PIECE.format(id=kind))
    key = F.concat_ws("/", F.coalesce(F.col("doc").cast("string"), F.lit("")), "piece", "ids_crc32", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    done: list[DataFrame] = []
    items = pieces.select(key.alias("key"), F.col("length").alias("size"), F.array(piece).alias("pieces"))
    count = items.count()
    for k in range(rounds):
        groups = max(1, -(-count // group_items))
        bins = staged(pack_round(items, groups, capacity))
        last = groups == 1 or k + 1 == rounds
        open_ = F.col("size") < nearly_full * capacity
        left = 0 if last else bins.where(open_).count()
        if last or left > 0.98 * count:
            done.append(bins)
            break
        done.append(bins.where(~open_))
        items, count = bins.where(open_), left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode("pieces").alias("p")).select(
        F.col("p.doc").alias(id_col), "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset"
    )


def op6_tree_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

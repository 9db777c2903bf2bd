"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised whole; ids of words that occur again come from a
bounded memory of the task, which changes nothing: white space separates what
the tokenizer's normal form and its merges can see.  An end id follows each
document.  Documents longer than a sequence are cut into full pieces and a last
one; only what is shorter than a sequence needs a place.

Pieces are dealt to shards of about ``SHARD_PIECES`` by a hash of their slot (a
number that each row has of its own, so copies spread as well).  In a shard,
pieces are placed by the sum-of-squares rule, longest first: of all gaps that
can hold a piece, and of opening a sequence, that is taken after which the sum
over all gap sizes of (open sequences with that gap) squared is smallest, the
smallest gap if several are equal.  A sequence beyond the least number that the
shard's total needs is opened only for a piece that fits nowhere.  With this
bound a shard of 8192 pieces of the test documents takes the least number of
sequences possible.  State is one counter for each gap size, and a list of open
sequences.

A null text is empty: a piece of the end id alone.  A null doc_id is kept.
Rows that repeat are packed each.  Without documents there are no pieces.
Other columns are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logprism.llm.common import arrow_rows, binary, store

SEQUENCE = 4096
END_ID = 1
SHARD_PIECES = 16384

PIECES = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "slot long, doc_id long, piece int, start long, length long, ids binary"
#: Bytes of ids in one Arrow batch.
BATCH_BYTES = 16 << 20


class ChunkIds(dict):
    """Bytes without ASCII white space -> their ids as little-endian unsigned 32-bit numbers.

    Forgets what it has when there is too much of it; very long chunks are not kept.
    """

    LIMIT, LONG, LOT = 1_000_000, 64, 500
    ENDS = frozenset(b".,;:!?")

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tokenizer = Tokenizer.from_str(tokenizer)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if suffix:
            self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk.  Plain words are encoded many at a time: each ends with the only token of its that ends a word."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        words = [k for k, text in enumerate(texts) if text.isalpha() and text.lower().isalpha()]
        lots = [words[low:low + self.LOT] for low in range(0, len(words), self.LOT)]
        out: list[bytes | None] = [None] * len(chunks)
        for lot, found in zip(lots, self.tokenizer.encode_batch_fast(
                [" ".join([texts[k] for k in lot]) for lot in lots], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(lot):
                data, low = ids.tobytes(), 0
                for k, high in zip(lot, (4 * ends).tolist()):
                    out[k], low = data[low:high], high
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(found.ids, "<u4").tobytes()
        return out

    def stem(self, chunk: bytes) -> bytes:
        """The chunk without a closing mark that the tokenizer splits off in any case."""
        if len(chunk) > 1 and chunk[-1] in self.ENDS and chunk[-2:-1].isalnum():
            return chunk[:-1]
        return chunk

    def learn(self, chunks: set[bytes]) -> None:
        if len(self) + len(chunks) > self.LIMIT:
            self.clear()
        new = {self.stem(c) for c in chunks} | {bytes([c]) for c in self.ENDS}
        new = [c for c in new if c not in self]
        self.update(zip(new, self.encode(new)))
        for chunk in chunks:
            stem = self.stem(chunk)
            if stem is not chunk:
                self[chunk] = self[stem] + self[chunk[-1:]]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        split = [self.lowered(text).split() for text in texts]
        every = set().union(*split)
        missing = every.difference(self)
        long = [c for c in missing if len(c) > self.LONG]
        once = dict(zip(long, self.encode(long)))
        if len(self) + len(missing) > self.LIMIT:  # learn() will forget, and all of these are needed
            missing = every
        self.learn(missing.difference(once))
        if once:
            return [b"".join([once[c] if c in once else self[c] for c in chunks]) for chunks in split]
        return [b"".join(map(self.__getitem__, chunks)) for chunks in split]

    @staticmethod
    def lowered(text: bytes) -> bytes:
        """The tokenizer lower-cases; done at once where no special token and no combining mark can be touched."""
        return text.lower() if text.isascii() and b"<|" not in text else text


#: What this worker's tasks have learnt, by tokenizer; only the last one is kept.
_LEARNT: dict[str, ChunkIds] = {}


def chunk_ids(tokenizer: str) -> ChunkIds:
    if tokenizer not in _LEARNT:
        _LEARNT.clear()
        _LEARNT[tokenizer] = ChunkIds(tokenizer)
    return _LEARNT[tokenizer]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``slot, doc_id, piece, start, length, ids`` of the documents' pieces; ``tokenizer`` is the tokenizer's JSON.

    ids are little-endian unsigned 32-bit numbers.  A slot is a number of its
    own within one run of the job: store the rows before they are read twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(shared.value)
        slot = TaskContext.get().partitionId() << 33
        rows, held = [], 0
        for batch in batches:
            texts = [text or b"" for text in binary(batch["text"]).to_pylist()]
            for doc_id, data in zip(batch["doc_id"].to_pylist(), chunks.ids(texts)):
                data += end
                for piece, low in enumerate(range(0, len(data), 4 * size)):
                    ids = data[low:low + 4 * size]
                    rows.append((slot, doc_id, piece, low // 4, len(ids) // 4, ids))
                    slot += 1
                    held += len(ids)
                    if held >= BATCH_BYTES:
                        yield arrow_rows(PIECES, list(zip(*rows)))
                        rows, held = [], 0
        if rows:
            yield arrow_rows(PIECES, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES_DDL)


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths lie between 1 and ``size``."""
    open_ = np.zeros(size + 1, np.int64)  # sequences by gap; a full or an unopened one is not counted
    held: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least, used = -(-int(lengths.sum()) // size), 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[at])
        # growth of the sum of squares when a sequence of gap g, from length on, comes to have g - length
        growth = 2 * (open_[:size + 1 - length] - open_[length:]) + 2
        growth[0] -= 1  # the gap is closed, and full sequences are not counted
        growth[open_[length:] == 0] = 1 << 62
        growth[size - length] = 2 * open_[size - length] + 1 if used < least else 1 << 61
        gap = length + int(growth.argmin())
        if gap == size:
            number, used = used, used + 1
        else:
            open_[gap] -= 1
            number = held[gap].pop()
        sequence[at], offset[at] = number, size - gap
        if gap > length:
            open_[gap - length] += 1
            held[gap - length].append(number)
    return sequence, offset


def placed(pieces: DataFrame, size: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The stored pieces (``slot``, ``length`` and others, without texts or ids) with ``sequence_id`` and ``offset``."""
    rest = pieces.filter(F.col("length") < size)
    shards = max(1, math.ceil(rest.count() / shard_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def pack(shard: pa.Table) -> pa.Table:
        order = np.argsort(shard["slot"].to_numpy())
        shard = shard.take(pa.array(order))
        sequence, offset = sum_of_squares(shard["length"].to_numpy(), size)
        number = (shard["_shard"].to_numpy().astype(np.int64) << 32) + sequence
        return shard.drop_columns(["_shard"]).append_column("sequence_id", pa.array(number)).append_column(
            "offset", pa.array(offset))

    dealt = rest.withColumn("_shard", F.pmod(F.xxhash64("slot"), F.lit(shards)))
    packed = dealt.groupBy("_shard").applyInArrow(pack, schema)
    full = pieces.filter(F.col("length") == size).withColumns(
        {"sequence_id": -1 - F.col("slot"), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def packed_sequences(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """``sequence_id, length, ids, doc_ids``: the packed sequences themselves, ids in order and each piece's document."""
    pieces = store(token_pieces(docs, tokenizer, size, end_id), "pieces")
    places = placed(pieces.select("slot", "length"), size, shard_pieces).select("slot", "sequence_id", "offset")
    rows = pieces.join(places, "slot").groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("_parts"))
    return rows.select(
        "sequence_id", "length", F.aggregate("_parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
        F.transform("_parts", lambda p: p["doc_id"]).alias("doc_ids"))

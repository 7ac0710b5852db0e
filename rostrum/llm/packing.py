"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every task tokenises its documents and gathers pieces into blocks of a few dozen windows.
Within a block, partial partitions are merged two at a time, those with the largest
imbalance first, full windows of one against empty windows of the other, which leaves
windows of nearly equal size; if one exceeds the capacity, the block is partitioned
again into one window more. No rows are shuffled, and a task holds one block.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from rostrum.llm.common import as_text, map_batches, register, table

CAPACITY = 1024
#: Longest piece, and windows per block. Short pieces let a block come out even; full windows are cut off first.
MAX_PIECE = 256
BLOCK_WINDOWS = 24

# The words of the byte-level BPE (fixed value of this kind of vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(vocabulary: dict[str, int], added: list[str]) -> dict[bytes, int]:
    """Tokens as bytes: such vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(shown[c] for c in t): i for t, i in vocabulary.items() if t not in added}


class Tokens:
    """Token ids of texts as little-endian 32-bit bytes, each document ended by id 0."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.path = path
        tokenizer = Tokenizer.from_file(path)  # given up at once: few texts need more than its vocabulary
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # The same merges by rank, several times as fast; added tokens are left to the tokenizer.
        self.by_rank = tiktoken.Encoding("bytes", pat_str=PATTERN, special_tokens={},
                                         mergeable_ranks=byte_ranks(tokenizer.get_vocab(), self.added))
        self.tokenizer = None

    def document(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        else:
            ids = self.by_rank.encode_to_numpy(text).astype("<u4", copy=False)
        return ids.tobytes() + b"\0\0\0\0"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Split item numbers into ``k`` groups of nearly equal total size by largest differencing."""
    # A partial partition: sums and groups, largest sum first. Its imbalance is the largest minus the smallest sum.
    heap = []
    for n, size in enumerate(sizes):
        heap.append((-size, n, [size] + [0] * (k - 1), [[n]] + [[] for _ in range(k - 1)]))
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, groups_a = heapq.heappop(heap)
        _, _, sums_b, groups_b = heapq.heappop(heap)
        both = sorted(((x + y, g + h) for x, y, g, h in zip(sums_a, reversed(sums_b), groups_a, reversed(groups_b))),
                      key=lambda t: -t[0])
        sums, groups = [s for s, _ in both], [g for _, g in both]
        heapq.heappush(heap, (sums[-1] - sums[0], tie, sums, groups))
        tie += 1
    return heap[0][3]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups within the capacity; the number of groups rises until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


def pieces_of(ids: bytes, capacity: int, max_piece: int) -> Iterator[tuple[int, int]]:
    """Start and length: full windows, then the rest in equal parts."""
    n = len(ids) // 4
    full = n - n % capacity
    for start in range(0, full, capacity):
        yield start, capacity
    rest = n - full
    if rest:
        parts = -(-rest // max_piece)
        cuts = [full + rest * i // parts for i in range(parts + 1)]
        yield from ((a, b - a) for a, b in zip(cuts, cuts[1:]))


SCHEMA = "{id} {type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         max_piece: int = MAX_PIECE, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place in it, checksum, and place in a sequence.

    ``with_ids`` appends the token ids. Null and empty texts are one piece, the end id.
    Rows are packed as they come, so repeated rows give their pieces each; a null id stays
    null. ``sequence_id`` holds the task in its upper bits, so a repeated task yields the same ids.
    Other columns are not read. Sequences are to be padded to ``capacity`` unless their size is a power of two.
    """

    def run(batches):
        tokens = Tokens(tokenizer_path)
        base = TaskContext.get().partitionId() << 33
        n = 0
        waiting: list[tuple] = []
        held = 0

        def emit(groups: list[list[tuple]]) -> list[list]:
            nonlocal n
            out: list = [[] for _ in range(7)]
            held_ids: list[bytes] = []
            for group in groups:
                offset = 0
                for doc, start, ids, total in group:
                    for col, v in zip(out, (doc, start, len(ids) // 4, zlib.crc32(ids), total, base + n, offset)):
                        col.append(v)
                    held_ids.append(ids)
                    offset += len(ids) // 4
                n += 1
            if with_ids:  # as buffers, a number in Python would take four times the room
                ends = np.cumsum([0, *out[2]]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(held_ids), dtype="<u4").astype(np.int64)))
            return out

        def settle() -> list[list[tuple]]:
            nonlocal waiting, held
            groups = [[waiting[i] for i in g] for g in windows([len(p[2]) // 4 for p in waiting], capacity)]
            waiting, held = [], 0
            return groups

        for b in batches:
            ready: list[list[tuple]] = []
            for doc, ids in zip(b.column(0).to_pylist(), map(tokens.document, as_text(b.column(1)))):
                for start, length in pieces_of(ids, capacity, max_piece):
                    piece = (doc, start, ids[4 * start:4 * (start + length)], len(ids) // 4)
                    if length == capacity:
                        ready.append([piece])
                    else:
                        # A block closes just under a whole number of windows, so the last one is nearly full too.
                        if held + length > BLOCK_WINDOWS * capacity:
                            ready += settle()
                        waiting.append(piece)
                        held += length
                if len(ready) > 500:
                    yield emit(ready)
                    ready = []
            if ready:
                yield emit(ready)
        if waiting:
            yield emit(settle())

    schema = SCHEMA.format(id=id_col, type=docs.schema[id_col].dataType.simpleString()) + ", ids array<long>" * with_ids
    return map_batches(docs.select(id_col, text_col), run, schema)


@register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

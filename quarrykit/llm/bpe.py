"""Byte-pair merging in two ways: counting by a heap over a linked list, encoding by a segment tree over byte positions.

Both hold what they found for short pieces in a table of bounded size that a Python worker keeps for all its tasks.

Cases: null text counts as empty: no tokens, and the digests of no bytes; texts are taken whole, whatever their length; rows that repeat get equal
results; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

import base64
import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, table

#: Pieces that a worker's table holds at most, and the characters of a piece that it takes at most.
MEMO_PIECES, MEMO_CHARS = 1 << 18, 64
LIMIT_TOKENS = 512
#: Children of a node of the segment tree.
FAN = 32
COUNT_FILE, ENCODE_FILE = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Memo(dict):
    """A table of what a function gives for pieces; emptied when it holds ``most``."""

    def __init__(self, of, most: int = MEMO_PIECES):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, piece: str):
        out = self.of(piece.encode())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in prints else chr(next(others)) for b in range(256)}


class Counter:
    """Counts the tokens of a text as the library would encode it, without making identifiers.

    Symbols stand in a linked list; a heap holds the ranks of adjacent pairs. The lowest is taken again and again, the leftmost first, and
    each merge takes one symbol away: tokens are the symbols at first less the merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, before = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or data["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        numbers = {s: i for i, s in enumerate(model["vocab"])}
        self.start = [numbers[c] for _, c in sorted(byte_symbols().items())]
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[numbers[a], numbers[b]] = (rank, numbers[a + b])
        special = [regex.escape(t["content"]) for t in data["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.find = regex.compile(piece_pattern()).findall
        self.memo = Memo(self.count_piece)

    def count_piece(self, piece: bytes) -> int:
        n = len(piece)
        symbol = [self.start[b] for b in piece]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        pairs = self.pairs
        heap = [(p[0], i, a, b, p[1]) for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (p := pairs.get((a, b)))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:  # one of the two has been merged meanwhile
                continue
            merges += 1
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get((made, symbol[k])):
                    heapq.heappush(heap, (p[0], i, made, symbol[k], p[1]))
            if (h := before[i]) >= 0 and (p := pairs.get((symbol[h], made))):
                heapq.heappush(heap, (p[0], h, symbol[h], made, p[1]))
        return n - merges

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, self.find(part))) for part in parts)


class Encoder:
    """Encodes by the ranks of a tiktoken file, and decodes; its table holds ``pieces`` pieces at most."""

    def __init__(self, path: str, pieces: int = MEMO_PIECES):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.find = regex.compile(piece_pattern()).findall
        self.memo = Memo(lambda piece: np.array(self.encode_piece(piece), "<u4").tobytes(), pieces)

    def encode_piece(self, piece: bytes) -> list[int]:
        """A segment tree over byte positions holds, at the leaf of each part's start, the rank that the part and its right neighbour have
        together; its root is the leftmost of the lowest. A merge changes three leaves, each in logarithmic time. A node has FAN children, so
        that the tree of a word is one node."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        shift = n.bit_length()
        mask, none = (1 << shift) - 1, 1 << 62
        get = ranks.get
        leaves = [none if (r := get(piece[i : i + 2])) is None else r << shift | i for i in range(n - 1)]
        levels = [leaves]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        root, pairs = levels[-1], [*zip(levels, levels[1:])]
        after, before = [*range(1, n + 2)], [*range(-1, n)]
        while (least := min(root)) != none:
            i = least & mask
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            if k < n:
                leaves[j] = none
                r = get(piece[i : after[k]])
                leaves[i] = none if r is None else r << shift | i
            else:  # the merged part is the last
                leaves[i] = none
                if j < n - 1:
                    leaves[j] = none
            if (h := before[i]) >= 0:
                r = get(piece[h:k])
                leaves[h] = none if r is None else r << shift | h
            if pairs:
                for at in (j, i, h):
                    for below, above in pairs:
                        at //= FAN
                        value = min(below[at * FAN : at * FAN + FAN], default=none)
                        if at < 0 or at >= len(above) or above[at] == value:
                            break
                        above[at] = value
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """The identifiers as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


@functools.lru_cache(2)
def encoder(path: str, pieces: int = MEMO_PIECES) -> Encoder:
    return Encoder(path, pieces)


def _texts(column: pa.Array):
    return (x.as_py() or "" for x in column)


def _by_row(batch: pa.RecordBatch, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=["doc_id", *schema.names])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each text; path is that of a byte-level BPE in the .json form."""
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        count = counter(path).count
        for batch in batches:
            yield _by_row(batch, [(len(t.encode()), n := count(t), n > limit) for t in _texts(batch.column(1))], schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def encode_texts(docs: DataFrame, path: str, keep_ids: bool = False, pieces: int = MEMO_PIECES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, with the identifiers as little-endian bytes in ids if asked for; path is that of a .tiktoken
    file. A worker's table holds ``pieces`` pieces at most: fewer take less memory and more time, and change no result."""
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * keep_ids
    schema = pa.schema(fields)

    def run(batches):
        e = encoder(path, pieces)
        for batch in batches:
            rows = []
            for t in _texts(batch.column(1)):
                ids = e.encode(t)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest(), *[ids] * keep_ids))
            yield _by_row(batch, rows, schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary_path(ENCODE_FILE))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(COUNT_FILE))

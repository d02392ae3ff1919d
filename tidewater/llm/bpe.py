"""Byte-level BPE encoding and decoding.

A pre-token is a doubly linked list of symbols; a priority queue holds the merge
ranks of adjacent pairs.  An entry whose pair has changed meanwhile is stale and is
skipped when it is popped.  Decoding concatenates the vocabulary strings.

Cases: null and empty texts give no ids and decode to the empty string; texts of any
length are encoded whole; repeated rows give repeated rows; an empty table gives an
empty result; only the id and text columns are read, so other columns never clash.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_batches, text_of

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers of Unicode versions after the tokenizer library's, which takes them for signs.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Pre-tokens in a generation of the cache of a Python worker (two are kept), and the longest that is kept.
CACHE_SIZE, CACHE_WORD = 300_000, 64


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 bytes stand for themselves, the
    others take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """Merge ranks and vocabulary of a tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in alphabet.items()}
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        #: left << 20 | right to rank << 32, and back from the rank; what the rank's merge makes
        self.ranks: dict[int, int] = {}
        self.pair_of: list[int] = []
        self.merged_of: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pair_of.append(vocab[a] << 20 | vocab[b])
            self.merged_of.append(vocab[a + b])
            self.ranks.setdefault(self.pair_of[-1], rank << 32)
        #: the same for two bytes, by first << 8 | second; -1 where they don't merge
        self.byte_ranks = [self.ranks.get(a << 20 | b, -1) for a in self.byte_id for b in self.byte_id]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.strings = {
            i: bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode() for i, s in strings.items()
        }
        self.split_known = regex.compile(PRE_TOKEN).findall
        letter, number = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
        self.split_newer = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])+|\s+(?!\S)|\s+",
            regex.V1,
        ).findall
        self.has_newer = re.compile(f"[{NEWER}]").search
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else None
        self.words = _Words(self)
        self.strings_array = pa.array([self.strings.get(i, b"") for i in range(max(self.strings) + 1)], pa.binary())

    def split(self, text: str) -> list[str]:
        return self.split_known(text) if text.isascii() or not self.has_newer(text) else self.split_newer(text)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token.  A queue entry is rank << 32 | place of the left symbol."""
        first, ids, rank_of, pair_of = self.byte_ranks, self.byte_id, self.ranks.get, self.pair_of
        heap = [r | i for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (r := first[a << 8 | b]) >= 0]
        symbols = [ids[b] for b in word]
        if not heap:
            return symbols
        heapify(heap)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] << 20 | symbols[j] != pair_of[entry >> 32]:
                continue  # stale: the pair is no longer there
            merged = symbols[i] = self.merged_of[entry >> 32]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(merged << 20 | symbols[k])) is not None:
                    heappush(heap, r | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << 20 | merged)) is not None:
                heappush(heap, r | h)
        return [s for s in symbols if s >= 0]

    def encode_packed(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        word = self.words.__getitem__
        if self.special_split is None or not any(s in text for s in self.special):
            return b"".join(map(word, self.split(text)))
        out = []
        for part in self.special_split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.append(b"".join(map(word, self.split(part))))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The texts of many lists of ids: the vocabulary strings are taken one after the
        other, and so already stand concatenated in the buffer of what is taken."""
        taken = self.strings_array.take(lists.flatten())
        ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
        counts = np.zeros(len(lists) + 1, np.int64)
        np.cumsum(lists.value_lengths().fill_null(0), out=counts[1:])
        texts = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(ends[counts].tobytes()), taken.buffers()[2]])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # ids that no text has
            return pa.array([self.decode(x or []) for x in lists.to_pylist()], pa.string())
        return texts


class _Words(dict):
    """Pre-token to packed ids.  When it is full its content becomes the older generation,
    from which words in use come back, and the generation before that goes."""

    def __init__(self, owner: Tokenizer):
        self.owner, self.older = owner, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = array("i", self.owner.merge(word.encode())).tobytes()
        if len(word) <= CACHE_WORD:
            if len(self) >= CACHE_SIZE:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(path)


def encode_batch(path: str, texts: pa.Array) -> pa.ListArray:
    packed = list(map(tokenizer(path).encode_packed, texts.to_pylist()))
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


IDS, DECODED = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``id_col``, the columns in ``keep`` and ``ids array<int>``, for every row."""

    def batch(b: pa.RecordBatch) -> dict[str, object]:
        return {"ids": encode_batch(path, b.column(b.num_columns - 1))}

    return map_batches(docs.select(id_col, *keep, text_of(text_col).alias("_text")), batch, [IDS], [id_col, *keep])


def roundtrip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that ids don't go to Python a second time."""

    def batch(b: pa.RecordBatch) -> dict[str, object]:
        ids = encode_batch(path, b.column(b.num_columns - 1))
        return {"ids": ids, "decoded": tokenizer(path).decode_lists(ids)}

    return map_batches(docs.select(id_col, *keep, text_of(text_col).alias("_text")), batch, [IDS, DECODED], [id_col, *keep])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """``id_col``, the columns in ``keep``, ``ids`` and ``decoded string``, for every row; null
    ids decode to the empty string."""

    def batch(b: pa.RecordBatch) -> dict[str, object]:
        return {"decoded": tokenizer(path).decode_lists(b.column(b.num_columns - 1))}

    return map_batches(encoded.select(id_col, *keep, "ids"), batch, [DECODED], [id_col, *keep, "ids"])


def roundtrip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens and SHA-256 digests of ids and decoded text."""
    return roundtrip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

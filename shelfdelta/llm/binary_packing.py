"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of ``longest`` tokens and then into the binary parts
of the rest, longest first. Every piece is a sequence of its own, its length a power of two,
so no sequence crosses documents and none needs padding; batches are drawn from buckets of
equal length (``bucket`` is the power).

Tokens are those of a tokenizer file and each document ends with ``end_id``. Ids of pieces of
text between blanks and line feeds are remembered per task within a bound, since the
tokenizer never merges across them. New pieces go through tiktoken with the file's vocabulary
where the file is checked to be plain byte-level BPE with merges in the order of ids (the same
ids, some ten times faster on rare words), else through the file's own library.

Defined results: a null text is empty and has the end token only; repeated rows are packed
each; other columns are left out. ``sequence_id`` is unique in the result and rises within a
partition of the input.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from shelfdelta.llm.common import map_rows, text_or_empty
from shelfdelta.llm.prefix_bpe import Remembered


def piece_lengths(n: int, longest: int = 1024) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole ones, then the set bits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def byte_ranks(tokenizer) -> dict[bytes, int] | None:
    """The vocabulary as bytes and ids, if ids alone decide its merges: byte-level pre-tokens, merges in the order of ids."""
    spec = json.loads(tokenizer.to_str())
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec["normalizer"] or cut != {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": cut.get("trim_offsets"), "use_regex": True}:
        return None
    vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if made != sorted(set(made)) or made[:1] < [256]:
        return None
    # Byte-level alphabet: printable Latin-1 characters stand for themselves, the others follow from U+0100 on.
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in same)}
    joined = set(made)
    return {bytes(letters[c] for c in word): i for word, i in vocab.items() if i < 256 or i in joined}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def _remembered(path: str, pattern: str) -> Remembered:
    """Encoder of a tokenizer file. Where ids alone decide its merges, tiktoken encodes with its vocabulary, else the file's own library."""
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
    ranks = byte_ranks(tokenizer)
    if ranks is None:
        return Remembered(lambda pieces: [_packed(e.ids) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)], regex.compile(pattern))
    quick = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Remembered(lambda pieces: [_packed(quick.encode_ordinary(p)) for p in pieces], regex.compile(pattern))


def pack(docs: DataFrame, path: str, pattern: str, *, longest: int = 1024, end_id: int = 0, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, bucket, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    kind, end = docs.schema[key].dataType.simpleString(), np.array([end_id], dtype="<u4").tobytes()

    def rows(batch: pa.RecordBatch) -> list:
        who, start, length, ids, total = [], [], [], [], []
        for i, data in enumerate(_remembered(path, pattern).encode(batch.column(1).to_pylist())):
            data += end
            lengths = piece_lengths(len(data) // 4, longest)
            at = 0
            for n in lengths:
                ids.append(data[4 * at:4 * (at + n)])
                start.append(at)
                at += n
            length += lengths
            who += [i] * len(lengths)
            total += [at] * len(lengths)
        return [batch.column(0).take(pa.array(who, pa.int64())), start, length, ids, total]

    pieces = map_rows(docs.select(key, text_or_empty(text).alias("text")), rows,
                      f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long", done=lambda: _remembered(path, pattern).forget())
    return pieces.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"))

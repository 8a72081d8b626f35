"""Packing token sequences: first-fit decreasing on a tournament tree of bin capacities, per randomised group.

A text is tokenised and ended by id 0. Its full windows are sequences of their own; only what is left over, less than a
window, is packed. Left-overs are dealt to groups by a seeded hash, and each group is packed by itself: longest first,
each into the first bin that has room, which a tree of maxima over the bins' free room finds in logarithmic time.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

WINDOW, END, SEED = 1024, 0, 20240611
#: Documents in a group, about.
GROUP_DOCS = 4096
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _fast(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})


@cache
def _full(tokenizer: str):
    from tokenizers import Tokenizer  # loaded by the workers that meet a text for it

    return Tokenizer.from_file(tokenizer)


#: Texts above this many characters are encoded in parts; a part above LONG holds a run that the faster encoder gives up on.
PART, LONG, FLUSH = 1 << 16, 100_000, 1 << 20
# No token of the vocabulary's pattern holds such a place inside: white space and punctuation start a token after a word.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])|(?<=[^\W_])(?=[.,;:!?。，、；：！？])")


def _parts(text: str):
    """The text in parts of about PART characters whose ids, one after the other, are the text's ids."""
    at = 0
    while len(text) - at > PART and (m := _SAFE.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode(text: str, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> list[int]:
    """The tokenizer's ids. Latin-1 texts without its special string go through the same vocabulary's faster encoder.

    Long texts are encoded in parts, so memory follows the part. A part that stays long (one run without a break, as of
    a million blanks, on which the faster encoder fails) goes through the tokenizer itself.
    """
    out: list[int] = []
    for part in _parts(text):
        if len(part) <= LONG and "<|endoftext|>" not in part:
            try:
                part.encode("latin-1")
                out += _fast(ranks).encode_ordinary(part)
                continue
            except UnicodeEncodeError:
                pass
        out += _full(tokenizer).encode(part, add_special_tokens=False).ids
    return out


class Bins:
    """First fit by a tournament tree: each inner node holds the largest free room below it."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.free = [room] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and the room that it had."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        had, found = free[at], at - self.leaves
        free[at] = had - size
        while at > 1:
            at //= 2
            top = max(free[2 * at], free[2 * at + 1])
            if free[at] == top:
                break
            free[at] = top
        return found, had


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) for each size, none above room; bins are numbered in the order of their first item."""
    bins, out = Bins(max(1, len(sizes)), room), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found, had = bins.put(sizes[i])
        out[i] = (found, room - had)
    return out


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(with_ids: bool, window: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def made(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names)

    def cut(batches):
        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):  # one text at a time: they may be long
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                for a in range(0, len(ids), window):
                    piece = ids[a : a + window]
                    rows.append((doc.as_py(), a, len(piece), zlib.crc32(piece.tobytes()), len(ids), *[piece.astype(np.int32)] * with_ids))
                held += len(ids)
                if held >= FLUSH:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return cut


def pieces(docs: DataFrame, with_ids: bool = True, window: int = WINDOW) -> DataFrame:
    """Texts as token pieces of at most window ids: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(with_ids, window), _PIECE + ", ids array<int>" * with_ids)


def _pack(window: int):
    def pack(key, group):
        import pandas as pd

        group = group.sort_values(["length", "doc_id", "ids_crc32"], ascending=[False, True, True], kind="stable")
        placed = first_fit_decreasing(group["length"].tolist(), window)
        return group.assign(bin=[b for b, _ in placed], offset=[o for _, o in placed]).astype({"bin": "int64", "offset": "int64"})

    return pack


def pack(docs: DataFrame, with_ids: bool = True, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Token pieces of docs (doc_id, text) with sequence_id and offset, gapless from 0 in each sequence.

    Every text, null and empty ones too (they hold the end id alone), is cut into windows; the rest of less than a
    window is packed within its group. Sequences are window long at most; the caller pads them. sequence_id is unique
    over all groups, not dense. Repeated rows are packed each; rows without doc_id too. Of left-overs of equal length the
    smaller doc_id (then ids_crc32) is placed first. Very long texts are encoded in parts and give many pieces. Other
    columns are ignored. Empty in, empty out.
    """
    cut = staged(pieces(docs, with_ids, window), "pack-pieces")
    n_rest = cut.where(F.col("length") < window).count()
    groups = max(1, -(-n_rest // GROUP_DOCS))
    # Full windows are sequences of their own: even ids; packed groups get odd ones.
    whole = cut.where(F.col("length") == window).withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < window).withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join([_PIECE, *["ids array<int>"] * with_ids, "grp long, bin long, offset long"])
    packed = rest.groupBy("grp").applyInPandas(_pack(window), schema).withColumn("sequence_id", (F.col("grp") * (1 << 31) + F.col("bin")) * 2 + 1)
    return whole.unionByName(packed.drop("grp", "bin"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"), with_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

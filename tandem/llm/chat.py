"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant texts are intersected
with the token spans by binary search. Turns are marked by special tokens, so no token reaches over the edge of a text.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, processors

from ._common import table

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
LEARNED = "assistant"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """No "<|" is left: a backslash more goes between "<" (with any backslashes) and "|"."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the learned role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == learned and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@cache
def encoder(path: str = TOKENIZER) -> Tokenizer:
    """The tokenizer with the three turn marks as special tokens and offsets that cover every character."""
    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (START, SEP, END)])
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    return tok


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token whether it meets one of the spans; both are in order."""
    out = np.zeros(len(starts), bool)
    for a, b in spans:
        out[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return out


def learned_text(formatted: str, starts, ends, loss) -> str:
    """The text under a loss mask, unescaped run by run; tokens that share a character count it once."""
    on = np.flatnonzero(loss)
    if not len(on):
        return ""
    a, reach = np.asarray(starts)[on], np.maximum.accumulate(np.asarray(ends)[on])
    first = np.flatnonzero(np.r_[True, (on[1:] != on[:-1] + 1) | (a[1:] > reach[:-1])])
    last = np.r_[first[1:], len(on)] - 1
    return "".join([unescape(formatted[i:j]) for i, j in zip(a[first].tolist(), reach[last].tolist())])


_OUT = "conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
_NAMES = [f.split()[0] for f in _OUT.split(", ")]


def _formatted(path: str):
    def conversation(conv, turns):
        text, spans = render(turns)
        code = encoder(path).encode(text, add_special_tokens=False)
        at = np.array(code.offsets, np.int32).reshape(-1, 2)
        return conv, len(turns), text, code.ids, at[:, 0], at[:, 1], mask(at[:, 0], at[:, 1], spans)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    def run(batches):
        own, turns, any_, done = None, [], False, []
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if any_ and conv != own:
                    done.append(conversation(own, turns))
                    turns = []
                    if len(done) >= 256:
                        yield batch(done)
                        done = []
                own, any_ = conv, True
                turns.append((role or "", text or ""))
        if any_:
            done.append(conversation(own, turns))
        if done:
            yield batch(done)

    return run


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per conversation: conv_id, n_turns, formatted, token ids, their character offsets and the loss mask.

    turns: conv_id, turn, role, text; other columns are ignored. Turns go by turn (nulls first), then role, then text;
    repeated rows are turns of their own. Null roles and texts are empty; rows without conv_id are one conversation. A
    conversation is rendered from a sorted stream, so it alone, not its partition, has to fit a task. Empty in, empty out.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatted(tokenizer), _OUT)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(at[:-1], at[1:])]


def _digests(batches):
    for b in batches:
        rows = []
        arrays = [_lists(b.column(c)) for c in ("starts", "ends", "loss_mask")]
        for conv, text, starts, ends, loss in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), *arrays):
            turns, learned = parse(text), learned_text(text, starts, ends, loss)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _DIGEST.split(", ")])


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, LEARNED, said)], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.unionByName(own)).mapInArrow(_digests, _DIGEST)


ORACLE_SQL = f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
said as (
    select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
           coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as learned,
           sum(length(regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + {len(START + SEP + END)}) as chars
    from turns group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256,
       chars::bigint as formatted_chars
from said
"""

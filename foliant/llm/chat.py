"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn after turn, as `<|turn|>` role `<|text|>` text `<|end|>`. These three marks are
special tokens, added to the vocabulary, so no token reaches over a turn's border. In roles and texts a backslash goes
between "<" (with any backslashes) and "|", which is undone by taking one out, so no text can hold a mark. The library
encodes the whole rendered string once and gives each token's characters; the turns' spans and the tokens' spans, both
sorted, are intersected by binary search.

Defined results: a null text is empty, a null role is empty. Turns are in the order of turn, null last; rows with the
same turn are ordered by role and text, so repeated rows are repeated turns. A null conv_id is one conversation. Other
columns are ignored. An empty table has no conversations. One conversation is one string, so it is rendered in one task; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from foliant.llm import textvec as tv
from foliant.llm.common import bounded_batches

TURN, TEXT, END = MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: Roles whose texts are learned from.
LEARNED = ("assistant",)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, text = turn.partition(TEXT)
        out.append((unescape(role), unescape(text.removesuffix(END))))
    return out


@lru_cache(2)
def marked_library(path: str) -> Tokenizer:
    """The vocabulary at path with the marks as special tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    library = Tokenizer.from_file(path)
    library.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
    return library


def encode(library: Tokenizer, rendered: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids, and first and last character (exclusive), of the tokens of each rendered conversation."""
    return [(np.array(e.ids, np.int32), np.array(e.offsets, np.int64).reshape(-1, 2)) for e in library.encode_batch(rendered, add_special_tokens=False)]


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that shares a character with a span; offsets (n x 2) and spans are sorted."""
    mask = np.zeros(len(offsets), np.int8)
    if len(offsets) and spans:
        s = np.array(spans)
        first = np.searchsorted(offsets[:, 1], s[:, 0], "right")
        last = np.searchsorted(offsets[:, 0], s[:, 1], "left")
        for a, b, span in zip(first.tolist(), last.tolist(), spans, strict=True):
            if span[1] > span[0]:
                mask[a:b] = 1
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, one for each run of masked tokens that no mark interrupts."""
    on = np.flatnonzero(mask)
    if not len(on):
        return []
    cuts = np.flatnonzero(np.diff(on) > 1) + 1
    return [unescape(formatted[offsets[run[0], 0] : offsets[run[-1], 1]]) for run in np.split(on, cuts)]


def _formatted(path: str, learned: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = marked_library(path)
        for batch in batches:
            turns = [[(t["role"], t["text"]) for t in c] for c in batch["turns"].to_pylist()]
            for lo, hi in tv.chunks(["".join(t for _, t in c) for c in turns]):
                rendered = [render(t) for t in turns[lo:hi]]
                encoded = encode(library, [x for x, _ in rendered])
                masks = [token_mask(at, [x for x, (role, _) in zip(spans, t, strict=True) if role in learned]) for t, (_, spans), (_, at) in zip(turns[lo:hi], rendered, encoded, strict=True)]
                columns = (([x for x, _ in encoded], pa.int32()), ([x[:, 0] for _, x in encoded], pa.int64()), ([x[:, 1] for _, x in encoded], pa.int64()), (masks, pa.int8()))
                lists = [pa.array(x, pa.list_(kind)) for x, kind in columns]
                yield pa.RecordBatch.from_arrays([batch["conv_id"].slice(lo, hi - lo), pa.array([x for x, _ in rendered], pa.string()), *lists], names=["conv_id", "formatted", "ids", "starts", "ends", "loss_mask"])

    return run


def format_conversations(turns: DataFrame, tokenizer_path: str, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, formatted, ids, starts, ends, loss_mask) for each conversation of turns (conv_id, turn, role, text)."""
    bounded_batches(turns.sparkSession, 200)
    row = F.struct(F.col("turn").isNull().alias("last"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    return whole.mapInArrow(_formatted(tokenizer_path, learned), "conv_id long, formatted string, ids array<int>, starts array<long>, ends array<long>, loss_mask array<tinyint>")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        of = lambda column, i: batch[column][i].values.to_numpy()
        for i in range(batch.num_rows):
            row = {c: batch[c][i].as_py() for c in ("conv_id", "formatted")}
            turns = parse(row["formatted"])
            loss = "".join(masked_text(row["formatted"], np.stack([of("starts", i), of("ends", i)], 1), of("loss_mask", i)))
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((row["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"])))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output itself says: its turns, and the text under its loss mask."""
    return formatted.mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that imitates marks of templates, to be formatted with the rest.
TRICKY_ID, TRICKY = -7, r"\### Assistant: </turn> ok"


def with_tricky(turns: DataFrame) -> DataFrame:
    rows = [(TRICKY_ID, 0, "user", TRICKY), (TRICKY_ID, 1, "assistant", TRICKY)]
    return turns.select("conv_id", "turn", "role", "text").unionByName(turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))

"""Chat formatting with loss masks that follow token offsets.

A conversation is rendered once, as one string: each turn is a mark, the role, a mark, the text and a mark.
Marks found inside roles and texts get a backslash, reversibly. The string is encoded once, with offsets; the
marks are tokens of their own, so token spans and turn spans share their ends, and binary search in the
sorted offsets gives the tokens of each turn.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and further control strings that texts may not hold plainly. None may overlap another."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    reserved: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    def escape(self, text: str) -> str:
        """A backslash more after the first character of each control string, whatever number stands there."""
        return _pattern(self, r"\\*").sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return _pattern(self, r"\\+").sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The string of (role, text) turns, and the span of each text in it."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head = self.turn + self.escape(role) + self.text
            body = self.escape(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(parts), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of a rendered string."""
        turns = []
        for piece in formatted.split(self.end)[:-1]:
            head, body = piece.split(self.text, 1)
            turns.append((self.unescape(head.removeprefix(self.turn)), self.unescape(body)))
        return turns


@functools.cache
def _pattern(template: Template, between: str) -> re.Pattern:
    controls = (template.turn, template.text, template.end, *template.reserved)
    return re.compile("|".join(re.escape(c[0]) + between + re.escape(c[1:]) for c in controls))


@functools.cache
def _encoder(path: str, template: Template):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
    from tokenizers import AddedToken, Tokenizer, processors

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    made.post_processor = processors.ByteLevel(trim_offsets=False)
    marks = (template.turn, template.text, template.end)
    made.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in marks])
    return made


def tokens_of(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the tokens that lie in one of the sorted spans, by binary search in the sorted offsets."""
    mask = np.zeros(len(starts), bool)
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(starts, a, side="left") : np.searchsorted(ends, b, side="right")] = True
    return mask


_OUT = "conv_id long, formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_conversations(turns: DataFrame, path: str, template: Template = Template(), learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, input_ids, token_starts, token_ends, loss_mask) of each conversation of ``turns``.

    ``turns`` has conv_id, turn, role and text; rows go by turn, then role and text, null turns first. Null
    roles and texts read as empty; rows with a null conv_id form one conversation; repeated rows are turns of
    their own; an empty table gives an empty result; other columns are not looked at. loss_mask marks the tokens of
    texts whose role is ``learn``. A conversation is one sequence, however long, and is held whole by one task;
    conversations spread over tasks by conv_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, template)
        for batch in conversation_chunks(batches):
            said = [[(t["role"] or "", t["text"] or "") for t in conv] for conv in batch.column("turns").to_pylist()]
            rendered = [template.render(turns_) for turns_ in said]
            coded = encoder.encode_batch([formatted for formatted, _ in rendered], add_special_tokens=False)
            ends = np.cumsum([0, *(len(c) for c in coded)])
            ids = np.fromiter(chain.from_iterable(c.ids for c in coded), np.int32, ends[-1])
            offsets = np.fromiter(chain.from_iterable(chain.from_iterable(c.offsets for c in coded)), np.int32, 2 * ends[-1]).reshape(-1, 2)
            starts, stops, mask = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1]), np.zeros(ends[-1], bool)
            for (_, spans), conv, a, b in zip(rendered, said, ends[:-1], ends[1:], strict=True):
                mask[a:b] = tokens_of([s for s, (role, _) in zip(spans, conv, strict=True) if role == learn], starts[a:b], stops[a:b])
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (ids, starts, stops, mask))
            names = ["conv_id", *(f.split()[0] for f in _OUT.split(", ")[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([formatted for formatted, _ in rendered], pa.string()), *lists], names)

    grouped = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", "text").alias("t"))
    return grouped.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).mapInArrow(run, _OUT)


def conversation_chunks(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``size`` bytes, or of one conversation if that is longer."""
    for batch in batches:
        step = max(1, size * batch.num_rows // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            small = part.num_rows == 1 or part.nbytes <= 2 * size
            yield from [part] if small else (part.slice(i, 1) for i in range(part.num_rows))


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of the string under the mask, one for each run of masked tokens."""
    at = np.flatnonzero(mask)
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
    return [formatted[starts[r[0]] : ends[r[-1]]] for r in runs]


def op2_chat_format(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests read back from the formatted conversations, by the contract of this query."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    template = Template()
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ends = [], batch.column("loss_mask").offsets.to_numpy()
            starts, stops, mask = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in ("token_starts", "token_ends", "loss_mask"))
            for formatted, a, b in zip(batch.column("formatted").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                said = template.parse(formatted)
                stretches = masked_text(formatted, starts[a:b], stops[a:b], mask[a:b])
                loss = "".join(template.unescape(s) for s in stretches)
                turns_hex = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
                rows.append((len(said), turns_hex, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), b - a))
            n, turns_hex, chars, loss_hex, total, tokens = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns_hex, pa.string()), pa.array(chars, pa.int64()),
                 pa.array(loss_hex, pa.string()), pa.array(total, pa.int64()), pa.array(tokens, pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"],
            )

    columns = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    return format_conversations(turns, path, template).mapInArrow(run, columns)

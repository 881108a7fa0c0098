"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the
others as named users; only the assistant's words and their end marks are to be learned. System turns stay
system turns in every rendering and are no participant.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered_prefix, small_batches

# Fixed values of the chat format.
OPEN, CLOSE, SYSTEM, NOBODY = "<|im_start|>", "<|im_end|>", "system", "unknown"


def render(turns: list[tuple[str, str]], perspective: str) -> tuple[str, list[tuple[int, int]]]:
    """The rendering of (speaker, text) turns, and the spans of characters to be learned.

    Marks inside a text or a name are broken up with a space, so that they can't pose as the format's own.
    """
    parts, spans, at = [], [], 0
    for speaker, text in turns:
        safe = text.replace("<|", "< |")
        if speaker == SYSTEM:
            head = f"{OPEN}system\n"
        elif speaker == perspective:
            head = f"{OPEN}assistant\n"
        else:
            head = f"{OPEN}user name={speaker.replace('<|', '< |')}\n"
        body = safe + CLOSE
        parts += [head, body, "\n"]
        if speaker == perspective and speaker != SYSTEM:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + 1
    return "".join(parts), spans


def _render(batches):
    for batch in batches:
        texts, starts, ends, counts = [], [], [], []
        for turns, perspective in zip(batch.column("turns").to_pylist(), batch.column("perspective").to_pylist(), strict=True):
            text, spans = render([(t["speaker"], t["text"]) for t in turns], perspective)
            texts.append(text)
            starts.append([a for a, _ in spans])
            ends.append([b for _, b in spans])
            counts.append(sum(b - a for a, b in spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("perspective"), batch.column("part"), pa.array([len(t) for t in batch.column("turns").to_pylist()], pa.int64()), pa.array(texts, pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(counts, pa.int64())],
            ["conv_id", "perspective", "part", "n_turns", "text", "mask_starts", "mask_ends", "n_learned"],
        )


def rotate_perspectives(turns: DataFrame, part_chars: int = 200_000) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask_starts, mask_ends, n_learned) of each conversation.

    Turns are in order of turn, then role, then text (nulls first). Spans are in characters of the row's
    text, ends exclusive. A conversation longer than part_chars is rendered in parts, cut between turns by
    prefix sums, so that no task holds a whole long conversation; all parts together are the rendering.
    A null role is the speaker "unknown"; a null text is empty; turns with a null conv_id are one
    conversation. A conversation of system turns only has no participant and no row; repeated turns are
    kept. Other columns are not read.
    """
    small_batches(turns.sparkSession, 500)
    t = turns.select(F.col("conv_id").try_cast("long").alias("conv_id"), F.col("turn").try_cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(NOBODY)).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).withColumn("_size", (F.char_length("text") + 64).cast("long"))
    numbered, _, _ = ordered_prefix(t, [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text")], "_size", group="_key")
    parts = numbered.withColumn("part", F.expr(f"cast(_before div {part_chars}L as int)")).groupBy("_key", "conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("_pos", "speaker", "text"))).alias("turns"))
    speakers = t.where(F.col("speaker") != SYSTEM).select("_key", F.col("speaker").alias("perspective")).distinct()
    rows = parts.join(speakers, "_key").select("conv_id", "perspective", "part", "turns")
    return rows.mapInArrow(_render, "conv_id long, perspective string, part int, n_turns long, text string, mask_starts array<long>, mask_ends array<long>, n_learned long")

"""Chat formatting by columnar byte assembly.

Turns are dealt by conversation and sorted by turn; a task lays out thousands of turns at once. Every turn is a head, its
escaped text and an end mark. The lengths of all these segments are counted, their running sum gives the offset of
every segment, and a scatter index says for each output byte where it comes from: one gather fills one preallocated
buffer that becomes the Arrow column of formatted conversations. A loss mask comes with it, as byte ranges.

Control strings of the template inside texts are escaped by a backslash (itself escaped), which undoing reverses exactly.
Null text counts as empty, null role as the empty role. Rows of one conversation are ordered by turn, ties by role and
text, null turns first; rows with a null conv_id form one conversation. Repeated rows are turns of their own. An empty
table gives no conversations. A conversation is one row of the output and so must fit into memory, but not twice: tasks
cut their input where conversations end.
Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A turn is TURN + role + BODY + text + END; LOSS names the role whose texts are trained on.
TURN, BODY, END = b"<|turn|>", b"<|body|>", b"<|end|>"
LOSS = "assistant"
#: Control strings of this and of other common templates, none of which may reach the output from a text.
CONTROLS = ("<|turn|>", "<|body|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")

_ESCAPE = re.compile("|".join(re.escape(c) for c in sorted((*CONTROLS, "\\"), key=len, reverse=True)).encode())
_MARKED = re.compile(rb"[\\<\[]")
_UNESCAPE = re.compile(rb"\\(.)", re.DOTALL)
BLOCK_BYTES = 4 << 20


def escape(text: bytes) -> bytes:
    """The text with a backslash before every backslash and after the first byte of every control string.

    A control string is split, not only preceded, so it no longer occurs in the output.
    """
    if not _MARKED.search(text):
        return text
    return _ESCAPE.sub(lambda m: b"\\\\" if m[0] == b"\\" else m[0][:1] + b"\\" + m[0][1:], text)


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", text) if b"\\" in text else text


def assemble(segments: list[bytes]) -> np.ndarray:
    """All segments end to end: their bytes laid out by one gather from the pool of distinct segments."""
    pool: dict[bytes, int] = {}
    which = np.fromiter((pool.setdefault(s, len(pool)) for s in segments), np.int64, len(segments))
    source = np.frombuffer(b"".join(pool), np.uint8)
    sizes = np.fromiter(map(len, pool), np.int64, len(pool))
    origin = np.cumsum(sizes) - sizes
    length = sizes[which]
    offset = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint8)
    index = np.repeat(origin[which] - offset, length) + np.arange(len(out))
    np.take(source, index, out=out)
    return out


def _formatted(conv: list, roles: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
    """One row per run of equal conv: conv_id, formatted text, loss ranges in bytes."""
    escaped = [escape(t) for t in texts]
    segments = [x for role, text in zip(roles, escaped) for x in (TURN + escape(role) + BODY, text, END)]
    buffer = assemble(segments)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments)).reshape(-1, 3)
    ends = np.cumsum(sizes.sum(axis=1))
    first = np.flatnonzero([i == 0 or conv[i] != conv[i - 1] for i in range(len(conv))])
    last = np.append(first[1:], len(conv)) - 1
    offsets = np.append(0, ends[last])
    body = ends - sizes[:, 2] - sizes[:, 1]
    trained = np.array([r == LOSS.encode() for r in roles])
    ranges = []
    for k, (a, z) in enumerate(zip(first, last + 1)):
        own = np.flatnonzero(trained[a:z]) + a
        ranges.append([{"start": int(s), "stop": int(s + n)} for s, n in zip(body[own] - offsets[k], sizes[own, 1])])
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)).cast(pa.string())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([conv[i] for i in first], pa.int64()), text, pa.array(ranges, kind)], ["conv_id", "formatted", "loss"]
    )


def format_chats(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text): conv_id, formatted, loss (byte ranges)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: list = []
        roles: list[bytes] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            columns = [c.cast(pa.binary()).to_pylist() for c in batch.columns[1:]]
            for c, role, text in zip(batch.column(0).to_pylist(), *columns):
                if held >= BLOCK_BYTES and c != conv[-1]:
                    yield _formatted(conv, roles, texts)
                    conv, roles, texts, held = [], [], [], 0
                conv.append(c)
                roles.append(role)
                texts.append(text)
                held += len(text) + 32
        if conv:
            yield _formatted(conv, roles, texts)

    clean = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = clean.repartition(partitions, "conv_id") if partitions else clean.repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>")


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of every turn, read back from the formatted bytes."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, text = piece[len(TURN) :].split(BODY, 1)
        turns.append((unescape(role).decode(), unescape(text).decode()))
    return turns


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from format_chats: turns, the text under the loss mask, sizes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                turns = parse(raw)
                learned = "".join(unescape(raw[x["start"] : x["stop"]]).decode() for x in loss)
                read = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((len(turns), _hex(read), len(learned), _hex(learned), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return chats.mapInArrow(run, schema)

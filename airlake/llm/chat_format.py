"""Chat formatting by columnar byte assembly.

A turn becomes header, escaped text and footer of its role.  For a batch of turns the lengths of all segments give
cumulative offsets; scatter indices send the bytes of headers, texts and footers into one preallocated buffer, and
conversations are slices of that buffer.  The loss mask lists the code points of assistant texts.

Template (``name`` is the role, percent-encoded)::

    system     <<SYS>>\\n text \\n<</SYS>>\\n
    user       [INST] text  [/INST]\\n
    assistant  <s> text </s>\\n
    others     [TURN name]\\n text [/TURN]\\n

A control string inside a text gets a backslash after its first character, and one that already has backslashes there gets
one more, so no text holds a control string and taking one backslash away restores it.

A conversation is written as consecutive chunks of whole turns, each of about ``CHUNK`` bytes at most (a longer turn is a
chunk of its own), so a conversation of any length needs bounded memory.

Defined cases: a null text counts as empty and a null role as the empty name; null turns come first; turns of the same
number are ordered by role, then text; rows with a null conversation form one conversation; repeated rows are turns
of their own; an empty table gives an empty result.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm.common import slices, table, utf8
from airlake.llm.registry import query

#: Bytes of a chunk.
CHUNK = 1 << 20
MARKS = {"system": (b"<<SYS>>\n", b"\n<</SYS>>\n"), "user": (b"[INST] ", b" [/INST]\n"), "assistant": (b"<s>", b"</s>\n")}
#: What a control string has after its first character.
_CONTROL = r"/?s>|/?INST\]|<SYS>>|</SYS>>|TURN |/TURN\]"
_ESCAPE = rf"(<|\[)(\\*)({_CONTROL})"
_UNESCAPE = re.compile(rf"(<|\[)\\(\\*)({_CONTROL})")
_TURN = re.compile(r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[INST\] (?P<user>.*?) \[/INST\]\n|<s>(?P<assistant>.*?)</s>\n"
                   r"|\[TURN (?P<name>[^\]]*)\]\n(?P<other>.*?)\[/TURN\]\n", re.DOTALL)
FORMATTED = "conv_id long, chunk int, n_turns int, text string, loss_start array<int>, loss_end array<int>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _marks(role: str) -> tuple[bytes, bytes]:
    return MARKS.get(role) or (f"[TURN {quote(role, safe='')}]\n".encode(), b"[/TURN]\n")


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(([0], np.cumsum(size))), np.frombuffer(b"".join(parts), np.uint8)


def _scatter(out: np.ndarray, to: np.ndarray, at: np.ndarray, size: np.ndarray, raw: np.ndarray) -> None:
    """Copy segment i, ``size[i]`` bytes at ``at[i]`` of ``raw``, to ``to[i]`` of ``out``."""
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = raw[np.repeat(at, size) + step]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte offset of every turn and the end, bytes, code points of every turn, code points of every header)."""
    names = roles.dictionary_encode()
    marks = [_marks(r) for r in names.dictionary.to_pylist()]
    kind = np.asarray(names.indices).astype(np.int64)
    head_at, heads = _table([m[0] for m in marks])
    foot_at, feet = _table([m[1] for m in marks])
    text_at, raw = utf8(texts)
    head, body, foot = np.diff(head_at)[kind], np.diff(text_at), np.diff(foot_at)[kind]
    at = np.concatenate(([0], np.cumsum(head + body + foot)))
    out = np.empty(at[-1], np.uint8)
    _scatter(out, at[:-1], head_at[kind], head, heads)
    _scatter(out, at[:-1] + head, text_at[:-1], body, raw)
    _scatter(out, at[:-1] + head + body, foot_at[kind], foot, feet)
    return at, out, head + foot + np.asarray(pc.utf8_length(texts)).astype(np.int64), head


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted conversations (``FORMATTED``): chunks in order, conversations side by side in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = (), -1
        for batch in batches:
            for some in slices(batch, 3):
                conv, role = some.column(0).to_pylist(), pc.fill_null(some.column(2), "")
                texts = escape(pc.fill_null(some.column(3), ""))
                at, raw, chars, head = assemble(role, texts)
                cut, held = [], 0
                for i, c in enumerate(conv):
                    if (c,) != last:
                        last, chunk, held = (c,), -1, 0
                        fresh = True
                    else:
                        fresh = not cut or held + at[i + 1] - at[i] > CHUNK
                    if fresh:
                        chunk, held = chunk + 1, 0
                        cut.append((i, c, chunk))
                    held += at[i + 1] - at[i]
                edge = np.array([c[0] for c in cut] + [len(conv)])
                begins = np.concatenate(([0], np.cumsum(chars)))
                start = begins[:-1] - np.repeat(begins[edge[:-1]], np.diff(edge)) + head
                loss = np.asarray(pc.equal(role, "assistant"))
                upto = np.concatenate(([0], np.cumsum(loss)))[edge]
                span = lambda x: pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(x[loss].astype(np.int32)))  # noqa: B023, E731
                text = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(at[edge].astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int32()), pa.array(np.diff(edge).astype(np.int32)), text,
                     span(start), span(start + np.asarray(pc.utf8_length(texts)))],
                    names=["conv_id", "chunk", "n_turns", "text", "loss_start", "loss_end"])

    t = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation or chunk."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = m.lastgroup if m["other"] is None else unquote(m["name"])
        yield role, unescape(m["other"] if m["other"] is not None else m[m.lastgroup])
        at = m.end()


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them: one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def row() -> list:
            conv, turns, whole, loss_chars, loss, chars = state
            return [conv, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars]

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    if state:
                        done.append(row())
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(r["text"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for a, b in zip(r["loss_start"], r["loss_end"]):
                    told = unescape(r["text"][a:b])
                    state[3] += len(told)
                    state[4].update(told.encode())
                state[5] += len(r["text"])
            yield _rows(done)
        if state:
            yield _rows([row()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                     ("formatted_chars", pa.int64())])


def _rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DIGEST)], schema=_DIGEST)


@query("op10_chat_format")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one whose texts are control strings, and read them back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string"))
    return digests(format_turns(turns))

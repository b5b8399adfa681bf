"""Chat formatting by columnar byte assembly.

Template: ``<s>`` once per conversation, then for each turn ``[INST]`` role ``[/INST]`` text ``</s>``.  Control strings inside
roles and texts are escaped reversibly: a control string with k backslashes after its first
character gets k + 1, so only the template's own stand without any.

Assembly: for each Arrow batch the segment lengths of all turns give cumulative offsets, and numpy scatter
indices copy headers and contents into one preallocated buffer.  Turns are sorted by conversation, so that buffer with the conversations'
offsets is the Arrow column; only a conversation that goes on in the next batch is copied again.  No string is built per turn.

Scale: one shuffle by conversation; a conversation of more than ``RUN`` rows is dealt by runs of ``RUN`` turn numbers, so one that holds a third of
all rows is spread over tasks.  Other conversations give one row (``part`` 0) unless they
outgrow ``PART_BYTES``.  A conversation's parts and pieces, in order of (part, piece), concatenate to the whole.
A task holds one Arrow batch (its scatter indices take some 24 bytes for each byte of it) and one piece.

Nulls, ties, repeats: conv_id and turn are whole numbers (cast to bigint; another text is an error); NULL text or role is empty, a NULL turn comes first, rows without a conv_id form one
conversation; equal turn numbers are ordered by role, then text; repeated rows are all
formatted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")
RUN = 4096
PART_BYTES = 16 << 20
LOSS_ROLE = "assistant"
SCHEMA = ("conv_id bigint, part bigint, piece int, n_turns bigint, formatted string, "
          "loss_start array<bigint>, loss_end array<bigint>")


def escape(texts: pa.Array) -> pa.Array:
    """One more backslash after the first character of every control string."""
    return pc.replace_substring_regex(texts, ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies segment i (data[start[i]:start[i] + length[i]]) to out[to[i]:]."""
    total = int(length.sum())
    if not total:
        return
    within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + within] = data[np.repeat(start, length) + within]


def assemble(roles: pa.Array, texts: pa.Array, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns of a batch in one buffer: (bytes, byte offsets of the turns, code points before the
    content, code points of the content).  ``begins``: the turn is a conversation's first."""
    kinds = roles.dictionary_encode()
    names = escape(kinds.dictionary.cast(pa.string())).to_pylist()
    heads = [f"{start}{OPEN}{n}{CLOSE}" for n in names for start in ("", BEGIN)]
    which = kinds.indices.to_numpy() * 2 + begins
    head_bytes = [h.encode("utf-8", "replace") for h in heads]
    head_len = np.array([len(h) for h in head_bytes], np.int64)[which]
    head_at = np.concatenate(([0], np.cumsum([len(h) for h in head_bytes])))[:-1].astype(np.int64)[which]
    content = escape(texts)
    data, offsets = _buffers(content)
    size = np.diff(offsets)
    end = np.frombuffer(END.encode(), np.uint8)
    turn = np.concatenate(([0], np.cumsum(head_len + size + len(end))))
    out = np.empty(int(turn[-1]), np.uint8)
    n = len(size)
    _scatter(out, turn[:-1], np.frombuffer(b"".join(head_bytes), np.uint8), head_at, head_len)
    _scatter(out, turn[:-1] + head_len, data, offsets[:-1], size)
    _scatter(out, turn[1:] - len(end), end, np.zeros(n, np.int64), np.full(n, len(end)))
    points = np.array([len(h) for h in heads], np.int64)[which]
    return out, turn, points, pc.utf8_length(content).to_numpy().astype(np.int64)


def _plain(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values with NULL as 0, which are NULL)."""
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_null().to_numpy(zero_copy_only=False)


def _piece_starts(starts: np.ndarray, turn: np.ndarray, held: int) -> np.ndarray:
    """The first turns of all pieces: ``starts`` and, in stretches beyond PART_BYTES, each turn before which a piece is full (``held`` bytes of
    the first stretch's piece lie in earlier batches)."""
    stops = np.append(starts[1:], len(turn) - 1)
    more = []
    for k in np.flatnonzero(turn[stops] - turn[starts] + np.where(np.arange(len(starts)) == 0, held, 0) > PART_BYTES):
        size = held if k == 0 else 0
        for i in range(starts[k], stops[k]):
            if size > PART_BYTES:
                more.append(i)
                size = 0
            size += turn[i + 1] - turn[i]
    return np.unique(np.concatenate([starts, np.array(more, np.int64)]))


PART_FIELDS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                         ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, part, turn) to formatted parts; the last piece of a batch is held until it is known to be whole."""
    open_ = None               # key, piece, turns, code points, bytes, loss_start, loss_end

    def closed() -> pa.RecordBatch:
        key, piece, turns, _, data, starts, ends = open_
        return pa.RecordBatch.from_pylist([{"conv_id": key[0], "part": key[1], "piece": piece, "n_turns": turns, "formatted": b"".join(data).decode(),
                                            "loss_start": starts, "loss_end": ends}], schema=PART_FIELDS)

    for b in batches:
        if not b.num_rows:
            continue
        conv, none = _plain(b.column(0))
        part = b.column(1).to_numpy(zero_copy_only=False)
        new = np.ones(b.num_rows, bool)
        new[1:] = (conv[1:] != conv[:-1]) | (none[1:] != none[:-1]) | (part[1:] != part[:-1])
        goes_on = open_ is not None and open_[0] == (b.column(0)[0].as_py(), int(part[0]))
        new[0] = not goes_on
        out, turn, before, chars = assemble(b.column(3), b.column(4), new & b.column(2).to_numpy(zero_copy_only=False))
        # the first turns of stretches of one part, then of pieces
        stretch = np.flatnonzero(new if not goes_on else np.concatenate(([True], new[1:])))
        first = _piece_starts(stretch, turn, sum(map(len, open_[4])) if goes_on else 0)
        if goes_on and sum(map(len, open_[4])) > PART_BYTES:
            joined = False                                     # the held piece is full: what comes is a piece of its own
        else:
            joined = goes_on
        of = np.searchsorted(stretch, first, side="right") - 1                # the stretch of each piece
        number = np.arange(len(first)) - np.searchsorted(first, stretch)[of]
        if goes_on:
            number[of == 0] += open_[1] + (0 if joined else 1)
        stop = np.append(first[1:], b.num_rows)
        ends_at = np.cumsum(before + chars + len(END))
        base = np.concatenate(([0], ends_at))[first]                          # code points before the piece
        loss = np.flatnonzero(pc.equal(b.column(3), LOSS_ROLE).to_numpy(zero_copy_only=False))
        piece_of = np.searchsorted(first, loss, side="right") - 1
        loss_end = ends_at[loss] - len(END) - base[piece_of]
        loss_start = loss_end - chars[loss]
        cut = np.searchsorted(loss, np.append(first, b.num_rows))
        if joined:                                             # the open piece takes in this batch's first one
            key, piece, turns, points, data, starts, ends = open_
            open_ = (key, piece, turns + int(stop[0]), points + int(ends_at[stop[0] - 1]), [*data, out[:turn[stop[0]]].tobytes()],
                     starts + (loss_start[:cut[1]] + points).tolist(), ends + (loss_end[:cut[1]] + points).tolist())
        low = 1 if joined else 0
        if len(first) > low:
            if open_ is not None:
                yield closed()
            last = len(first) - 1                              # may go on in the next batch
            if last > low:
                at = turn[first[low:last + 1]]
                lists = [pa.ListArray.from_arrays(pa.array(cut[low:last + 1].astype(np.int32)), pa.array(x)) for x in (loss_start, loss_end)]
                text = pa.LargeStringArray.from_buffers(last - low, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(out)).cast(pa.string())
                rows = pa.array(first[low:last])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(number[low:last], pa.int32()),
                     pa.array(stop[low:last] - first[low:last]), text, *lists], schema=PART_FIELDS)
            i, c = int(first[last]), cut[last]
            open_ = ((b.column(0)[i].as_py(), int(part[i])), int(number[last]), b.num_rows - i, int(ends_at[-1] - base[last]),
                     [out[turn[i]:].tobytes()], loss_start[c:].tolist(), loss_end[c:].tolist())
    if open_ is not None:
        yield closed()


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations: conv_id, part, piece, n_turns, formatted, loss_start and loss_end (code point spans of
    the escaped assistant texts within ``formatted``)."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        whole_text("role").alias("role"), whole_text("text").alias("text"))
    run = F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62))).cast("bigint")
    # only conversations of more rows than a run are dealt by runs; all others are one part, the first
    split = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min(run).alias("low")).filter(F.col("n") > RUN).select(
        F.col("conv_id").alias("s_id"), "low")
    rows = rows.join(split, F.col("conv_id").eqNullSafe(F.col("s_id")), "left")
    rows = rows.withColumn("part", F.when(F.col("low").isNull(), F.lit(0)).otherwise(run).cast("bigint")).withColumn(
        "first", F.col("low").isNull() | (F.col("part") == F.col("low")))
    keyed = rows.select("conv_id", "part", "first", "role", "text", "turn")
    dealt = keyed.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(_parts, SCHEMA)


# -- reading back -----------------------------------------------------------------------

def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    at, out = len(BEGIN) if formatted.startswith(BEGIN) else 0, []
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("not a formatted conversation")
        close = formatted.index(CLOSE, at)
        end = formatted.index(END, close)
        out.append((unescape(formatted[at + len(OPEN):close]), unescape(formatted[close + len(CLOSE):end])))
        at = end + len(END)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by (conv_id, part, piece) to one row per conversation; a hash and counts are held, no text."""
    key, state, done = object(), None, []

    def close():
        n, all_, chars, loss, size = state
        done.append((key, n, all_.hexdigest(), chars, loss.hexdigest(), size))

    def batch():
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)],
                                          names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        for r in b.to_pylist():
            if state is None or r["conv_id"] != key:
                if state is not None:
                    close()
                key, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = r["formatted"]
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
            for s, e in zip(r["loss_start"], r["loss_end"]):
                plain = unescape(text[s:e])
                state[2] += len(plain)
                state[3].update(plain.encode("utf-8", "replace"))
            state[4] += len(text)
        if len(done) >= 2000:
            yield batch()
            done = []
    if state is not None:
        close()
    if done:
        yield batch()


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the parts."""
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return parts.mapInArrow(_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                      "loss_sha256 string, formatted_chars bigint")

r"""Chat formatting: columnar assembly of conversations as marked-up text with a mask for the loss.

A turn becomes `### role: text</turn>` and a line feed. Inside a text a backslash is put before
every backslash, before every `#` that two more follow and before every `<` that begins `</turn>`;
in a role before every colon as well. So markers of the template never occur inside a turn, and
taking the backslashes away again gives back every role and text exactly.

A batch of turns is assembled as columns of bytes: escapes are found on the concatenated bytes of
all texts, the lengths of headers, contents and ends are summed to offsets, and one scatter copies
each into a single preallocated buffer, which becomes the Arrow column without another copy.
Reading back is columnar too: backslashes that escape are told from escaped ones by their place in
a run, unescaped markers are found on the bytes of all rows, and what is left is kept by a mask.

A conversation is one row, or several `part`s if it is longer than `PART_BYTES`; parts end between
turns, so a conversation of any length needs no more memory than a part and its longest turn. Rows
of a conversation are sorted by turn and pass through one task one after the other.

Defined cases: a null text or role is empty; turns are ordered by turn, null first, then role and
text, so repeated turns stay, in a fixed order; null ids are one conversation; a conversation that
is empty but for its markers has its markers; an empty table gives an empty table; columns other
than id, turn, role and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import prepare, slices

HEAD, MIDDLE, END = b"### ", b": ", b"</turn>\n"
LOSS_ROLE = "assistant"
TURN_BYTES = len(HEAD + MIDDLE + END)
PART_BYTES = 1 << 20  # of roles, texts and markers
SLICE_BYTES = 4 << 20  # handled at a time; a longer turn or part is a slice of its own

_BACKSLASH, _HASH, _LESS, _COLON = b"\\#<:"


# --- bytes ----------------------------------------------------------------------------------


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and the offset of each row and of the end."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    octets = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return octets[offsets[0] : offsets[-1]], offsets - offsets[0]


def _found(octets: np.ndarray, what: bytes, ends: np.ndarray | None = None) -> np.ndarray:
    """Where `what` begins. `ends` are row ends that an occurrence may not cross."""
    at = np.flatnonzero(octets[: max(0, len(octets) - len(what) + 1)] == what[0])
    for i, c in enumerate(what[1:], 1):
        at = at[octets[at + i] == c]
    if ends is not None and len(at):
        at = at[at + len(what) <= ends[np.searchsorted(ends, at, "right")]]
    return at


def _to_escape(octets: np.ndarray, offsets: np.ndarray, role: bool) -> np.ndarray:
    """Ascending places of bytes that need a backslash before them."""
    ends = offsets[1:]
    marks = [_found(octets, b"\\"), _found(octets, HEAD[:3], ends), _found(octets, END[:-1], ends)]
    if role:
        marks.append(_found(octets, MIDDLE[:1]))
    return np.sort(np.concatenate(marks))


def _escaping(octets: np.ndarray) -> np.ndarray:
    """Which backslashes are escapes: the first, third ... of each run of them."""
    slash = octets == _BACKSLASH
    at = np.flatnonzero(slash)
    if not len(at):
        return slash
    first = np.r_[True, np.diff(at) > 1]
    run = np.maximum.accumulate(np.where(first, at, 0))
    out = np.zeros(len(octets), bool)
    out[at[(at - run) % 2 == 0]] = True
    return out


def _code_points(octets: np.ndarray) -> np.ndarray:
    """The number of code points before each byte and before the end."""
    return np.r_[0, np.cumsum((octets & 0xC0) != 0x80)]


def _strings(octets: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(octets)]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, buffers)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, where each ends, and where its text starts and ends.

    Returns octets, ends (turns), spans (turns x 2).
    """
    parts = [_bytes_of(roles), _bytes_of(texts)]
    escapes = [_to_escape(*part, role=i == 0) for i, part in enumerate(parts)]
    added = [np.searchsorted(e, offsets) for e, (_, offsets) in zip(escapes, parts, strict=True)]
    role_size, text_size = (np.diff(o) + np.diff(a) for (_, o), a in zip(parts, added, strict=True))
    n = len(role_size)
    ends = np.cumsum(len(HEAD) + role_size + len(MIDDLE) + text_size + len(END))
    starts = np.r_[0, ends[:-1]] if n else ends
    role_at = starts + len(HEAD)
    middle_at = role_at + role_size
    text_at = middle_at + len(MIDDLE)
    end_at = text_at + text_size
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for at, what in ((starts, HEAD), (middle_at, MIDDLE), (end_at, END)):
        for i, c in enumerate(what):
            out[at + i] = c
    for (octets, offsets), marks, extra, to in zip(parts, escapes, added, (role_at, text_at), strict=True):
        # a byte moves by where its row goes, and by the escapes of its row up to it
        move = np.repeat(to - offsets[:-1] - extra[:-1], np.diff(offsets))
        step = np.zeros(len(octets), np.int64)
        step[marks] = 1
        place = np.arange(len(octets)) + move + np.cumsum(step)
        out[place] = octets
        out[place[marks] - 1] = _BACKSLASH
    return out, ends, np.stack([text_at, end_at], axis=1)


def dissect(octets: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What formatted bytes say: role, line feed, text, line feed of every turn.

    `loss` (spans x 2) are the byte ranges under the mask. Returns the bytes, with a line feed in the
    place of each colon; which of them stay; which of those the mask covers; and where the ends of
    turns begin. Bytes that are no formatted turns are refused.
    """
    escape = _escaping(octets)
    literal = np.r_[False, escape[:-1]]
    end = _found(octets, END)
    end = end[~literal[end]]
    start = np.r_[0, end[:-1] + len(END)] if len(end) else end
    colon = _found(octets, MIDDLE)
    colon = colon[~literal[colon]]
    first = np.searchsorted(colon, start)
    head = _found(octets, HEAD)
    if len(octets) != (end[-1] + len(END) if len(end) else 0) or not np.isin(start, head).all() or (first >= len(colon)).any():
        raise ValueError("not a formatted conversation")
    colon = colon[first]
    if (colon >= end).any():
        raise ValueError("not a formatted conversation")
    keep = ~escape
    for at, what in ((start, HEAD), (colon, MIDDLE), (end, END)):
        for i in range(len(what)):
            keep[at + i] = False
    keep[colon] = keep[end + len(END) - 1] = True
    said = octets.copy()
    said[colon] = END[-1]
    change = np.zeros(len(octets) + 1, np.int64)
    np.add.at(change, loss[:, 0], 1)
    np.add.at(change, loss[:, 1], -1)
    return said, keep, (np.cumsum(change[:-1]) > 0) & keep, end


# --- over tables ----------------------------------------------------------------------------


def _new(ids: pa.Array) -> np.ndarray:
    """Whether each row has another id than the row before it; null is an id."""
    before, here = ids.slice(0, len(ids) - 1), ids.slice(1)
    other = pc.fill_null(pc.not_equal(before, here), False)
    other = pc.or_(other, pc.not_equal(pc.is_null(before), pc.is_null(here)))
    return np.r_[True, other.to_numpy(zero_copy_only=False)]


def _small(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a bounded number of bytes in the given columns; none is empty."""
    for batch in batches:
        sizes = sum((pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy() for c in columns), np.zeros(batch.num_rows, np.int64))
        for part in slices(sizes.tolist(), SLICE_BYTES):
            yield batch.slice(part.start, part.stop - part.start)


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, part, n_turns, formatted, loss) out of turns in order."""
    held: pa.Table | None = None  # turns of the part that the next batch may go on with
    done = 0  # bytes of their conversation before them
    for batch in _small(batches, 1, 2):
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        table = table.combine_chunks()
        ids, roles, texts = (table.column(i).chunk(0) for i in range(3))
        size = sum((np.diff(_bytes_of(c)[1]) for c in (roles, texts)), TURN_BYTES)
        new = _new(ids)
        before = np.cumsum(size) - size
        first = np.maximum.accumulate(np.where(new, np.arange(len(size)), 0))
        before -= before[first]
        before[first == 0] += done
        part = before // PART_BYTES
        cut = np.flatnonzero(new | (np.r_[-1, part[:-1]] != part))
        held, done = table.slice(cut[-1]), int(before[cut[-1]])
        if len(cut) > 1:
            yield _rows(ids, roles, texts, part, cut)
    if held is not None:
        ids, roles, texts = (held.column(i).combine_chunks() for i in range(3))
        yield _rows(ids, roles, texts, np.array([done // PART_BYTES]), np.array([0, len(ids)]))


def _rows(ids: pa.Array, roles: pa.Array, texts: pa.Array, part: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    """A row for each run of turns between two cuts."""
    turns = int(cut[-1])
    roles, texts = roles.slice(0, turns), texts.slice(0, turns)
    octets, ends, spans = assemble(roles, texts)
    offsets = np.r_[0, ends][cut]
    points = _code_points(octets)
    marked = pc.fill_null(pc.equal(roles, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
    row = np.searchsorted(cut, np.flatnonzero(marked), "right") - 1
    loss = points[spans[marked]] - points[offsets[row]][:, None]
    structs = pa.StructArray.from_arrays([pa.array(loss[:, i], pa.int64()) for i in (0, 1)], ["start", "end"])
    per_row = np.bincount(row, minlength=len(cut) - 1)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(cut[:-1])),
            pa.array(part[cut[:-1]], pa.int64()),
            pa.array(np.diff(cut), pa.int64()),
            _strings(octets, offsets),
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_row)], pa.int32()), structs),
        ],
        ["conv_id", "part", "n_turns", "formatted", "loss"],
    )


def format_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows conv_id, part, n_turns, `formatted`, `loss` (code point ranges of assistant texts).

    The parts of a conversation, in order, are its formatted text. They lie next to each other.
    """
    prepare(turns.sparkSession)
    named = {"conv_id": id_col, "turn": turn_col, "role": role_col, "text": text_col}
    rows = turns.select(*(F.col(f"`{c}`").alias(name) for name, c in named.items()))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    id_type = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {id_type}, part long, n_turns long, formatted string, loss array<struct<start: long, end: long>>"
    return rows.select("conv_id", "role", "text").mapInArrow(_formatted, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation; its hashes go on from part to part."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state = None  # id, turns, hash, loss characters, hash, formatted characters
    id_type = None

    def closed(states: list) -> pa.RecordBatch:
        columns = [[s[0] for s in states], [s[1] for s in states], [s[2].hexdigest() for s in states]]
        columns += [[s[3] for s in states], [s[4].hexdigest() for s in states], [s[5] for s in states]]
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in _small(batches, 2):
        ids = batch.column(0)
        id_type = ids.type
        octets, offsets = _bytes_of(batch.column(2))
        points = _code_points(octets)
        loss = batch.column(3)
        per_row = np.diff(loss.offsets.to_numpy())
        spans = np.stack([loss.flatten().field(i).to_numpy() for i in (0, 1)], axis=1)
        spans = spans + np.repeat(points[offsets[:-1]], per_row)[:, None]
        # the byte at which a code point begins
        spans = np.r_[np.flatnonzero((octets & 0xC0) != 0x80), len(octets)][spans]
        said, keep, under, turn_ends = dissect(octets, spans)
        kept, kept_at = said[keep], np.r_[0, np.cumsum(keep)]
        masked, masked_at = said[under], np.r_[0, np.cumsum(under)]
        masked_points = _code_points(masked)
        turns = np.searchsorted(turn_ends, offsets)
        new = _new(ids)
        done = []
        for r, value in enumerate(ids.to_pylist()):
            a, b = offsets[r], offsets[r + 1]
            if state is None or (new[r] if r else value != state[0]):
                if state is not None:
                    done.append(state)
                state = [value, 0, sha256(), 0, sha256(), 0]
            state[1] += int(turns[r + 1] - turns[r])
            state[2].update(kept[kept_at[a] : kept_at[b]])
            state[3] += int(masked_points[masked_at[b]] - masked_points[masked_at[a]])
            state[4].update(masked[masked_at[a] : masked_at[b]])
            state[5] += int(points[b] - points[a])
        if done:
            yield closed(done)
    if state is not None:
        yield closed([state])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say, a row a conversation: counts and digests.

    Reads nothing but `formatted` and `loss`, of rows that lie as `format_conversations` puts them.
    """
    id_type = dict(formatted.dtypes)["conv_id"]
    schema = (
        f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long"
    )
    return formatted.select("conv_id", "part", "formatted", "loss").mapInArrow(_read, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of one formatted conversation."""
    octets = np.frombuffer(formatted.encode("utf-8", "surrogatepass"), np.uint8)
    literal = np.r_[False, _escaping(octets)]
    turns, at = [], 0
    for end in _found(octets, END):
        if literal[end]:
            continue
        middle = next(i for i in _found(octets[at:end], MIDDLE) + at if not literal[i])
        ranges = ((at + len(HEAD), middle), (middle + len(MIDDLE), end))
        turns.append(tuple(_unescaped(octets[a:b]) for a, b in ranges))
        at = end + len(END)
    return turns


def _unescaped(octets: np.ndarray) -> str:
    return octets[~_escaping(octets)].tobytes().decode("utf-8", "surrogatepass")

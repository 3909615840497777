"""Packing token ids into windows by best-fit decreasing.

A task encodes its documents and packs them a buffer at a time (``BUFFER`` ids), so
nothing is shuffled and memory follows the buffer, not the table:

1. a document longer than a window is cut into full windows first; its rest, like any
   shorter document, is an item;
2. items go by falling length, each into the open window with the least room that takes
   it. Open windows stand in a segment tree indexed by their room, whose nodes count the
   windows below them, so that window is found in O(log window);
3. windows with more than ``slack`` free places are then filled up with cuts from the
   emptiest ones. At most one window of a buffer stays open; its pieces are items of the
   task's next buffer. So a task pads one window, and gaps of at most ``slack``.

A sequence is padded to the window, except where its length is a power of two. Sequence
ids are (partition << 33) + a running number, as in ``monotonically_increasing_id``: a task
that runs again gives the same rows, but another partitioning of the table gives others.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.llm.token_files import encoded

WINDOW, SLACK = 1024, 8
#: Ids that a task packs at once.
BUFFER = 4 << 20


class Piece(NamedTuple):
    """``length`` ids of document ``doc`` (its place in the buffer) from its id ``start`` on."""

    doc: int
    start: int
    length: int


class Rooms:
    """Open windows by room, in a segment tree over the rooms 0..window."""

    def __init__(self, window: int) -> None:
        self.base = 1 << window.bit_length()
        self.below = [0] * (2 * self.base)  # open windows under each node
        self.at: list[list[int]] = [[] for _ in range(self.base)]

    def _count(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.below[node] += by
            node >>= 1

    def put(self, number: int, room: int) -> None:
        self.at[room].append(number)
        self._count(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the open window with the least room of at least ``length``: (number, room)."""
        node = self.base + length
        if not self.below[node]:
            while node > 1 and (node & 1 or not self.below[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node + (not self.below[2 * node])
        room = node - self.base
        self._count(room, -1)
        return self.at[room].pop(), room


def best_fit(items: list[Piece], window: int = WINDOW) -> list[list[Piece]]:
    """Best-fit decreasing of items of at most ``window`` ids; ties keep their order."""
    windows: list[list[Piece]] = []
    rooms = Rooms(window)
    for item in sorted(items, key=lambda x: -x.length):
        found = rooms.tightest(item.length)
        if found is None:
            found = len(windows), window
            windows.append([])
        number, room = found
        windows[number].append(item)
        if room > item.length:
            rooms.put(number, room - item.length)
    return windows


def fill(windows: list[list[Piece]], window: int = WINDOW, slack: int = SLACK) -> tuple[list[list[Piece]], list[Piece]]:
    """(windows with at most ``slack`` free places, pieces of the one that could not be filled):
    the emptiest windows are taken apart, and cuts of their pieces fill the fullest first."""
    used = [sum(p.length for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda i: -used[i])
    done = [windows[i] for i in order if window - used[i] <= slack]
    gaps = order[len(done):]
    at, last = 0, len(gaps) - 1
    while at < last:
        into, room = windows[gaps[at]], window - used[gaps[at]]
        while room and at < last:
            donor = windows[gaps[last]]
            p = donor.pop()
            into.append(Piece(p.doc, p.start, min(room, p.length)))
            if p.length > room:
                donor.append(Piece(p.doc, p.start + room, p.length - room))
            room -= min(room, p.length)
            if not donor:
                last -= 1
        if not room:
            done.append(into)
            at += 1
    left = windows[gaps[at]] if at <= last else []
    return done, left


def pack_buffer(sizes: list[int], carried: list[Piece], window: int = WINDOW, slack: int = SLACK) -> tuple[list[list[Piece]], list[Piece]]:
    """Documents of ``sizes`` ids (numbered from 0) and pieces carried over -> (sequences, pieces left)."""
    full, items = [], list(carried)
    for doc, size in enumerate(sizes):
        whole = size - size % window
        full.extend([Piece(doc, at, window)] for at in range(0, whole, window))
        if size > whole:
            items.append(Piece(doc, whole, size - whole))
    packed, left = fill(best_fit(items, window), window, slack)
    return full + packed, left


def _pack(path: str, end_id: int, window: int, slack: int, buffer: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from rarebird.llm.arrowbatch import binary_slices, ragged

        context = TaskContext.get()
        number = context.partitionId() << 33 if context else 0
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        # documents of the buffer: columns of batches, the first of them with the rest of the last buffer
        docs, held, left = [], 0, []

        def flush(end: bool):
            nonlocal docs, held, left, number
            if not docs:
                return
            ids = pa.concat_arrays([d[0] for d in docs])
            size = np.concatenate([d[1] for d in docs])
            flat = np.concatenate([d[2] for d in docs])
            first = np.cumsum(size) - size
            old = docs[0][3]  # documents at the front that are in the buffer for their pieces in ``left`` alone
            fresh = [0] * old + size[old:].tolist()
            sequences, left = pack_buffer(fresh, left, window, slack)
            if end and left:
                sequences, left = [*sequences, left], []
            pieces = [(p.doc, p.start, p.length, number + i) for i, s in enumerate(sequences) for p in s]
            number += len(sequences)
            if pieces:
                doc, start, length, sequence = np.array(pieces, np.int64).T
                new = np.append(True, sequence[1:] != sequence[:-1])
                before = np.cumsum(length) - length
                offset = before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(new))))
                out = binary_slices(flat[ragged(first[doc] + start, length)], np.append(0, np.cumsum(length)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc)), *map(pa.array, (start, length)), out, *map(pa.array, (size[doc], sequence, offset))], names=names)
            # what is left takes its documents along, renumbered
            kept = sorted({p.doc for p in left})
            place = {d: i for i, d in enumerate(kept)}
            left = [p._replace(doc=place[p.doc]) for p in left]
            at = np.array(kept, np.int64)
            docs = [(ids.take(pa.array(at)), size[at], flat[ragged(first[at], size[at])], len(kept))] if kept else []
            held = 0

        for b in encoded(path, end_id)(batches):
            size = np.asarray(b.column("n"), np.int64)
            flat = np.frombuffer(b.column("ids").buffers()[2], np.uint32, int(size.sum()))
            docs.append((b.column("id"), size, flat, 0))
            held += len(flat)
            if held >= buffer:
                yield from flush(False)
        yield from flush(True)

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0,
         slack: int = SLACK, buffer: int = BUFFER) -> DataFrame:
    """(id, start, length, ids binary, doc_tokens, sequence_id, offset), one row for each piece.

    A document's ids are the tokenizer's (no special tokens added) and ``end_id``; ``start`` is
    the number of its ids before the piece, ``offset`` the place in the sequence, gapless from
    0. Null and empty texts have the end id alone; null or repeated ids keep their rows; other
    columns are not read; an empty table gives an empty one. One pass without a shuffle. A
    text, its ids and the buffer must fit in a task's memory.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _pack(path, end_id, window, slack, buffer),
        f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, length, padded_length, ids binary, ends): the ids of each sequence, and where its
    pieces end in it, for attention masks. A sequence has at most ``window`` ids, so groups are bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    power = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    return (pieces.groupBy("sequence_id").agg(parts.alias("parts")).withColumn("length", length)
            .select("sequence_id", "length", F.when(power, F.col("length")).otherwise(window).alias("padded_length"),
                    F.aggregate("parts", F.lit(bytearray(b"")), lambda x, p: F.concat(x, p["ids"])).alias("ids"),
                    F.transform("parts", lambda p: p["offset"] + p["length"]).alias("ends")))

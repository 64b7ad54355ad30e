"""Packing: documents cut and laid into sequences of a fixed number of tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cardwatch.llm.cutting_stock import Pattern, cut
from cardwatch.llm.shared import pieces, stage
from cardwatch.llm.tokens import TokenizerFiles, encoder

#: Bytes of text encoded at a time.
BLOCK = 4_000_000
#: Offsets (16 bytes each) are broadcast up to this many, joined by a shuffle beyond.
FEW_OFFSETS = 2_000_000

PIECE = pa.schema(
    [
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.binary()),
        ("_part", pa.int64()),
        ("_rank", pa.int64()),
    ]
)


def _cut_documents(files: TokenizerFiles, capacity: int, end_id: int, id_type: pa.DataType):
    """Batches of documents -> their pieces: full ones and a rest, ranked in the task."""
    schema = PIECE.insert(0, pa.field("_id", id_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = list(zip(batch["_id"].to_pylist(), batch["_text"].to_pylist(), strict=True))
            for block in pieces(rows, (len(t or "") for _, t in rows), BLOCK):
                ids, counts = encoder(files).encode([t for _, t in block])
                out = [[] for _ in schema]
                at = 0
                for (key, _), n in zip(block, counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for start in range(0, n + 1, capacity):
                        piece = own[start : start + capacity]
                        size = len(piece)
                        row = (key, start, size, n + 1, piece.tobytes(), part, ranks[size])
                        ranks[size] += 1
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema
                )

    return run


@dataclass(frozen=True)
class Layout:
    """Where pieces go: a row for each run of ranks of a length that a pattern takes.

    Columns of `runs`: length, first rank, pieces in a copy, base, offset in a copy, fill.
    Fill 0: each copy is a sequence, numbered from base. Else copies of `fill` tokens lie
    end to end in a stream, from position base; it is cut every `capacity`
    tokens and its tail into powers of two, which need no padding.
    """

    runs: np.ndarray
    capacity: int
    stream: int
    sequences: int

    def bounds(self) -> np.ndarray:
        """Starts of the tail's sequences, and its end."""
        rest = self.stream % self.capacity
        powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        return self.stream - rest + np.cumsum([0, *powers])

    def find(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of positions in the stream."""
        tail = self.bounds()
        k = np.maximum(np.searchsorted(tail, position, "right") - 1, 0)
        late = position >= tail[0]
        number = np.where(late, tail[0] // self.capacity + k, position // self.capacity)
        return self.sequences + number, np.where(late, position - tail[k], position % self.capacity)

    def ends(self, sequence: int) -> int:
        """The position in the stream where a sequence ends."""
        k = sequence - self.sequences - self.stream // self.capacity
        return int(self.bounds()[k + 1]) if k >= 0 else (sequence - self.sequences + 1) * self.capacity


def _layout(patterns: list[Pattern], n_full: int, capacity: int, slack: float) -> Layout:
    taken: Counter = Counter()
    runs, sequence, stream = [(capacity, 0, 1, 0, 0, 0)] if n_full else [], n_full, 0
    for p in patterns:
        offset, fill = 0, sum(n * k for n, k in zip(p.lengths, p.counts, strict=True))
        apart = capacity - fill <= slack * capacity
        for n, k in zip(p.lengths, p.counts, strict=True):
            runs.append((n, taken[n], k, sequence if apart else stream, offset, 0 if apart else fill))
            taken[n] += k * p.times
            offset += n * k
        sequence += p.times * apart
        stream += p.times * fill * (not apart)
    return Layout(np.array(sorted(runs), np.int64).reshape(-1, 6).T, capacity, stream, sequence)


def _place(layout: Layout, schema: pa.Schema):
    lengths, ranks, eaches, bases, offsets, fills = layout.runs
    starts = (lengths << 42) + ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["_rank"].to_numpy() + batch["_before"].to_numpy()
            at = np.searchsorted(starts, (length << 42) + rank, "right") - 1
            copy, nth = np.divmod(rank - ranks[at], eaches[at])
            inside = offsets[at] + nth * length
            flows = fills[at] > 0
            position = np.where(flows, bases[at] + copy * fills[at] + inside, 0)
            sequence, offset = layout.find(position)
            crossing = flows & (layout.find(position + length - 1)[0] > sequence)
            sequence = np.where(flows, sequence, bases[at] + copy)
            offset = np.where(flows, offset, inside)
            columns = [batch[name] for name in schema.names[:-2]]
            whole = pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], schema=schema
            )
            yield whole.filter(pa.array(~crossing))
            for k in np.flatnonzero(crossing).tolist():
                row = whole.slice(k, 1).to_pylist()[0]
                now, end = int(position[k]), int(position[k] + length[k])
                ids, start = row["ids"], row["start"]
                parts = []
                while now < end:
                    seq, at_offset = (int(x[0]) for x in layout.find(np.array([now])))
                    upto = min(end, layout.ends(seq))
                    begin = now - int(position[k])
                    size = upto - now
                    parts.append(
                        row
                        | {"start": start + begin, "length": size, "sequence_id": seq}
                        | {"offset": at_offset, "ids": ids[4 * begin : 4 * (begin + size)]}
                    )
                    now = upto
                yield pa.RecordBatch.from_pylist(parts, schema=schema)

    return run


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    files: TokenizerFiles = TokenizerFiles(),
    slack: float = 0.005,
    gap: float = 0.001,
    rounds: int = 1_500,
) -> DataFrame:
    """Pieces of all documents with their place: id_col, start, length, doc_tokens,
    ids (little-endian unsigned 32-bit), sequence_id, offset.

    A document is its ids and then `end_id`. It is cut into full pieces of `capacity`,
    which are sequences of their own, and a rest. The rests' length histogram (at most
    `capacity` lengths) is a cutting-stock problem: its linear program over patterns is
    solved by column generation, until it is within `gap` (or one and a half sequences) of
    a dual bound or for `rounds` rounds. Shares of patterns are rounded, what is left is a
    program again, and pieces take their places by rank within their length.
    Copies of a pattern that would leave over `slack` of a sequence empty are laid end to
    end instead and cut at sequence ends, which splits a few pieces more; the tail of that
    stream is cut into powers of two. So padding is at most `slack` of the tokens; it is
    never stored.

    Ranks are counted in the task that encodes, and sums over tasks put them in one
    order: no length is gathered in one task, however frequent. Texts are encoded once,
    into a table in the shared folder.

    Null text: empty, so one piece with `end_id`. Null or repeated ids, repeated rows:
    each row is a document of its own. Empty table: no rows. Very long texts are cut as
    any other. Only the two columns named are read, other columns can't clash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = rows.schema["_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    ddl = (
        f"_id {id_type.simpleString()}, start long, length long, doc_tokens long, ids binary, "
        "_part long, _rank long"
    )
    encode = _cut_documents(files, capacity, end_id, to_arrow_type(id_type))
    table = stage(rows.mapInArrow(encode, ddl), "pieces")

    counts = stage(table.groupBy("_part", "length").agg(F.count("*").alias("n")), "piece-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    n_full = total.pop(capacity, 0)
    patterns = cut(total, capacity, gap, rounds)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    if counts.count() <= FEW_OFFSETS:
        offsets = F.broadcast(offsets)

    out = ["_id", "start", "length", "doc_tokens", "ids"]
    ranked = table.join(offsets, ["_part", "length"]).select(*out, "_rank", "_before")
    schema = pa.schema(
        [("_id", to_arrow_type(id_type)), *((f.name, f.type) for f in PIECE if f.name in out)]
        + [("sequence_id", pa.int64()), ("offset", pa.int64())]
    )
    layout = _layout(patterns, n_full, capacity, slack)
    ddl = f"_id {id_type.simpleString()}, start long, length long, doc_tokens long, ids binary"
    placed = ranked.mapInArrow(_place(layout, schema), ddl + ", sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)

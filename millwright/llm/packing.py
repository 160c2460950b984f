"""Mixture-controlled packing of documents into fixed-length token sequences.

Every source is a queue of documents in the table's order. Deficit round-robin serves the queues
in rounds of one window: a round credits each queue with its share of `length` tokens, and the
queue sends slices of `least` tokens (documents are cut freely) while its credit covers them; what
is left is its deficit, carried to the next round. So every window holds the sources in their
target proportions, to within a slice or two each, and when a queue is empty the others go on in
proportion. The stream of rounds is cut every `length` tokens; every sequence but the last is full.

All of it has a closed form, as credit only grows. By round w a queue of T tokens and quantum q
has sent `least` * floor(w q / `least`) tokens, or T once w q reaches T; the stream's length by
round w is the sum over queues. So the place of a token follows from its queue and its number
there, and rounds need no loop, no sort and no state between partitions (`Schedule`).

A token's number in its queue is a prefix sum in two levels: while a task tokenizes its rows it
counts what each source had before in this task, and one row for each task and source gives the
rest. So texts are read once and no row is shuffled for its place: token ids go to a written
table and meet one offset for each (source, task), which Spark broadcasts if it is small.

Beyond `most_queues` sources the smallest share the last queue, in the table's order.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.session import sliced, staged, table

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
_encoders: dict[str, object] = {}


@cache
def ordinary(vocabulary: str):
    """The encoding of a file of ranks; what spells a special token is ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(vocabulary: str = VOCABULARY):
    """A function from a text to its ids, equal to the tokenizer file's own encoding.

    The file's ranks are run by the faster of two libraries; a text that spells a special
    token is left to the tokenizer file itself."""
    if vocabulary not in _encoders:
        import public_tokenizers

        fast, slow = ordinary(vocabulary), []

        def encode(text: str) -> list[int]:
            if SPECIAL not in text:
                return fast.encode_ordinary(text)
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def tokenized(docs: DataFrame, text: str = "text", end: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, cell, inside, doc_tokens, ids of every row of `docs`: its ids and the end
    id as little-endian 16-bit numbers (the vocabulary has fewer ids), the task that read it and
    how many tokens of its source that task had before it. A table to write at once: places hold
    for the rows of one reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cell = encoder(vocabulary), TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for b in sliced(batches):
            ids = [np.array([*encode(t.as_py()), end], "<u2").tobytes() for t in b["t"]]
            inside = []
            for s, x in zip(b["source"].to_pylist(), ids, strict=True):
                inside.append(seen.get(s, 0))
                seen[s] = inside[-1] + len(x) // 2
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array([cell] * len(ids), pa.int32()), pa.array(inside, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "cell", "inside", "doc_tokens", "ids"])

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id"), source.alias("source"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, source string, cell int, inside long, doc_tokens long, ids binary")


class Schedule:
    """Deficit round-robin over queues of `totals` tokens, served in proportion to `weights`."""

    def __init__(self, totals: list[int], weights: list[float], length: int, least: int):
        self.totals, self.length, self.least = np.array(totals, np.int64), length, least
        self.quanta = length * np.array(weights, np.float64) / max(math.fsum(weights), 1e-300)

    def sent(self, rounds: np.ndarray, queue: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tokens sent by the queues after so many rounds; arrays that broadcast."""
        credit = rounds * self.quanta[queue]
        return np.where(credit >= self.totals[queue], self.totals[queue], self.least * np.floor(credit / self.least).astype(np.int64))

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round, from 0, in which a queue sends a token: the first one after which its credit
        covers the token's slice."""
        q = self.quanta[queue]
        end = np.minimum((token // self.least + 1) * self.least, self.totals[queue])
        after = np.ceil(end / q).astype(np.int64)
        after += after * q < end
        after -= (after - 1) * q >= end
        return after - 1

    def positions(self, queue: np.ndarray, rounds: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Places in the stream of tokens that their queues send in the given rounds."""
        out, step = np.empty(len(token), np.int64), max(1, (1 << 22) // max(1, len(self.totals)))
        order = np.arange(len(self.totals))
        for at in range(0, len(token), step):
            j, w = queue[at : at + step, None], rounds[at : at + step, None]
            before = self.sent(w)
            others = np.where(order < j, self.sent(w + 1), before).sum(axis=1)
            out[at : at + step] = others + token[at : at + step] - np.take_along_axis(before, j, 1)[:, 0]
        return out

    def segments(self, queue: np.ndarray, before: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, length, position) of the runs of tokens that stay together of documents
        with `before` tokens of their queue before them: one run for each round, in order."""
        wide = self.quanta[queue] >= self.least  # each round sends a slice; else each slice has a round
        first = np.where(wide, self.round_of(queue, before), before // self.least)
        last = np.where(wide, self.round_of(queue, before + size - 1), (before + size - 1) // self.least)
        row, number = _runs(first, last - first + 1)
        j, b, n, own = queue[row], before[row], size[row], wide[row]
        begin = np.maximum(b, np.where(own, self.sent(number, j), number * self.least))
        to = np.minimum(b + n, np.where(own, self.sent(number + 1, j), (number + 1) * self.least))
        rounds = np.where(own, number, self.round_of(j, begin))
        return row, begin - b, to - begin, self.positions(j, rounds, begin)


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first[row] + 0, 1, ..., count[row] - 1) for every row."""
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def queues(tokens: DataFrame, weights: dict[str, float] | None, length: int, least: int, most_queues: int) -> tuple[DataFrame, Schedule]:
    """(source, cell, queue, first) for every source and task: the queue and the tokens in it
    before this task's; and the schedule. `weights` are the sources' target shares (default: their
    own); a source without one is served at the least positive weight."""
    sums = staged(tokens.groupBy("source", "cell").agg(F.sum("doc_tokens").alias("size")), "packing-sums")
    totals = sums.groupBy("source").agg(F.sum("size").alias("total"))
    large = totals.orderBy(F.col("total").desc(), "source").limit(most_queues - 1).collect()  # at most most_queues rows
    given = {s: float(w) for s, w in (weights or {}).items() if w > 0}
    spark = tokens.sparkSession
    names = spark.createDataFrame([(r["source"], i) for i, r in enumerate(large)], "source string, queue int")
    placed = sums.join(F.broadcast(names), "source", "left").na.fill({"queue": len(large)})
    before = F.sum("size").over(Window.partitionBy("queue").orderBy("cell", "source").rowsBetween(Window.unboundedPreceding, -1))
    rest = totals.join(F.broadcast(names), "source", "left_anti").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    sizes = [*((r["total"], given.get(r["source"], min(given.values())) if given else r["total"]) for r in large), *([(rest, min(given.values()) if given else rest)] if rest else [])]
    return staged(placed.select("source", "cell", "queue", F.coalesce(before, F.lit(0)).cast("long").alias("first")), "packing-offsets"), Schedule([t for t, _ in sizes], [w for _, w in sizes], length, least)


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = 1024, weights: dict[str, float] | None = None, text: str = "text", end: int = 0, least: int = 32, most_queues: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, source, start, length, ids_crc32,
    doc_tokens, sequence_id, offset (and ids, as 32-bit numbers). Every document ends with the
    id `end`; pieces are cut where its queue's turn or a sequence ends. All sequences but the last
    hold `length` ids.

    A null text is empty and still has its end id; a null source is the source ''; equal rows
    are packed each; no rows give no pieces."""
    tokens = staged(tokenized(docs, text, end), "packing-ids")
    offsets, schedule = queues(tokens.select("source", "cell", "doc_tokens"), weights, length, least, most_queues)
    placed = tokens.join(offsets, ["source", "cell"]).select("doc_id", "source", "queue", (F.col("first") + F.col("inside")).alias("before"), "doc_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            queue, before, size = (b[c].to_numpy().astype(np.int64) for c in ("queue", "before", "doc_tokens"))
            row, start, run, position = schedule.segments(queue, before, size)
            part, window = _runs(position // length, (position + run - 1) // length - position // length + 1)
            begin = np.maximum(position[part], window * length)
            run = np.minimum(position[part] + run[part], (window + 1) * length) - begin
            row, start = row[part], start[part] + begin - position[part]
            wide = [memoryview(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in b["ids"].to_pylist()]
            ids = [wide[i][4 * a : 4 * (a + n)] for i, a, n in zip(row.tolist(), start.tolist(), run.tolist(), strict=True)]
            made = [start, run, np.array([zlib.crc32(x) for x in ids], np.int64), size[row], window, begin - window * length]
            out = [*b.select(["doc_id", "source"]).take(pa.array(row)).columns, *(pa.array(x, pa.int64()) for x in made)]
            out += [pa.array([bytes(x) for x in ids], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "source", *(f.split()[0] for f in PIECE.split(", ")), *(["ids"] if with_ids else [])])

    kind = dict(placed.dtypes)["doc_id"]
    return placed.mapInArrow(cut, f"doc_id {kind}, source string, {PIECE}" + ", ids binary" * with_ids)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed to 1024 tokens, sources in their own proportions in every window."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))

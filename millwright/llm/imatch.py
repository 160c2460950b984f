"""I-Match document fingerprints over randomised lexicons.

A document keeps the terms whose document frequency lies in a band, so neither noise nor
stop words count. Its distinct kept terms are sorted, and each of several randomised subsets
of the lexicon gives one hash: that of the sorted kept terms inside the subset. Two documents
agree on a subset when no kept term of it differs.

Subsets come at several rates (an eighth of the lexicon, a thirty-second, ...), as an edit of a
long document touches every large subset and a short document leaves small ones empty.
Likeness is the share of equal subsets among those that either document has a term in, by
rate, averaged over the rates that have any.

Document frequencies are exact counts over all documents of 2^`bits` hashed terms: a table of
fixed size, whatever the corpus, so the band is a bitmap of 2^`bits` bits, small enough to
broadcast by construction. Terms that share a slot share a frequency.

The edited text of a document ends with the start of its successor by doc_id. Documents are
dealt to ranges of doc_id (split points from a count over ids; a doc_id with many rows is cut by
a hash of their texts), sorted inside a range and read in one stream that keeps two rows; the first
document of every range is sent to the range before it too. So texts are shuffled once and no order
spans one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import sliced, staged, table

#: ASCII punctuation separates terms.
SPLIT = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)
#: log2 of the subsets' inverse rates, and subsets at each rate.
RATES, SUBSETS = (3, 5, 7, 9), 16
NONE = "------"


def term_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the terms of a text: runs without white space or ASCII
    punctuation, lower-cased."""
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(SPLIT).split())
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


def slots(terms: np.ndarray, bits: int) -> np.ndarray:
    return (terms >> np.uint64(64 - bits)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text", bits: int = 22) -> DataFrame:
    """(slot, df) over all rows: in how many documents a hashed term occurs. Each task counts
    before the shuffle, so a frequent term is one row of it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**bits, np.int32)
        for b in sliced(batches):
            for t in b["t"]:
                total[np.unique(slots(term_hashes(t.as_py()), bits))] += 1
        on = np.flatnonzero(total)
        for a in range(0, len(on), 1 << 16):
            part = on[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], names=["slot", "df"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(count, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", low: float = 2e-5, high: float = 0.2, least: int = 2, bits: int = 22) -> np.ndarray:
    """Bitmap (2^`bits` / 8 bytes) of the slots whose document frequency is at least `least`
    and `low` of all documents, and at most `high` of them (but at least `least`)."""
    n = docs.count()
    band = document_frequencies(docs, text, bits).where(F.col("df").between(max(least, low * n), max(least, high * n)))
    words = band.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, slot & 31)) AS bits")).toPandas()
    out = np.zeros(2**bits // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def kept(terms: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The terms inside the band, still sorted."""
    at = slots(terms, int(band.size * 32).bit_length() - 1)
    return terms[(band[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1]


_MIX = np.array([int.from_bytes(hashlib.sha256(b"lexicon %d" % i).digest()[:8], "big") | 1 for i in range(SUBSETS)], np.uint64)


def fingerprint(terms: np.ndarray, everything: np.ndarray) -> str:
    """Hash of the whole sorted kept terms, then of each subset (`------` for one with none).

    A text without kept terms is told from others by all its terms, so equal texts and only
    alike texts agree on the first part. Subsets of one draw are nested, so each rate looks only at
    what the one before kept, for several draws at once."""
    whole = terms if len(terms) else everything
    parts = [[NONE] * len(RATES) for _ in range(SUBSETS)]
    base, step = terms ^ (terms >> np.uint64(31)), max(1, (1 << 20) // max(1, len(terms)))
    for first in range(0, SUBSETS, step):
        draw = base * _MIX[first : first + step, None]
        draw ^= draw >> np.uint64(32)
        row, col = np.nonzero(draw & np.uint64(2 ** RATES[0] - 1) == 0)
        at = draw[row, col]
        for k, rate in enumerate(RATES):
            if k:
                inside = at & np.uint64(2**rate - 1) == 0
                row, col, at = row[inside], col[inside], at[inside]
            held, ends = terms[col].tobytes(), (8 * np.searchsorted(row, np.arange(len(draw) + 1))).tolist()
            for i in range(len(draw)):
                if ends[i + 1] > ends[i]:
                    parts[first + i][k] = f"{xxhash.xxh64_intdigest(held[ends[i] : ends[i + 1]], 1) >> 40:06x}"
    return ".".join([xxhash.xxh64_hexdigest(whole.tobytes()) if len(whole) else "0" * 16, *chain.from_iterable(parts)])


def likeness(a: str, b: str) -> float:
    """Between two fingerprints, 0 to 1; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = a.split(".")[1:], b.split(".")[1:]
    shares = []
    for k in range(len(RATES)):
        held = [(p, q) for p, q in zip(x[k :: len(RATES)], y[k :: len(RATES)], strict=True) if p != NONE or q != NONE]
        if held:
            shares.append(sum(p == q for p, q in held) / len(held))
    return sum(shares) / len(shares) if shares else 0.0


def of_text(text: str, band: np.ndarray) -> str:
    terms = term_hashes(text)
    return fingerprint(kept(terms, band), terms)


def fingerprints(docs: DataFrame, band: Broadcast, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Every row with its fingerprint in column `name` (replaced if there). Null and empty
    texts have the same fingerprint."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([of_text(t.as_py(), band.value) for t in texts], pa.string())

    return docs.select(*(c for c in docs.columns if c != name), run(F.coalesce(F.col(text), F.lit(""))).alias(name))


Place = tuple[bool, int, int]


def split_points(rows: DataFrame, range_rows: int = 512, most: int = 20_000) -> list[Place]:
    """Places (key is there, key, hash) at which ranges of about `range_rows` rows (key, hash) start,
    ascending; nulls come first. A key with more rows is cut by hash. At most about `most` points are
    made, so the ranges of a larger table are longer."""
    n = rows.count()
    parts = min(most, n // range_rows)
    if parts < 2:
        return []
    size = max(range_rows, n // most)
    keys = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    hot = rows.groupBy("key").count().where(F.col("count") > 2 * size).collect()  # at most most / 2 rows
    out = {(True, k, -(1 << 63)) for k in keys}
    for r in hot:
        cuts = -(-r["count"] // size)
        out |= {(r["key"] is not None, r["key"] or 0, -(1 << 63) + (i << 64) // cuts) for i in range(cuts)}
    return sorted(out)


def with_successor(docs: DataFrame, key: str, text: str, range_rows: int = 512) -> DataFrame:
    """Rows (range, copied, key, text), each partition sorted so that every row that is not
    copied is directly followed by its successor by `key`; after the last comes the first.
    Equal keys are ordered by a hash of their texts, rows equal in both hold the same text."""
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = staged(docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(t).alias("hash")), "imatch-order")
    starts = split_points(narrow, range_rows)

    def ranged(keys: list, hashes: list) -> list[int]:
        return [bisect_right(starts, (k is not None, k or 0, h)) for k, h in zip(keys, hashes, strict=True)]

    @F.arrow_udf("int")
    def of(keys: pa.Array, nulls: pa.Array, hashes: pa.Array) -> pa.Array:
        own = [None if x else k for k, x in zip(keys.to_pylist(), nulls.to_pylist(), strict=True)]
        return pa.array(ranged(own, hashes.to_pylist()), pa.int32())

    place = (F.coalesce("key", F.lit(0)), F.col("key").isNull(), F.col("hash"))
    first = narrow.withColumn("range", of(*place)).groupBy("range").agg(F.min(F.struct(F.col("key").isNotNull().alias("there"), "key", "hash")).alias("m")).orderBy("range").collect()  # one row a range
    heads = {(r["m"]["key"], r["m"]["hash"]): first[i - 1]["range"] for i, r in enumerate(first)}  # of a range, and the range before it

    @F.arrow_udf("array<int>")
    def ranges(keys: pa.Array, nulls: pa.Array, hashes: pa.Array) -> pa.Array:
        own, at = [None if x else k for k, x in zip(keys.to_pylist(), nulls.to_pylist(), strict=True)], hashes.to_pylist()
        before = [heads.get(x) for x in zip(own, at, strict=True)]
        return pa.array([[r] if b is None else [r, b] for r, b in zip(ranged(own, at), before, strict=True)], pa.list_(pa.int32()))

    dealt = docs.select(F.col(key).cast("long").alias("key"), t.alias("text")).withColumn("hash", F.xxhash64("text"))
    dealt = dealt.select("key", "text", "hash", F.posexplode(ranges(*place)).alias("copied", "range"))
    return dealt.repartition("range").sortWithinPartitions("range", "copied", F.col("key").asc_nulls_first(), "hash").select("range", "copied", "key", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 22) -> DataFrame:
    """One row for each row of `docs` (columns EDITED): its fingerprint, that of its edited
    text (the last half of its code points, rounded down, replaced by the first as many of the
    successor, or all of them), and the likeness to that and to the successor's own.

    Null texts are empty; null keys come first; equal keys follow each other; a single row is
    its own successor; no rows give none."""
    band = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text, bits=bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, key, text, fingerprint
        for b in sliced(batches):
            out = []
            for r, copied, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if copied and held is None:
                    continue
                own = of_text(t, band.value)
                if held is not None:
                    half = len(held[2]) // 2
                    edited = held[2][: len(held[2]) - half] + t[:half]
                    changed = of_text(edited, band.value)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[1], len(held[2]), digest, held[3], changed, likeness(held[3], changed), likeness(held[3], own)))
                held = None if copied else (r, k, t, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=[f.split()[0] for f in EDITED.split(", ")])

    return with_successor(docs, key, text).mapInArrow(run, EDITED)


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, one vote of all shingle hashes each. Two fingerprints link at
`LIMIT` = 4 or fewer differing bits. Plain pigeonhole would cut five segments so that one is
equal; instead three longer segments are cut, of which one differs by at most one bit. Every
fingerprint is indexed under each segment with each single bit of it deleted (22 + 21 + 21 =
64 keys), so two such segments meet under the key without the differing bit, and an equality
join finds every link. The join itself verifies the distance and takes a pair only under its
first common key.

Groups are kept small by construction:

* equal fingerprints are one row from the start, so exact copies cost nothing;
* keys are counted first, and only keys with up to `crowd` fingerprints are joined;
* fingerprints under a more crowded key (many near copies of one text) are linked exactly in
  linear size: each is dealt to every value within two bits of it (2,081 of them), and all
  that meet at a value are linked to the smallest there. Two fingerprints meet at a common
  value if and only if they differ by at most four bits.

The query's fingerprints are over four-word shingles. `deduplicate` starts from the same components
and joins to them texts that share 0.8 of their five-word shingles, of which fingerprints miss some,
by an exact search (see `similar`).

Links are then labelled with the smallest doc_id by rounds of hooking and shortcutting in
tables, never on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.session import sliced, staged, table

LIMIT, SEED = 4, 42
#: (first bit, bits) of the segments.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
#: Hashes voted on at once, which bounds the memory of a very long text.
BLOCK = 1 << 16
#: Frequent shingles that are kept to order the others; longs of a parity map, and of the same
#: map folded, which travels with the keys.
COMMON, WIDE, FOLDED = 1 << 17, 32, 4
#: Rows of a narrow table that is sent to all tasks; a larger one is joined by a shuffle.
SMALL = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def simhash(text: str | None, size: int = 4) -> int:
    """Fingerprint of the `size`-word shingles, repeats included; of the whole sequence where
    there are fewer words; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    votes, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], starts[at + size : to + size], strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4, name: str = "fp") -> DataFrame:
    """Every row of `docs` without its text, with the fingerprint as a signed long."""
    rows = docs.select(*(c for c in docs.columns if c not in (text, name)), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([simhash(t.as_py(), size) for t in b["__text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], name])

    return rows.mapInArrow(run, T.StructType([*rows.drop("__text").schema, T.StructField(name, T.LongType())]))


def _keys(fp: Column) -> Column:
    """The 64 one-wildcard keys of a fingerprint as ints: the segment's bits without one of
    them, and which key it is."""
    out = []
    for first, bits in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        out += [segment.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << w)).cast("long")).bitwiseOR(F.lit((first + w) << 22).cast("long")).cast("int") for w in range(bits)]
    return F.array(*out)


def _first_key(x: Column) -> Column:
    """Which key is the first that two fingerprints with the difference `x` share: in the
    lowest segment with at most one differing bit, that bit, or the first bit if none is."""
    found = F.lit(None).cast("int")
    for first, bits in reversed(SEGMENTS):
        part = F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        found = F.when(part == 0, F.lit(first)).when(F.bit_count(part) == 1, F.bit_count(part - 1) + first).otherwise(found)
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball() -> list[int]:
    """All values with at most two set bits, as signed longs."""
    one = [1 << i for i in range(64)]
    return [_signed(v) for v in (0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]))]


def links(prints: DataFrame, crowd: int = 128) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints of `prints` (column fp, one row
    each): every pair at `LIMIT` or fewer bits under keys of at most `crowd` fingerprints, and
    for the others enough of them to connect the same fingerprints."""
    keyed = prints.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    crowded = staged(keyed.groupBy("key").count().where(F.col("count") > crowd).select(F.col("key").alias("full")), "simhash-crowded")
    few = keyed.join(_sent(crowded), F.col("key") == F.col("full"), "left_anti")
    # Exploded rows have the size of what they came from in the optimiser's estimate.
    x, y = few.select("key", F.col("fp").alias("a")), few.select(F.col("key").alias("other"), F.col("fp").alias("b")).hint("merge")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = x.join(y, (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & (F.bit_count(diff) <= LIMIT) & (_first_key(diff) == F.shiftright("key", 22))).select("a", "b")
    many = keyed.join(_sent(crowded), F.col("key") == F.col("full"), "left_semi").select("fp").distinct()
    return pairs.unionByName(_crowd_links(staged(many, "simhash-crowd")))


def _crowd_links(prints: DataFrame) -> DataFrame:
    """Links that connect every two of the given fingerprints at `LIMIT` or fewer bits: those
    within two bits of a value (at most 2,081) are linked to the smallest of them."""
    n = prints.count()
    if not n:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    dealt = prints.repartition(min(2000, max(1, n // 32)))
    near = dealt.select("fp", F.explode(F.array(*(F.lit(v) for v in _ball()))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = near.groupBy("value").agg(F.sort_array(F.collect_set("fp")).alias("all")).where(F.size("all") > 1)
    return met.select(F.element_at("all", 1).alias("a"), F.explode(F.expr("slice(all, 2, size(all) - 1)")).alias("b")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the root is the smallest node reachable.

    Alternates two steps until nothing changes: every node links its larger neighbours to its
    smallest one, then its smaller neighbours and itself. Smallest neighbours come from a
    partial aggregate, so a hub is no single task's; every round is a written table."""
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    while True:
        count, mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == (count, mark):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (count, mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "stars", instead_of=now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = staged(small.where("u != v").distinct(), "stars", instead_of=large)


def components(prints: DataFrame) -> DataFrame:
    """`prints` (fp, first) with the smallest `first` of each component as `component`."""
    linked = staged(stars(links(prints.select("fp"))), "simhash-roots")
    member = prints.join(linked.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = staged(member, "simhash-members")
    return member.join(member.groupBy("root").agg(F.min("first").alias("component")).hint("merge"), "root").select("fp", "component")


def grouped(docs: DataFrame, text: str = "text", size: int = 4) -> DataFrame:
    """doc_id, digest (of the text), fp and component (doc_id and digest of the smallest
    document reachable over links) of every row of `docs`."""
    own = fingerprints(docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text")), "text", size)
    own = staged(own, "simhash-prints")
    # Structs order by doc_id, nulls first; a null doc_id must not stand for a component.
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"))
    prints = staged(own.groupBy("fp").agg(F.min(ident).alias("first")), "simhash-distinct")
    return own.join(components(prints).hint("merge"), "fp").select("doc_id", "digest", "fp", "component")


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs`.

    Null, empty and blank texts have the fingerprint 0 and link like any other. Repeated rows
    stay; a component without any doc_id has a null id; no rows give none."""
    return grouped(docs, text, size).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component.doc_id").alias("component_id"))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles of a text; of the whole sequence where
    there are fewer words; none without words."""
    words = words_of(text)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined)] if words else [], np.uint64).view(np.int64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a : b - 1]) for a, b in zip(starts, starts[size:], strict=False)], np.uint64).view(np.int64))


def frequent(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted hashes, counts) in a sixteenth of the distinct texts, at
    most `COMMON` of them. They only set an order of shingles, so a sample is as right as all."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for t in b["t"]:
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), size))], names=["s"])

    t = F.coalesce(F.col(text), F.lit(""))
    some = docs.select(t.alias("t"), F.xxhash64(t).alias("digest")).where(F.pmod(F.xxhash64("digest"), F.lit(16)) == 0).dropDuplicates(["digest"]).select("t")
    rows = some.mapInArrow(listed, "s long").groupBy("s").count().where("count > 2").orderBy(F.col("count").desc(), "s").limit(COMMON).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def prefix(shingles: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The first shingles in one order of all shingles, rarest first, so many that two sets with
    the given Jaccard similarity share one of them, and how many of these are not among the
    `common` ones; 0 for the empty set."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.int64), 1
    hashes, counts = common
    rank = np.zeros(n, np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        rank = np.where(hashes[at] == shingles, counts[at], 0)
    order = np.lexsort((shingles, rank))[: n - math.ceil(similarity * n - 1e-9) + 1]
    return shingles[order], int((rank[order] == 0).sum())


def parity(shingles: np.ndarray) -> np.ndarray:
    """A map of 64 * `WIDE` bits, each the parity of the shingles that fall on it. Two sets' maps
    differ in no more bits than the sets do in shingles, and so do folded maps."""
    bits = np.bincount((shingles.view(np.uint64) >> np.uint64(40)).astype(np.int64) % (64 * WIDE), minlength=64 * WIDE) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def folded(maps: np.ndarray) -> np.ndarray:
    """Maps (one a row) as narrower ones of `FOLDED` longs."""
    return np.bitwise_xor.reduce(maps.reshape(-1, WIDE // FOLDED, FOLDED), axis=1)


def _sent(rows: DataFrame) -> DataFrame:
    """A narrow staged table, to be broadcast if it has at most `SMALL` rows, and else not at all."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows.hint("merge")


def _likely(x: dict[str, Column], y: dict[str, Column], similarity: float, mapped: bool = True) -> Column:
    """Whether two sets that meet under a key can be similar: what is left of both from the first
    shingle they share on, and the parity maps, bound what they share."""
    both = x["n"] + y["n"]
    enough = F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= both * (similarity / (1 + similarity)) - 1e-9
    if not mapped:
        return enough
    apart = reduce(lambda a, b: a + b, (F.bit_count(x[f"b{k}"].bitwiseXOR(y[f"b{k}"])) for k in range(FOLDED)))
    return enough & (apart <= both * ((1 - similarity) / (1 + similarity)) + 1e-9)


def _verified(pairs: DataFrame, docs: DataFrame, text: str, units: DataFrame, flat: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of `pairs` (x, y) whose whole shingle sets are similar, as (a, b): bounded by their maps
    first, then counted."""
    side = lambda rows, c, *to: rows.select(F.col("digest").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in to))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            one, other = (np.frombuffer(b"".join(b[c].to_pylist()), "<u8").reshape(-1, WIDE) for c in ("map_x", "map_y"))
            both = b["n_x"].to_numpy() + b["n_y"].to_numpy()
            near = np.bitwise_count(one ^ other).sum(axis=1) <= both * ((1 - similarity) / (1 + similarity)) + 1e-9
            yield b.select(["x", "y"]).filter(pa.array(near))

    mapped = pairs.join(side(flat, "x", "n", "map"), "x").join(side(flat, "y", "n", "map"), "y")
    pairs = staged(mapped.mapInArrow(bounded, "x long, y long"), "similar-pairs")
    wanted = staged(pairs.select(F.col("x").alias("digest")).unionByName(pairs.select(F.col("y").alias("digest"))).distinct(), "similar-wanted")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b["digest"], pa.array([shingle_set(x.as_py(), size) for x in b["t"]], pa.list_(pa.int64()))], names=["digest", "shingles"])

    # One row of each wanted text, told by its smallest document; equal rows give equal sets.
    chosen = staged(units.join(wanted, "digest").select(F.col("digest").alias("__digest"), F.col("first.doc_id").alias("__id")), "similar-chosen")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("digest"), "doc_id", t.alias("t"))
    rows = rows.join(_sent(chosen), (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("digest", "t").dropDuplicates(["digest"])
    sets = staged(rows.mapInArrow(shingled, "digest long, shingles array<long>"), "similar-shingles")
    both = pairs.join(side(sets, "x", "shingles"), "x").join(side(sets, "y", "shingles"), "y")
    both = both.select("x", "y", F.size(F.array_intersect("shingles_x", "shingles_y")).alias("n"), (F.size("shingles_x") + F.size("shingles_y")).alias("total"))
    links = both.where(F.col("n") >= similarity * (F.col("total") - F.col("n"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return staged(links, "similar-links", instead_of=sets)


def similar(docs: DataFrame, text: str = "text", size: int = 5, similarity: float = 0.8, linked: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the text) and component (doc_id and digest of the smallest document
    reachable) of every row of `docs`, over all links between texts that share `similarity` of
    their `size`-word shingles, and over those in `linked` (a, b: digests of texts), if given.

    The search is exact. Texts are indexed under their rarest shingles (`prefix`), under which
    every two similar texts meet. First each text is compared with the heads of its keys: the text
    there with the fewest rarer shingles, which in a group of near copies is the one they were made
    of, and one by hash. That links most of a large group in linear size. Then every two texts that
    meet, are not of one component yet and that `_likely` does not tell apart inside the join are
    compared on the whole sets.

    A key of a frequent shingle may hold a third of all texts: its head is an aggregate joined
    back, and no window."""
    kind = dict(docs.dtypes)["doc_id"]
    t = F.coalesce(F.col(text), F.lit(""))
    common = frequent(docs, text, size)
    maps = [f"b{k}" for k in range(FOLDED)]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingle_set(x.as_py(), size) for x in b["t"]]
            keys = [prefix(x, similarity, common) for x in sets]
            wide = np.array([parity(x) for x in sets], np.int64).reshape(-1, WIDE)
            bits = folded(wide)
            own = [pa.array([len(x) for x in sets], pa.int64()), pa.array([k for k, _ in keys], pa.list_(pa.int64())), pa.array([c for _, c in keys], pa.int32()), pa.array([x.tobytes() for x in wide]), *(pa.array(bits[:, k]) for k in range(FOLDED))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], names=[*b.schema.names[:-1], "n", "keys", "cold", "map", *maps])

    full = docs.select("doc_id", F.xxhash64(t).alias("digest"), t.alias("t")).mapInArrow(indexed, f"doc_id {kind}, digest long, n long, keys array<long>, cold int, map binary, {', '.join(f'{b} long' for b in maps)}")
    full = staged(full, "similar-prefixes")
    own = staged(full.select("doc_id", "digest"), "similar-documents")
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"))
    units = staged(own.groupBy("digest").agg(F.min(ident).alias("first"), F.count("*").alias("copies")), "similar-texts")
    copied = staged(units.where("copies > 1").select("digest"), "similar-copied")
    once = full.join(_sent(copied), "digest", "left_anti").drop("doc_id").unionByName(full.join(_sent(copied), "digest", "left_semi").drop("doc_id").dropDuplicates(["digest"]))
    once = staged(once, "similar-once", instead_of=full)
    flat = staged(once.drop("keys", "cold"), "similar-maps")

    def exploded(keys: Column, first: Column) -> DataFrame:
        rows = once.select("digest", "n", first.alias("first"), F.posexplode(keys).alias("at", "key"))
        return rows.select("key", "digest", "n", (F.col("first") + F.col("at")).alias("pos"))

    heads = {"deep": F.min(F.struct("pos", F.xxhash64("digest").alias("h"), "digest", "n")), "drawn": F.min(F.struct(F.xxhash64("digest", F.lit(1)).alias("h"), "digest", "n", "pos"))}
    rare, key = exploded(F.slice("keys", 1, F.col("cold")), F.lit(0)), Window.partitionBy("key")
    rare = rare.select("*", F.count("*").over(key).alias("many"), *(h.over(key).alias(k) for k, h in heads.items()))
    often = exploded(F.slice("keys", F.col("cold") + 1, F.size("keys")), F.col("cold"))
    often = often.join(often.groupBy("key").agg(F.count("*").alias("many"), *(h.alias(k) for k, h in heads.items())).hint("merge"), "key").select(rare.columns)
    near = lambda k: F.when((F.col(f"{k}.digest") != F.col("digest")) & _likely({c: F.col(c) for c in ("n", "pos")}, {c: F.col(f"{k}.{c}") for c in ("n", "pos")}, similarity, False), F.col(f"{k}.digest")).alias(k)
    met = staged(rare.unionByName(often).where("many > 1").select("key", "digest", "n", "pos", *map(near, heads)), "similar-met", instead_of=once)

    asked = met.select(F.col("digest").alias("x"), F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.col(k).alias("y")) for i, k in enumerate(heads)))).alias("e")).select("x", "e.*").where("y IS NOT NULL")
    best = asked.groupBy("x", "turn", "y").count().groupBy("x", "turn").agg(F.max(F.struct("count", "y"))["y"].alias("y")).select("x", "y").distinct()
    found = _verified(best, docs, text, units, flat, size, similarity)
    if linked is not None:
        found = found.unionByName(linked)
    roots = staged(stars(found), "similar-roots")

    label = met.select("key", "digest", "n", "pos").join(roots, F.col("digest") == F.col("node"), "left").select("key", "digest", "n", "pos", F.coalesce("root", "digest").alias("label"))
    label = staged(label, "similar-labels")
    apart = staged(label.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("key"), "similar-apart")
    rest = label.join(apart, "key", "left_semi").join(flat.select("digest", *maps), "digest").select("key", "digest", "n", "pos", "label", *maps)
    rest = staged(rest, "similar-rest", instead_of=met)
    other = rest.select(F.col("key").alias("key_"), *(F.col(c).alias(f"{c}_") for c in rest.columns[1:]))
    wide = ("n", "pos", *maps)
    meets = (F.col("key") == F.col("key_")) & (F.col("digest") < F.col("digest_")) & (F.col("label") != F.col("label_")) & _likely({c: F.col(c) for c in wide}, {c: F.col(f"{c}_") for c in wide}, similarity)
    pairs = rest.join(other, meets).select(F.col("digest").alias("x"), F.col("digest_").alias("y")).distinct()
    found = found.unionByName(_verified(pairs, docs, text, units, flat, size, similarity))
    roots = staged(stars(found), "similar-roots")
    member = staged(units.join(roots, F.col("digest") == F.col("node"), "left").select("digest", "first", F.coalesce("root", "digest").alias("root")), "similar-members")
    component = member.join(member.groupBy("root").agg(F.min("first").alias("component")), "root").select("digest", "component")
    return own.select("doc_id", "digest").join(component, "digest").select("doc_id", "digest", "component")


def deduplicate(docs: DataFrame, text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of near-duplicates, the one with the smallest doc_id; columns as
    in `docs`.

    Texts of one component of `near_duplicates` are near-duplicates; those that `similar` finds
    beside are too, as fingerprints miss some of them."""
    prints = grouped(docs, text).select("digest", F.col("component.digest").alias("root")).where("digest <> root")
    linked = staged(prints.select(F.col("digest").alias("a"), F.col("root").alias("b")).distinct(), "simhash-linked")
    rows = staged(similar(docs, text, size, similarity, linked), "simhash-groups")
    first = F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("digest") == F.col("component.digest"))
    gone = staged(rows.where(~first).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "simhash-gone")
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    kept = docs.join(_sent(gone), docs["doc_id"].eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_anti")
    repeats = rows.where(first).groupBy("doc_id", "digest").count().where("count > 1")
    return kept if repeats.isEmpty() else kept.dropDuplicates(["doc_id", text])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

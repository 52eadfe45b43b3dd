"""Exact n-gram Jaccard join with vertical partitioning of the n-gram order.

The global order of n-grams is the order of their 64-bit hashes, and it is cut into fragments.

1. Buckets. Two sets with Jaccard >= p/q differ in at most (|x|+|y|)(q-p)/(q+p) n-grams. There are
   more fragments than that (the number depends on the size class), so the sets agree in several of
   them, and documents that share a fragment's digest meet in a bucket. Fragments with too few
   n-grams are passed over; there are some to spare for that. Buckets are gathered in rounds over
   the digests, which bounds the disk that shuffles need.
2. Counts. A set must share as many fragments as a linked set has to agree in; sets that only have a
   passage in common with others share fewer, and leave the buckets.
3. Stars. The members of a bucket are compared with its leader, the member that meets most others, so
   near copies of one document all meet the same leader, and a bucket gives fewer pairs than members.
   Pairs are dropped where their parity bitmaps differ in more bits than linked sets can: a bit
   can't differ without an n-gram that does.
4. Overlaps. The order is cut into vertical parts; each pair's overlap is counted part by part and
   summed.
5. The rest. Members of a bucket that isn't connected by now meet again by a prefix filter among
   themselves: their n-grams are put in order from the rarest on, and two linked sets share one
   early in that order. Pairs that aren't connected yet are verified too.

No link between components is lost, and a group of near copies costs as many pairs as it has members.
Sets are identified by a 64-bit sum of their hashes (two different sets of 10^8 documents agree by
chance with a probability of about 3e-4).

Defined results: null and empty texts have an empty set and are linked with nothing; a text with
fewer words than n has its whole sequence as its one n-gram; equal sets are linked; repeated rows
give repeated rows; rows without a doc_id are linked like any others, but a null never becomes a
component's id unless there is no other; very long texts are read whole; an empty table gives an
empty one; other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, map_arrow, pieces, released, stored, utf8
from .components import components

VERTICAL = 8  # parts of the order in which overlaps are counted
PASSES = ((4, 5), (6, 7), (0, 1), (2, 3))  # parts that are joined at a time, in the order of signed hashes
FEW = 20_000  # documents that are compared in one pass at most
ROUNDS = 4  # rounds in which buckets are gathered
KEPT = 400_000  # words whose hashes, and sets whose digests, a task remembers


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept for the words of this task."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= KEPT:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def shingles(data: bytes, n: int, known: _Words) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams (A-Z in lower case)."""
    found = data.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    if len(w) < n:
        h = np.full(1, len(w), dtype=np.uint64)
        for k in range(len(w)):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k])
        return h
    h = w[: len(w) - n + 1]
    for k in range(1, n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


class Fragments:
    """The size classes of a threshold, and the digests by which sets of a class meet."""

    def __init__(self, p: int, q: int) -> None:
        self.p, self.q, self.edges = p, q, [1]
        # Fragments with fewer than `small` n-grams are passed over; the wider fragments of a high
        # threshold seldom hold fewer than two, those of a lower one seldom none.
        self.small, self.extra, self.share = (2, 1, 6) if 20 * p >= 17 * q else (1, 3, 20)
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 3 // 2))

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Digests of a set's fragments, and how many of them a linked set shares at least.

        A set has one level or two neighbouring ones; a digest's last bit is its level's parity, and
        the two counts are by that parity.
        """
        n, need = len(s), [0, 0]
        own = int(np.searchsorted(self.edges, n, side="right")) - 1
        found = []
        for level in [own, own + 1] if n * self.q // self.p >= self.edges[own + 1] else [own]:
            most = self.edges[level + 1] - 1
            differ = 2 * most * (self.q - self.p) // (self.q + self.p)
            spare = (self.extra + differ * self.share // 100) if differ else 0
            count = differ + 1 + spare
            part = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            sizes = np.bincount(part.astype(np.int64), minlength=count)
            total = np.zeros(count, dtype=np.uint64)
            full = np.flatnonzero(sizes)
            total[full] = np.add.reduceat(_mix(s + np.uint64(level)), (np.cumsum(sizes) - sizes)[full])
            small = sizes < self.small
            at = np.arange(count) if small.sum() > spare else np.flatnonzero(~small)
            digest = _mix(total[at] + _mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1)))
            found.append(digest & ~np.uint64(1) | np.uint64(level & 1))
            apart = (n + min(most, n * self.q // self.p)) * (self.q - self.p) // (self.q + self.p)
            need[level & 1] = max(1, count - apart - int(small.sum()))
        return np.concatenate(found), need


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set's parity bitmap: two bits an n-gram or more, in a power of two of 64-bit words."""
    words = 1 << max(0, (2 * len(s) - 1).bit_length() - 6)
    odd = np.bincount((_mix(s) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _profiles(docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """doc_id, row (a hash of id and text), size of the set, its digest (null for an empty set), its
    bitmap, its bucket keys and the numbers of them that it must share.

    A set that the task has met before gets no bitmap and no keys: its digest has them already.
    """
    longs, none = F.array().cast("array<long>"), F.lit(None).cast("long")
    schema = docs.select("doc_id", none.alias("row"), F.lit(0).cast("long").alias("n"), none.alias("sig"), longs.alias("bits"), longs.alias("keys"), longs.alias("need")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, fragments, empty = _Words(), set(), Fragments(p, q), np.zeros(0, np.int64)
        for batch in pieces(batches, "text"):
            sizes, digests, bits, keys, needs = [], [], [], [], []
            for data in utf8(batch.column("text")).to_pylist():
                s = shingles(data or b"", n, known)
                digest = int(_mix(s).sum().view(np.int64)) if len(s) else None
                sizes.append(len(s))
                digests.append(digest)
                if digest is None or digest in seen:
                    own = empty, empty, []
                else:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen.add(digest)
                    found, need = fragments.keys(s)
                    own = bitmap(s), found.view(np.int64), need
                for held, x in zip((bits, keys, needs), own):
                    held.append(x)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)], dtype=np.int32)), pa.array(np.concatenate(x), pa.int64())) for x in (bits, keys, needs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), *lists], names=["doc_id", "row", "n", "sig", "bits", "keys", "need"])

    return map_arrow(docs.select("doc_id", row_hash(docs).alias("row"), "text"), run, schema)


def row_hash(docs: DataFrame) -> Column:
    """The `row` of each of docs (doc_id, text); rows of the same id and text have the same."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """sig, part, items: the vertical parts of the sets in wanted (row, sig)."""
    schema = "sig long, part int, items array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Words(), set()
        for batch in pieces(batches, "text"):
            sigs, parts, items = [], [], []
            for sig, data in zip(batch.column("sig").to_pylist(), utf8(batch.column("text")).to_pylist()):
                if sig in seen:
                    continue
                s = shingles(data or b"", n, known)
                if len(s) and int(_mix(s).sum().view(np.int64)) == sig:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen.add(sig)
                    cuts = np.searchsorted(s, np.arange(1, VERTICAL, dtype=np.uint64) << np.uint64(61))
                    sigs += [sig] * VERTICAL
                    parts += range(VERTICAL)
                    items += np.split(s.view(np.int64), cuts)
            ends = np.cumsum([0, *map(len, items)], dtype=np.int32)
            flat = np.concatenate(items) if items else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["sig", "part", "items"])

    # wanted grows with the documents: it is shuffled at every size, never broadcast.
    return map_arrow(docs.select(row_hash(docs).alias("row"), "text").join(wanted.hint("merge"), "row").select("sig", "text"), run, schema)


def _members(profiles: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(key, sig) of the buckets that different sets share."""
    found = None
    for k in range(rounds):
        # One shuffle serves the grouping and the join; a key has few different sets or none.
        keyed = profiles.select("sig", F.explode("keys").alias("key")).where(F.pmod(F.shiftrightunsigned("key", 1), F.lit(rounds)) == k).repartition("key")
        shared = keyed.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("key")
        part = stored(keyed.join(shared.hint("shuffle_hash"), "key").distinct(), "members", few=True)
        released(profiles.sparkSession)
        found = part if found is None else found.unionByName(part)
    return found


def _counted(members: DataFrame, needs: DataFrame) -> DataFrame:
    """The members without sets that share fewer buckets than a linked set would share with them.

    What these leave behind can fall short in turn, so it is counted twice; more rounds would only
    save work, as every pair is verified.
    """
    for _ in range(2):
        parity = F.col("key").bitwiseAND(F.lit(1)).alias("parity")
        counts = members.groupBy("sig").agg(F.sum(F.when(parity == 0, 1).otherwise(0)).alias("even"), F.sum(F.when(parity == 1, 1).otherwise(0)).alias("odd"))
        enough = counts.join(needs, "sig").select("sig", (F.col("even") >= F.col("need")[0]).alias("even"), (F.col("odd") >= F.col("need")[1]).alias("odd")).where("even or odd")
        left = members.join(enough, "sig").where(F.when(parity == 0, F.col("even")).otherwise(F.col("odd"))).select("key", "sig")
        left = stored(left, "counted", few=True)
        shared = left.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("key")
        members = stored(left.join(shared, "key").select("key", "sig"), "members", few=True)
        released(members.sparkSession)
    return members


def _stars(members: DataFrame) -> DataFrame:
    """(a, b), a < b: the leader of each bucket with each of its members."""
    sizes = members.groupBy("key").agg(F.count("*").alias("members"))
    meets = members.join(sizes, "key").groupBy("sig").agg(F.sum("members").alias("meets"))
    leaders = members.join(meets, "sig").groupBy("key").agg(F.max(F.struct("meets", "sig"))["sig"].alias("leader"))
    return members.join(leaders, "key").where("leader <> sig").select(F.least("leader", "sig").alias("a"), F.greatest("leader", "sig").alias("b")).distinct()


def _near(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs with their sizes, but for those that sizes or bitmaps show not to be linked."""
    of = lambda side: sketches.select(F.col("sig").alias(side), F.col("n").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}"))
    sized = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    half = lambda x: (F.size(x) / 2).cast("int")
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda u, v: u.bitwiseXOR(v))
    to = lambda x, y: F.when(F.size(x) > F.size(y), fold(x)).otherwise(x)
    differ = F.aggregate(F.zip_with(to(F.col("bits_a"), F.col("bits_b")), to(F.col("bits_b"), F.col("bits_a")), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, x: s + x)
    sizes = F.expr(f"{q} * least(size_a, size_b) >= {p} * greatest(size_a, size_b)")
    return sized.where(sizes).where(differ * (q + p) <= (F.col("size_a") + F.col("size_b")) * (q - p)).select("a", "b", "size_a", "size_b")


def _overlaps(pairs: DataFrame, sets: DataFrame, passes: tuple = PASSES) -> DataFrame:
    """pairs with common, the size of their intersection: counted part by part, then summed.

    A few parts at a time are joined, so that the items in flight are a share of the sets.
    """
    counts = None
    for parts in passes:
        unique = sets.where(F.col("part").isin(*parts)).dropDuplicates(["sig", "part"])
        spread = pairs.select("a", "b", F.explode(F.array(*map(F.lit, parts))).alias("part"))
        of = lambda side: unique.select(F.col("sig").alias(side), "part", F.col("items").alias(f"of_{side}")).hint("merge")  # noqa: E731, B023
        each = spread.join(of("b"), ["b", "part"]).join(of("a"), ["a", "part"]).select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("common"))
        one = stored(each.groupBy("a", "b").agg(F.sum("common").alias("common")), "overlaps", few=True)
        released(pairs.sparkSession)
        counts = one if counts is None else counts.unionByName(one)
    return pairs.join(counts.groupBy("a", "b").agg(F.sum("common").alias("common")), ["a", "b"])


def _linked(p: int, q: int) -> Column:
    return F.expr(f"{q} * common >= {p} * (size_a + size_b - common)")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, root) of the members of buckets that aren't connected, but for those of two members."""
    rooted = members.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low <> high and members > 2").select("key")
    return rooted.join(mixed, "key").select("sig", "root").distinct()


def _rest(still: DataFrame, sketches: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): pairs of still (sig, root) with different roots that can be linked, by a prefix filter.

    First in the order come n-grams that only one root has, which no pair here can share, then the
    others, the rarest first.
    """
    items = sets.dropDuplicates(["sig", "part"]).join(still, "sig").select("sig", "root", F.explode("items").alias("item"))
    common = items.groupBy("item").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("item", "held")
    met = items.join(common, "item")
    own = Window.partitionBy("sig")
    placed = met.withColumn("at", F.row_number().over(own.orderBy("held", "item")) - F.count("*").over(own)).join(sketches.select("sig", "n"), "sig")
    ahead = placed.withColumn("after", -F.col("at")).where(F.expr(f"after + 1 >= ({p} * n + {q - 1}) div {q}"))
    ahead = stored(ahead.select("sig", "root", "item", "n", "after"), "prefixes", few=True)
    sizes = f"{q} * least(x.n, y.n) >= {p} * greatest(x.n, y.n)"
    reach = f"{p + q} * (1 + least(x.after, y.after)) >= {p} * (x.n + y.n)"
    near = F.expr(f"x.item = y.item and x.sig < y.sig and x.root <> y.root and {sizes} and {reach}")
    return ahead.alias("x").join(ahead.alias("y"), near).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct()


def link(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, row, n_shingles, component_id and group for every row of docs (doc_id, text).

    Two documents are linked when their word n-gram sets have a Jaccard similarity of at least the
    threshold; component_id is the smallest doc_id that links lead to. group is the same number for
    all rows of a component, whatever their ids, and null for an empty set; row is row_hash's.
    """
    p, q = threshold.numerator, threshold.denominator
    spark = docs.sparkSession
    whole = stored(_profiles(docs, n, p, q), "profiles")
    profiles = stored(whole.select("doc_id", "row", "n", "sig"), "sizes")
    first = profiles.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.count("*").alias("copies"))
    needs = whole.where("size(need) > 0").groupBy("sig").agg(F.first("need").alias("need"))
    sketches = stored(whole.where("size(bits) > 0").groupBy("sig").agg(F.max("n").alias("n"), F.first("bits").alias("bits")), "sketches", few=True)
    # Every exchange costs the driver a thread for a minute, so that few documents take one pass.
    few = profiles.count() <= FEW
    passes = (tuple(part for parts in PASSES for part in parts),) if few else PASSES
    members = _counted(_members(whole, 1 if few else ROUNDS), needs)
    dropped(whole)
    released(spark)
    pairs = stored(_near(_stars(members), sketches, p, q), "pairs", few=True)
    released(spark)

    def sets_of(sigs: DataFrame) -> DataFrame:
        kept = stored(_sets(docs, first.join(sigs.select("sig").distinct(), "sig").select("row", "sig"), n), "sets")
        released(spark)
        return kept

    sets = sets_of(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")))
    near = stored(_overlaps(pairs, sets, passes).where(_linked(p, q)).select("a", "b"), "links", few=True)
    dropped(sets)
    roots = components(near)
    still = stored(_open(members, roots), "open", few=True)
    if still.head(1):
        sets = sets_of(still)
        others = stored(_near(_rest(still, sketches, sets, p, q), sketches, p, q), "others", few=True)
        released(spark)
        if others.head(1):
            late = stored(_overlaps(others, sets, passes).where(_linked(p, q)).select("a", "b"), "links", few=True)
            roots = components(near.union(late))
        dropped(sets)
    grouped = first.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").select("sig", "doc_id", F.coalesce("root", "sig").alias("group"), "copies", F.col("root").isNotNull().alias("linked"))
    grouped = grouped.where("linked or copies > 1")
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    component = stored(grouped.select("sig", "group").join(least, "group"), "component", few=True)
    joined = profiles.select("doc_id", "row", F.col("n").alias("n_shingles"), "sig").join(component, "sig", "left")
    return joined.select("doc_id", "row", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("group", "sig").alias("group"))

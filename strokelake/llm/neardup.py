"""MinHash near-duplicates with b-bit signatures, exact links and connected components.

Rows with the same set of shingles form one class and go on as one node. Minima of many hash functions give band keys; nodes that
share a key stand in one bucket. Packed low bits of the minima estimate their similarity, corrected for agreements by chance;
pairs far below the threshold are left out, and so are those whose sets differ in more shingles than a link may have by the
parities of their shingles' hashes, a bound that never errs. The rest is confirmed on the full sets.

Nodes of a bucket are never listed as pairs. The one that meets most others is the hub, and every other one is compared with it.
What remains are strays: nodes that links don't join to their hub, by whatever way. Two nodes that link with each other, one of
them not with the hub, have a shingle in common that the hub lacks, or else one of them lacks more of the hub than it adds: d = A
+ R being what a node adds to and removes from the hub h, a link of x and y needs |dx ^ dy| <= t (|x| + |y|), and x not linked
|dx| > t (|x| + |h|), which together leave no other case. So strays meet others on added shingles, of which the rarest few are
enough, and on removed ones only with nodes that remove more than they add. Nodes that have little to do with their hub must
share two buckets instead. Where all nodes that hold such an item are of one component already, none of them is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TwoGenerations, byte_slices, checkpoint, maybe_broadcast, numbered, renamed


@dataclass(frozen=True)
class Settings:
    """Rows whose sets have 100 * intersection >= percent * union are linked.

    ``bands`` of ``rows`` minima each: with p = s ** rows, a pair at similarity s shares no band with probability
    (1 - p) ** bands, and one band at most with that and bands * p * (1 - p) ** (bands - 1) more: 8e-7 and 2e-5 at 0.85 with
    24 bands, 3e-6 and 5e-5 at 0.8 with 32. The first bounds what is missed near a hub, the second away from it. ``bits`` of each
    minimum are packed. ``margin`` is by how much an estimate may fall short of the threshold, over five standard deviations.
    ``parities`` is how many parity bits stand for a set.
    """

    words: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 5
    bits: int = 4
    margin: float = 0.2
    parities: int = 1024
    seed: int = 20240229

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def around(self) -> float:
        """The estimate from which a node is compared with its hub by sets; just above it, it may count as away from it too."""
        return min(0.5, self.percent / 100 - self.margin)


#: Odd multipliers and increments of a 64-bit mixing.
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _MIX[2])) * _MIX[0]
    x = (x ^ (x >> _MIX[2])) * _MIX[1]
    return x ^ (x >> _MIX[2])


class Shingler:
    """Distinct shingle hashes of texts: lower-cased A-Z, words of anything but ASCII white space."""

    def __init__(self, settings: Settings):
        self.words, self.memo = settings.words, TwoGenerations(400_000)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        import xxhash

        parts = [t.encode().lower().split() for t in texts]
        new = self.memo.missing(set().union(*parts))
        self.memo.put(new, [xxhash.xxh3_64_intdigest(w) for w in new])
        known = self.memo.young.__getitem__
        out = []
        for p in parts:
            w = np.fromiter(map(known, p), np.uint64, len(p))
            if len(w) == 0:
                out.append(w)
                continue
            k = min(self.words, len(w))
            # A text of fewer words is one shingle, told from longer ones by its number of words.
            h = np.full(len(w) - k + 1, k, np.uint64)
            for i in range(k):
                h = _mix(h + w[i : len(w) - k + 1 + i]) * _MIX[1]
            out.append(np.unique(_mix(h)))
        self.memo.turn()
        return out


class Signer:
    """Minima of many hash functions over sets of hashes, their band keys and their packed low bits; parities of the hashes."""

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.a = rng.integers(0, 1 << 62, settings.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, settings.minima, dtype=np.uint64)
        self.settings = settings

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Band keys (one column a band), packed bits and parities, one row a set; no set may be empty."""
        s = self.settings
        x = np.concatenate(sets)
        starts = np.cumsum([0, *(len(y) for y in sets[:-1])])
        lows = np.empty((len(sets), s.minima), np.uint64)
        for k in range(s.minima):
            lows[:, k] = np.minimum.reduceat(x * self.a[k] + self.b[k], starts)
        lows = _mix(lows)
        keys = np.full((len(sets), s.bands), np.uint64(1))
        for r in range(s.rows):
            keys = _mix(keys + lows[:, r :: s.rows] + np.arange(s.bands, dtype=np.uint64))
        per = 64 // s.bits
        low = lows & np.uint64((1 << s.bits) - 1)
        padded = np.zeros((len(sets), -(-s.minima // per) * per), np.uint64)
        padded[:, : s.minima] = low
        shifts = np.arange(per, dtype=np.uint64) * np.uint64(s.bits)
        packed = (padded.reshape(len(sets), -1, per) << shifts).sum(axis=2, dtype=np.uint64)
        # Of two sets, every parity that differs is a shingle at least that only one of them has.
        cells = np.repeat(np.arange(len(sets)), [len(y) for y in sets]) * s.parities + (x >> np.uint64(40)).astype(np.int64) % s.parities
        odd = np.bincount(cells, minlength=len(sets) * s.parities).reshape(len(sets), -1).astype(np.uint8) & 1
        return keys.view(np.int64), packed.view(np.int64), np.packbits(odd, axis=1).view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(rows.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that stand for a set, as two longs a row."""
    return np.array([[s.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s + np.uint64(1)))] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


def signatures(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, n_shingles, h1, h2, keys (array), bits (array), odd (array)`` of each row; the last five null for an empty set."""
    signer = Signer(settings)

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in byte_slices(texts, 4 << 20):
                sets = shingler.sets(texts[a:b])
                full = [k for k, s in enumerate(sets) if len(s)]
                found = signer.sign([sets[k] for k in full]) if full else [np.zeros((0, 1), np.int64)] * 3
                digests = _digests([sets[k] for k in full])
                # Rows without a word take part in nothing.
                at = np.full(len(sets), -1)
                at[full] = np.arange(len(full))
                take = pa.array(at, pa.int64(), mask=at < 0)
                columns = [pa.array(digests[:, 0]), pa.array(digests[:, 1]), *map(_lists, found)]
                given = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*given, *(c.take(take) for c in columns)], names=["id", "text_hash", "n_shingles", "h1", "h2", "keys", "bits", "odd"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, n_shingles long, h1 long, h2 long, keys array<long>, bits array<long>, odd array<long>")


#: A node: the smallest id of a class, and the first half of its digest, which tells sets of one id apart.
NODE = "struct<id: long, h: long>"


def node_sets(docs: DataFrame, nodes: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """``node, hub, shingles`` of the nodes ``node, hub``, from the rows of their ids only. Repeated rows give repeated sets."""
    listed = maybe_broadcast(nodes.select("node.id", "node.h", "hub"))  # else all texts are shuffled
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(listed, "id").select("id", "h", "hub", "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for a, b in byte_slices(texts, 4 << 20):
                sets, part = shingler.sets(texts[a:b]), batch.slice(a, b - a)
                asked = part.column(1).to_pylist()
                mine = [k for k, s in enumerate(sets) if len(s) and _digests([s])[0, 0] == asked[k]]
                part, sets = part.take(pa.array(mine, pa.int64())), [sets[k] for k in mine]
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([part.column(0), part.column(1)], names=["id", "h"]), part.column(2), lists], names=["node", "hub", "shingles"])

    return texts.mapInArrow(run, f"node {NODE}, hub boolean, shingles array<long>")


def estimate(a: Column, b: Column, settings: Settings) -> Column:
    """Similarity from packed bits: agreements of b-bit minima less what chance gives."""
    ones = sum(1 << (settings.bits * i) for i in range(64 // settings.bits))
    low = F.lit(ones - (1 << 64) if ones >> 63 else ones)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d
        for k in range(1, settings.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(folded.bitwiseAND(low))

    wrong = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << settings.bits)
    return (1 - wrong / F.lit(float(settings.minima)) - chance) / (1 - chance)


def plausible(a: str, b: str, settings: Settings) -> Column:
    """Sizes, parities and packed bits that a link could have.

    A link has 100 (x + y - d) >= percent (x + y + d), d being the number of shingles that only one of both has.
    """
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = (100 * F.least(x, y)) >= (settings.percent * F.greatest(x, y))
    differing = F.aggregate(F.zip_with(F.col(f"{a}.odd"), F.col(f"{b}.odd"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    few = (100 + settings.percent) * differing <= (100 - settings.percent) * (x + y)
    return sizes & few & (estimate(F.col(f"{a}.bits"), F.col(f"{b}.bits"), settings) >= settings.percent / 100 - settings.margin)


def with_sets(pairs: DataFrame, docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """Adds ``sa``, ``sb``, the full sets of the nodes ``a`` and ``b``, and ``linked``; sets are built once, for these nodes only.

    Rows end up dealt by ``b``, so that the many partners of one ``a`` are spread.
    """
    side = lambda c, hub: pairs.select(F.col(c).alias("node"), F.lit(hub).alias("hub"))
    nodes = checkpoint(side("a", True).union(side("b", False)).groupBy("node").agg(F.bool_or("hub").alias("hub")))
    sets = checkpoint(node_sets(docs, nodes, settings, id_col, text_col))
    hubs = maybe_broadcast(checkpoint(sets.filter("hub").select(F.col("node").alias("a"), F.col("shingles").alias("sa")).dropDuplicates(["a"])))
    both = pairs.join(hubs, "a").join(sets.dropDuplicates(["node"]).select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("linked", 100 * common >= settings.percent * (F.size("sa") + F.size("sb") - common))


#: Up to so many links the smallest neighbours are broadcast: two nodes of two longs each a link.
FEW_LINKS = 1 << 17


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``: the smallest node that can be reached.

    Alternating large-star and small-star steps, each a group-by whose rows stay as many as the links; a hub's neighbours are
    never collected. Ends when only stars are left, which these steps always reach, in about the logarithm of the longest path.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    # The steps make no more edges than two a link, so few links are few everywhere and need few tasks.
    n = edges.count()
    least = F.broadcast if n <= FEW_LINKS else lambda rows: rows
    fewer = (lambda rows: rows.coalesce(1)) if n <= FEW_LINKS else lambda rows: rows
    edges = fewer(edges)
    while True:
        # Stars only: no smaller end is the larger end of another link, and no larger end has two smaller ones.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("larger")), F.struct(F.col("v").alias("id"), F.lit(0).alias("larger")))).alias("e"))
        ends = ends.groupBy("e.id").agg(F.sum("e.larger").alias("larger"), F.min("e.larger").alias("least"))
        if n == 0 or ends.filter("larger > 1 or larger > 0 and least = 0").isEmpty():
            break
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least(low), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least(low), "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = fewer(checkpoint(fewer(small.filter("u <> v").distinct())))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def label(rows: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the component of a node; a node without links is its own."""
    known = found.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(name, column))


def candidates(reps: DataFrame) -> DataFrame:
    """``node, w, shared, n_shingles, keys, bits, odd`` of the nodes that share a key; ``shared`` are these keys, ``w`` how many nodes they hold."""
    keyed = reps.select("node", F.explode("keys").alias("key"))
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    mine = keyed.join(many, "key").groupBy("node").agg(F.sum("n").alias("w"), F.collect_list("key").alias("shared"))  # at most one entry a band
    return mine.join(reps.select("node", "n_shingles", "keys", "bits", "odd"), "node")


def spokes_of(known: DataFrame, settings: Settings) -> DataFrame:
    """``key, a, b, e``: for each bucket its hub ``a`` and each other node ``b`` with its estimate ``e``.

    The hub is the node that meets most others: it agrees with their usual minima and is the likeliest origin of a group of copies.
    """
    entries = known.select(F.explode("shared").alias("key"), "w", "node", "bits")
    hubs = entries.groupBy("key").agg(F.max(F.struct("w", "node", "bits")).alias("h"))
    met = entries.join(hubs, "key").filter("node <> h.node")
    return met.select("key", F.col("h.node").alias("a"), F.col("node").alias("b"), estimate(F.col("bits"), F.col("h.bits"), settings).alias("e"))


def stray_items(around: DataFrame, known: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """What the nodes around hubs with a stray add to the hub (kind 1) and lack of it (kind 2), as items on which they meet.

    ``g, kind, item, b, component, n_shingles, bits, odd, keys, at, at2, asks, answers, total, most``: only nodes that ask look for
    partners, among those that answer; ``most`` is how many of a node's ``total`` items, the rarest first, are enough.
    """
    told = label(label(around, found, "b", "component"), found, "a", "_hub").withColumn("stray", F.col("component") != F.col("_hub"))
    open_hubs = maybe_broadcast(checkpoint(told.filter("stray").select("a").distinct()))
    rows = told.join(open_hubs, "a", "left_semi").join(known.select(F.col("node").alias("b"), "n_shingles", "bits", "odd"), "b").withColumns({"n_added": F.size("added"), "n_removed": F.size("removed")})
    less = F.col("n_added") < F.col("n_removed")
    # A node adds at most the share 1 - t of its set to what a linked one has; so of its added shingles that many and one more
    # hold one that both have. Its removed shingles are a linked one's too but for a few, so any of them beyond that number will
    # meet: R - ((1 - t) A + (1 + t) R) / 2 + 1.
    share = F.floor((100 - settings.percent) * F.col("n_shingles") / 100).cast("int") + 1
    t = (100 - settings.percent) / (100 + settings.percent)
    few = F.floor(F.col("n_removed") - ((1 - t) * F.col("n_added") + (1 + t) * F.col("n_removed")) / 2 + 1e-9).cast("int") + 1
    of_kind = lambda kind, items: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))
    lacks = F.when(F.col("stray") | less, F.col("removed")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(F.col("a").alias("g"), "b", "component", "n_shingles", "bits", "odd", "stray", less.alias("less"), share.alias("share"), few.alias("few"), "n_added", "n_removed", F.explode(F.concat(of_kind(1, F.col("added")), of_kind(2, lacks))).alias("_item"))
    one = F.col("_item.kind") == 1
    picked = {"asks": F.col("stray"), "answers": one | F.col("less"), "total": F.when(one, F.col("n_added")).otherwise(F.col("n_removed")), "most": F.when(one, F.col("share")).otherwise(F.col("few"))}
    nothing = {"keys": F.lit(None).cast("array<bigint>"), "at": F.lit(None).cast("int"), "at2": F.lit(None).cast("int")}
    return rows.select("g", "_item.*", "b", "component", "n_shingles", "bits", "odd", *[c.alias(n) for n, c in (nothing | picked).items()])


def away_items(spokes: DataFrame, known: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """The second keys (kind 3) of nodes away from the hub of a bucket and of those near enough to them, in the form of ``stray_items``.

    Such nodes share a bucket by a common passage or by chance, so a second one is asked for. The estimates of two plausible
    nodes against one hub differ by no more than their bits do, which tells who can be a partner there.
    """
    reach, away = 1 - (settings.percent / 100 - settings.margin) + 1e-9, F.col("e") < settings.around + 0.01
    told = label(spokes.select("key", "b", "e"), found, "b", "component")
    open_keys = told.groupBy("key").agg((F.max(F.when(away, F.col("e"))) + reach).alias("furthest"), F.min("component").alias("low"), F.max("component").alias("high")).filter("furthest is not null and low <> high")
    members = told.join(open_keys.select("key", "furthest"), "key").filter("e <= furthest").join(known.select(F.col("node").alias("b"), "n_shingles", "bits", "odd", "keys", "shared"), "b")
    band = lambda key: (F.array_position("keys", F.col(key)) - 1).cast("int")
    rows = members.select(F.struct(F.col("key").alias("id"), F.lit(0).cast("long").alias("h")).alias("g"), F.lit(3).alias("kind"), "b", "component", "n_shingles", "bits", "odd", "keys", band("key").alias("at"), away.alias("asks"), F.explode("shared").alias("item"))
    rows = rows.withColumn("at2", band("item")).filter("at <> at2")
    return rows.select("g", "kind", "item", "b", "component", "n_shingles", "bits", "odd", "keys", "at", "at2", "asks", F.lit(True).alias("answers"), F.lit(None).cast("int").alias("total"), F.lit(None).cast("int").alias("most"))


def meetings(items: DataFrame, settings: Settings) -> DataFrame:
    """``a, b, ca, cb``: pairs of plausible nodes of different components that meet on an item, each once."""
    same = ["g", "kind", "item"]
    counts = items.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.bool_or("asks").alias("any"), F.min("component").alias("low"), F.max("component").alias("high"))
    counts = maybe_broadcast(checkpoint(counts.filter("any and low <> high").select(*same, "n")))
    # Items without a partner stand first, then those that the fewest nodes have: one order for all nodes of a hub.
    each = Window.partitionBy("g", "kind", "b")
    met = items.join(counts, same).withColumns({"_alone": F.col("total") - F.count(F.lit(1)).over(each), "_rank": F.row_number().over(each.orderBy("n", "item"))})
    first = F.col("most").isNull() | (F.col("_rank") <= F.col("most") - F.col("_alone"))
    asks, answers = F.col("asks") & (first | (F.col("kind") == 2)), F.col("answers") & first
    met = checkpoint(met.withColumns({"asks": asks, "answers": answers}).filter("asks or answers").drop("total", "most", "n", "_alone", "_rank"))
    # Of two nodes with several keys in common, the first key but for the bucket's own one counts, so each pair meets once a bucket.
    before = F.expr("x.kind < 3 or size(filter(zip_with(slice(x.keys, 1, x.at2), slice(y.keys, 1, x.at2), (p, q) -> p = q), e -> e)) = int(x.at < x.at2)")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in same]
    pairs = met.filter("asks").alias("x").join(met.filter("answers").alias("y"), [*on, F.col("x.component") != F.col("y.component"), plausible("x", "y", settings), before])
    end = lambda b, c: F.struct(F.col(b).alias("node"), F.col(c).alias("component"))
    x, y = end("x.b", "x.component"), end("y.b", "y.component")
    pairs = pairs.select(F.least(x, y).alias("p"), F.greatest(x, y).alias("q")).distinct()
    return pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.component").alias("ca"), F.col("q.component").alias("cb"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept, text_hash`` for each row.

    ``component_id`` is the smallest id that links reach from the row's own set; ``kept`` tells that it is the row's id, and
    ``text_hash`` is Spark's xxhash64 of the text. Null and empty texts have no shingles and stay alone, as do rows with a null
    id, whose component is null and which are kept. Rows that repeat an id are judged each by its own text, and give a row
    each; other columns are not read; an empty table gives an empty result.
    """
    signed = checkpoint(signatures(docs, settings, id_col, text_col))
    # Copies: one node a set goes on.
    own = ["h1", "h2", "n_shingles"]
    classes = signed.filter("id is not null and h1 is not null").groupBy(*own).agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("odd").alias("odd"))
    reps = checkpoint(classes.select(*own, F.struct("id", F.col("h1").alias("h")).alias("node"), "keys", "bits", "odd"))
    known = checkpoint(candidates(reps))
    spokes = checkpoint(spokes_of(known, settings))
    # Around the hub: who is linked, and what the others add to it or lack of it.
    near = checkpoint(spokes.filter(F.col("e") >= settings.around).select("a", "b").distinct())
    around = with_sets(near, docs, settings, id_col, text_col)
    added, removed = F.array_except("sb", "sa"), F.array_except("sa", "sb")
    around = checkpoint(around.select("a", "b", "linked", added.alias("added"), F.when(~F.col("linked") | (F.size(added) < F.size(removed)), removed).alias("removed")))
    found = components(around.filter("linked").select("a", "b"))
    near_found = maybe_broadcast(checkpoint(found))
    items = stray_items(around, known, near_found, settings).unionByName(away_items(spokes, known, near_found, settings))
    rest = checkpoint(meetings(items, settings))
    # Links between what are components so far.
    more = rest.limit(0).select("ca", "cb") if rest.isEmpty() else with_sets(rest, docs, settings, id_col, text_col).filter("linked").select("ca", "cb")
    joined = maybe_broadcast(checkpoint(components(more.toDF("a", "b"))))
    classed = label(label(reps.select(*own, "node"), near_found, "node", "_near"), joined, "_near", "_last")
    out = signed.select("id", "text_hash", *own).join(classed.select(*own, F.col("_last.id").alias("component_id")), own, "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"), "text_hash")


def first_of_group(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` less those that are near-duplicates of a row of a smaller id.

    Of each group the rows of the smallest id stay; so do rows of a null id, and rows that repeat an id and its text. Columns of
    any name go with their rows; an empty table stays empty.
    """
    rows, names = numbered(docs)
    i, t = names[id_col], names[text_col]
    found = near_duplicates(rows, settings, i, t)
    gone = found.filter(~F.col("kept")).select(F.col(i).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return renamed(rows.join(gone, (rows[i].cast("long") == F.col("_id")) & (F.xxhash64(rows[t]) == F.col("_hash")), "left_anti"), names, {})

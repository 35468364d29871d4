"""One-permutation MinHash fingerprints as native expressions.

Each shingle of five words is hashed once; the top bits of the hash deal it to a bin and the smallest hash of a bin is its
minimum. An empty bin borrows from the first non-empty bin of its own random probing order (optimal densification), which is
the same for all texts. The low bits of the minima are packed; agreements that chance alone explains are corrected for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

BINS = 256
BITS = 4
WORDS = 5
#: Probes tried before an empty bin ranks all non-empty ones; only very short texts get that far.
PROBES = 12

_SHIFT = 64 - 8
_REST = (1 << _SHIFT) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def minima(frame: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the densified minima of all bins as ``array<bigint>``; null where the text has no word.

    A text of fewer than five words is one shingle.
    """
    words, dense = f"{name}_words", f"{name}_dense"
    frame = frame.withColumn(words, F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), ""))
    shingle = ", ".join(f"element_at({words}, i + {k})" for k in range(WORDS))
    shingles = F.expr(f"case when size({words}) >= {WORDS} then transform(sequence(1, size({words}) - {WORDS - 1}), i -> xxhash64({shingle})) when size({words}) > 0 then array(xxhash64({words})) end")
    # One marker a bin sorts behind whatever the bin holds, so the first value of each bin is its minimum, or tells that it is empty.
    markers = F.array(*[F.lit(_signed(b << _SHIFT | _REST)) for b in range(BINS)])
    frame = frame.withColumn(f"{name}_sorted", F.sort_array(F.concat(shingles, markers)))
    s = f"{name}_sorted"
    firsts = F.expr(f"filter({s}, (x, k) -> k = 0 or shiftright(x, {_SHIFT}) != shiftright({s}[k - 1], {_SHIFT}))")
    frame = frame.withColumn(dense, firsts)
    empty = lambda x: f"({x} & {_REST}L) = {_REST}L"
    frame = frame.withColumn(dense, F.expr(f"transform({dense}, x -> if({empty('x')}, cast(null as bigint), x))"))
    probes = ", ".join(f"{dense}[cast(pmod(xxhash64(k, {t}), {BINS}) as int)]" for t in range(PROBES))
    ranked = f"{dense}[array_min(transform(sequence(0, {BINS - 1}), j -> if({dense}[j] is null, cast(null as struct<r: bigint, j: int>), struct(xxhash64(k, j, -1) as r, j as j)))).j]"
    # Hashed once more with the bin, so that the bits of a minimum that many bins borrowed are independent.
    filled = F.when(F.col(dense).isNull(), F.lit(None).cast("array<bigint>")).otherwise(F.expr(f"transform({dense}, (x, k) -> xxhash64(coalesce(x, {probes}, {ranked}), k))"))
    return frame.withColumn(name, filled).drop(words, s, dense)


def packed(values: Column) -> Column:
    """The low bits of the minima, sixteen to a long.

    ``values`` stands twice, and so Catalyst keeps it as a column instead of copying its expression into the lambda.
    """
    each = 64 // BITS
    pack = lambda j: F.aggregate(F.slice(values, j * each + 1, each), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))))
    return F.transform(F.sequence(F.lit(0), (F.size(values) / each).cast("int") - 1), pack)


def fingerprint_text(longs: Column) -> Column:
    """Packed bits as hex digits; the empty string where there is no word."""
    return F.coalesce(F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1: agreements beyond the share that chance gives.

    Two texts without words are alike, one of them is like nothing.
    """
    low = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(folded.bitwiseAND(low))

    wrong = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (1 - wrong / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` for each row; null and empty texts have the empty fingerprint, equal texts equal ones."""
    rows = minima(docs.select(id_col, text_col), F.col(text_col), "_minima")
    return rows.select(id_col, fingerprint_text(packed(F.col("_minima"))).alias("fingerprint"))


def with_next(rows: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """Adds ``next_<column>`` from the row with the next id, the first one's after the last, without one task seeing all rows.

    Rows are dealt to ranges of ids; the first row of each range also stands, as a guest, at the end of the range before.
    The bounds of the ranges are a fixed number of quantiles. Rows of equal id stand in any order; null ids stand first.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # several ranges a task even out
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    bounds = sorted({int(x) for x in rows.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts)})
    dealt = rows.withColumn("_key", key).withColumn("_range", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col("_key"))))
    firsts = sorted((r["_range"], r["first"]) for r in dealt.groupBy("_range").agg(F.min("_key").alias("first")).collect())  # one row a range
    if not firsts:
        return dealt.select(*rows.columns, *[F.col(c).alias(f"next_{c}") for c in columns])
    host = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    guests = dealt.filter(F.col("_key").isin(list(host)))
    # Of rows that share a first id one guest is enough: the one that stands first.
    order = F.struct(*[F.col(c) for c in columns])
    guests = guests.groupBy("_key").agg(F.min(order).alias("g")).select("_key", "g.*")
    to = F.create_map(*[F.lit(x) for pair in host.items() for x in pair])
    guests = guests.withColumn("_range", to[F.col("_key")]).withColumn("_guest", F.lit(1))
    both = dealt.withColumn("_guest", F.lit(0)).unionByName(guests, allowMissingColumns=True)
    over = f"over (partition by _range order by _guest, _key, {', '.join(columns)})"
    return both.withColumns({f"next_{c}": F.expr(f"lead({c}) {over}") for c in columns}).filter("_guest = 0").select(*rows.columns, *[f"next_{c}" for c in columns])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is replaced by the beginning of the next document.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts are
    empty; rows of equal id follow one another in order of text; a single row is its own next; extra columns are not read.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = minima(rows, F.col("_text"), "_minima")
    rows = rows.select(id_col, "_text", packed(F.col("_minima")).alias("_own"))
    rows = with_next(rows, id_col, ("_text", "_own"))
    rows = rows.withColumn("n_chars", F.length("_text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    rows = rows.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next__text", F.lit(1), half)))
    rows = rows.select(id_col, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "_own", F.col("next__own").alias("_next"), "_edited")
    rows = minima(rows, F.col("_edited"), "_edited_minima").withColumn("_changed", packed(F.col("_edited_minima")))
    return rows.select(
        id_col,
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("_own")).alias("fingerprint"),
        fingerprint_text(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )

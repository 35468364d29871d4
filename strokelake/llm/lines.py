"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines within one edit have a variant in common: a line itself, or a line less one character. The edit distance is verified on
the texts, and of lines within the bound only the earliest in the corpus stays. Before variants are written, lines that share neither half
with any line of almost the same length are left out: an edit touches one half only, so this loses nothing. The others are cut into
segments; an edit touches one of them only, so only segments with all around them in common with another line's are varied, between the
hashes of what is before and behind them. A line costs a row a segment, and of a group of near copies no more than its open segments vary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, checkpoint, maybe_broadcast, numbered, renamed

#: Shorter lines are compared exactly, not by edits, unless a caller asks for it: one edit makes another word or number of them.
MIN_CHARS = 20

#: Of lines longer than the first only a part is measured; all are cut into segments of the root of their length, but of so many characters at least.
LONG, SEGMENT = 512, 12

#: A line with anything but white space.
FILLED = r"[^\x20\x09-\x0D]"


def _halves(line: Column) -> Column:
    """Hashes of both halves as they are compared with lines as long as this one and with lines one character shorter or longer.

    For a pair, both halves are cut by the length of the shorter line; so each line cuts itself by its own length and by one less.
    """
    n = F.length(line)

    def keys(length: Column) -> list[Column]:
        h = F.floor(length / 2).cast("int")
        return [F.xxhash64(length, F.lit("head"), F.substring(line, F.lit(1), h)), F.xxhash64(length, F.lit("tail"), F.substring(line, n - (length - h) + 1, length - h))]

    return F.array(*keys(n), *keys(n - 1))


def exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _text_hash, _no, _line``: the lines of each row, numbered from 0, less blank ones."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text_hash"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_no", "_line"))
    return rows.filter(F.col("_line").rlike(FILLED))


def _identity(line: Column) -> list[Column]:
    """128 bits that stand for a line: two independent hashes."""
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(7), line).alias("_h2")]


def _less(text: Column, i: Column) -> Column:
    """The text without its i-th character."""
    return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))


def shared_segments(lines: DataFrame) -> DataFrame:
    """``_place, itself, around, start, text``: the segments of lines that have all around them in common with another line's.

    A pair is cut by the length of the shorter line: segments begin at fixed places from the start, and what is behind them is
    counted from the end. So each line is cut by its own length (``itself``), as the shorter or an equal one, and by one less, as the longer.
    """

    def segments(length: Column, itself: bool) -> Column:
        size = F.greatest(F.lit(SEGMENT), F.ceil(F.sqrt(length)).cast("int"))
        starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), size)

        def cut(start: Column) -> Column:
            behind = F.greatest(length - start - size, F.lit(0))
            around = F.xxhash64(length, start, F.substring("_line", F.lit(1), start), F.substring("_line", F.length("_line") - behind + 1, behind))
            return F.struct(F.lit(itself).alias("itself"), around.alias("around"), start.alias("start"), F.substring("_line", start + 1, F.length("_line") - behind - start).alias("text"))

        return F.transform(starts, cut)

    n = F.length("_line")
    cuts = lines.select("_place", F.explode(F.concat(segments(n, True), F.filter(segments(n - 1, False), lambda _: n > 1))).alias("_s")).select("_place", "_s.*")
    return cuts.withColumn("_n", F.expr("count(*) over (partition by around)")).filter("_n > 1").drop("_n")


def segment_variants(cuts: DataFrame) -> DataFrame:
    """``_place, at, variant``: the hashes of segments as they are (``at`` 0) and less each of their characters, with what is around them."""
    at_each = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.struct((F.col("start") + i).alias("at"), F.xxhash64("around", _less(F.col("text"), i)).alias("variant")))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64("around", "text").alias("variant")))
    return cuts.select("_place", F.explode(F.concat(F.filter(whole, lambda _: F.col("itself")), at_each)).alias("v")).select("_place", "v.*")


def one_edit_apart(pairs: DataFrame) -> DataFrame:
    """Rows whose ``_line`` and ``_earlier`` are at edit distance one, in time proportional to their length but for a small factor.

    Of long lines only what stands around the first difference is measured; behind it, counted from the end, both must be equal.
    """
    a, b = F.col("_line"), F.col("_earlier")
    least = F.least(F.length(a), F.length(b))
    part = lambda x, k: F.substring(x, k * LONG + 1, F.lit(LONG))
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.floor(least / LONG).cast("int")), lambda k: part(a, k) != part(b, k)))
    cut = pairs.withColumn("_same", F.when(least > LONG, first * LONG).otherwise(0))
    behind = F.greatest(least - F.col("_same") - LONG - 2, F.lit(0))
    tail = lambda x: F.substring(x, F.length(x) - F.col("_behind") + 1, F.col("_behind"))
    head = lambda x: F.substring(x, F.col("_same") + 1, F.length(x) - F.col("_same") - F.col("_behind"))
    return cut.withColumn("_behind", F.when(least > LONG, behind).otherwise(0)).filter((tail(a) == tail(b)) & (F.levenshtein(head(a), head(b), 1) == 1)).drop("_same", "_behind")


def near_lines(lines: DataFrame) -> DataFrame:
    """``_h1, _h2`` of the lines that have an earlier one at edit distance one, from distinct lines ``_h1, _h2, _place, _line``.

    A line and the same line less one character meet where the one's variant is the other itself; two lines that differ in one
    character meet in the variant that lacks it at the same place. In each such meeting it is enough to look at the earliest
    line, so no pairs are listed: the later ones are compared with it.
    """
    keyed = segment_variants(shared_segments(lines))
    itself = F.expr("min(if(at = 0, _place, null)) over (partition by variant)")
    others = F.expr("min(if(at > 0, _place, null)) over (partition by variant)")
    same = F.expr("min(_place) over (partition by variant, at)")
    met = keyed.withColumns({"_same": same, "_itself": itself, "_others": others})
    met = met.select("_place", F.explode(F.array("_same", F.when(F.col("at") > 0, F.col("_itself")), F.when(F.col("at") == 0, F.col("_others")))).alias("_other"))
    met = met.filter(F.col("_other") < F.col("_place")).distinct()
    texts = lines.select(F.col("_place").alias("_other"), F.col("_line").alias("_earlier"))
    return one_edit_apart(met.join(lines, "_place").join(texts, "_other")).select("_h1", "_h2").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``_id, _text_hash, _dropped``: for each text, the numbers of its lines that an earlier line of the corpus equals or nearly equals.

    Earlier is by id (null first), then by hash of the text, then by line number. Any earlier line counts, dropped or not.
    """
    if edits not in (0, 1):
        raise ValueError("lines are compared within no or one edit")
    lines = exploded(docs, id_col, text_col)
    place = F.struct("_id", "_text_hash", "_no").alias("_place")
    hashed = lines.select(*_identity(F.col("_line")), place, "_line")
    # All occurrences of a line meet as hashes; a frequent line is summed up before the shuffle.
    halves = F.when(F.length("_line") >= min_chars, _halves(F.col("_line"))) if edits else F.lit(None).cast("array<bigint>")
    distinct = checkpoint(hashed.withColumn("_halves", halves).groupBy("_h1", "_h2").agg(F.min("_place").alias("_place"), F.count(F.lit(1)).alias("_n"), F.first("_halves").alias("_halves")))
    heads = distinct.withColumn("_gone", F.lit(None).cast("boolean"))
    if edits:
        halves = distinct.select("_place", F.explode(F.array_distinct("_halves")).alias("_half"))
        shared = halves.groupBy("_half").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_half")
        wanted = maybe_broadcast(checkpoint(halves.join(shared, "_half", "left_semi").select("_place").distinct()), broadcast_bytes)
        # Each of these lines becomes as many rows as it has characters, so they are spread over more tasks than their bytes ask for.
        parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        gone = near_lines(checkpoint(hashed.join(wanted, "_place", "left_semi").dropDuplicates(["_place"]).repartition(parts, "_h1", "_h2")))
        heads = distinct.join(gone.withColumn("_gone", F.lit(True)), ["_h1", "_h2"], "left")
    # Only lines that go altogether or occur again have a say; the others needn't meet their texts once more.
    heads = heads.filter("_gone or _n > 1").select("_h1", "_h2", F.col("_place").alias("_first"), "_gone")
    hit = hashed.select("_h1", "_h2", "_place").join(maybe_broadcast(checkpoint(heads), broadcast_bytes), ["_h1", "_h2"])
    hit = hit.filter(F.col("_gone").isNotNull() | (F.col("_place") != F.col("_first"))).select("_place.*")
    return hit.groupBy("_id", "_text_hash").agg(F.collect_set("_no").alias("_dropped"))


def _deduped(docs: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int, broadcast_bytes: int) -> tuple[DataFrame, dict[str, str]]:
    """The rows with their remaining text and ``_n_lines, _n_dropped``, columns numbered, and the numbers' names."""
    docs, names = numbered(docs)
    i, t = names[id_col], names[text_col]
    dropped = maybe_broadcast(checkpoint(dropped_lines(docs, i, t, edits, min_chars, broadcast_bytes)), broadcast_bytes)
    keyed = docs.withColumn("_hash", F.xxhash64(t))
    rows = keyed.join(dropped, [keyed[i].eqNullSafe(dropped["_id"]), keyed["_hash"] == dropped["_text_hash"]], "left")
    lines = F.split(F.col(t), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, k: ~F.array_contains("_dropped", k)), "\n")
    counts = {
        "_n_lines": F.when(F.col(t).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
        "_n_dropped": F.when(F.col("_dropped").isNull(), F.lit(0)).otherwise(F.size("_dropped")).cast("long"),
    }
    return rows.withColumns(counts | {t: F.when(F.col("_dropped").isNull(), F.col(t)).otherwise(kept)}), names


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` less the dropped lines, and ``n_lines`` and ``n_dropped``.

    A line that equals an earlier line of the corpus goes, whatever its length; so does one of ``min_chars`` characters or more that is
    within ``edits`` (0 or 1) of an earlier one of as many. Blank lines stay. Rows that share id and text are one document and keep
    the same lines. A null text stays null and has no lines, an empty text has one; an empty table gives an empty result.
    Columns of any name go with their rows, but that the two new ones replace those of their names.
    """
    rows, names = _deduped(docs, id_col, text_col, edits, min_chars, broadcast_bytes)
    return renamed(rows, names, {"n_lines": "_n_lines", "n_dropped": "_n_dropped"})


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The columns of ``docs`` with ``text_col`` as ``dedup_lines`` leaves it, less documents that lost lines and have none left but blank ones."""
    rows, names = _deduped(docs, id_col, text_col, edits, min_chars, broadcast_bytes)
    return renamed(rows.filter((F.col("_n_dropped") == 0) | F.col(names[text_col]).rlike(FILLED)), names, {})

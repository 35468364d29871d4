"""Enhanced metafiles that are carried inside WMF files, as fragments in escape records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokelake.functions import binary

# The escape function of comments, the identifier "WMFC" and type of a fragment, and the bytes of its head.
ESCAPE, COMMENT, WMFC, KIND, HEAD = 0x26, 15, 0x43464D57, 1, 34
#: Bytes of a fragment and of a carried file at most.
FRAGMENT_BYTES, FILE_BYTES = 8192, 64 << 20


def fragment_heads(records: DataFrame) -> DataFrame:
    """Adds ``version, checksum, count, current, remaining, total, data, fault`` to WMF records ``type, raw``; only fragments of carried files stay.

    ``fault`` is ``flags`` or ``fragment lengths``: no fragments, an empty or too long one, more to come than the total allows, or another size than the
    escape record says; null for a sound head.
    """
    raw = F.col("raw")
    u = lambda at, width=4: binary.unsigned(raw, at, width)
    mine = records.filter((F.col("type") % 256 == ESCAPE) & (u(6, 2) == COMMENT) & (u(10) == WMFC) & (u(14) == KIND))
    mine = mine.withColumns({"version": u(18), "checksum": u(22, 2), "count": u(28), "current": u(32), "remaining": u(36), "total": u(40)})
    lengths = (F.col("count") == 0) | ~F.col("current").between(1, FRAGMENT_BYTES) | (F.col("current") + F.col("remaining") > F.col("total")) | (u(8, 2) != HEAD + F.col("current")) | (F.octet_length(raw) < 44 + F.col("current"))
    return mine.withColumns({"data": F.substring(raw, F.lit(45), F.col("current").cast("int")), "fault": F.when(u(24) != 0, "flags").when(F.coalesce(lengths, F.lit(True)), "fragment lengths")})


def carried_files(records: DataFrame, keys: list[str], order: str, most: int = FILE_BYTES) -> DataFrame:
    """``keys, content, fault``: the file that each WMF file carries, put together from its fragments in order; no row for files that carry none.

    Every fragment must tell the same total and count, what remains behind it must be the total less all bytes up to it, the last one leaves
    nothing and is the last of the count, and nothing may follow. Later fragments may leave their checksum 0. The first one's is the complement
    of the exclusive or of all words of the whole content. Faults: those of ``fragment_heads``, ``carried bytes`` over ``most``, ``inconsistent
    fragments``, ``checksum of a fragment``, ``remaining bytes``, ``fragment count``, ``second file``, ``incomplete file``, ``checksum``; content is null with any.
    """
    part = F.struct(F.col(order).alias("_at"), "checksum", "count", "remaining", "total", "data", "fault")
    files = fragment_heads(records).groupBy(F.struct(*keys).alias("_key")).agg(F.sort_array(F.collect_list(part)).alias("_p"))  # a file is bounded by its limits
    first = F.get("_p", F.lit(0))

    def step(s, p):
        bytes_ = s["bytes"] + F.octet_length(p["data"])
        fault = (
            F.when(p["fault"].isNotNull(), p["fault"])
            .when(s["done"], "second file")
            .when(p["total"] > most, "carried bytes")
            .when((p["total"] != first["total"]) | (p["count"] != first["count"]) | (s["seen"] >= p["count"]), "inconsistent fragments")
            .when((s["seen"] > 0) & (p["checksum"] != 0) & (p["checksum"] != first["checksum"]), "checksum of a fragment")
            .when((bytes_ > p["total"]) | (p["remaining"] != p["total"] - bytes_), "remaining bytes")
            .when((p["remaining"] == 0) & (s["seen"] + 1 != p["count"]), "fragment count")
        )
        return F.struct((s["seen"] + 1).alias("seen"), bytes_.cast("bigint").alias("bytes"), (p["remaining"] == 0).alias("done"), F.coalesce(s["fault"], fault).alias("fault"))

    start = F.struct(F.lit(0).alias("seen"), F.lit(0).cast("bigint").alias("bytes"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("fault"))
    files = files.withColumns({"_s": F.aggregate("_p", start, step), "_content": binary.joined(F.col("_p.data")), "_sum": first["checksum"]})
    # An odd byte at the end counts as a word of its own.
    even = F.when(F.octet_length("_content") % 2 == 1, F.concat("_content", F.lit(b"\0"))).otherwise(F.col("_content"))
    wrong = F.coalesce(F.col("_s.fault"), F.when(~F.col("_s.done"), "incomplete file"), F.when(F.lit(0xFFFF).cast("bigint").bitwiseXOR(binary.xor_words(even)) != F.col("_sum"), "checksum"))
    files = files.withColumn("fault", wrong)
    return files.select("_key.*", F.when(F.col("fault").isNull(), F.col("_content")).alias("content"), "fault")

"""A query over files inside files: a document is an EMF comment, its EMF file is carried by a WMF file, and both are walked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import binary
from strokelake.functions.shared import checkpoint
from strokelake.operators import nested
from strokelake.sources import metafiles

from .registry import query, table


@query("""with d as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) as n, case when doc_id % 23 = 3 then 'checksum' when doc_id % 29 = 4 then 'remaining bytes' when doc_id % 31 = 5 then 'flags' end as fault from documents)
 select doc_id, fault, case when fault is null then cast(3 as bigint) end as n_records, case when fault is null then cast(120 + (n + 3) // 4 * 4 as bigint) end as n_bytes, case when fault is null then sha256(text) end as text_sha256 from d""")
def carried_metafiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as EMF files carried in fragments of 4000 bytes, some with a wrong checksum, length or flags; taken out and walked again."""
    word = lambda v, width=4: binary.little(v if not isinstance(v, int) else F.lit(v), width)
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t"))
    size = F.octet_length("t")
    filled = F.rpad("t", (F.ceil(size / 4) * 4).cast("int"), F.lit(b"\0"))
    inner = metafiles.build_emf(d.select("doc_id", F.lit(0).alias("at"), F.concat(word(70), word(F.octet_length(filled) + 12), word(size), filled).alias("record")), ["doc_id"], ["at"])
    k, total = F.col("doc_id"), F.octet_length("content")
    inner = inner.withColumn("sum", F.lit(0xFFFF).cast("bigint").bitwiseXOR(binary.xor_words(F.col("content"))))
    # Only the parts of a file go with its rows, not the file.
    cut = F.transform(F.sequence(F.lit(0), total - 1, F.lit(4000)), lambda s: F.substring("content", s + 1, F.lit(4000)))
    parts = inner.select("doc_id", "sum", total.alias("total"), F.posexplode(cut).alias("at", "part")).withColumn("start", F.col("at") * 4000)
    total = F.col("total")
    current = F.octet_length("part")
    remaining = total - F.col("start") - current
    checksum = F.when(k % 23 == 3, F.col("sum").bitwiseXOR(F.lit(1).cast("bigint"))).when(F.col("start") == 0, F.col("sum")).otherwise(0)
    head = F.concat(word(nested.WMFC), word(1), word(0x10000), word(F.when((k % 23 == 3) & (F.col("start") > 0), 0).otherwise(checksum), 2), word(F.when((k % 31 == 5) & (k % 23 != 3) & (k % 29 != 4), 1).otherwise(0)))
    left = F.when((k % 29 == 4) & (k % 23 != 3) & (remaining == 0), 0).otherwise(remaining)
    stated = total + F.when((k % 29 == 4) & (k % 23 != 3), 2).otherwise(0)
    body = F.concat(word(nested.COMMENT, 2), word(34 + current, 2), head, word(F.ceil(total / 4000)), word(current), word(left), word(stated), F.col("part"))
    even = F.rpad(body, (F.ceil(F.octet_length(body) / 2) * 2).cast("int"), F.lit(b"\0"))
    rows = parts.select("doc_id", "start", even.alias("even")).select("doc_id", "start", F.concat(word(3 + F.octet_length("even") / 2), word(0x0626, 2), F.col("even")).alias("record"))
    outer = metafiles.records(metafiles.build_wmf(rows, ["doc_id"], ["start"]), "doc_id")
    found = checkpoint(nested.carried_files(outer, ["file"], "seq"))
    walked = metafiles.records(found.filter("fault is null"), "file")
    text = F.max(F.when(F.col("type") == 70, F.sha2(F.substring("raw", F.lit(13), binary.unsigned(F.col("raw"), 8, 4).cast("int")), 256)))
    seen = walked.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.octet_length("raw")).alias("n_bytes"), text.alias("text_sha256"))
    return found.select("file", "fault").join(seen, "file", "left").select(F.col("file").cast("long").alias("doc_id"), "fault", "n_records", "n_bytes", "text_sha256")

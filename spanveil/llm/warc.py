"""WARC archives: a writer, and a reader that verifies the chain of record boundaries.

Writing: one record a row through Spark's text sink with the record terminator CRLF CRLF
as line separator, so archives get Spark's commit protocol on any file system it can
write. Records with equal payloads of at least ``least`` bytes: the one with the largest
id is the response, others are revisit records that name it and repeat its digest and
length in their headers.

Reading: the files are read in splits, cut at each occurrence of the magic line, which
gives every candidate record, also those inside payloads. Each candidate names its
successor: own offset + header + Content-Length + terminator. What lies between magics is
written once with its split and order, so all later steps number it alike, whatever the
splits of another scan would be. Within a split a run of
candidates, each the successor of the one before, is contracted to one edge from where
the chain enters it to where it leaves; pointer jumping over these edges from offset 0
of each file doubles its reach each round. Candidates that are not reached are parts of
a payload: they are rejected, and payloads that hold them are put together again.

Defined results: a null payload is empty; a null url an empty Target-URI; CR and LF in a
url become %0D and %0A; repeated rows give repeated records; a file that does not start
with the magic has no records; a chain that ends in a broken header ends there; rows
with a null id are written with an empty id and read back as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanveil.llm.scratch import discard, keep

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    payload = F.coalesce(F.col(payload_col), F.lit("" if pages.schema[payload_col].dataType.typeName() == "string" else b"")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("n", F.octet_length("payload"))
    same = F.when(F.col("n") >= least, F.sha2("payload", 256))
    groups = keep(rows.select("id", same.alias("same")).where("same is not null").groupBy("same").agg(F.max("id").alias("first_id"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "warc-groups")
    full = rows.withColumn("same", same).join(groups, "same", "left")
    revisit = F.coalesce(F.col("id") != F.col("first_id"), F.col("first_id").isNotNull())
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.sha1("payload")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Payload-Length: "), F.col("n"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
    )
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    full.select(F.concat(head, F.lit(END), block).alias("value")).write.option("lineSep", END).text(path)


def header(headers: Column, name: str) -> Column:
    """The value of a header field, null where it is absent."""
    found = F.regexp_extract(headers, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(F.regexp_like(headers, F.lit(rf"(?im)^{name}:")), found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics, in file order: file, block, id (order within a block), value."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def candidates(pieces: DataFrame) -> DataFrame:
    """file, block, id, pos (offset of the magic; null before the first one), succ, n (bytes), need (bytes of header and content)."""
    heads = F.substring_index("value", END, 1)
    sized = pieces.select("file", "block", "id", F.octet_length("value").cast("long").alias("n"), F.octet_length(heads).cast("long").alias("h"), header(heads, "Content-Length").try_cast("long").alias("len"))
    sized = sized.withColumn("end", F.when(F.col("n") >= F.col("h") + len(END), F.col("h") + len(END) + F.col("len")))
    inside = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("n") + len(MAGIC)
    rows = sized.withColumn("before", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    blocks = sized.groupBy("file", "block").agg(F.sum(step).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(F.col("file"), F.col("block"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    at = F.col("base") + F.col("before")
    pos = F.when(at > 0, at - len(MAGIC))
    return rows.join(base, ["file", "block"]).select("file", "block", "id", pos.alias("pos"), (pos + len(MAGIC) + F.col("end") + len(END)).alias("succ"), "n", F.col("end").alias("need"))


def verified(nodes: DataFrame) -> DataFrame:
    """(file, run, entry): of each run of candidates that the chain from offset 0 enters, where it does."""
    order = Window.partitionBy("file", "block").orderBy("pos")
    runs = nodes.withColumn("breaks", F.coalesce((F.lag("succ").over(order) != F.col("pos")).cast("int"), F.lit(1))).withColumn("run", F.sum("breaks").over(order))
    exits = runs.groupBy("file", "block", "run").agg(F.max_by("succ", "pos").alias("out"))
    members = runs.select("file", "block", "run", "pos")
    entered = exits.select("file", F.col("out").alias("pos")).where("pos is not null").unionByName(members.where("pos = 0").select("file", "pos")).distinct()
    edges = keep(members.join(entered, ["file", "pos"]).join(exits, ["file", "block", "run"]).select("file", "pos", "out", "block", "run"), "warc-edges")
    jump, reach = edges.select("file", "pos", "out"), edges.where("pos = 0").select("file", "pos")
    seen, old = -1, []
    while (now := reach.count()) != seen:
        seen = now
        onward = reach.join(jump, ["file", "pos"]).select("file", F.col("out").alias("pos")).join(edges.select("file", "pos"), ["file", "pos"])
        reach = keep(reach.unionByName(onward).distinct(), "warc-reach")
        jump = keep(jump.join(jump.select("file", F.col("pos").alias("out"), F.col("out").alias("far")), ["file", "out"]).select("file", "pos", F.col("far").alias("out")), "warc-jump")
        discard(*old)
        old = [reach, jump]
    out = keep(edges.join(reach, ["file", "pos"]).select("file", "block", "run", F.col("pos").alias("entry")), "warc-entered")
    discard(edges, *old)
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a verified record: file, pos, headers, payload (binary)."""
    pieces = keep(_pieces(spark, path), "warc-pieces", "zstd")
    every = keep(candidates(pieces), "warc-candidates")
    nodes = every.where("pos is not null")
    order = Window.partitionBy("file", "block").orderBy("pos")
    runs = nodes.withColumn("breaks", F.coalesce((F.lag("succ").over(order) != F.col("pos")).cast("int"), F.lit(1))).withColumn("run", F.sum("breaks").over(order))
    good = verified(nodes)
    judged = runs.join(good, ["file", "block", "run"], "left").withColumn("ok", F.coalesce((F.col("pos") >= F.col("entry")) & F.col("succ").isNotNull(), F.lit(False)))
    # files with a rejected candidate are few; there, each piece goes to the record before it, in its split or an earlier one
    odd = keep(judged.where("not ok").select("file").distinct(), "warc-odd")
    record = F.when(F.col("ok"), F.struct(F.col("pos").alias("owner"), F.col("need").alias("until")))
    mixed = judged.join(odd, "file", "left_semi").withColumn("record", record)
    lasts = mixed.groupBy("file", "block").agg(F.max("record").alias("record"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("file", "block", F.last("record", ignorenulls=True).over(earlier).alias("carried"))
    owned = mixed.withColumn("record", F.last("record", ignorenulls=True).over(order)).join(carried, ["file", "block"])
    owned = owned.withColumn("record", F.coalesce("record", "carried")).withColumns({"owner": F.col("record.owner"), "until": F.col("record.until")})
    part = F.col("owner").isNull() | ~F.col("ok") | (F.col("n") < F.col("need"))
    parts = keep(owned.where(part).select("file", "id", "owner", "until", "pos"), "warc-parts")
    raw = pieces.withColumn("bytes", F.col("value").cast("binary"))
    heads = F.substring_index("value", END, 1)
    skip = keep(parts.select("file", "id").unionByName(every.where("pos is null").select("file", "id")), "warc-skip")
    discard(every, odd, good)
    start = F.octet_length(heads) + len(END)
    size = header(heads, "Content-Length").cast("int")
    ends = F.octet_length("value") >= F.octet_length(heads) + len(END)
    whole = raw.join(skip, ["file", "id"], "left_anti").where(ends).select("file", heads.alias("headers"), F.substring(F.col("bytes"), start + 1, size).alias("payload"))
    glued = raw.join(parts.where("owner is not null"), ["file", "id"]).groupBy("file", "owner", "until").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("ps"))
    joined = glued.select("file", F.aggregate(F.slice("ps", 2, F.size("ps")), F.element_at("ps", 1)["bytes"], lambda a, x: F.concat(a, F.lit(MAGIC.encode()), x["bytes"])).alias("bytes"), "until")
    joined = joined.withColumn("headers", F.substring_index(F.col("bytes").cast("string"), END, 1)).select(
        "file", "headers", F.substring(F.col("bytes"), F.octet_length("headers") + len(END) + 1, header(F.col("headers"), "Content-Length").cast("int")).alias("payload")
    )
    return whole.unionByName(joined)

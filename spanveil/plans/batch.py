"""Folder batches: inventory, windows, parts, ledger and resume."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.config import EngineConfig
from spanveil.functions.text import cut, let
from spanveil.operators.spans import union_windows
from spanveil.plans.pipeline import detect, redact

# Suffixes that a batch reads.
SUFFIXES = ("txt", "pdf", "docx", "png", "jpg", "jpeg", "webp", "tif", "tiff")
#: Media types a request may have.
MEDIA = ("image/png", "image/jpeg", "image/webp", "application/pdf")


def inventory(files: DataFrame) -> DataFrame:
    """Files (relpath, content): id from the path, digest of the content, and whether the suffix is read; none is left out."""
    suffix = F.lower(F.regexp_extract("relpath", r"\.([^./]*)$", 1))
    return files.select(
        F.substring(F.sha2("relpath", 256), 1, 24).alias("doc_key"), "relpath", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"),
        F.when(suffix.isin(*SUFFIXES), "pending").otherwise("unsupported").alias("status"),
    )


def admission(media: Column, size: Column, pages: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Why a document is refused, or null."""
    return F.when(~media.isin(*MEDIA), "unsupported_media").when(size == 0, "empty").when(size > config.max_bytes, "too_large").when(pages == 0, "no_pages").when(pages > config.max_pages, "too_many_pages")


def windows(texts: DataFrame, text: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Overlapping windows of each text: window_start and chunk; each stride begins one, with a halo before and after."""
    n = F.length(text)
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(config.window_stride))).otherwise(F.array().cast("array<int>")))
    low = F.greatest(F.lit(0), F.col("_at") - config.window_halo)
    cut_at = F.least(n, F.col("_at") + config.window_stride + config.window_halo)
    return texts.withColumn("_at", at).withColumn("window_start", low).withColumn("chunk", cut(F.col(text), low, cut_at)).drop("_at", text)


def redact_long(texts: DataFrame, key: str, text: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Texts of any length by windows: key, n_spans, redacted. Spans belong to a text: rows that share a key or have none get their own."""
    base = texts.select(key, text, F.sha2(F.encode(F.col(text), "UTF-8"), 256).alias("_of"))
    by = [key, "_of"]
    found = detect(windows(base, text, config), "chunk", config=config)
    flat = found.select(*by, "window_start", F.explode("spans").alias("s")).select(*by, (F.col("s.start") + F.col("window_start")).alias("start"), (F.col("s.end") + F.col("window_start")).alias("end"), "s.label")
    merged = union_windows(flat.distinct(), by)
    spans = merged.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    spans = spans.withColumnsRenamed({key: "_key", "_of": "_text"})
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    out = base.join(spans, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_of") == F.col("_text")), "left").withColumn("spans", F.coalesce("spans", none))
    return out.select(key, F.size("spans").alias("n_spans"), redact(F.col(text), F.col("spans")).alias("redacted"))


def parts(text: Column, limit: int) -> Column:
    """The text in parts of at most limit characters, cut after the last line break before the limit unless that is below half of it."""

    def step(acc: Column, _: Column) -> Column:
        def one(head: Column) -> Column:
            back = F.position(F.lit("\n"), F.reverse(head))
            more = F.length(text) - acc["at"] > limit
            # without a line break the cut stands at the start, below half of the limit
            found = F.when(back > 0, F.length(head) - back + 1).otherwise(F.lit(0))
            size = F.when(~more, F.length(head)).when(F.greatest(F.lit(0), found - 1) < limit // 2, F.lit(limit)).otherwise(found)
            return F.struct((acc["at"] + size).cast("int").alias("at"), F.concat(acc["out"], F.array(F.substring(head, F.lit(1), size))).alias("out"))

        return F.when(acc["at"] < F.length(text), let(F.substring(text, acc["at"] + 1, F.lit(limit)), one)).otherwise(acc)

    rounds = F.sequence(F.lit(1), F.ceil(2 * F.length(text) / limit).cast("int") + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(rounds, start, step, lambda acc: acc["out"])


def numbered_parts(texts: DataFrame, key: str, limit: int = EngineConfig.part_chars, text: str = "text") -> DataFrame:
    """key, part (from 1), name, part_text, sha256, chars of the parts of each text."""
    cut_up = texts.select(key, F.posexplode(parts(F.coalesce(F.col(text), F.lit("")), limit)).alias("_part", "part_text"))
    number = F.col("_part") + 1
    name = F.concat(F.lit("parte-"), F.lpad(number.cast("string"), 4, "0"), F.lit(".txt"))
    return cut_up.select(key, number.alias("part"), F.when(number > 9999, F.concat(F.lit("parte-"), number.cast("string"), F.lit(".txt"))).otherwise(name).alias("name"), "part_text", F.sha2("part_text", 256).alias("sha256"), F.length("part_text").alias("chars"))


def signature(config: EngineConfig, rules: str, inventory_hash: str) -> str:
    """What a resumed batch must share with the ledger; another value is refused."""
    import hashlib

    return hashlib.sha256(json.dumps([vars(config), rules, inventory_hash], sort_keys=True).encode()).hexdigest()


def pending(units: DataFrame, ledger: DataFrame, sign: str) -> DataFrame:
    """Units (doc_key, unit, sha256) that the ledger does not have done with the same content; a ledger of another signature is an error."""
    if ledger.where(F.col("signature") != sign).limit(1).count():
        raise ValueError("the ledger belongs to another configuration")
    return units.join(ledger.where("status = 'done'").select("doc_key", "unit", "sha256"), ["doc_key", "unit", "sha256"], "left_anti")


def join_pages(pages: DataFrame, key: str) -> DataFrame:
    """One text a document: a single page bare, several with a header each."""
    one = F.array_sort(F.collect_list(F.struct("page_index", "redacted")))
    headed = F.transform(F.col("ps"), lambda p: F.concat(F.lit("--- página "), (p["page_index"] + 1).cast("string"), F.lit(" ---\n"), p["redacted"]))
    return pages.groupBy(key).agg(one.alias("ps")).select(key, F.when(F.size("ps") == 1, F.element_at("ps", 1)["redacted"]).otherwise(F.array_join(headed, "\n\n")).alias("text"))


def neutral_name(template: Column, base: Column, date: Column, ident: Column, ext: Column, default: str = "{base}_{date}_{id}.{ext}") -> Column:
    """A file name from a template; a blank one is the default."""
    name = F.when(F.trim(F.coalesce(template, F.lit(""))) == "", F.lit(default)).otherwise(template)
    for field, value in (("{base}", base), ("{date}", date), ("{id}", ident), ("{ext}", ext)):
        name = F.replace(name, F.lit(field), value)
    return name


def totals(units: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Units, characters, substitutions and the exit state of a batch, or of each of several."""
    state = F.when(F.max((F.col("status") != "done").cast("int")) == 1, "pending").otherwise("review")
    return units.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.sum("chars").alias("chars"), F.sum("n_spans").alias("substitutions"), state.alias("state"))

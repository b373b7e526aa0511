"""Reading and writing archives: trees of exported conversations, inventories, payloads, media files and rendered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.functions import text as T

BLOCK = "struct<language:string,code:string>"
VARIANT = f"struct<kind:string,texte:string,code_blocks:array<{BLOCK}>,model:string,timestamp:string,message_id:string,active:boolean>"
#: A message as it is written, with the names that older archives use.
MESSAGE = f"struct<message_id:string,role:string,model:string,timestamp:variant,texte:string,content:string,code_blocks:array<{BLOCK}>,reasoning:string,artifacts:array<string>,sources:array<string>,tools:array<string>,variants:array<{VARIANT}>,metadata:struct<model:string>>"
CONVERSATION = f"platform string, service string, conversation_id string, title string, url string, model string, started_at string, last_message_at string, exported_at string, messages array<{MESSAGE}>"
INVENTORY = "platform string, conversations array<struct<conversation_id:string,title:string,url:string,message_count:long,last_message_at:string,has_code:boolean,scraped:boolean,file:string,unavailable:boolean>>"
#: Files of an export that are no conversation, and the largest file that is read. Fixed values.
RESERVED = ("conversation_list.json", "api_health.json", "recheck.json")
MAX_BYTES = 64 * 1024 * 1024


def read_conversations(spark: SparkSession, root: str, platforms: list[str] | None = None, strict: bool = False, max_bytes: int = MAX_BYTES, lines: bool = False) -> DataFrame:
    """Conversations of an export tree root/platform/file.json. Broken files are left out, or fail if strict; reserved names and files beyond the bound are left out. lines: a file holds a conversation a line, as large archives do; a broken line is left out, and files have no bound, as they are read in parts."""
    rows = spark.read.schema(CONVERSATION + ("" if strict else ", _corrupt_record string")).option("multiLine", not lines).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("pathGlobFilter", "*.json").json(f"{root}/*/")
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    rows = rows.withColumn("name", F.element_at(F.split("file", "/"), -1)).withColumn("folder", F.element_at(F.split("file", "/"), -2))
    rows = rows.where(~F.col("name").isin(*RESERVED) & (F.lit(lines) | (F.col("size") <= max_bytes)) & F.col("messages").isNotNull())
    if platforms:
        rows = rows.where(F.col("folder").isin(*platforms))
    return rows.withColumn("platform", F.coalesce("platform", "service", F.regexp_replace("folder", "^platform=", ""))).drop("service", "size", "folder", *([] if strict else ["_corrupt_record"]))


def messages(conversations: DataFrame) -> DataFrame:
    """A row for each message; nulls become empty where the schema has no null, and code blocks come from the text where none are given."""
    m = conversations.select("platform", "conversation_id", F.posexplode("messages").alias("pos", "m"))
    text = F.coalesce(F.col("m.texte"), F.col("m.content"), F.lit(""))
    full = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return m.select(
        "platform", "conversation_id", "pos", F.coalesce(F.col("m.message_id"), F.lit("")).alias("message_id"), F.col("m.role").alias("role"), F.coalesce(F.col("m.model"), F.col("m.metadata.model")).alias("model"), T.any_time(F.col("m.timestamp")).alias("ts"), text.alias("texte"),
        F.when(F.coalesce(F.size("m.code_blocks"), F.lit(0)) > 0, F.col("m.code_blocks")).otherwise(T.code_blocks(text)).alias("code_blocks"), F.coalesce(F.col("m.reasoning"), F.lit("")).alias("reasoning"), *(full(F.col(f"m.{c}")).alias(c) for c in ("artifacts", "sources", "tools")), "m.variants",
    )


def violations(conversations: DataFrame) -> DataFrame:
    """What is wrong with each conversation, as an array of names."""
    bad = {
        "platform": F.coalesce("platform", F.lit("")) == "", "conversation_id": F.coalesce("conversation_id", F.lit("")) == "", "title": F.coalesce("title", F.lit("")) == "", "messages": F.coalesce(F.size("messages"), F.lit(0)) == 0,
        "role": F.exists("messages", lambda m: ~F.coalesce(m["role"].isin("user", "assistant", "system"), F.lit(False))), "started_at": F.col("started_at").isNotNull() & T.parse_iso(F.col("started_at")).isNull(),
    }
    return conversations.withColumn("violations", F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in bad.items()))))


def read_inventories(spark: SparkSession, root: str) -> DataFrame:
    """Entries of all inventories; of entries with one id the last wins, and those without an id are left out."""
    rows = spark.read.schema(INVENTORY).option("multiLine", True).json(f"{root}/*/conversation_list.json")
    rows = rows.select(F.coalesce("platform", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).alias("platform"), F.posexplode("conversations").alias("at", "e")).select("platform", "at", "e.*").where("conversation_id <> ''")
    last = F.row_number().over(Window.partitionBy("platform", "conversation_id").orderBy(F.col("at").desc()))
    return rows.withColumn("k", last).where("k = 1").drop("k", "at")


def write_inventories(inventory: DataFrame, path: str) -> None:
    """An envelope for each platform: newest conversations first, with their count."""
    entry = F.struct(F.coalesce("last_message_at", F.lit("")).alias("last_message_at"), F.coalesce("title", F.lit("")).alias("title"), "conversation_id", "url", "message_count", "scraped")
    rows = inventory.groupBy("platform").agg(F.sort_array(F.collect_list(entry), asc=False).alias("conversations"))
    rows.select("platform", F.size("conversations").alias("count"), "conversations").write.mode("overwrite").partitionBy("platform").json(path)


def read_payloads(spark: SparkSession, root: str) -> DataFrame:
    """Raw payloads root/platform/raw/name.json as text, those that are JSON."""
    rows = spark.read.option("wholetext", True).text(f"{root}/*/raw/*.json").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("platform"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("conversation_id"), F.col("value").alias("payload"))
    return rows.where(F.call_function("try_parse_json", F.col("payload")).isNotNull())


def read_media(spark: SparkSession, root: str) -> DataFrame:
    """Media files of an export: images under images, audio and video under files, with a key of their content (size, first and last 256 KiB)."""
    files = spark.read.format("binaryFile").load(f"{root}/*/{{images,files}}/*").withColumn("folder", F.element_at(F.split("path", "/"), -2)).withColumn("kind", T.media_kind(F.col("path")))
    files = files.where(((F.col("folder") == "images") & (F.col("kind") == "image")) | ((F.col("folder") == "files") & F.col("kind").isin("audio", "video")))
    part = 256 * 1024
    head, tail = F.substring("content", 1, part), F.when(F.col("length") > 2 * part, F.expr(f"substring(content, length(content) - {part - 1}, {part})")).otherwise(F.expr("X''"))
    return files.select("path", "folder", "kind", "length", F.concat_ws(":", F.col("length").cast("string"), F.md5(F.concat(head, tail))).alias("content_key"))


def media_references(rows: DataFrame) -> DataFrame:
    """(folder, name) of media that messages link to, with the first message that does."""
    link = r"\]\((images|files)/([^)\s]+)\)"
    both = F.arrays_zip(F.regexp_extract_all("texte", F.lit(link), F.lit(1)).alias("folder"), F.regexp_extract_all("texte", F.lit(link), F.lit(2)).alias("name"))
    found = rows.select("platform", "conversation_id", "message_id", "pos", F.explode(both).alias("x")).select("*", "x.*").drop("x")
    return found.groupBy("platform", "folder", "name").agg(F.min_by(F.struct("conversation_id", "message_id"), F.struct("conversation_id", "pos")).alias("reference")).select("platform", "folder", "name", "reference.*")


def _escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _in_order(rows: DataFrame, said) -> DataFrame:
    return rows.groupBy("platform", "conversation_id").agg(F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))).alias("parts"))


def render_markdown(rows: DataFrame) -> DataFrame:
    """A conversation as one Markdown text."""
    said = F.concat(F.lit("## "), F.col("role"), F.coalesce(F.concat(F.lit(" ("), F.col("model"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" — "), T.iso_z(F.col("ts"))), F.lit("")), F.lit("\n\n"), F.coalesce("texte", F.lit("")), F.lit("\n"))
    return _in_order(rows, said).select("platform", "conversation_id", F.concat(F.lit("# "), F.col("conversation_id"), F.lit("\n\n- Messages : "), F.size("parts").cast("string"), F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["said"]), "\n")).alias("markdown"))


def render_html(rows: DataFrame) -> DataFrame:
    """A conversation as one page."""
    said = F.concat(F.lit('<div class="msg '), _escape(F.col("role")), F.lit('"><pre class="texte">'), _escape(F.coalesce("texte", F.lit(""))), F.lit("</pre></div>"))
    return _in_order(rows, said).select("platform", "conversation_id", F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), _escape(F.col("conversation_id")), F.lit("</title></head><body>\n"), F.array_join(F.transform("parts", lambda p: p["said"]), "\n"), F.lit("\n</body></html>\n")).alias("html"))


def write_table(rows: DataFrame, path: str) -> None:
    """Rows as Parquet by platform; only the platforms that rows has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("platform").parquet(path)

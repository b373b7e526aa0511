"""Media of an archive: their references, the incremental index of their vectors, and search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.operators import archive, search


def referenced(media: DataFrame, references: DataFrame) -> DataFrame:
    """Media (platform, folder, name, and more) with the conversation_id and message_id that link to them, empty where none does."""
    at = references.select("platform", "folder", "name", "conversation_id", "message_id")
    rows = media.drop("conversation_id", "message_id").join(at, ["platform", "folder", "name"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("conversation_id", "message_id")})


def nearest(media: DataFrame, vectors: DataFrame, vector: list[float], k: int, kind: str | None = None) -> DataFrame:
    """The k media nearest to a vector, of one kind if it is given (filtered before), with their score, the cosine."""
    rows = media if kind is None else media.where(F.col("kind") == kind)
    return search.nearest(vectors.select("media_id", "embedding").join(rows, "media_id"), vector, k, "media_id").withColumn("score", 1 - F.col("distance")).drop("distance", "embedding")


def for_query(media: DataFrame, vectors: DataFrame, vector: list[float], k: int, known: list[str], platforms: list[str] | None = None) -> DataFrame:
    """Media for a query, in this order: more of the nearest than asked for, only those of known and of wanted platforms, each content once, the k best. Content that can't be read is kept apart."""
    rows = nearest(media, vectors, vector, min(max(6 * k, 64), 192))
    rows = rows.where(F.col("platform").isin(*known))
    rows = rows.where(F.col("platform").isin(*platforms)) if platforms else rows
    order = [F.col("score").desc(), F.col("media_id")]
    ranked = rows.withColumn("__rank", F.struct((-F.col("score")).alias("a"), F.col("media_id").alias("b")))
    return archive.media_dedupe(ranked, "content_key", "__rank").drop("__rank").orderBy(*order).limit(k).withColumn("score", F.round("score", 4))


def index_step(files: DataFrame, index: DataFrame, encode: Callable[[DataFrame], DataFrame], model: str) -> tuple[DataFrame, DataFrame]:
    """(index, counts by kind) after new files (media_id, kind, size, mtime, and what the index has besides fingerprint and embedding).

    A file of an unchanged fingerprint is skipped. encode adds embedding to the others; where it gives null the file has failed, and what the index had of it stays.
    counts: kind, scanned, skipped, indexed, failed.
    """
    told = files.withColumn("fingerprint", T.fingerprint(model, F.col("media_id"), F.col("size").cast("string"), F.col("mtime").cast("string")))
    known = index.select("media_id", "fingerprint").withColumn("__known", F.lit(True))
    told = told.join(known, ["media_id", "fingerprint"], "left")
    fresh = encode(told.where("__known IS NULL").drop("__known"))
    made = fresh.where("embedding IS NOT NULL").select(*index.columns)
    scanned = told.groupBy("kind").agg(F.count(F.lit(1)).alias("scanned"), F.count("__known").alias("skipped"))
    done = fresh.groupBy("kind").agg(F.count("embedding").alias("indexed"), F.count_if(F.col("embedding").isNull()).alias("failed"))
    counts = scanned.join(done, "kind", "left").na.fill(0)
    return index.join(made.select("media_id"), "media_id", "left_anti").unionByName(made), counts


def backfill_fingerprints(index: DataFrame, model: str, text_col: str = "texte") -> DataFrame:
    """An index of messages with the fingerprints that it lacks."""
    return index.withColumn("fingerprint", F.coalesce(F.nullif("fingerprint", F.lit("")), T.fingerprint(model, F.col(text_col))))


def delete(index: DataFrame, media_ids: DataFrame) -> DataFrame:
    """An index of media without some of them."""
    return index.join(media_ids.select("media_id"), "media_id", "left_anti")


#: Columns of a cache of fetched addresses. name is the local one; null if what came was no file.
CACHE = "address_key string, url string, folder string, name string, kind string"


def addresses(messages: DataFrame) -> DataFrame:
    """The distinct addresses of images and attached files in texts: address_key (SHA-1 of the address), url, folder (images, files)."""
    shown = messages.select(F.explode(T.image_urls(F.col("texte"))).alias("url"), F.lit("images").alias("folder"))
    links = messages.select(F.explode(T.media_urls(F.col("texte"))).alias("x")).where("x.context = 'md-link'").select("x.url", F.lit("files").alias("folder"))
    rows = shown.unionByName(links.where(T.is_attachment(F.col("url"), F.col("url")))).where(F.col("url").rlike("^https?://"))
    return rows.groupBy("url").agg(F.max("folder").alias("folder")).select(F.sha1("url").alias("address_key"), "url", "folder")  # an image that is linked too is an image


def refresh_cache(wanted: DataFrame, cache: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows of the cache, counts of cached, new and failed) of addresses, with what was fetched for them (url, content_type, content); nothing is fetched here. An address that is cached takes no row, what is no file of its folder's kind fails, and of several
    contents of one address the smallest by hash counts."""
    known = cache.where("name IS NOT NULL").select("address_key").distinct().withColumn("known", F.lit(True))
    got = fetched.groupBy("url").agg(F.min_by(F.struct("content_type", "content"), F.coalesce(F.sha1("content"), F.lit("~"))).alias("x")).select("url", "x.*")
    rows = wanted.join(known, "address_key", "left").join(got, "url", "left")
    kind = F.trim(F.lower(F.element_at(F.split(F.coalesce("content_type", F.lit("")), ";"), 1)))
    head = F.lower(F.ltrim(F.decode(F.substring("content", 1, 256), "ISO-8859-1")))
    page = kind.isin("text/html", "application/xhtml+xml") | head.startswith("<!doctype html") | head.startswith("<html")
    usable = F.coalesce(F.length("content"), F.lit(0)) > 0
    usable = usable & F.when(F.col("folder") == "images", T.looks_like_image(F.col("content"), F.col("content_type"))).otherwise(~page)
    path = F.regexp_extract(F.lower(F.regexp_replace("url", r"[?#].*$", "")), r"(\.[a-z0-9]{1,5})$", 1)
    said = F.regexp_extract(kind, r"^(?:image|audio|video|text|application)/([a-z0-9]+)", 1)
    end = F.when(path != "", path).when(said.isin(*ENDS), F.element_at(F.create_map(*(F.lit(x) for kv in ENDS.items() for x in kv)), said)).when(said != "", F.concat(F.lit("."), said)).otherwise(".bin")
    rows = rows.withColumn("state", F.when(F.col("known"), "cached").when(F.coalesce(usable, F.lit(False)), "new").otherwise("failed"))
    made = rows.where("state = 'new'").select("address_key", "url", "folder", F.concat(F.substring("address_key", 1, 20), end).alias("name"), kind.alias("kind"))
    return made, rows.groupBy("state").count()


#: Kinds of content whose files end otherwise. Fixed values.
ENDS = {"jpeg": ".jpg", "svg": ".svg", "mpeg": ".mp3", "quicktime": ".mov", "plain": ".txt", "markdown": ".md", "json": ".json"}


def localised(messages: DataFrame, cache: DataFrame) -> DataFrame:
    """Messages whose texts name the local files of all cached addresses, each text rewritten in one pass; other addresses stay."""
    keyed = messages.select("*", F.monotonically_increasing_id().alias("__row"))
    found = F.array_distinct(F.concat(T.image_urls(F.col("texte")), F.transform(T.media_urls(F.col("texte")), lambda x: x["url"])))
    local = cache.where("name IS NOT NULL").select("address_key", F.concat_ws("/", "folder", "name").alias("path"))
    pairs = messages.select(F.explode(found).alias("url")).distinct().withColumn("address_key", F.sha1("url")).join(local, "address_key").select("url", "path")
    own = keyed.select("__row", F.explode(found).alias("url")).join(pairs, "url").groupBy("__row").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("url", "path")), asc=False)).alias("__local"))
    whole = keyed.join(own, "__row", "left")  # longer addresses come before those that they begin with
    return whole.withColumn("texte", F.when(F.col("__local").isNotNull(), T.rewrite_links(F.col("texte"), F.col("__local"))).otherwise(F.col("texte"))).select(*messages.columns)

"""Retrieval: exact cosine neighbours, keyword candidates, hybrid scores, grouping by conversation, grep and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions import text as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def nearest(vectors: DataFrame, vector: list[float], k: int, key: str = "msg_seq", column: str = "embedding") -> DataFrame:
    """The k rows of least cosine distance, ties by key: a heap in each partition and a merge, never a full sort."""
    return vectors.withColumn("distance", 1 - cosine(F.col(column), literal(vector))).orderBy("distance", key).limit(k)


def knn_prefiltered(messages: DataFrame, vectors: DataFrame, vector: list[float], k: int, platform: str | None = None, role: str | None = None) -> DataFrame:
    """Neighbours among the messages that pass the filters."""
    for c, v in (("platform", platform), ("role", role)):
        messages = messages.where(F.col(c) == v) if v is not None else messages
    return nearest(vectors.join(messages, "msg_seq"), vector, k)


def filters(messages: DataFrame, platforms: list[str] | None = None, model: str | None = None, date_from=None, date_to=None) -> DataFrame:
    """Conjunction of the criteria that are given; both bounds are inclusive."""
    if platforms:
        messages = messages.where(F.col("platform").isin(*platforms))
    if model:
        messages = messages.where(F.col("model") == model)
    if date_from is not None:
        messages = messages.where(F.col("ts") >= F.lit(date_from).cast("timestamp"))
    return messages if date_to is None else messages.where(F.col("ts") <= F.lit(date_to).cast("timestamp"))


def knn_postfiltered(messages: DataFrame, vectors: DataFrame, vector: list[float], k: int, **criteria) -> DataFrame:
    """Neighbours first, then the filters, so that fewer than k may be left."""
    return filters(nearest(vectors, vector, k).join(messages, "msg_seq"), **criteria)


def keyword_candidates(messages: DataFrame, query: str, limit: int = 2000, **criteria) -> DataFrame:
    terms = T.query_terms(query)
    return filters(messages, **criteria).where(T.any_term(F.col("texte"), terms)).orderBy("msg_seq").limit(limit)


def hybrid(messages: DataFrame, vectors: DataFrame, vector: list[float], query: str, k: int = 20, alpha: float = 0.6, **criteria) -> DataFrame:
    """The k best by alpha times similarity and 1 - alpha times keyword score, of the nearest and of those with a term. Both candidate sets are bounded, so what follows is small."""
    alpha, terms = max(0.0, min(1.0, alpha)), T.query_terms(query)
    near = knn_postfiltered(messages, vectors, vector, min(max(4 * k, 200), 2000), **criteria).select(*messages.columns, (1 - F.col("distance")).alias("similarity"), F.lit(0).alias("arm"))
    word = keyword_candidates(messages, query, **criteria)
    word = word.join(vectors, "msg_seq").select(*messages.columns, dot(F.col("embedding"), literal(vector)).alias("similarity"), F.lit(1).alias("arm")) if terms else near.limit(0)
    both = near.unionByName(word).withColumn("first", F.row_number().over(Window.partitionBy("msg_seq").orderBy("arm"))).where("first = 1")
    both = both.withColumn("semantic_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity")))).withColumn("keyword_score", T.keyword_score(F.col("texte"), terms, query))
    both = both.withColumn("raw", F.lit(alpha) * F.col("semantic_score") + F.lit(1 - alpha) * F.col("keyword_score")).where("raw > 0")
    both = both.withColumns({c: F.round(F.col(c), 4) for c in ("semantic_score", "keyword_score")}).withColumn("score", F.round("raw", 4))
    order = [F.col("score").desc(), "arm", F.when(F.col("arm") == 0, -F.col("similarity")).otherwise(F.lit(0.0)), "msg_seq"]
    return both.orderBy(*order).limit(k).select(*messages.columns, "semantic_score", "keyword_score", "score")


def group_results(found: DataFrame) -> DataFrame:
    """Hits by conversation: those with two or more first, then the best score."""
    own = found.groupBy("platform", "conversation_id").agg(F.count(F.lit(1)).alias("hit_count"), F.max("score").alias("best_score"), F.max_by("msg_seq", F.struct("score", -F.col("msg_seq"))).alias("best_seq"))
    return own.withColumn("place", F.row_number().over(Window.orderBy((F.col("hit_count") >= 2).desc(), F.col("best_score").desc(), "conversation_id")).cast("long"))


def similar(messages: DataFrame, vectors: DataFrame, msg_seq: int, k: int = 10) -> DataFrame:
    """Neighbours of a message, without itself; none if it has no vector."""
    own = vectors.where(F.col("msg_seq") == msg_seq).select(F.col("embedding").alias("own")).limit(1)
    near = vectors.where(F.col("msg_seq") != msg_seq).join(F.broadcast(own), F.lit(True)).withColumn("distance", 1 - cosine(F.col("embedding"), F.col("own")))
    return near.orderBy("distance", "msg_seq").limit(k).join(messages, "msg_seq").select("msg_seq", "platform", "conversation_id", F.round(1 - F.col("distance"), 4).alias("score"))


def cached_vectors(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """For each wanted fingerprint the vector of the first message that has it."""
    return index.join(wanted.select("fingerprint").distinct(), "fingerprint").groupBy("fingerprint").agg(F.min_by("embedding", "msg_seq").alias("embedding"), F.min("msg_seq").alias("msg_seq"))


def grep(messages: DataFrame, pattern: str, regex: bool = False, limit: int | None = None) -> DataFrame:
    """Matches in the fields of messages, in order of place: case doesn't count in a literal pattern."""
    fields = messages.select("platform", "conversation_id", "pos", F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(f).alias("field"), F.col(f).alias("value")) for k, f in enumerate(("texte", "message_id", "model"))))).alias("x")).select("platform", "conversation_id", "pos", "x.*")
    hit = F.col("value").rlike(pattern) if regex else F.contains(F.lower("value"), F.lit(pattern.lower()))
    n = F.regexp_count("value", F.lit(pattern)) if regex else F.size(F.split(F.lower("value"), F.lit(r"\Q" + pattern.lower() + r"\E"))) - 1
    out = fields.where(hit).withColumn("n", n.cast("long"))
    return out.orderBy("platform", "conversation_id", "pos", "rank").limit(limit) if limit else out


def field_stack(messages: DataFrame) -> DataFrame:
    """Text fields of messages as a long table (field, value), empty ones left out; arrays count from 0."""
    out = None
    for f in ("texte", "reasoning", "message_id", "model", "sources", "tools", "artifacts"):
        if f not in messages.columns:
            continue
        keys = [c for c in ("platform", "conversation_id", "pos") if c in messages.columns]
        if dict(messages.dtypes)[f].startswith("array"):
            part = messages.select(*keys, F.posexplode(f).alias("i", "value")).select(*keys, F.concat(F.lit(f"{f}["), F.col("i").cast("string"), F.lit("]")).alias("field"), "value")
        else:
            part = messages.select(*keys, F.lit(f).alias("field"), F.col(f).alias("value"))
        part = part.where("value <> ''")
        out = part if out is None else out.unionByName(part)
    return out


#: Fields of a message that are searched, in order; a conversation's come before them. Fixed values.
FIELDS, LISTS, OF_CONVERSATION = ("texte", "reasoning", "message_id", "model", "timestamp"), ("sources", "tools", "artifacts"), ("title", "url", "conversation_id", "model")
#: Signs that part a match from what is around it; those of a text become others.
_OPEN, _CLOSE = "\x00", "\x01"


def occurrences(c: Column, pattern: str) -> Column:
    """Places (start, end), from 0, of the matches of a Java pattern in a text, left to right, none over another; empty matches don't count."""
    marked = F.regexp_replace(F.translate(c, _OPEN + _CLOSE, "\ufffd\ufffd"), f"(?:{pattern})", f"{_OPEN}$0{_CLOSE}")
    pieces = F.split(F.replace(marked, F.lit(_OPEN + _CLOSE), F.lit("")), _OPEN, -1)
    sizes = F.transform(pieces, lambda p: F.struct(F.length(F.replace(p, F.lit(_CLOSE), F.lit(""))).alias("all"), (F.position(F.lit(_CLOSE), p) - 1).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))
    step = lambda s, x: F.struct((s["at"] + x["all"]).alias("at"), F.when(x["own"] > 0, F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), (s["at"] + x["own"]).alias("end"))))).otherwise(s["spans"]).alias("spans"))
    return F.when(F.contains(marked, F.lit(_OPEN)), F.aggregate(sizes, start, step, lambda s: s["spans"]))


def _fields(messages: DataFrame) -> Column:
    """The fields of a message as an array of (field, value) in order; those that messages lack are passed over, empty ones left out."""
    none = F.expr("CAST(array() AS array<struct<field:string,value:string>>)")
    entry = lambda f, v: F.struct(f.alias("field"), v.alias("value"))
    listed = lambda c, name, of: F.coalesce(F.transform(c, lambda v, i: entry(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]" + of)), v["texte"] if of else v)), none)
    parts = [F.array(*(entry(F.lit(f), F.col(f).cast("string")) for f in FIELDS if f in messages.columns))]
    parts += [listed(F.col(f), f, "") for f in LISTS if f in messages.columns]
    parts += [listed(F.col("variants"), "variants", ".texte")] if "variants" in messages.columns else []
    return F.filter(F.concat(*parts), lambda x: F.coalesce(x["value"], F.lit("")) != "")


def grep_archive(conversations: DataFrame, messages: DataFrame, pattern: str, regex: bool = False, limit: int = 50, inventory: DataFrame | None = None, platforms: list[str] | None = None) -> tuple[DataFrame, bool]:
    """(matches, truncated): up to limit occurrences over all fields, in order of platform, file, field and place: those of conversations (platform, conversation_id, file, title, url, model), then of messages (pos and any of the fields), then of inventory
    entries that were never read. Case doesn't count. truncated: the limit was met and files are left.

    One platform after the other is scanned, until the limit is met. Of a platform each file's matches are counted where it lies, and only files that come first with limit matches between them, limit of them at most, have their matches made out.
    """
    import re

    if not pattern:
        raise ValueError("an empty pattern")
    limit, java = max(1, min(limit, 200)), f"(?iu){pattern}" if regex else r"(?iu)\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    if regex:
        re.compile(re.sub(r"\\[QEpPhHRXGzZ]|\(\?<[a-zA-Z]|[+*?}]\+", "", pattern))
    found, left, truncated = None, limit, False
    names = sorted(r.platform for r in conversations.select("platform").distinct().collect()) if platforms is None else platforms
    own_fields = [f for f in OF_CONVERSATION if f in conversations.columns]
    for k, name in enumerate(names):
        files = conversations.where(F.col("platform") == name)
        head = files.select("conversation_id", F.lit(0).alias("pos"), F.posexplode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in own_fields))).alias("k", "x"))
        body = messages.where(F.col("platform") == name).select("conversation_id", (F.col("pos") + 1).alias("pos"), F.posexplode(_fields(messages)).alias("k", "x"))
        every = head.unionByName(body).select("conversation_id", "pos", "k", "x.field", "x.value")
        hits = every.where(F.col("value").rlike(java)).withColumn("spans", occurrences(F.col("value"), java)).where("size(spans) > 0")
        counts = hits.groupBy("conversation_id").agg(F.sum(F.size("spans")).alias("n")).join(files.select("conversation_id", "file"), "conversation_id")
        first = counts.orderBy("file", "conversation_id").limit(left).collect()  # as many as the limit at most
        wanted, room = [], left
        for r in first:
            if room <= 0:
                break
            wanted.append((r.conversation_id, len(wanted)))
            room -= r.n
        if wanted:
            chosen = conversations.sparkSession.createDataFrame(wanted, "conversation_id string, place int")
            rows = hits.join(F.broadcast(chosen), "conversation_id").select(F.lit(k).alias("source"), "place", "pos", "k", "conversation_id", "field", "value", F.explode("spans").alias("s"))
            rows = rows.select("source", "place", "pos", "k", F.col("s.start").alias("start"), F.lit(name).alias("platform"), "conversation_id", "field", T.window(F.col("value"), F.col("s.start"), F.col("s.end")).alias("snippet"))
            rows = rows.orderBy("place", "pos", "k", "start").limit(left)
            found = rows if found is None else found.unionByName(rows)
        left = max(0, room)
        if left == 0:
            last = files.agg(F.max(F.struct("file", "conversation_id")).alias("x")).first().x
            at = next(r for r in first if r.conversation_id == wanted[-1][0])
            truncated = (last.file, last.conversation_id) != (at.file, at.conversation_id) or any(not conversations.where(F.col("platform") == p).isEmpty() for p in names[k + 1 :])
            break
    if left and inventory is not None:
        rows = inventory.where("NOT coalesce(scraped, FALSE)").where(F.col("platform").isin(names) if platforms else F.lit(True))
        rows = rows.select("platform", "conversation_id", F.posexplode(F.array(*(F.struct(F.lit(f"list.{f}").alias("field"), F.col(f).cast("string").alias("value")) for f in ("title", "url", "conversation_id") if f in inventory.columns))).alias("k", "x"))
        rows = rows.where(F.col("x.value").rlike(java)).select("platform", "conversation_id", "k", "x.*", F.explode(occurrences(F.col("x.value"), java)).alias("s"))
        rows = rows.select(F.lit(len(names)).alias("source"), F.lit(0).alias("place"), F.lit(0).alias("pos"), "k", F.col("s.start").alias("start"), "platform", "conversation_id", "field", T.window(F.col("value"), F.col("s.start"), F.col("s.end")).alias("snippet"))
        rows = rows.orderBy("platform", "conversation_id", "k", "start").limit(left)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = conversations.sparkSession.createDataFrame([], "source int, place int, pos int, k int, start int, platform string, conversation_id string, field string, snippet string")
    return found, truncated


def lookup(messages: DataFrame, conversation_id: str, key: str) -> DataFrame:
    """A message by exact id, place from 1 on, or unique start of its id, in this order; an ambiguous start finds nothing."""
    own = messages.where(F.col("conversation_id") == conversation_id)
    rank = F.when(F.col("message_id") == key, 0).when((F.col("pos") + 1).cast("string") == key, 1).when(F.col("message_id").startswith(key), 2)
    own = own.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rank"))).withColumn("best", F.min("rank").over(Window.partitionBy()))
    return own.where("rank = best AND n = 1").drop("rank", "n", "best")


def known_platforms(wanted: list[str] | None, known: list[str]) -> list[str]:
    """The wanted platforms that are known, once each in order; nothing wanted means all. An error if none is left."""
    found = [p for p in dict.fromkeys(wanted or known) if p in known]
    if not found:
        raise ValueError(f"no known platform among {wanted!r}")
    return found


def criteria_only(messages: DataFrame, limit: int = 200, **criteria) -> DataFrame:
    """Newest messages that meet the criteria, without scores."""
    return filters(messages, **criteria).orderBy(F.col("ts").desc(), F.col("msg_seq").desc()).limit(limit)


def random_conversations(conversations: DataFrame, n: int, seed: int) -> DataFrame:
    """Up to eight conversations in an order that the seed tells."""
    return conversations.orderBy(F.xxhash64("conversation_id", F.lit(seed))).limit(min(n, 8))


def random_indexed(messages: DataFrame, n: int, seed: int) -> DataFrame:
    """random_conversations() of an index, with the number of messages and the last time of each."""
    own = messages.groupBy("platform", "conversation_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("ts").alias("last_message_at"))
    return random_conversations(own, n, seed)


def media_groups(groups: DataFrame, hits: DataFrame) -> DataFrame:
    """Text groups with the media hits of their conversation; media of other conversations come as groups of their own."""
    own = hits.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("media_hits"))
    return groups.join(own, "conversation_id", "full_outer").select("conversation_id", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.coalesce("media_hits", F.lit(0)).alias("media_hits"))

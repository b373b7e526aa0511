"""Quality of parsed conversations: metrics, capabilities, regressions, verdicts and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions.text import code_blocks, strip_fences
from convolake.operators.base import sql_operator

#: Metrics in their order. Fixed values.
FEATURES = ("messages", "consecutive_roles", "images", "tables", "lists", "code_langs", "latex")
#: Capabilities that the text of a conversation shows. Fixed values.
DETECTORS = {
    "headings": r"(?m)^#{1,3} ",
    "emphasis": r"\*\*[^*\n]+\*\*|(?<!\*)\*[^*\n]+\*(?!\*)|~~[^~\n]+~~",
    "inline_code": r"`[^`\n]+`",
    "link": r"\]\(https?://",
    "blockquote": r"(?m)^\s*> ",
    "hr": r"(?m)^\s*(?:---|\*\*\*|___)\s*$",
    "list_bullet": r"(?m)^\s*[-*+] ",
    "list_numbered": r"(?m)^\s*\d+\. ",
    "checklist": r"(?m)^\s*[-*+] \[[ xX]\]",
    "list_nested": r"(?m)^\s{2,}[-*+] ",
    "table": r"\|\s*-{2,}",
    "latex_inline": r"(?<!\$)\$[^$\n]+\$(?!\$)",
    "latex_display": r"\$\$",
    "latex_matrix": r"\\begin\{(?:matrix|pmatrix|bmatrix|vmatrix|cases|aligned)\}",
    "image_markdown": r"!\[[^\]]*\]\(",
    "emoji_unicode": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]|[\x{0600}-\x{06FF}]|[\x{4E00}-\x{9FFF}]",
    "refusal_error": r"(?iu)\b(je ne peux pas|impossible|désolé|refus|je ne suis pas en mesure)\b",
}
#: Files that a text attaches, by capability; words in labels of tools; what pages have for sound and film. Fixed values.
FILES = {
    "upload_pdf": r"document[^ \n]*\.pdf|\]\(files/[^)\s]*\.pdf\)",
    "upload_csv": r"donnees[^ \n]*\.csv|\]\(files/[^)\s]*\.csv\)",
    "upload_json": r"donnees[^ \n]*\.json|\]\(files/[^)\s]*\.json\)",
    "upload_text": r"notes[^ \n]*\.(?:txt|md)|\]\(files/[^)\s]*\.(?:txt|md)\)",
    "audio": r"audio[^ \n]*\.(?:mp3|wav|m4a|ogg)|\]\(files/[^)\s]*\.(?:mp3|wav|m4a|ogg)\)",
    "video": r"video[^ \n]*\.(?:mp4|mov|webm)|\]\(files/[^)\s]*\.(?:mp4|mov|webm)\)",
    "upload_image": r"image[^ \n]*\.(?:png|jpe?g|webp|gif)|\]\(images/|\]\(files/[^)\s]*\.(?:png|jpe?g|webp|gif|svg)\)",
}
TOOL_WORDS = {"code_execution": "exécution de code|code|terminal|commande|python", "connectors": "connecteur|mcp", "image_generation": "génération d['’]image", "thread_memory": "mémoire"}
SOUND = {"audio": r"audio\.mp3|<audio", "video": r"video\.mp4|<video"}
#: Links, images, remains of HTML and fences that an audit counts. Fixed values.
LINK = r"\[[^\]]+\]\((?:https?://|/)[^)]*\)|https?://[^\s)>]+"
IMAGE = r"!\[[^\]]*\]\([^)]+\)|data:image/"
HTML = r"</?(?:div|span|p|a|button|svg|li|ul|table)[\s>/]|</?xai[A-Za-z]*|grok:render|</?argument\b"
FENCE = r"(?m)^```"


def _literal_count(c: Column, what: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)


def metrics(messages: DataFrame) -> DataFrame:
    """The metrics of each conversation; code_langs needs a column of that name with the number of named code blocks."""
    from pyspark.sql import Window

    t, again = F.col("texte"), F.lag("role").over(Window.partitionBy("platform", "conversation_id").orderBy("pos")) == F.col("role")
    has = lambda start: (F.contains(t, F.lit("\n" + start)) | t.startswith(start)).cast("int")
    rows = messages.withColumn("again", again)
    langs = F.sum("code_langs") if "code_langs" in messages.columns else F.lit(0)
    made = {
        "messages": F.count(F.lit(1)),
        "consecutive_roles": F.count_if("again"),
        "images": F.sum(_literal_count(t, "![")),
        "tables": F.count_if(F.contains(t, F.lit("| ---")) | F.contains(t, F.lit("|---"))),
        "lists": F.sum(has("- ") + has("1. ")),
        "code_langs": langs,
        "latex": F.sum(_literal_count(t, "$")),
    }
    return rows.groupBy("platform", "conversation_id").agg(*(v.cast("long").alias(k) for k, v in made.items()))


def capabilities(messages: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Names of the capabilities that each conversation shows, sorted. Columns code_blocks, reasoning, artifacts, sources and tools count where messages have them; without code_blocks those of the text do. pages: (platform, conversation_id, html), of which one of several counts."""
    has = messages.columns
    order = F.sort_array(F.collect_list(F.struct("pos", "texte")))
    blocks = F.col("code_blocks") if "code_blocks" in has else code_blocks(F.col("texte"))
    any_of = lambda c: F.coalesce(F.max(c), F.lit(False))
    filled = lambda name: any_of(F.size(name) > 0) if name in has else F.lit(False)
    labels = F.array_join(F.flatten(F.collect_list(F.transform(F.coalesce("tools", F.array()), F.lower))), " ") if "tools" in has else F.lit("")
    whole = messages.withColumn("blocks", F.coalesce(blocks, code_blocks(F.lit("")))).groupBy("platform", "conversation_id").agg(
        F.array_join(F.transform(order, lambda x: x["texte"]), "\n").alias("said"), F.max(F.length("texte")).alias("longest"), any_of(F.size("blocks") > 0).alias("code_block"), any_of(F.exists("blocks", lambda b: F.coalesce(b["language"], F.lit("")) != "")).alias("code_languages"),
        any_of(F.exists("blocks", lambda b: F.regexp_count(F.coalesce(b["code"], F.lit("")), F.lit("\n")) >= 8)).alias("code_long"), (any_of(F.trim(F.coalesce("reasoning", F.lit(""))) != "") if "reasoning" in has else F.lit(False)).alias("reasoning"),
        filled("artifacts").alias("artifact_canvas"), filled("sources").alias("web_search_citations"), labels.alias("labels"),
    )
    page = F.lit("")
    if pages is not None:
        whole, page = whole.join(pages.groupBy("platform", "conversation_id").agg(F.min(F.lower("html")).alias("page")), ["platform", "conversation_id"], "left"), F.coalesce("page", F.lit(""))
    low = F.lower("said")
    told = {name: F.col(name) for name in ("code_block", "code_languages", "code_long", "reasoning", "artifact_canvas", "web_search_citations")} | {"long_message": F.col("longest") >= 1200}
    told |= {name: F.col("said").rlike(p) for name, p in DETECTORS.items()} | {name: low.rlike(p) for name, p in FILES.items()} | {name: F.col("labels").rlike(p) for name, p in TOOL_WORDS.items()}
    for name in ("audio", "video"):
        told[name] = told[name] | page.rlike(SOUND[name])
    return whole.select("platform", "conversation_id", F.sort_array(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in told.items())))).alias("capabilities"))


def regressions(current: DataFrame, baseline: DataFrame, floor: float = 0.6) -> DataFrame:
    """Metrics that fell below floor times the baseline; runs of one role only count if there are more."""
    b = baseline.select("platform", "conversation_id", *(F.col(f).alias(f"was_{f}") for f in FEATURES))
    lost = [F.when((F.col(f"was_{f}") > 0) & ((F.col(f) > F.col(f"was_{f}")) if f == "consecutive_roles" else (F.col(f) < F.col(f"was_{f}") * floor)), F.lit(f)) for f in FEATURES]
    return current.join(b, ["platform", "conversation_id"]).select("platform", "conversation_id", F.col("was_messages").alias("old_messages"), F.col("messages").alias("new_messages"), F.array_compact(F.array(*lost)).alias("lost"))


def recheck(current: DataFrame, archived: DataFrame) -> DataFrame:
    """Retention and status of conversations that were read again."""
    r = regressions(current, archived)
    kept = F.when(F.col("old_messages") > 0, F.round(F.col("new_messages") / F.col("old_messages"), 3))
    return r.withColumn("retention", kept).withColumn("status", F.when(F.col("new_messages") <= 0, "vide").when((F.size("lost") > 0) | (F.col("retention") < 1.0), "degrade").otherwise("ok"))


def verdicts(checked: DataFrame) -> DataFrame:
    """Verdict and summary of each platform; ignored rows don't count."""
    used = F.col("status") != "ignore"
    broken, usable = F.count_if(used & F.col("status").isin("echec", "vide")), F.count_if(used)
    out = checked.groupBy("platform").agg(usable.alias("compared"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "degrade").alias("degraded"), broken.alias("failed"), F.count_if(F.col("status") == "ignore").alias("ignored"), F.round(F.avg(F.when(used, F.col("retention"))), 3).alias("retention"), F.min(F.when(used, F.col("retention"))).alias("least"))
    verdict = F.when(F.col("compared") == 0, "inconnu").when((F.col("failed") * 2 >= F.col("compared")) | (F.col("least") < 0.5), "critique").when((F.col("failed") > 0) | (F.col("degraded") > 0), "attention").otherwise("ok")
    return out.withColumn("verdict", verdict).drop("least")


def audit(messages: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Links, images, fences, code blocks and what is wrong, by platform; with conversations (platform, started_at, model) also how many lack a time or a model. A platform without messages has zeros."""
    t = F.col("texte")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    count = lambda p: total(F.regexp_count(t, F.lit(p)))
    blocks = F.col("code_blocks") if "code_blocks" in messages.columns else code_blocks(t)
    own = messages.groupBy("platform").agg(
        F.count_distinct("conversation_id").alias("conv"), F.count(F.lit(1)).alias("msgs"), count(LINK).alias("links"), count(FENCE).alias("fences"), count(IMAGE).alias("images"), total(F.size(blocks)).alias("code_blocks"),
        F.count_if(strip_fences(t).rlike(HTML)).alias("residual_html"), F.count_if((F.length(t) < 4) & (F.col("role") == "assistant")).alias("near_empty"),
    )
    if conversations is None:
        return own
    lacks = conversations.groupBy("platform").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("started_at").isNull()).alias("without_time"), F.count_if(F.col("model").isNull()).alias("without_model"))
    both = lacks.join(own, "platform", "full_outer")
    return both.select("platform", F.coalesce("listed", "conv").alias("conv"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("msgs", "links", "fences", "images", "code_blocks", "residual_html", "near_empty", "without_time", "without_model")))


#: Expected, detected and lost capabilities of canaries, from (canary, capability, expected, detected).
canary_coverage = sql_operator("SELECT canary, count(CASE WHEN expected THEN 1 END) AS expected, count(CASE WHEN detected THEN 1 END) AS detected, count(CASE WHEN expected AND NOT detected THEN 1 END) AS lost FROM {canaries} GROUP BY canary", "canaries")

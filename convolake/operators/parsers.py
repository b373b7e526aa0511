"""Vendor payloads and pages as messages of one schema.

Payloads with a fixed schema are read by from_json and reshaped by column functions; payloads of untyped nested lists are walked once (positional), and pages need a parser that runs as a vectorised function.
Every mapper takes rows (conversation_id, payload) and returns messages: conversation_id, pos, message_id, role, model, ts, texte, reasoning, tools, sources, artifacts, variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.functions.markdown import render_citations
from convolake.operators import positional
from convolake.operators.normalize import follow

COLUMNS = ("conversation_id", "pos", "message_id", "role", "model", "ts", "texte", "reasoning", "tools", "sources", "artifacts", "variants")
#: Other versions of a message: edits of a question, regenerations of an answer, in order, with the one that is shown.
VARIANTS = "array<struct<kind:string,texte:string,ts:timestamp,message_id:string,active:boolean>>"
_NONE = "CAST(array() AS array<string>)"


def finish(rows: DataFrame, order: list, keep_empty: bool = False, **columns: Column) -> DataFrame:
    """All columns of the schema; messages without any content leave if they aren't kept, and places count from 0."""
    full = {"model": F.lit(None).cast("string"), "reasoning": F.lit(""), "tools": F.expr(_NONE), "sources": F.expr(_NONE), "artifacts": F.expr(_NONE), "variants": F.expr(f"CAST(array() AS {VARIANTS})")} | columns
    rows = rows.select("conversation_id", *(c.alias(f"__o{i}") for i, c in enumerate(order)), *(full[c].alias(c) for c in COLUMNS[2:]))
    rows = rows if keep_empty else rows.where("texte <> '' OR reasoning <> '' OR size(tools) > 0 OR size(sources) > 0 OR size(artifacts) > 0")
    at = Window.partitionBy("conversation_id").orderBy(*(f"__o{i}" for i in range(len(order))))
    return rows.withColumn("pos", (F.row_number().over(at) - 1).cast("int")).select(*COLUMNS)


def _variants(same: Window, order: Column, kind: Column, texte: Column, ts: Column, shown: Column, own: Column, message_id: Column) -> Column:
    """The versions of a message, which are the rows of a window, where there are two or more. shown names a version, own that of the row."""
    every = F.sort_array(F.collect_list(F.struct(order.alias("order"), shown.alias("shown"), texte.alias("texte"), ts.alias("ts"), message_id.alias("message_id"))).over(same))
    made = F.transform(every, lambda v: F.struct(kind.alias("kind"), v["texte"].alias("texte"), v["ts"].alias("ts"), v["message_id"].alias("message_id"), (v["shown"] == own).alias("active")))
    return F.when(F.size(every) > 1, made).otherwise(F.expr(f"CAST(array() AS {VARIANTS})"))


def _read(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.select("conversation_id", F.from_json("payload", schema).alias("p"))


def _distinct(c: Column) -> Column:
    return F.coalesce(F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != ""))), F.expr(_NONE))


def _joined(c: Column, by: str = "\n\n") -> Column:
    return F.coalesce(T.strip(F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), by)), F.lit(""))


CLAUDE = "uuid string, model string, current_leaf_message_uuid string, chat_messages array<struct<uuid:string,parent_message_uuid:string,sender:string,index:int,created_at:string,content:array<struct<type:string,text:string,thinking:string,name:string,citations:array<struct<url:string>>,input:struct<filepaths:array<string>,title:string,file_path:string>>>,files:array<struct<file_name:string,file_kind:string,preview_url:string>>>>"


def claude(payloads: DataFrame) -> DataFrame:
    """A tree of messages: the branch from the current leaf, or else from the message with the largest index, to the root."""
    p = _read(payloads, CLAUDE)
    rows = p.select("conversation_id", F.col("p.model").alias("model"), F.col("p.current_leaf_message_uuid").alias("leaf"), F.explode("p.chat_messages").alias("m"))
    flat = rows.select("conversation_id", "model", F.col("m.uuid").alias("id"), F.col("m.parent_message_uuid").alias("parent"), "m", F.row_number().over(Window.partitionBy("conversation_id").orderBy((F.col("m.uuid") == F.col("leaf")).desc_nulls_last(), F.col("m.index").desc_nulls_last())).alias("k"))
    blocks = lambda kind, f: F.transform(F.filter(F.col("m.content"), lambda b: b["type"] == kind), f)
    same = Window.partitionBy("conversation_id", F.coalesce("parent", F.lit("")), "m.sender")
    kind = F.when(F.col("m.sender") == "human", "edit").otherwise("regeneration")
    flat = flat.withColumn("variants", _variants(same, F.coalesce("m.index", F.lit(0)), kind, T.autolink(_joined(blocks("text", lambda b: b["text"]), "\n")), T.parse_iso(F.col("m.created_at")), F.col("id"), F.col("id"), F.col("id")))
    walk = follow(flat.withColumns({"next": F.col("parent"), "start": F.col("k") == 1}), "id")
    on = flat.join(walk, ["conversation_id", "id"])
    content, answer = F.coalesce(F.col("m.content"), F.array()), F.col("m.sender") != "human"
    of = lambda kind, f: F.transform(F.filter(F.col("m.content"), lambda b: b["type"] == kind), f)
    files = F.transform("m.files", lambda f: F.when(f["file_kind"] == "image", F.concat(F.lit("!["), f["file_name"], F.lit("]("), f["preview_url"], F.lit(")"))).otherwise(f["file_name"]))
    made = F.filter(F.col("m.content"), lambda b: (b["type"] == "tool_use") & b["name"].isin("present_files", "Artifact"))
    only = lambda c, none: F.when(answer, c).otherwise(none)
    return finish(
        on.where(content.isNotNull() | F.col("m.files").isNotNull()), [-F.col("depth")], variants=F.col("variants"), message_id=F.col("id"), role=F.when(answer, "assistant").otherwise("user"), model=only(F.col("model"), F.lit(None)), ts=T.parse_iso(F.col("m.created_at")),
        texte=_joined(F.array(T.autolink(_joined(of("text", lambda b: b["text"]), "\n")), _joined(files))), reasoning=only(_joined(of("thinking", lambda b: b["thinking"])), F.lit("")),
        tools=only(_distinct(of("tool_use", lambda b: tool_label(b["name"], CLAUDE_TOOLS))), F.expr(_NONE)), sources=only(F.slice(_distinct(F.filter(F.flatten(of("text", lambda b: F.coalesce(F.transform(b["citations"], lambda c: c["url"]), F.expr(_NONE)))), lambda u: u.rlike("^https?://"))), 1, 25), F.expr(_NONE)),
        artifacts=only(_distinct(F.flatten(F.transform(made, lambda b: F.coalesce(b["input"]["filepaths"], F.array(F.coalesce(b["input"]["title"], b["input"]["file_path"])))))), F.expr(_NONE)),
    )


CHATGPT = (
    "conversation_id string, messages array<struct<id:string,author:struct<role:string>,recipient:string,create_time:double,content:struct<content_type:string,parts:array<variant>,thoughts:array<struct<summary:string,content:string>>,content:string>,"
    "metadata:struct<model_slug:string,is_visually_hidden_from_conversation:boolean,reasoning_recap_type:string,image_gen_title:string,attachments:array<struct<id:string,name:string>>,"
    "content_references:array<struct<type:string,title:string,url:string,matched_text:string,alt:string,sources:array<struct<title:string,url:string>>>>,citations:array<struct<title:string,url:string,metadata:struct<title:string,url:string>>>,"
    "genui_components:array<struct<type:string,safe_urls:array<struct<url:string>>>>>>>"
)
#: Kinds of content that are no message. Fixed values.
CHATGPT_CONTEXT, CHATGPT_INTERNAL = ("model_editable_context", "user_editable_context"), ("code", "execution_output", "system_error")


def message_kind(m: Column) -> Column:
    """What a message of a flat list is: context, reasoning, tool, internal, other or text."""
    role, kind = F.lower(F.coalesce(m["author"]["role"], F.lit(""))), F.coalesce(m["content"]["content_type"], F.lit(""))
    return (
        F.when((role == "system") | kind.isin(*CHATGPT_CONTEXT), "context").when(kind.isin("reasoning_recap", "thoughts"), "reasoning").when(role == "tool", "tool").when(kind.isin(*CHATGPT_INTERNAL), "internal")
        .when(~kind.isin("text", "multimodal_text") | F.coalesce(m["metadata"]["is_visually_hidden_from_conversation"], F.lit(False)), "other").otherwise("text")
    )


#: Where an uploaded or a made file is had; the kind of a part that is an image; kinds of components with images and what a full size one's address holds; kinds of references that are sources. Fixed values.
CHATGPT_FILE, CHATGPT_IMAGE, CHATGPT_CARDS, FULL_SIZE, CHATGPT_SOURCES = "https://chatgpt.com/backend-api/files/", "image_asset_pointer", ("async_image", "image", "generated_image"), "purpose=fullsize", ("url", "source", "file")


def _each(c: Column, f) -> Column:
    """f of each element, as text, in order and once; nulls and empty texts leave."""
    return _distinct(F.transform(c, f))


def replace_first(c: Column, what: Column, by: Column) -> Column:
    """c with the first what as by; null if there is none, or what is empty."""
    at = F.position(what, c)
    return F.when((F.coalesce(what, F.lit("")) != "") & (at > 0), F.concat(F.substring(c, F.lit(1), at - 1), by, F.substring(c, at + F.length(what), F.length(c))))


def splice_references(c: Column, references: Column) -> Column:
    """c with the Markdown of each reference to a group of images in place of its mark, the first left; one whose mark isn't in the text comes at its end, once. Marks are replaced in the order of the references, so that of two marks that overlap the first counts."""

    def put(text: Column, ref: Column) -> Column:
        said = T.strip(F.coalesce(ref["alt"], F.lit("")))
        end = F.when(F.contains(text, said), text).otherwise(T.strip(F.concat_ws("\n\n", F.nullif(text, F.lit("")), said)))
        return F.when(said == "", text).otherwise(F.coalesce(replace_first(text, ref["matched_text"], said), end))

    return F.aggregate(F.filter(references, lambda r: r["type"] == "image_group"), c, put)


def _image(part: Column, m: Column, made: bool) -> Column:
    """An image part as Markdown; empty without an identifier."""
    pointer = T.strip(F.coalesce(F.try_variant_get(part, "$.asset_pointer", "string"), F.lit("")))
    fid = F.when(F.contains(pointer, F.lit("://")), F.regexp_replace(pointer, r"(?s)^.*?://", "")).otherwise(pointer)
    if made:
        title = T.strip(F.coalesce(m["metadata"]["image_gen_title"], F.lit("")))
        alt = F.when(title == "", "Generated image").otherwise(F.concat(F.lit("Generated image: "), title))
    else:
        names = F.filter(F.transform(m["metadata"]["attachments"], lambda a: F.when(a["id"] == fid, T.strip(a["name"]))), lambda n: F.coalesce(n, F.lit("")) != "")
        alt = F.coalesce(F.get(names, 0), F.lit("image"))
    alt = F.translate(alt, "[]\n", "() ")
    return F.when(fid == "", "").otherwise(F.concat(F.lit("!["), alt, F.lit(f"]({CHATGPT_FILE}"), fid, F.lit("/download)")))


def chatgpt_text(m: Column) -> Column:
    """Text of a message: its texts and transcripts, then images, those that its references and cards show included. Parts that can't be had, such as sound, have no text."""
    kind = lambda p: F.coalesce(F.try_variant_get(p, "$.content_type", "string"), F.lit(""))
    said = lambda p: F.coalesce(F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.when(kind(p) != CHATGPT_IMAGE, T.strip(F.try_variant_get(p, "$.text", "string")))), F.lit(""))
    parts = F.filter(m["content"]["parts"], lambda p: p.isNotNull())
    texts = F.filter(F.transform(parts, said), lambda x: T.strip(x) != "")
    images = F.filter(F.transform(F.filter(parts, lambda p: kind(p) == CHATGPT_IMAGE), lambda p: _image(p, m, False)), lambda x: x != "")
    text = T.strip(F.concat_ws("\n\n", F.nullif(F.regexp_replace(F.array_join(texts, "\n"), r"\s+$", ""), F.lit("")), F.nullif(F.array_join(images, "\n\n"), F.lit(""))))
    text = splice_references(T.math(F.coalesce(text, F.lit(""))), F.coalesce(m["metadata"]["content_references"], F.expr("CAST(array() AS array<struct<type:string,title:string,url:string,matched_text:string,alt:string,sources:array<struct<title:string,url:string>>>>)")))

    def card(c: Column) -> Column:
        urls = F.filter(F.transform(c["safe_urls"], lambda u: T.strip(u["url"])), lambda u: u.rlike("^https?://"))
        url = F.coalesce(F.get(F.filter(urls, lambda u: u.contains(FULL_SIZE)), 0), F.get(urls, 0))
        return F.concat(F.lit("![image]("), url, F.lit(")"))

    cards = F.array_join(_each(F.filter(m["metadata"]["genui_components"], lambda c: c["type"].isin(*CHATGPT_CARDS)), card), "\n\n")
    return F.when(cards == "", text).otherwise(T.strip(F.concat_ws("\n\n", F.nullif(text, F.lit("")), cards)))


def chatgpt_sources(m: Column) -> Column:
    """Sources of a message: those of its references, each with its own after the ones it lists, then its citations."""
    none = F.expr(_NONE)
    entry = lambda title, url: F.when(T.strip(F.coalesce(url, F.lit(""))) != "", T.source_entry(T.strip(title), T.strip(url)))
    of = lambda r: F.concat(F.coalesce(F.transform(r["sources"], lambda s: entry(s["title"], s["url"])), none), F.array(F.when(r["type"].isin(*CHATGPT_SOURCES), entry(r["title"], r["url"]))))
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    cited = F.transform(m["metadata"]["citations"], lambda c: entry(first(c["metadata"]["title"], c["title"]), first(c["metadata"]["url"], c["url"])))
    return _distinct(F.concat(F.coalesce(F.flatten(F.transform(m["metadata"]["content_references"], of)), none), F.coalesce(cited, none)))


def chatgpt(payloads: DataFrame) -> DataFrame:
    """A flat list of messages. What comes between the visible ones (reasoning, steps of tools, made images) goes to the next answer before the next question. Made images before a question, or at the end, go back to the answer before them, with what came along, or make an answer of their own;
    reasoning and steps alone do that only at the end and after a question, and are left out before another question."""
    rows = _read(payloads, CHATGPT).select("conversation_id", F.posexplode("p.messages").alias("at", "m")).where("m IS NOT NULL").withColumn("kind", message_kind(F.col("m")))
    role, content, none = F.lower("m.author.role"), F.col("m.content"), F.expr(_NONE)
    visible = (F.col("kind") == "text") & ((role == "user") | (role == "assistant") & (F.coalesce("m.recipient", F.lit("all")) == "all"))
    made = F.filter(content["parts"], lambda p: F.try_variant_get(p, "$.content_type", "string") == CHATGPT_IMAGE)
    recap = F.when(content["content_type"] == "reasoning_recap", F.array(F.when(F.col("m.metadata.reasoning_recap_type") == "collapse", T.strip(content["content"])))).otherwise(F.transform(content["thoughts"], lambda t: T.strip(t["content"])))
    thoughts, inner = content["content_type"] == "thoughts", F.col("kind") == "reasoning"
    rows = rows.select(
        "conversation_id", "at", F.coalesce(visible, F.lit(False)).alias("visible"), F.when(visible, F.struct("at", role.alias("role"), F.col("m.id").alias("id"), F.col("m.metadata.model_slug").alias("model"), F.col("m.create_time").alias("time"), chatgpt_text(F.col("m")).alias("texte"), chatgpt_sources(F.col("m")).alias("sources"))).alias("v"),
        F.coalesce(F.when(inner, recap), none).alias("reasoning"), F.coalesce(F.when(inner & thoughts, F.transform(content["thoughts"], lambda t: T.strip(t["summary"]))), none).alias("tools"),
        F.coalesce(F.when((F.col("kind") == "tool") & (content["content_type"] == "multimodal_text"), F.transform(made, lambda p: _image(p, F.col("m"), True))), none).alias("images"),
    ).where("visible OR size(reasoning) + size(tools) + size(images) > 0")
    ahead = Window.partitionBy("conversation_id").orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("segment", F.sum(F.col("visible").cast("int")).over(ahead))
    more = F.sort_array(F.collect_list(F.when(~F.col("visible"), F.struct("at", "reasoning", "tools", "images"))))
    own = rows.groupBy("conversation_id", "segment").agg(F.max("v").alias("v"), more.alias("more"), F.max("at").alias("at"))
    all_of = lambda field: _distinct(F.flatten(F.transform("more", lambda x: x[field])))
    own = own.select("conversation_id", "at", "v", F.col("v.role").alias("role"), F.struct(F.array_join(all_of("images"), "\n\n").alias("images"), F.array_join(all_of("reasoning"), "\n\n").alias("reasoning"), all_of("tools").alias("tools")).alias("x"))
    order = Window.partitionBy("conversation_id").orderBy("at")
    own = own.withColumns({"before": F.lag("role").over(order), "next": F.lead(F.struct("role", "x")).over(order)})
    x, answer = F.col("x"), F.col("role") == "assistant"
    back = F.when(answer & F.coalesce(F.col("next.role") != "assistant", F.col("next").isNotNull()) & (F.col("next.x.images") != ""), F.col("next.x"))
    texte = T.strip(F.concat_ws("\n\n", *(F.nullif(c, F.lit("")) for c in (F.col("v.texte"), F.when(answer, x["images"]), back["images"]))))
    shown = F.struct(
        F.lit(1).alias("half"), F.col("role").alias("role"), F.coalesce("v.id", F.lit("")).alias("id"), F.col("v.model").alias("model"), F.col("v.time").alias("time"), texte.alias("texte"),
        F.when(answer, F.coalesce(F.nullif(x["reasoning"], F.lit("")), back["reasoning"], F.lit(""))).otherwise("").alias("reasoning"), F.when(answer, F.array_distinct(F.concat(x["tools"], F.coalesce(back["tools"], none)))).otherwise(none).alias("tools"), F.when(answer, F.col("v.sources")).otherwise(none).alias("sources"),
    )
    alone = F.coalesce(F.col("before") != "assistant", F.col("role").isNotNull()) & ~F.coalesce(answer, F.lit(False)) & ((x["images"] != "") | F.col("role").isNull() & ((x["reasoning"] != "") | (F.size(x["tools"]) > 0)))
    lone = F.struct(F.lit(0).alias("half"), F.lit("assistant").alias("role"), F.lit("").alias("id"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("time"), x["images"].alias("texte"), x["reasoning"].alias("reasoning"), x["tools"].alias("tools"), none.alias("sources"))
    turns = own.select("conversation_id", "at", F.explode(F.filter(F.array(F.when(alone, lone), F.when(F.col("role").isNotNull(), shown)), lambda t: t.isNotNull())).alias("t"))
    return finish(
        turns, [F.col("at"), F.col("t.half")], keep_empty=True, message_id=F.col("t.id"), role=F.col("t.role"), model=F.when(F.col("t.role") == "assistant", F.nullif(F.col("t.model"), F.lit(""))), ts=F.timestamp_seconds(F.col("t.time")),
        texte=F.col("t.texte"), reasoning=F.col("t.reasoning"), tools=F.col("t.tools"), sources=F.col("t.sources"),
    )


#: Names of a vendor's tools, in lower case without separators, and what they are called. Fixed values.
GROK_TOOLS = {
    "websearch": "Recherche web", "websearchwithsnippets": "Recherche web (extraits)", "browsepage": "Navigation web", "browsertab": "Navigation web", "openpage": "Ouverture de page", "openpagewithfind": "Recherche dans une page",
    "xkeywordsearch": "Recherche X", "xsearch": "Recherche X", "xsemanticsearch": "Recherche X (sémantique)", "xthreadfetch": "Lecture de fil X", "xusersearch": "Recherche d'utilisateur X", "viewxvideo": "Consultation de vidéo X",
    "readfile": "Lecture de fichier", "writefile": "Écriture de fichier", "viewimage": "Analyse d'image", "bash": "Exécution de commandes", "initterminalsession": "Initialisation du terminal", "codeexecution": "Exécution de code",
    "mcp": "Connecteurs MCP", "chatroomsend": "Envoi au chat",
}
#: The same of another vendor, by exact name. Fixed values.
CLAUDE_TOOLS = {
    "web_search": "Recherche web", "web_fetch": "Lecture de page", "bash_tool": "Exécution de code", "create_file": "Création de fichier", "present_files": "Fichiers présentés", "memory_read": "Mémoire lue", "memory_write": "Mémoire enregistrée",
    "memory_str_replace": "Mémoire mise à jour", "Artifact": "Artefact publié",
}
#: Results of a response that tell a tool which no step names: (fields, tool). Fixed values.
GROK_RESULTS = ((("webSearchResults", "citedWebSearchResults"), "Recherche web"), (("xposts", "citedXposts"), "Recherche X"))


def tool_label(name: Column, labels: dict[str, str], loose: bool = False) -> Column:
    """What a tool is called; an unknown one keeps its name. loose: case and separators don't count."""
    own = F.trim(F.coalesce(name, F.lit("")))
    key = F.regexp_replace(F.lower(own), "[^a-z0-9]", "") if loose else own
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), key), own)


_RESULT, _POST = "array<struct<url:string>>", "array<struct<url:string,username:string,postId:string>>"
_RESULTS = f"webSearchResults:{_RESULT},citedWebSearchResults:{_RESULT},xposts:{_POST},citedXposts:{_POST}"
GROK = (
    f"conversation struct<conversationId:string,title:string>, responses array<struct<responseId:string,sender:string,message:string,createTime:string,model:string,{_RESULTS},cardAttachmentsJson:array<string>,fileAttachmentAssetMetadata:array<struct<key:string,name:string,mimeType:string>>,fileAttachmentsMetadata:array<struct<fileUri:string,fileName:string,fileMimeType:string>>,generatedImageUrls:array<string>,"
    f"streamErrors:array<struct<message:string>>,metadata:struct<request_metadata:struct<stream_errors:array<struct<message:string>>>>,steps:array<struct<tags:array<string>,text:array<string>,toolName:string,{_RESULTS}>>>>"
)
#: Where assets are had; cards of files, and words in the kinds of cards of artifacts. Fixed values.
GROK_ASSETS, GROK_ARTIFACTS = "https://assets.grok.com", r"render_file|rendered_file_card|artifact|canvas"



def grok(payloads: DataFrame) -> DataFrame:
    """A list of responses, whose texts lose the vendor's tags and get links for its citations, and have what was made or attached after them. A response without a text says the error of its stream, else its files; an answer without any of these stays, a question doesn't.
    Sources are those cited, or else all that were found."""
    rows = _read(payloads, GROK).select("conversation_id", F.posexplode("p.responses").alias("at", "r"))
    role = F.when(F.lower("r.sender").isin("human", "user"), "user").otherwise("assistant")
    steps = F.coalesce("r.steps", F.array().cast(dict(rows.select("r.steps").dtypes)["steps"]))
    none = F.expr(_NONE)
    every = lambda field: F.concat(F.coalesce(F.col(f"r.{field}"), F.array().cast(dict(rows.select(f"r.{field}").dtypes)[field])), F.flatten(F.transform(steps, lambda s: F.coalesce(s[field], F.array().cast(dict(rows.select(f"r.{field}").dtypes)[field])))))
    urls = lambda field: F.transform(every(field), lambda x: F.trim(x["url"]))
    posts = lambda field: F.transform(every(field), lambda x: F.coalesce(F.nullif(F.trim(x["url"]), F.lit("")), F.when((x["username"] != "") & (x["postId"] != ""), F.concat(F.lit("https://x.com/"), x["username"], F.lit("/status/"), x["postId"]))))
    rows = rows.withColumn("cards", F.filter(F.transform(F.coalesce("r.cardAttachmentsJson", none), lambda c: F.from_json(c, "id string, url string, cardType string, type string, file_name string, title string, mime_type string, content_type string, file_size long")), lambda c: c.isNotNull()))
    cards = F.filter("cards", lambda c: (c["cardType"] == "citation_card") | (c["type"] == "render_inline_citation"))
    cards = F.filter(cards, lambda c: (c["id"] != "") & (c["url"] != ""))
    cited = _distinct(F.concat(urls("citedWebSearchResults"), F.transform(cards, lambda c: c["url"])))
    found = _distinct(F.concat(urls("webSearchResults"), posts("xposts"), posts("citedXposts")))
    named = F.flatten(F.transform(steps, lambda s: F.concat(F.array(s["toolName"]), F.regexp_extract_all(F.array_join(F.coalesce(s["text"], none), "\n"), F.lit(r"(?is)<xai:tool_name>(.*?)</xai:tool_name>"), F.lit(1)))))
    told = [F.when(F.size(every(a)) + F.size(every(b)) > 0, label) for (a, b), label in GROK_RESULTS]
    by_card = F.map_from_entries(F.transform(F.array_distinct(F.transform(cards, lambda c: c["id"])), lambda i: F.struct(i, F.get(F.filter(cards, lambda c: c["id"] == i), -1 + F.size(F.filter(cards, lambda c: c["id"] == i)))["url"])))
    about = lambda c: F.concat_ws(", ", F.nullif(_first_of(c["mime_type"], c["content_type"]), F.lit("")), F.concat(c["file_size"].cast("string"), F.lit(" o")))
    made = F.filter("cards", lambda c: F.coalesce((c["type"] == "render_file"), F.lit(False)) | F.coalesce(c["cardType"] == "rendered_file_card", F.lit(False)))
    files = F.array_join(F.transform(made, lambda c: F.concat(F.lit("Fichier généré : "), F.coalesce(F.nullif(T.strip(c["file_name"]), F.lit("")), F.lit("fichier")), F.when(about(c) != "", F.concat(F.lit(" ("), about(c), F.lit(")"))).otherwise(""))), "\n")
    url = lambda key: F.when(key.rlike("^https?://"), key).otherwise(F.concat(F.lit(GROK_ASSETS + "/"), F.ltrim(key, F.lit("/"))))
    link = lambda key, name, mime: F.when(_first_of(key) != "", F.concat(F.when(F.lower(T.strip(F.coalesce(mime, F.lit("")))).startswith("image/"), "![").otherwise("["), F.replace(F.replace(F.coalesce(F.nullif(_first_of(name), F.lit("")), F.lit("fichier")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]")), F.lit("]("), url(T.strip(key)), F.lit(")")))
    rich = _distinct(F.transform("r.fileAttachmentAssetMetadata", lambda x: link(x["key"], x["name"], x["mimeType"])))
    plain = _distinct(F.transform("r.fileAttachmentsMetadata", lambda x: link(x["fileUri"], x["fileName"], x["fileMimeType"])))
    drawn = _distinct(F.transform("r.generatedImageUrls", lambda u: F.when(_first_of(u) != "", F.concat(F.lit("![image]("), url(T.strip(u)), F.lit(")")))))
    attached = F.array_join(_distinct(F.concat(F.when(F.size(rich) > 0, rich).otherwise(plain), drawn)), "\n\n")
    wrong = F.coalesce(F.get(_each(F.when(F.size("r.streamErrors") > 0, F.col("r.streamErrors")).otherwise(F.col("r.metadata.request_metadata.stream_errors")), lambda e: T.strip(e["message"])), 0), F.lit(""))
    said = T.clean_vendor_text(render_citations(F.coalesce(F.col("r.message"), F.lit("")), by_card))
    rows = rows.withColumns({"said": said, "files": files, "attached": attached}).withColumn("texte", _first_of(F.col("said"), wrong, F.col("files"), F.col("attached")))
    for more in ("files", "attached"):
        rows = rows.withColumn("texte", F.when((F.col("texte") == "") | F.contains("texte", more), F.col("texte")).otherwise(F.concat_ws("\n\n", "texte", more)))
    titles = _each(F.filter("cards", lambda c: F.lower(F.concat_ws(" ", c["type"], c["cardType"])).rlike(GROK_ARTIFACTS)), lambda c: _first_of(c["file_name"], c["title"]))
    rows = rows.where((role == "assistant") | (F.col("texte") != ""))
    return finish(
        rows, [F.col("at")], keep_empty=True, message_id=F.coalesce(F.col("r.responseId"), F.lit("")), role=role, model=F.col("r.model"), ts=T.parse_iso(F.col("r.createTime")), texte=F.col("texte"), artifacts=titles,
        tools=_distinct(F.concat(F.transform(named, lambda n: tool_label(n, GROK_TOOLS, True)), F.array(*told))), sources=F.when(F.size(cited) > 0, cited).otherwise(found),
    )


_FOUND, _MEDIA = "array<struct<name:string,url:string,is_attachment:boolean,is_image:boolean>>", "array<struct<name:string,caption:string,medium:string,url:string,image:string,original_image_url:string,thumbnail:string>>"
_SHOWN = f"struct<media_items:{_MEDIA},generated_media_items:{_MEDIA}>"
PERPLEXITY = (
    "entries array<struct<uuid:string,query_str:string,display_model:string,user_selected_model:string,entry_created_datetime:string,entry_updated_datetime:string,sources:struct<sources:array<string>>,blocks:array<struct<intended_usage:string,"
    f"markdown_block:struct<answer:string,chunks:array<string>,chunk_starting_offset:string>,web_result_block:struct<web_results:{_FOUND}>,sources_mode_block:struct<web_results:{_FOUND}>,"
    f"workflow_block:struct<steps:array<struct<title:string,items:array<struct<type:string,payload:struct<text_payload:struct<variant:string,text:string>,sources_payload:struct<sources:{_FOUND}>>>>>>>,"
    "unified_assets_block:struct<assets:array<struct<asset_type:string,code_file:struct<filename:string,name:string>,image:struct<url:string,name:string>,url:string,name:string>>>,"
    f"media_block:{_SHOWN},image_mode_block:{_SHOWN},video_mode_block:{_SHOWN},inline_entity_block:struct<media_block:struct<media_items:{_MEDIA}>>>>>>"
)
#: Segments of an answer that was sent in pieces, and the block that holds all of it; kinds of steps; extensions of images; most sources of an answer. Fixed values.
SEGMENT, WHOLE, STEP_TEXT, STEP_SOURCES, IMAGE_NAME, MOST_SOURCES = r"^ask_text_(\d+)_markdown$", "ask_text", "WORKFLOW_ITEM_TEXT", "WORKFLOW_ITEM_SOURCES", r"(?i)\.(png|jpe?g|gif|webp|bmp|svg|avif|heic|heif)$", 40


def first_by(c: Column, key) -> Column:
    """Of the elements of an array with one key the first; those without a key leave. c must be a column, as it is read again for each."""
    keys = F.transform(c, key)
    return F.filter(c, lambda x, i: (F.coalesce(key(x), F.lit("")) != "") & (F.array_position(keys, key(x)) == i + 1))


def _first_of(*cols: Column) -> Column:
    """The first text that isn't blank, stripped."""
    return F.coalesce(*(F.nullif(T.strip(c), F.lit("")) for c in cols), F.lit(""))


def assembled_answer(blocks: Column) -> Column:
    """The answer of an entry's blocks: what its steps say is one; else the last whole block that has a text; else the segments by offset, then number. A block whose text was never fixed has that of its chunks."""
    text = lambda b: F.when(T.strip(F.coalesce(b["answer"], F.lit(""))) != "", b["answer"]).otherwise(T.strip(F.array_join(F.coalesce(b["chunks"], F.expr(_NONE)), "")))
    whole = F.try_element_at(F.filter(blocks, lambda b: (b["intended_usage"] == WHOLE) & b["markdown_block"].isNotNull()), F.lit(-1))
    parts = F.filter(blocks, lambda b: b["intended_usage"].rlike(SEGMENT) & b["markdown_block"].isNotNull())
    placed = F.transform(parts, lambda b: F.struct(F.coalesce(b["markdown_block"]["chunk_starting_offset"].try_cast("long"), F.lit(0)).alias("offset"), F.regexp_extract(b["intended_usage"], SEGMENT, 1).try_cast("long").alias("number"), text(b["markdown_block"]).alias("text")))
    segments = F.array_join(F.transform(F.array_sort(F.filter(placed, lambda x: x["text"] != "")), lambda x: x["text"]), "\n")
    steps = F.flatten(F.transform(F.filter(blocks, lambda b: b["workflow_block"]["steps"].isNotNull()), lambda b: b["workflow_block"]["steps"]))
    items = F.filter(F.flatten(F.filter(F.transform(steps, lambda s: s["items"]), lambda x: x.isNotNull())), lambda i: (i["type"] == STEP_TEXT) & (i["payload"]["text_payload"]["variant"] == "answer"))
    said = F.array_join(F.filter(F.transform(items, lambda i: T.strip(i["payload"]["text_payload"]["text"])), lambda x: x != ""), "\n\n")
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(text(whole["markdown_block"]), F.lit("")), segments, F.lit(""))


def perplexity(payloads: DataFrame) -> DataFrame:
    """Entries, each a question with its attached files and an answer, with what its blocks show. Files of the thread that a later entry only lists aren't attached to it; an answer that used tools and nothing else is left out."""
    rows = _read(payloads, PERPLEXITY).select("conversation_id", F.posexplode("p.entries").alias("at", "e")).where("e IS NOT NULL")
    some = lambda c, kind: F.coalesce(c, F.expr(f"CAST(array() AS {kind})"))
    every = lambda c, kind, f: F.flatten(F.transform(c, lambda x: some(f(x), kind)))
    blocks = F.filter(F.coalesce("e.blocks", F.expr("CAST(array() AS " + PERPLEXITY.split("blocks:", 1)[1][:-2] + ")")), lambda b: b.isNotNull())
    steps_kind = PERPLEXITY.split("workflow_block:struct<steps:", 1)[1].split(">,unified_assets_block", 1)[0]
    rows = rows.select("conversation_id", "at", "e", blocks.alias("b"), every(blocks, steps_kind, lambda b: b["workflow_block"]["steps"]).alias("steps"))
    items_kind = steps_kind.split("items:", 1)[1][:-2]
    shown = lambda b: F.concat(*(some(b[k][f], _MEDIA) for k in ("media_block", "image_mode_block", "video_mode_block") for f in ("media_items", "generated_media_items")), some(b["inline_entity_block"]["media_block"]["media_items"], _MEDIA))
    context = every(F.filter(every(F.col("steps"), items_kind, lambda s: s["items"]), lambda i: i["type"] == STEP_SOURCES), _FOUND, lambda i: i["payload"]["sources_payload"]["sources"])
    asset_kind = PERPLEXITY.split("assets:", 1)[1].split(">,media_block", 1)[0]
    video = lambda m: F.coalesce(m["medium"], F.lit("image")) == "video"
    media = F.transform(every(F.col("b"), _MEDIA, shown), lambda m: F.struct(video(m).alias("video"), F.when(video(m), _first_of(m["url"])).otherwise(_first_of(m["image"], m["original_image_url"], m["thumbnail"])).alias("url"), _first_of(m["name"], m["caption"]).alias("name")))
    rows = rows.select(
        "conversation_id", "at", "e", "b", "steps", every(F.col("b"), _FOUND, lambda b: F.concat(some(b["web_result_block"]["web_results"], _FOUND), some(b["sources_mode_block"]["web_results"], _FOUND))).alias("own"), context.alias("context"),
        F.filter(every(F.col("b"), asset_kind, lambda b: b["unified_assets_block"]["assets"]), lambda a: a.isNotNull()).alias("assets"), F.filter(media, lambda m: m["url"].rlike("^https?://")).alias("media"),
    )
    key = lambda r: _first_of(r["url"], r["name"])
    rows = rows.withColumn("own", first_by(F.col("own"), key)).withColumn("found", F.concat("own", first_by(F.col("context"), key))).withColumn("found", first_by(F.col("found"), key)).withColumn("media", first_by(F.col("media"), lambda m: m["url"]))
    attached = lambda r: F.coalesce(r["is_attachment"], F.lit(False))
    name = lambda r: F.coalesce(F.nullif(T.strip(r["name"]), F.lit("")), F.lit("fichier"))
    picture = lambda r: F.coalesce(r["is_image"], F.lit(False)) | name(r).rlike(IMAGE_NAME) | F.split(T.strip(r["url"]), r"\?", 2)[0].rlike(IMAGE_NAME)
    file = lambda r: F.when(T.strip(F.coalesce(r["url"], F.lit(""))) == "", name(r)).otherwise(F.concat(F.when(picture(r), "![").otherwise("["), name(r), F.lit("]("), T.strip(r["url"]), F.lit(")")))
    files = F.array_join(_each(F.filter("own", attached), file), "\n\n")
    kind = lambda a: F.coalesce(a["asset_type"], F.lit(""))
    made = F.transform(F.filter("assets", lambda a: kind(a).contains("IMAGE") & _first_of(a["image"]["url"], a["url"]).rlike("^https?://")), lambda a: F.concat(F.lit("!["), F.coalesce(F.nullif(_first_of(a["image"]["name"], a["name"]), F.lit("")), F.lit("image")), F.lit("]("), _first_of(a["image"]["url"], a["url"]), F.lit(")")))
    media = lambda moving: F.transform(F.filter("media", lambda m: m["video"] == moving), lambda m: F.concat(F.lit("[" if moving else "!["), F.coalesce(F.nullif(m["name"], F.lit("")), m["url"] if moving else F.lit("image")), F.lit("]("), m["url"], F.lit(")")))
    images = F.array_join(_distinct(F.concat(made, media(False), media(True))), "\n\n")
    pages = F.filter("found", lambda r: ~attached(r))
    sources = F.slice(_distinct(F.transform(F.filter(pages, lambda r: T.strip(r["url"]).rlike("^https?://")), lambda r: T.source_entry(T.strip(r["name"]), T.strip(r["url"])))), 1, MOST_SOURCES)
    searched = F.coalesce(F.exists(some(F.col("e.sources.sources"), "array<string>"), lambda s: F.lower(s) == "web"), F.lit(False)) | (F.size(pages) > 0)
    tools = _distinct(F.concat(F.array(F.when(searched, "Recherche")), F.transform("assets", lambda a: F.when(kind(a) == "CODE_ASSET", "Code").when(kind(a).contains("IMAGE"), "Génération d'image"))))
    both = lambda *cols: T.strip(F.concat_ws("\n\n", *(F.nullif(c, F.lit("")) for c in cols)))
    none = F.expr(_NONE)
    half = lambda k, role, said, when, reasoning, tools, src, art: F.struct(F.lit(k).alias("half"), F.lit(role).alias("role"), said.alias("said"), when.alias("at"), reasoning.alias("reasoning"), tools.alias("tools"), src.alias("sources"), art.alias("artifacts"))
    rows = rows.withColumns({
        "asked": both(T.math(T.strip(F.coalesce("e.query_str", F.lit("")))), files), "answer": both(T.math(assembled_answer(F.col("b"))), images), "reasoning": F.array_join(_each(F.col("steps"), lambda s: T.strip(s["title"])), "\n\n"),
        "artifacts": _each(F.col("assets"), lambda a: _first_of(a["code_file"]["filename"], a["code_file"]["name"])), "sources": sources, "tools": tools,
    })
    halves = F.array(half(0, "user", F.col("asked"), F.col("e.entry_created_datetime"), F.lit(""), none, none, none), half(1, "assistant", F.col("answer"), F.col("e.entry_updated_datetime"), F.col("reasoning"), F.col("tools"), F.col("sources"), F.col("artifacts")))
    turns = rows.select("conversation_id", "at", F.col("e.uuid").alias("uuid"), F.nullif(_first_of(F.col("e.display_model"), F.col("e.user_selected_model")), F.lit("")).alias("model"), F.explode(halves).alias("t"))
    turns = turns.where("t.said <> '' OR t.reasoning <> '' OR size(t.sources) > 0 OR size(t.artifacts) > 0")
    return finish(turns, [F.col("at"), F.col("t.half")], keep_empty=True, message_id=F.coalesce("uuid", F.lit("")), role=F.col("t.role"), model=F.col("model"), ts=T.parse_iso(F.col("t.at")), texte=F.col("t.said"), reasoning=F.col("t.reasoning"), tools=F.col("t.tools"), sources=F.col("t.sources"), artifacts=F.col("t.artifacts"))


_CANVAS = "struct<id:string,version:string,title:string,type:string,content:string>"
MISTRAL = (
    "messages struct<items:array<struct<id:string,version:int,parentId:string,parentVersion:int,role:string,createdAt:string,content:string,references:array<struct<url:string,title:string>>,citedSources:array<struct<url:string,title:string>>,"
    "contentChunks:array<struct<type:string,text:string,id:string,version:string,name:string,fileUrl:string,fileAlt:string,imageUrl:string,_context:struct<type:string>,element:struct<type:string,attributes:struct<title:string>>,"
    "publicMetadata:struct<display:struct<kind:string>>,publicResult:struct<results:array<struct<url:string,title:string>>>>>,files:array<struct<name:string,url:string>>>>>, "
    f"chat struct<id:string,model:string>, canvases struct<items:array<{_CANVAS}>>"
)
#: Names of tools, starts of names, and those whose results are sources. Fixed values.
MISTRAL_TOOLS = {
    "web_search": "Recherche web", "open_search_results": "Résultats de recherche", "open_url": "Ouverture de page web", "search_tool_functions": "Recherche d'outil", "code_interpreter": "Exécution de code", "run_typescript": "Exécution de code", "bash": "Exécution de code",
    "generate_image": "Génération d'image", "image_generation": "Génération d'image", "analyze_image": "Analyse d'image", "write_canvas": "Canvas", "read_file": "Lecture de fichier", "write_file": "Écriture de fichier", "search_replace": "Modification de fichier",
    "skill": "Compétence", "read_resource": "Connecteur", "library_search": "Bibliothèque", "library_list": "Bibliothèque",
}
MISTRAL_STARTS = {"gmail": "Gmail", "github": "GitHub", "google_calendar": "Google Agenda", "library": "Bibliothèque"}
MISTRAL_FINDS = ("web_search", "open_search_results", "open_url")


def _mistral_tool(chunk: Column) -> Column:
    """What the step of a chunk is called; empty for a name that can't be one."""
    name = T.strip(F.coalesce(chunk["name"], F.lit("")))
    made = F.when((name != "") & F.lower(F.concat_ws(" ", chunk["publicMetadata"]["display"]["kind"], name)).contains("canvas"), "Canvas")
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in MISTRAL_TOOLS.items() for x in kv)), name)
    begins = F.coalesce(*(F.when(F.lower(name).startswith(k), F.lit(v)) for k, v in MISTRAL_STARTS.items()))
    return F.when(chunk["type"] == "canva", "Canvas").when(chunk["type"] == "tool_call", F.coalesce(made, known, begins, F.when(name.rlike(r"^[A-Za-z0-9_.\-]{1,60}$"), name), F.lit("")))


def _mistral_text(m: Column, canvases: Column) -> Column:
    """Text of an item: its chunks, else the canvas that it made, else its content as a whole; a question's content comes first."""
    url = lambda c, f: T.strip(F.coalesce(c[f], F.lit("")))
    alt = lambda c: F.coalesce(F.nullif(T.strip(F.coalesce(c["fileAlt"], F.lit(""))), F.lit("")), url(c, "fileUrl"))
    part = lambda c: (
        F.when((c["type"] == "text") & ~F.coalesce(c["_context"]["type"] == "reasoning", F.lit(False)), T.strip(c["text"]))
        .when((c["type"] == "file_reference") & (url(c, "fileUrl") != ""), F.concat(F.lit("["), F.replace(F.replace(alt(c), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]")), F.lit("]("), url(c, "fileUrl"), F.lit(")")))
        .when((c["type"] == "image_url") & (url(c, "imageUrl") != ""), F.concat(F.lit("![image]("), url(c, "imageUrl"), F.lit(")")))
        .when((c["type"] == "custom_element") & (c["element"]["type"] == "table-metadata"), T.strip(c["element"]["attributes"]["title"]))
    )
    chunks = _joined(F.transform(m["contentChunks"], part))
    canvas = F.get(F.filter(F.transform(F.filter(m["contentChunks"], lambda c: c["type"] == "canva"), lambda c: _canvas_of(c, canvases)), lambda x: x.isNotNull()), 0)["content"]
    return F.when(m["role"] == "user", _first_of(m["content"], chunks)).otherwise(_first_of(chunks, canvas, m["content"]))


def _canvas_of(chunk: Column, canvases: Column) -> Column:
    version = lambda x: F.coalesce(x["version"].try_cast("int"), F.lit(0))
    return F.get(F.filter(canvases, lambda x: (x["id"] == chunk["id"]) & (version(x) == version(chunk))), 0)


def mistral(payloads: DataFrame) -> DataFrame:
    """Versioned items, along the parents of the newest one, with the other versions of each as variants; a missing parent's version is 0. Answers have the canvases that their chunks name, their steps, and as sources their references, what their steps found and what they cite."""
    p = _read(payloads, MISTRAL)
    rows = p.select("conversation_id", F.coalesce("p.canvases.items", F.expr(f"CAST(array() AS array<{_CANVAS}>)")).alias("canvases"), F.explode("p.messages.items").alias("m")).where("m IS NOT NULL")
    flat = rows.select("conversation_id", "canvases", F.concat_ws("@", "m.id", F.coalesce("m.version", F.lit(0)).cast("string")).alias("id"), F.when(F.col("m.parentId").isNotNull(), F.concat_ws("@", "m.parentId", F.coalesce("m.parentVersion", F.lit(0)).cast("string"))).alias("parent"), "m")
    flat = flat.withColumn("k", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.col("m.createdAt").desc_nulls_last(), F.col("id").desc())))
    files = F.transform("m.files", lambda f: F.concat(F.lit("["), f["name"], F.lit("]("), f["url"], F.lit(")")))
    answer = F.col("m.role") == "assistant"
    flat = flat.withColumn("said", T.math(_joined(F.array(_mistral_text(F.col("m"), F.col("canvases")), _joined(files)))))
    same = Window.partitionBy("conversation_id", F.when(answer, F.concat_ws("@", F.lit("p"), F.coalesce("parent", F.lit("")))).otherwise(F.concat_ws("@", F.lit("i"), "m.id")))
    kind = F.when(answer, "regeneration").otherwise("edit")
    flat = flat.withColumn("variants", _variants(same, F.coalesce("m.version", F.lit(0)), kind, F.col("said"), T.parse_iso(F.col("m.createdAt")), F.col("id"), F.col("id"), F.col("m.id")))
    walk = follow(flat.withColumns({"next": F.col("parent"), "start": F.col("k") == 1}), "id")
    on, none = flat.join(walk, ["conversation_id", "id"]), F.expr(_NONE)
    thinks = lambda c: (c["type"] == "reasoning") | (c["type"] == "text") & F.coalesce(c["_context"]["type"] == "reasoning", F.lit(False))
    why = T.math(_joined(F.transform(F.filter("m.contentChunks", thinks), lambda c: T.strip(c["text"]))))
    named = lambda x: F.when((_first_of(x["title"]) != "") & (_first_of(x["type"]) != ""), F.concat(_first_of(x["title"]), F.lit(" ("), _first_of(x["type"]), F.lit(")"))).otherwise(_first_of(x["title"], x["type"]))
    artifacts = _each(F.filter("m.contentChunks", lambda c: c["type"] == "canva"), lambda c: named(_canvas_of(c, F.col("canvases"))))
    pair = "array<struct<url:string,title:string>>"
    some = lambda c: F.coalesce(c, F.expr(f"CAST(array() AS {pair})"))
    results = F.flatten(F.transform(F.filter("m.contentChunks", lambda c: (c["type"] == "tool_call") & c["name"].isin(*MISTRAL_FINDS)), lambda c: some(c["publicResult"]["results"])))
    on = on.withColumn("found", F.filter(F.concat(some(F.col("m.references")), some(results), some(F.col("m.citedSources"))), lambda x: T.strip(x["url"]).rlike("^https?://")))
    on = on.withColumn("found", first_by(F.col("found"), lambda x: T.strip(x["url"])))
    title = lambda x: T.collapse(F.coalesce(x["title"], F.lit("")))
    sources = F.slice(F.transform("found", lambda x: F.when((title(x) != "") & ~F.contains(T.strip(x["url"]), title(x)), F.concat(title(x), F.lit(" — "), T.strip(x["url"]))).otherwise(F.coalesce(F.nullif(title(x), F.lit("")), T.strip(x["url"])))), 1, MOST_SOURCES)
    only = lambda c: F.when(answer, c).otherwise(none)
    return finish(
        on, [-F.col("depth")], variants=F.col("variants"), message_id=F.col("m.id"), role=F.col("m.role"), ts=T.parse_iso(F.col("m.createdAt")), texte=F.col("said"), reasoning=F.when(answer, why).otherwise(""),
        tools=only(_each(F.col("m.contentChunks"), _mistral_tool)), sources=only(sources), artifacts=only(artifacts),
    )


def attach_thread_sources(messages: DataFrame, thread: DataFrame) -> DataFrame:
    """Messages (conversation_id, pos, role, sources, source_count) with the sources of their thread (conversation_id, place, title, url), which don't say whose they are.

    A source goes to the first answer that has its address, else to the last one with sources; if none has any, to the last whose count is that of the thread's sources, else to the last answer.
    """
    answers = messages.where("role = 'assistant'")
    count = thread.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    of = answers.join(count, "conversation_id").groupBy("conversation_id").agg(F.max(F.when(F.size("sources") > 0, F.col("pos"))).alias("inline"), F.max(F.when(F.col("source_count") == F.col("n"), F.col("pos"))).alias("counted"), F.max("pos").alias("last"))
    url = F.regexp_replace("entry", r"^(?s:.*) — (?=\S+$)", "")
    first = answers.select("conversation_id", "pos", F.explode("sources").alias("entry")).groupBy("conversation_id", url.alias("url")).agg(F.min("pos").alias("own"))
    dealt = thread.join(of, "conversation_id").join(first, ["conversation_id", "url"], "left")
    target = F.when(F.col("inline").isNotNull(), F.coalesce("own", "inline")).otherwise(F.coalesce("counted", "last"))
    has, entry = F.coalesce(F.col("own") == target, F.lit(False)), F.struct("place", "url", T.source_entry(F.col("title"), F.col("url")).alias("entry"))
    more = dealt.groupBy("conversation_id", target.alias("pos")).agg(F.sort_array(F.collect_list(F.when(~has, entry))).alias("more"), F.collect_list(F.when(has, entry)).alias("known"))
    rows = messages.join(more, ["conversation_id", "pos"], "left")
    titled = F.transform("sources", lambda s: F.coalesce(F.get(F.filter("known", lambda k: k["url"] == s), 0)["entry"], s))  # an address that a message has already only gains its title
    return rows.withColumn("sources", F.array_distinct(F.concat(titled, F.coalesce(F.transform("more", lambda x: x["entry"]), F.expr(_NONE))))).drop("more", "known").select(*messages.columns)


#: Kinds of variants. Fixed values.
KINDS = ("edit", "regeneration")


def valid_variants(variants: Column) -> Column:
    """Whether all variants of a message are of a known kind and have a text."""
    return F.coalesce(F.forall(variants, lambda v: F.coalesce(v["kind"].isin(*KINDS), F.lit(False)) & v["texte"].isNotNull()), F.lit(True))


def gemini(payloads: DataFrame) -> DataFrame:
    """Turns of untyped nested lists: questions with their files, answers with what their marks stand for. An answer without anything stays, so that two questions don't become one."""
    rows = positional.messages(payloads)
    said = {c: F.col(c) for c in ("message_id", "role", "model", "ts", "tools", "sources", "artifacts")}
    return finish(rows, [F.col("at"), F.col("half")], keep_empty=True, texte=F.col("texte"), **said)


MAPPERS = {"chatgpt": chatgpt, "claude": claude, "gemini": gemini, "grok": grok, "mistral": mistral, "perplexity": perplexity}

#: Elements that pages lose, signs of emphasis, and elements that end a line. Fixed values.
DROPPED = frozenset(("script", "style", "noscript", "iframe", "button", "svg", "textarea"))
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}
BLOCKS = frozenset(("p", "div", "section", "article", "header", "footer", "main", "nav", "blockquote", "tr", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "hr", "title"))


class Markdown(HTMLParser):
    """A page as Markdown: headings, lists by depth, tables of one width, fences, links, images and emphasis. An element left open ends with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.lists, self.links, self.fence = 0, [], [], 0
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.title, self.in_title = "", False

    def put(self, s: str) -> None:
        (self.out if self.cell is None else self.cell).append(s)

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in DROPPED:
            self.skip += 1
        if self.skip:
            return
        if tag == "title":
            self.in_title = True
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "pre":
            self.fence += 1
            self.put(f"\n\n```{at.get('data-language') or ''}\n")
        elif tag == "code" and not self.fence:
            self.put("`")
        elif tag in EMPHASIS and not self.fence:
            self.put(EMPHASIS[tag])
        elif tag in ("ul", "ol"):
            start = at.get("start") or "1"
            self.lists.append([tag, int(start) if start.lstrip("-").isdigit() else 1])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 1]
            self.put("\n" + "  " * max(0, len(self.lists) - 1) + (at.get("data-mark") or (f"{kind[1]}. " if kind[0] == "ol" else "- ")))
            kind[1] += 1
        elif tag == "a":
            href = at.get("href") or ""
            self.links.append(href if href.split(":")[0] in ("http", "https", "mailto") else "")
            if self.links[-1]:
                self.put("[")
        elif tag == "img":
            src = at.get("src") or ""
            if src and not src.startswith(("blob:", "data:")):
                self.put(f"![{at.get('alt') or ''}]({src})")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []
        elif tag[0] == "h" and tag[1:].isdigit():
            self.put("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in BLOCKS:
            self.put("\n\n")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "title":
            self.in_title = False
        elif tag == "pre" and self.fence:
            self.fence -= 1
            self.put("\n```\n\n")
        elif tag == "code" and not self.fence:
            self.put("`")
        elif tag in EMPHASIS and not self.fence:
            self.put(EMPHASIS[tag])
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            if not self.lists:
                self.put("\n\n")
        elif tag == "a" and self.links:
            if href := self.links.pop():
                self.put(f"]({href})")
        elif tag in ("td", "th") and self.cell is not None:
            cell, self.cell = " ".join("".join(self.cell).split()), None
            self.rows[-1].append(cell)
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.cell = [r for r in self.rows if r], None, None
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            self.put("\n\n" + "\n".join(lines[:1] + ["| " + " | ".join(["---"] * width) + " |"] * bool(lines) + lines[1:]) + "\n\n")
        elif tag in BLOCKS and tag != "li":
            self.put("\n\n")

    def raw(self, markdown: str) -> None:
        """Markdown as it is."""
        if not self.skip:
            self.put(markdown)

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.put(data if self.fence else " ".join(data.split()) and (" " * data[:1].isspace() + " ".join(data.split()) + " " * data[-1:].isspace()) or (" " if data else ""))

    def said(self) -> str:
        lines, fence, out = "".join(self.out).replace("\xa0", " ").split("\n"), False, []
        for line in lines:
            if line.lstrip().startswith("```"):
                fence = not fence
                line = line.strip()
            elif not fence:
                line = line.rstrip() if line.lstrip()[:2] in ("- ",) or line.lstrip()[:1].isdigit() else line.strip()
            if line or fence or not out or out[-1]:
                out.append(line)
        return "\n".join(out).strip()


def to_markdown(html: str) -> tuple[str, str]:
    """(title, text) of a page."""
    page = Markdown()
    page.feed(html or "")
    page.close()
    return " ".join(page.title.split()), page.said()


def html_to_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, markdown) of each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [to_markdown(h) for h in frame[html_col]]
            yield pd.DataFrame({id_col: frame[id_col], "title": [a for a, _ in made], "markdown": [b for _, b in made]})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {dict(pages.dtypes)[id_col]}, title string, markdown string")


def page_links(pages: DataFrame, pattern: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Links of pages whose address matches, once each in order: (page, place, url, title)."""
    link = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    both = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(link), F.lit(1)).alias("url"), F.regexp_extract_all(html_col, F.lit(link), F.lit(2)).alias("label"))
    rows = pages.select(id_col, F.posexplode(both).alias("at", "x")).select(id_col, "at", "x.url", T.ui_title(T.html_text(F.col("x.label"))).alias("title")).where(F.col("url").rlike(pattern))
    return rows.groupBy(id_col, "url").agg(F.min("at").alias("place"), F.min_by("title", "at").alias("title"))

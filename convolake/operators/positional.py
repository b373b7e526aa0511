"""Payloads of untyped nested lists as typed rows: one walk finds the nodes by their form and gives a struct for each turn; everything after it is column functions.

A turn is [ids of the question, ids of the answer, question, answer, time]. Places inside the answer move from request to request, so nodes are known by what they look like:
a file is a list that begins null, number, name; a candidate's fields sit in objects anywhere below it, of which the first with a key counts.

A payload that is null, no JSON or without turns has no messages; a turn that is no list is passed over. The walk keeps its own stack, so lists may be nested to any depth that JSON readers take.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions import markdown as MD
from convolake.functions import text as T

#: Identifiers of tools and what they are called; words in a label that tell that a tool made an image; what a video and a drawing are called. Fixed values.
TOOLS = {"google": "Recherche web", "data_analysis_tool": "Exécution de code", "image_generation_tool": "Génération d'images", "canvas_tool": "Canvas", "video_tool": "Analyse vidéo"}
IMAGE_WORDS, IMAGE_TOOL, VIDEO_TOOL, CANVAS, DRAWING = ("image", "imagen", "banana"), "Génération d'images", "Analyse vidéo", "Canvas", "SVG"
#: Keys of a candidate's fields: citations, generated files. How marks begin; what an address of a made image and a model contain; what addresses of previews and of downloads contain. Fixed values.
CITATIONS, FILES = "44", "59"
CITE, TAG, MADE, MODEL = "[cite:", "[file-tag:", "image_generation_content", "gemini-"
PREVIEW, DOWNLOAD = "googleusercontent.com/gg/", "contribution.usercontent.google.com/download"

FILE = pa.struct([("name", pa.string()), ("mime", pa.string()), ("own", pa.string()), ("urls", pa.list_(pa.string()))])
MARKED = pa.list_(pa.struct([("mark", pa.string()), ("file", FILE)]))
TURN = pa.struct([
    ("question_id", pa.string()), ("parts", pa.list_(pa.string())), ("files", pa.list_(FILE)), ("answer_id", pa.string()), ("chunks", pa.list_(pa.string())), ("citations", MARKED), ("tags", MARKED), ("made", MARKED),
    ("tools", pa.list_(pa.struct([("name", pa.string()), ("label", pa.string())]))), ("model", pa.string()), ("seconds", pa.float64()), ("nanos", pa.float64()),
])


def children(node) -> list:
    """What is right below a node, in order."""
    return node if isinstance(node, list) else list(node.values()) if isinstance(node, dict) else []


def walk(node) -> Iterator:
    """Lists and objects from a node downwards, each before what it holds."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, (list, dict)):
            yield x
            todo.extend(reversed(children(x)))


def at(node, *path: int):
    """The node at a path of places, or None."""
    for k in path:
        if not isinstance(node, list) or not -len(node) <= k < len(node):
            return None
        node = node[k]
    return node


def number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def is_file(node) -> bool:
    return isinstance(node, list) and len(node) >= 4 and node[0] is None and isinstance(node[1], int) and isinstance(node[2], str) and node[2] != ""


def file_of(node: list) -> dict:
    mime = next((x for x in node[3:] if isinstance(x, str) and "/" in x and len(x) < 64), "")
    return {"name": node[2], "mime": mime, "own": node[3] if isinstance(node[3], str) else "", "urls": [u for u in at(node, 7) or [] if isinstance(u, str) and u.startswith("http")] if isinstance(at(node, 7), list) else []}


def shown(file: dict) -> bool:
    """Whether a file has anything to show: an image without an address has not."""
    return not file["mime"].startswith("image/") or file["own"].startswith("http")


def files_below(node) -> list[dict]:
    """Files from a node downwards; what is inside of a file is none."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if is_file(x):
            out.append(file_of(x))
        else:
            todo.extend(reversed(children(x)))
    return out


def marked_files(entries, begins: str) -> list[dict]:
    """Of each entry the first mark that begins so, and the first file."""
    out = []
    for entry in entries if isinstance(entries, list) else []:
        mark = next((s for node in walk(entry) for s in children(node) if isinstance(s, str) and s.startswith(begins)), None)
        files = files_below(entry)
        if mark and files:
            out.append({"mark": mark, "file": files[0]})
    return out


def made_images(candidate) -> list[dict]:
    """Addresses that stand for made images, each with the first file of the smallest node that holds both: nodes are closed from below, so that each knows its size, its addresses and its file."""
    best: dict[str, tuple[int, dict]] = {}
    todo: list[tuple] = [(candidate, False)]
    closed: list[tuple[int, list[str], dict | None]] = []
    while todo:
        node, left = todo.pop()
        below = [x for x in children(node) if isinstance(x, (list, dict))]
        if not left:
            todo.append((node, True))
            todo.extend((x, False) for x in reversed(below))
            continue
        own = closed[len(closed) - len(below) :]
        del closed[len(closed) - len(below) :]
        urls = [s for s in children(node) if isinstance(s, str) and MADE in s and s.startswith("http") and not any(map(str.isspace, s))] + [u for x in own for u in x[1]]
        file = file_of(node) if is_file(node) else next((x[2] for x in own if x[2]), None)
        size = 1 + sum(x[0] for x in own)
        if file and shown(file):
            for u in urls:
                if u not in best or size < best[u][0]:
                    best[u] = size, file
        closed.append((size, urls, file))
    return [{"mark": u, "file": f} for u, (_, f) in best.items()]


def turn_of(turn: list) -> dict:
    """A turn as its struct."""
    content, answer = at(turn, 2), at(turn, 3)
    first = at(content, 0)
    parts = [content] if isinstance(first, str) else [p for p in first if isinstance(p, list)] if isinstance(at(first, 0), list) else [first] if isinstance(first, list) else []
    candidate = at(answer, 0, 0)
    candidate = candidate if isinstance(candidate, list) else None
    fields: dict = {}
    for node in walk(candidate):
        if isinstance(node, dict):
            for key in (CITATIONS, FILES):
                if key in node:
                    fields.setdefault(key, node[key])
    groups = [g for p in parts for g in (at(p, 4) if isinstance(at(p, 4), list) else [])]
    steps = [at(e, 1) for k in (4, 5) for e in (at(answer, k) if isinstance(at(answer, k), list) else []) if len(turn) > 4 and isinstance(at(e, 1), list)]
    said = at(candidate, 0) if isinstance(at(candidate, 0), str) else at(answer, 3)
    model = next((x for x in reversed(answer) if isinstance(x, str) and x.startswith(MODEL)), None) if isinstance(answer, list) else None
    return {
        "question_id": str(at(turn, 0, 1) or ""), "parts": [at(p, 0) for p in parts if isinstance(at(p, 0), str)], "files": [f for g in groups if isinstance(at(g, 3), list) for f in files_below(g[3])],
        "answer_id": str(said or "") if not isinstance(said, (list, dict)) else "", "chunks": [c for c in (at(candidate, 1) if isinstance(at(candidate, 1), list) else []) if isinstance(c, str)],
        "citations": marked_files(fields.get(CITATIONS), CITE), "tags": marked_files(fields.get(FILES), TAG), "made": made_images(candidate) if candidate else [],
        "tools": [{"name": at(s, 0) if isinstance(at(s, 0), str) else "", "label": " ".join(x for x in at(s, 1) if isinstance(x, str)) if isinstance(at(s, 1), list) else ""} for s in steps if s],
        "model": model, "seconds": float(at(turn, 4, 0)) if number(at(turn, 4, 0)) else None, "nanos": float(at(turn, 4, 1)) if number(at(turn, 4, 1)) else 0.0,
    }


def turns_of(payload: str | None) -> list[dict]:
    """All turns of a payload."""
    try:
        said = json.loads(payload)
    except (TypeError, ValueError):
        return []
    turns = said.get("turns") if isinstance(said, dict) else None
    return [turn_of(t) for t in turns if isinstance(t, list)] if isinstance(turns, list) else []


def read_turns(payloads: DataFrame) -> DataFrame:
    """(conversation_id, at, t) of payloads (conversation_id, payload): a typed turn a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, said in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if turns := turns_of(said):
                    yield pa.RecordBatch.from_arrays([pa.array([cid.as_py()] * len(turns), pa.string()), pa.array(range(len(turns)), pa.int64()), pa.array(turns, TURN)], ["conversation_id", "at", "t"])

    file = "struct<name:string,mime:string,own:string,urls:array<string>>"
    marked = f"array<struct<mark:string,file:{file}>>"
    kind = f"struct<question_id:string,parts:array<string>,files:array<{file}>,answer_id:string,chunks:array<string>,citations:{marked},tags:{marked},made:{marked},tools:array<struct<name:string,label:string>>,model:string,seconds:double,nanos:double>"
    return payloads.select(F.col("conversation_id").cast("string").alias("conversation_id"), "payload").mapInArrow(run, f"conversation_id string, at long, t {kind}")


def file_markdown(file: Column) -> Column:
    """A file as Markdown: an image, or a preview and a link to the download, or else its name."""
    label = MD.escape_label(T.collapse(F.replace(file["name"], F.lit("\\"), F.lit("\\\\"))))
    link = lambda sign, name, url: F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit(sign), name, F.lit("]("), url, F.lit(")")))
    with_ = lambda part: F.get(F.filter(file["urls"], lambda u: u.contains(part)), 0)
    both = F.concat_ws("\n\n", link("![", label, with_(PREVIEW)), link("[", label, with_(DOWNLOAD)))
    image = F.coalesce(F.when(file["own"].startswith("http"), link("![", F.when(label == "", "image").otherwise(label), file["own"])), F.lit(""))
    return F.when(file["mime"].startswith("image/"), image).when(both != "", both).otherwise(label)


def source_label(file: Column) -> Column:
    """A cited file as a source: its kind, then its name."""
    kind = F.when(file["name"].contains("."), F.element_at(F.split(file["name"], r"\."), -1)).when(file["mime"] != "", F.element_at(F.split(file["mime"], "/"), -1))
    return F.when(kind.isNull(), file["name"]).otherwise(F.concat(F.upper(kind), F.lit(": "), file["name"]))


def marks(found: Column, made) -> Column:
    """A map from mark to made(file); of a mark that repeats the last counts, where the first was."""
    said = F.transform(found, lambda x: F.struct(x["mark"].alias("mark"), made(x["file"]).alias("said")))
    said = F.filter(said, lambda x: x["said"] != "")
    each = F.array_distinct(F.transform(said, lambda x: x["mark"]))
    return F.map_from_entries(F.transform(each, lambda m: F.struct(m, F.element_at(F.filter(said, lambda x: x["mark"] == m), -1)["said"])))


def messages(payloads: DataFrame) -> DataFrame:
    """(conversation_id, at, half, message_id, role, model, ts, texte, tools, sources, artifacts): questions with their files, and answers with all that their marks stand for. A question without anything is left out; an answer stays if it has anything or follows a question."""
    rows = read_turns(payloads)
    none = F.expr("CAST(array() AS array<string>)")
    files = F.array_distinct(F.filter(F.transform("t.files", file_markdown), lambda x: x != ""))
    block = F.array_join(files, "\n\n")
    asked = MD.normalise_markdown(F.array_join(F.filter("t.parts", lambda p: p != ""), "\n\n"))
    asked = F.when(block == "", asked).when(asked == "", block).when(F.contains(asked, block), asked).otherwise(F.concat(asked, F.lit("\n\n"), block))
    raw = F.array_join("t.chunks", "\n")
    answer = MD.normalise_markdown(raw, F.map_concat(marks(F.col("t.tags"), file_markdown), marks(F.filter("t.made", lambda m: ~F.exists("t.tags", lambda x: x["mark"] == m["mark"])), file_markdown)))
    rows = rows.select("conversation_id", "at", "t", asked.alias("asked"), answer.alias("answer"), raw.alias("raw"))
    named = F.transform("t.tools", lambda x: F.when((x["name"] == "data_analysis_tool") & F.lower(x["label"]).rlike("|".join(IMAGE_WORDS)), F.lit(IMAGE_TOOL)).otherwise(F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in TOOLS.items() for v in kv)), x["name"]), x["name"])))
    video = F.when(F.exists("t.files", lambda f: f["mime"].startswith("video/")), F.array(F.lit(VIDEO_TOOL))).otherwise(none)
    drawn = F.col("answer").rlike(r"```xml[^\n]*\n[^`]*<svg")
    tools = F.array_distinct(F.filter(F.concat(named, video, F.when(drawn, F.array(F.lit(CANVAS))).otherwise(none)), lambda x: x != ""))
    cited = marks(F.col("t.citations"), source_label)
    sources = F.array_distinct(F.transform(F.filter(F.map_entries(cited), lambda e: F.contains(F.col("raw"), e["key"])), lambda e: e["value"]))
    ts = F.when(F.col("t.seconds").isNotNull(), F.timestamp_seconds(F.floor(F.col("t.seconds") + F.col("t.nanos") / 1e9)))
    half = lambda k, role, i, model, said, tools, sources, artifacts: F.struct(F.lit(k).alias("half"), i.alias("message_id"), F.lit(role).alias("role"), model.alias("model"), said.alias("texte"), tools.alias("tools"), sources.alias("sources"), artifacts.alias("artifacts"))
    both = F.array(
        half(0, "user", F.col("t.question_id"), F.lit(None).cast("string"), F.col("asked"), none, none, none),
        half(1, "assistant", F.col("t.answer_id"), F.col("t.model"), F.col("answer"), tools, sources, F.when(drawn, F.array(F.lit(DRAWING))).otherwise(none)),
    )
    flat = rows.select("conversation_id", "at", ts.alias("ts"), (F.col("asked") != "").alias("was_asked"), F.explode(both).alias("m")).select("conversation_id", "at", "ts", "was_asked", "m.*")
    has = (F.col("texte") != "") | (F.size("tools") > 0) | (F.size("sources") > 0) | (F.size("artifacts") > 0)
    # what comes before an answer that isn't asked in its own turn is an answer too, or nothing
    return flat.where(has | (F.col("half") == 1) & F.col("was_asked")).drop("was_asked")

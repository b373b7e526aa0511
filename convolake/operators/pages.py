"""Pages of five vendors as messages: which elements are turns, whose, and what in them is content, reasoning, a source, a step of a tool, an artifact, a file or nothing of these.

A page is made a tree once, by a vectorised function over rows (conversation_id, html), which picks nodes and renders content; labels, addresses and names become entries in columns. The result has the columns of the payload mappers.
An element that holds another turn is none itself. What is taken of a turn is taken before any node is replaced, as turns may share what is around them. A turn without content is left out, but for an answer without text where the vendor shows one, so that two questions don't meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.functions import markdown as MD
from convolake.functions import text as T
from convolake.operators import tree as X
from convolake.operators.parsers import IMAGE_NAME, MOST_SOURCES, finish

#: Rules of tree, in the order in which they are tried. around: what a turn's parts may be in besides the turn. What each vendor's pages have: fixed values.
PAGES = {
    "chatgpt": {
        "user": (("", "data-message-author-role", "=", "user"),), "assistant": (("", "data-message-author-role", "=", "assistant"),),
        "content": (("", "data-testid", "^", "conversation-turn-text"), ("", "class", "~", "markdown"), ("div", "class", "~", "whitespace-pre-wrap"), ("", "class", "~", "prose"), ("p", "", "?", "")),
        "around": (("", "data-turn-key", "?", ""), ("", "data-testid", "^", "conversation-turn")), "id": "data-message-id", "model": "data-message-model-slug",
    },
    "claude": {
        "user": (("div", "data-testid", "=", "user-message"), ("div", "data-test", "=", "user-editor"), ("div", "data-testid", "=", "user-message-content"), ("div", "data-cds", "=", "UserMessage")),
        "assistant": (("div", "data-cds", "=", "AssistantMessage"), ("div", "data-testid", "=", "assistant-message-text"), ("div", "data-testid", "=", "collapsible-text"), ("div", "data-test", "=", "assistant-message-text"), ("div", "data-test", "=", "collapsible-text"), ("div", "class", "~", "font-claude-message"), ("div", "class", "~", "font-claude-response")),
        "content": (("", "class", "~", "standard-markdown"), ("", "class", "~", "prose"), ("", "data-perf-reply-text", "?", ""), ("", "class", "~", "cds-user-message-body")),
        "reasoning": (("", "data-testid", "=", "thinking-block"), ("", "data-cds", "=", "ThinkingBlock"), ("", "data-testid", "=", "thinking-block-content"), ("", "data-step-key", "^", "thinking"), ("", "data-item-key", "*", ":grp:th")),
        "drop": (("", "data-test", "=", "thinking-toggle"), ("", "data-cds", "=", "TurnStatus"), ("", "data-testid", "=", "TurnStatus"), ("", "role", "=", "status"), ("details", "", "?", "")),
    },
    "gemini": {
        "user": (("user-query", "", "?", ""),), "assistant": (("model-response", "", "?", ""),),
        "content": (("", "class", "~", "query-text"), ("", "class", "~", "model-response-text"), ("", "class", "~", "content"), ("message-content", "", "?", "")),
        "drop": (("", "data-test-id", "=", "response-footer"), ("", "class", "~", "response-footer"), ("message-actions", "", "?", ""), ("", "class", "*", "model-response-label"), ("", "class", "~", "cdk-visually-hidden"), ("", "class", "*", "screen-reader"), ("", "aria-hidden", "=", "true"), ("mat-divider", "", "?", "")),
        "around": (("", "class", "~", "conversation-container"),), "empty": True,
    },
    "mistral": {
        "user": (("", "data-message-author-role", "=", "user"),), "system": (("", "data-message-author-role", "=", "system"),), "assistant": (("", "data-message-author-role", "?", ""),),
        "content": (), "drop": (("div", "class", "~", "text-hint"),), "id": "data-message-id",
    },
    "perplexity": {
        "user": (("div", "class", "~", "group/user-bubble"), ("", "data-testid", "=", "user-query-text"), ("div", "class", "~", "user-query")),
        "assistant": (("div", "data-workflow-final-text", "?", ""), ("div", "class", "~", "group/final-text"), ("", "data-testid", "=", "answer-text"), ("", "data-testid", "=", "answer-body"), ("div", "class", "~", "answer")),
        "content": (), "body": (("", "data-renderer", "=", "lm"),), "around": (("", "data-workflow-entry", "?", ""),),
        "drop": (("span", "class", "~", "citation"), ("", "class", "*", "step-header"), ("", "data-workflow-text-footer", "?", ""), ("figcaption", "", "?", ""), ("", "data-pplx-task-checkbox", "?", "")),
    },
}

#: Names of languages on pages, and the usual ones; labels of code that name none. Fixed values.
LANGUAGES = {"c++": "cpp", "c#": "csharp", "objective-c": "objectivec", "shell": "bash", "plain text": "text"}
NO_LANGUAGE = frozenset(("", "code", "extrait de code", "code snippet", "resultat", "resultat du code", "résultat", "résultat du code", "sortie", "output"))
#: How labels of reasoning begin; what files of content are had from. Fixed values.
REASONING = re.compile(r"(?i)(thought for|worked for|reasoned for|thinking|réflexion|raisonnement|a réfléchi|a travaillé|travail pendant|réfléchi pendant)[\s:]")
IMAGE_HOSTS = {"chatgpt": ("estuary", "oaiusercontent", "images.openai.com"), "gemini": ("googleusercontent.com/gg",), "perplexity": ()}
#: What a citation's label says; nodes that tell of a tool; extensions by kind of artifact; names of files. Fixed values.
CITED = re.compile(r"(?i)citations?\s+de\s+(.+?)(?:\.\s*Appuyer\b|$)")
TOOL_NODES = (
    ((("", "class", "~", "code-result-container"), ("", "data-test-id", "=", "code-output-stdout-stderr")), "Exécution de code"), ((("", "class", "~", "generated-images"), ("generated-image", "", "?", "")), "Génération d'images"),
    ((("svg-code-block", "", "?", ""), ("immersive-editor", "", "?", "")), "Canvas"), ((("", "class", "~", "luminous-video-duration-pill"), ("", "data-test-id", "=", "video-thumbnail")), "Analyse vidéo"),
)
EXTENSIONS = {"yaml": "yaml", "yml": "yml", "json": "json", "markdown": "md", "md": "md", "html": "html", "csv": "csv", "python": "py", "javascript": "js", "typescript": "ts", "text": "txt", "xml": "xml", "sql": "sql", "shell": "sh", "bash": "sh"}
FILE_NAME = re.compile(r"(?i)[\w .()'\-]+\.(txt|md|csv|json|pdf|png|jpe?g|gif|webp|svg|mp3|wav|m4a|mp4|mov|webm|docx?|xlsx?|pptx?|zip|rtf|odt)")
IS_IMAGE = re.compile(IMAGE_NAME.replace("(?i)", ""), re.I)

_any = lambda key, how="?", value="": ("", key, how, value)
_word = lambda value, tag="": (tag, "class", "~", value)
_tag = lambda name: (name, "", "?", "")
PILL, LINK, BUTTON = _any("data-testid", "=", "webpage-citation-pill"), _tag("a"), _tag("button")
ACTIVITY, CANVAS, TILE = ("", "class", "*", "activity-header"), ("", "id", "^", "textdoc-message-"), (("", "class", "*", "group/file-tile"), ("", "class", "*", "resource-card"))


def _maths(node: X.Node) -> None:
    """Formulas as they were written: from an attribute, or the annotation of what is drawn; as blocks where they stand alone."""
    for x in X.select(node, _any("data-math-source"), _any("data-math")):
        tex = (x.at.get("data-math-source") or x.at.get("data-math") or "").strip()
        if tex and not X.within(x, _any("data-math-source"), _any("data-math")):
            X.replace(x, f"\n$${tex}$$\n" if _alone(x) else f" ${tex}$ ")
    for x in X.select(node, _word("katex", "span")):
        tex = X.plain(note).strip() if (note := X.first(x, ("annotation", "encoding", "=", "application/x-tex"))) else ""
        if tex and x.up is not None and not X.within(x, _any("data-math-source"), _any("data-math")):
            X.replace(x, f"\n$${tex}$$\n" if _alone(x) else f" ${tex}$ ")


def _alone(x: X.Node) -> bool:
    said, names = x.at.get("data-math-display", "").lower(), x.at.get("class", "")
    if said in ("true", "block", "false"):
        return said != "false"
    return "display:block" in x.at.get("style", "").replace(" ", "").lower() or any(n in names for n in ("mathBlock", "Display-", "math-block")) or (x.tag == "div" and "data-math" in x.at) or X.within(x, _word("katex-display"), _word("caption-text"))


def _language(label: str) -> str:
    """A label above code as the name of a language; empty if it is none."""
    label = " ".join(label.split()).lower()
    return "" if label in NO_LANGUAGE or len(label) > 30 else LANGUAGES.get(label, "" if " " in label else label)


def _code(node: X.Node, platform: str) -> None:
    """Code with the language that is above it, which leaves the text; code without a block of its own as one."""
    for pre in X.select(node, _tag("pre")):
        if pre.at.get("data-language") or X.within(pre, _tag("pre")):
            continue
        code, label = X.first(pre, _tag("code")), ""
        if platform == "gemini":
            block = X.closest(pre, _tag("code-block"))
            result = code is not None and X.any_fits(code, TOOL_NODES[0][0])
            label = X.text(X.first(block, _word("code-block-decoration"))) if block and not result else ""
        elif platform == "perplexity":
            label = (X.text(X.first(pre, _tag("figcaption"))).split() or [""])[0]
        else:
            block = X.closest(pre.up, _any("data-markdown-copy", "=", "code-block"))
            head = X.first(pre, _word("font-sans", "div")) or (block and X.first(block, _word("font-sans", "div")))
            if head:
                label = X.text(next((x for x in head.below if isinstance(x, X.Node) and x.tag == "div"), None) or X.first(head, _word("truncate", "div"), _word("min-w-0", "div")))
                X.remove(head)
        named = next((w[9:] for w in (code.at.get("class", "") if code else "").split() if w.startswith("language-")), "")
        pre.at["data-language"] = _language(label) or named
    for block in X.select(node, _any("data-markdown-copy", "=", "code-block")):
        code = X.first(block, _tag("code"))
        if code and not X.first(block, _tag("pre")):
            head = X.first(block, _word("font-sans", "div"))
            label = X.text(head and (next((x for x in head.below if isinstance(x, X.Node) and x.tag == "div"), None) or head))
            X.replace(block, f"\n```{'' if label.lower() == 'plain text' else _language(label)}\n{X.plain(code)}\n```\n")
    for span in X.select(node, _any("data-markdown-copy", "=", "inline-code")):
        if not X.within(span, _tag("pre")) and X.plain(span):
            X.replace(span, f"`{X.plain(span)}`")
    X.remove(*X.select(node, _word("code-block-decoration")))


def _boxes(node: X.Node) -> None:
    """Items of a list of tasks, with their boxes."""
    for li in X.select(node, _tag("li")):
        box = X.first(li, ("input", "type", "=", "checkbox"), _any("data-pplx-task-checkbox"))
        if box and X.closest(box, _tag("li")) is li:
            button = X.first(box, BUTTON)
            li.at["data-mark"] = "- [x] " if "checked" in box.at or button and button.at.get("aria-checked", "").lower() == "true" else "- [ ] "


def _pill(pill: X.Node) -> tuple[str, str, str]:
    """Label, count and address of a citation's pill."""
    link = X.first(pill, LINK)
    if link is None:
        return "", "", ""
    label = X.text(X.first(link, _word("truncate", "span")) or link)
    count = next((t for s in X.select(link, _tag("span")) if (t := X.text(s)).startswith("+") and t[1:].isdigit()), "")
    return label, count, (link.at.get("href") or link.at.get("alt") or "").strip()


def _label(c: str) -> str:
    return " ".join(c.split()).replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")


def _activity(head: X.Node) -> str:
    by = (X.first(head, BUTTON) or head).at.get("aria-labelledby")
    return X.text((by and X.first(head, _any("id", "=", by))) or X.first(head, _word("truncate", "span"), _tag("span")))


def _of_chatgpt(turn: X.Node, scope: X.Node, role: str) -> dict:
    out: dict = {"files": [], "extra": []}
    for x in X.select(turn, _tag("img")):
        if any(h in x.at.get("src", "") for h in IMAGE_HOSTS["chatgpt"]):
            out["files"].append(f"![{_label(x.at.get('alt') or 'image')}]({x.at['src']})")
    seen = set()
    for x in X.select(turn, *TILE):
        if X.within(x, *TILE):
            continue
        button, name = X.first(x, ("button", "aria-label", "?", "")), X.first(x, ("span", "title", "?", ""), _word("font-semibold"))
        label = " ".join((x.at.get("aria-label") or (button.at["aria-label"] if button else "") or (name.at.get("title") or X.text(name) if name else "")).split())
        if label and label not in seen:
            seen.add(label)
            link = X.first(x, ("a", "href", "?", ""))
            href = link.at["href"].strip() if link else ""
            out["files"].append(f"[{label}]({href})" if href.startswith(("http", "/")) else label)
    if role != "assistant":
        return out
    heads = [(_activity(h), h) for h in X.select(scope, ACTIVITY)]
    why = [t for t, _ in heads if REASONING.match(t + " ")]
    if not why:
        for b in X.select(scope, BUTTON):
            if REASONING.match((t := X.text(b)) + " "):
                panel = X.next_node(b)
                why.append("\n".join(" ".join(s.split()) for s in X.markdown(panel).splitlines() if s.strip()) if panel and panel.tag == "div" and X.text(panel) else t)
    steps = [X.text(X.first(h, _any("data-markdown-text-style", "=", "assistant-message"), ("", "class", "*", "MarkdownRoot"))) or t for t, h in heads if not REASONING.match(t + " ")]
    if not steps:
        for pile in X.select(scope, _any("data-testid", "=", "cot-v5-tool-icon-pile")):
            group = X.closest(pile.up, _word("group", "div"))
            button = group and X.first(group, BUTTON)
            steps.append(" ".join((button.at.get("aria-label", "") if button else "").split()) or X.text(group))
    canvases = X.select(scope, CANVAS)
    pills = [_pill(p) for p in X.select(scope, PILL)]
    return out | {
        "why": "\n\n".join(dict.fromkeys(why)), "tools": steps, "artifacts": [X.text(X.first(c, _word("font-semibold"))) for c in canvases], "sources": [(re.sub(r"\s*\+\d+$", "", t), u) for t, _, u in pills if u],
        "extra": [X.markdown(X.first(c, _any("contenteditable", "=", "true"), _word("markdown")) or c) for c in canvases],
    }


def _before_chatgpt(node: X.Node) -> None:
    for card in X.select(node, _any("data-testid", "=", "math-block-layout")):
        said = " ".join(filter(None, (X.text(x) for x in X.select(card, _word("sr-only")))))
        X.remove(*X.select(card, _word("control-panel"), _word("sr-only")))
        if said:
            card.below.append(X.Raw(f"\n{said}\n"))
    for pill in X.select(node, PILL):
        label, count, href = _pill(pill)
        label = label if not count or count in label else f"{label} {count}".strip()
        X.replace(pill, f" [{_label(label)}]({href}) " if href and label else None)


def _of_gemini(turn: X.Node, scope: X.Node, role: str) -> dict:
    if role != "assistant":
        names = [f"![{_label(x.at.get('alt') or 'image')}]({x.at['src']})" for x in X.select(turn, _tag("img")) if any(h in x.at.get("src", "") for h in IMAGE_HOSTS["gemini"])]
        for x in X.select(turn, _any("data-test-id", "=", "uploaded-file")):
            stem, ext = X.text(X.first(x, _word("filename-label"))), X.text(X.first(x, _word("extension-label"))).lower()
            names.append((X.first(x, BUTTON) or x).at.get("aria-label", "").strip() or (f"{stem}.{ext}" if stem and ext else stem))
        return {"files": list(dict.fromkeys(filter(None, names)))}
    sources = []
    for chip in X.select(turn, _tag("source-inline-chip")):
        title, links = X.text(X.first(chip, _word("source-title"))), [u for a in X.select(chip, LINK) if (u := a.at.get("href", "").strip())]
        said = CITED.search((X.first(chip, BUTTON) or chip).at.get("aria-label", ""))
        if links:
            sources += [("" if title in u else title, u) for u in links]
        else:
            sources += [("", t.strip(" .;")) for t in re.split(r",\s*|\s+et\s+", " ".join(said[1].split()))] if said else [("", title)]
    for a in (a for x in X.select(turn, _tag("sources-list"), _tag("sources-carousel")) for a in X.select(x, LINK)):
        title, href = X.text(a), a.at.get("href", "").strip()
        sources.append(("" if title in href else title, href) if href else ("", title))
    drawings = [X.text(X.first(x, ("", "class", "*", "svg-label"))) or "SVG" for x in X.select(turn, _tag("svg-code-block"))]
    editors = [X.text(x)[:80] for x in X.select(turn, _tag("immersive-editor"), ("", "class", "*", "canvas-title"))]
    return {"sources": sources, "artifacts": drawings + editors, "tools": [name for rules, name in TOOL_NODES if X.first(scope, *rules)]}


def _markup(node: X.Node) -> str:
    """A node as it was written."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, X.Node):
            out.append(f"<{x.tag}" + "".join(f' {k}="{v}"' for k, v in reversed(x.at.items())) + ">")
            todo.extend([f"</{x.tag}>", *reversed(x.below)])
        else:
            out.append(x)
    return "".join(out)


def _before_gemini(node: X.Node) -> None:
    for x in X.select(node, _tag("svg-code-block")):
        if svg := X.first(x, _tag("svg")):
            X.replace(x, f"\n```svg\n{_markup(svg)}\n```\n")
    for x in X.select(node, _tag("generated-file")):
        name = X.first(x, _word("file-name-lr"))
        X.replace(x, f"\n\n{(name.at.get('title') or X.text(name)) if name else X.text(x)}\n\n")
    X.remove(*X.select(node, ("img", "src", "*", "drive-thirdparty.googleusercontent.com")))


def _of_perplexity(turn: X.Node, scope: X.Node, role: str) -> dict:
    if role != "assistant":
        names = [f"\n\n{t}\n\n".strip() for b in X.select(turn, BUTTON) if not X.first(b, _tag("img")) and FILE_NAME.fullmatch(t := X.text(b))]
        for chip in X.select(scope, _any("data-asset-chip")) if scope is not turn else ():
            if chip is turn or X.closest(chip, *PAGES["perplexity"]["user"]) is turn:
                continue
            label, image = (chip.at.get("title") or chip.at.get("aria-label") or X.text(chip)).strip(), X.first(chip, _tag("img"))
            src = image.at.get("src", "").strip() if image else ""
            names.append(label and (f"![{label}]({src or label})" if src or IS_IMAGE.search(label) else label))
        return {"files": list(dict.fromkeys(filter(None, names)))}
    sources: dict[str, str] = {}
    for x in X.nodes(turn.up or turn):
        if url := x.at.get("data-pplx-citation-url", "").strip():
            inner = (y.at["aria-label"].strip() for y in X.select(x, _any("aria-label")))
            title = x.at.get("aria-label", "").strip() or next((t for t in inner if len(t) >= 12 and not t.lower().startswith("domaine fiable")), "")
        elif x.tag == "a" and ("source-pill" in x.at.get("class", "").split() or X.within(x, ("", "data-testid", "*", "source"))):
            url, title = x.at.get("href", "").strip(), (x.at.get("title") or x.at.get("aria-label") or "").strip()
            said = X.text(x)
            title = title or (said if len(said) >= 20 and len(said.split()) >= 3 and not said.startswith("http") else "")
        else:
            continue
        if url.startswith(("http://", "https://")):
            sources.setdefault(url, title)
    made = []
    for b in X.select(turn, BUTTON):
        if any(w in b.at.get("aria-label", "").lower() for w in ("artefact", "artifact")):
            row = b
            while row is not None and not (row.tag == "div" and {"group", "relative"} <= set(row.at.get("class", "").split())):
                row = row.up
            name, kind = X.text(X.first(row or turn, _word("font-bold", "div"))), X.text(X.first(row or turn, _word("text-secondary", "div"))).lower()
            ext = EXTENSIONS.get(kind)
            made.append(f"{name}.{ext}" if name and ext and not name.lower().endswith("." + ext) else name)
    steps = [t for h in X.select(turn, ("", "class", "*", "step-header")) for x in X.select(h, _any("title")) if (t := x.at["title"].strip()) and not t.lower().startswith("recherche termin")]
    images = [x for x in X.select(turn, _tag("img")) if x.at.get("data-testid") == "image-carousel-img" or X.within(x, _any("data-testid", "=", "image-carousel-img"))]
    shown = [f"![{x.at.get('alt', '').strip() or 'image'}]({x.at['src'].strip()})" for x in images if x.at.get("src", "").strip() and not x.at["src"].startswith("data:")]
    return {"sources": [(t, u) for u, t in list(sources.items())[:MOST_SOURCES]], "artifacts": made, "why": "\n\n".join(dict.fromkeys(steps)), "files": list(dict.fromkeys(shown))}


def _before_perplexity(node: X.Node) -> None:
    for x in X.select(node, ("", "title", "^", "http")):
        if x.at.get("role") == "button":
            X.replace(x, x.at["title"].strip())


OF = {"chatgpt": _of_chatgpt, "gemini": _of_gemini, "perplexity": _of_perplexity}
BEFORE = {"chatgpt": _before_chatgpt, "gemini": _before_gemini, "perplexity": _before_perplexity}


def turns_of(html: str, platform: str) -> list[dict]:
    """The turns of a page: id, role, said, model, why, tools, sources (title, url), artifacts."""
    rules, page = PAGES[platform], X.parse(html)
    found = {id(x): (x, r) for x in X.nodes(page) if (r := next((r for r in ("user", "system", "assistant") if X.any_fits(x, rules.get(r, ()))), None))}
    for x, _ in list(found.values()):
        up = x.up
        while up is not None:
            found.pop(id(up), None)
            up = up.up
    turns = []
    for x, role in found.values():
        of = OF.get(platform, lambda *a: {})(x, X.closest(x, *rules.get("around", ())) or x, role)
        why = [X.markdown(y) for y in X.select(x, *rules.get("reasoning", ())) if not X.within(y, *rules.get("reasoning", ()))] if role == "assistant" else []
        turns.append((x, role, of, "\n\n".join(filter(None, [of.get("why", ""), "\n\n".join(filter(None, why))]))))
    out: list[dict] = []
    for x, role, of, why in turns:
        BEFORE.get(platform, lambda node: None)(x)
        _maths(x)
        _code(x, platform)
        _boxes(x)
        X.remove(*X.select(x, *rules.get("reasoning", ()), *rules.get("drop", ())))
        bodies = [b for b in X.select(x, *rules.get("body", ())) if not X.within(b, *rules.get("body", ()))]
        said = "\n\n".join(filter(None, map(X.markdown, bodies))) if bodies else ""
        said = said or X.markdown(X.first(x, *rules["content"]) or x)
        for more in (*of.get("files", ()), *of.get("extra", ())):
            if more and more not in said:
                said = f"{said}\n\n{more}".strip()
        if said or why or of.get("artifacts") or rules.get("empty") and role == "assistant" and out and out[-1]["role"] == "user":
            out.append({"id": x.at.get(rules.get("id", ""), ""), "role": role, "said": said, "model": x.at.get(rules.get("model", "")) or None, "why": why, "tools": of.get("tools", []), "sources": [{"title": t, "url": u} for t, u in of.get("sources", [])], "artifacts": of.get("artifacts", [])})
    return out


_TURN = pa.struct([("id", pa.string()), ("role", pa.string()), ("said", pa.string()), ("model", pa.string()), ("why", pa.string()), ("tools", pa.list_(pa.string())), ("sources", pa.list_(pa.struct([("title", pa.string()), ("url", pa.string())]))), ("artifacts", pa.list_(pa.string()))])


def read_pages(pages: DataFrame, platform: str) -> DataFrame:
    """Messages of the pages (conversation_id, html) of a vendor; a page without any has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, html in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if turns := turns_of(html, platform):
                    yield pa.RecordBatch.from_arrays([pa.array([cid.as_py()] * len(turns), pa.string()), pa.array(range(len(turns)), pa.int32()), pa.array(turns, _TURN)], ["conversation_id", "at", "t"])

    kind = "struct<id:string,role:string,said:string,model:string,why:string,tools:array<string>,sources:array<struct<title:string,url:string>>,artifacts:array<string>>"
    rows = pages.select(F.col("conversation_id").cast("string").alias("conversation_id"), "html").mapInArrow(run, f"conversation_id string, at int, t {kind}")
    named = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: T.collapse(x)), lambda x: x != ""))
    sources = F.array_distinct(F.transform(F.filter("t.sources", lambda s: s["url"] != ""), lambda s: T.source_entry(s["title"], s["url"])))
    return finish(
        rows, [F.col("at")], keep_empty=True, message_id=F.col("t.id"), role=F.col("t.role"), model=F.col("t.model"), ts=F.lit(None).cast("timestamp"), texte=MD.normalise_text(F.col("t.said")), reasoning=F.col("t.why"),
        tools=named(F.col("t.tools")), sources=sources, artifacts=named(F.col("t.artifacts")),
    )

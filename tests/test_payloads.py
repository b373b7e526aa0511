"""Payloads of vendors, by examples of each of their forms."""

import copy
import json
import random

import pytest

from convolake.operators import parsers, positional

END = "/download)"


def mapped(spark, platform, *payloads):
    rows = [(f"c{k}", p if isinstance(p, str) or p is None else json.dumps(p)) for k, p in enumerate(payloads)]
    out = parsers.MAPPERS[platform](spark.createDataFrame(rows, "conversation_id string, payload string")).orderBy("conversation_id", "pos").collect()
    return out if len(payloads) == 1 else [[r for r in out if r.conversation_id == c] for c, _ in rows]


def file(name, url=None, mime=None, urls=None):
    return [None, 1, name, url, None, mime, None, urls or []]


PREVIEW, DOWNLOAD = "https://lh3.googleusercontent.com/gg/" + "k" * 60, "https://contribution.usercontent.google.com/download?c=" + "k" * 40


def lists(question="q", answer="a", below=(), used=(), steps=(), model="gemini-test", candidate="rc_1"):
    return [["c_1", "r_1"], ["c_1", "r_2", "rc_x"], [question, None, None, None, [[None, None, None, list(used), [file("of the space.txt")]]]], [[[candidate, [answer] if answer is not None else [], None, *below]], None, None, "rc_place", list(steps), None, model], [1790236042, 999]]


def test_positional_fields(spark):
    cited = {"44": [[["[cite: 5]", 0], [[None, [file("donnees.json")]]], ["x", 0]], [["[cite: 6]"], [[file("unused.pdf")]]], [["[cite: 7]"], "no file"]]}
    tagged = {"44": [[["[cite: 9]"], [file("late.txt")]]], "59": [[["[file-tag: f1]"], [file("pro[d].csv", None, "text/csv", [DOWNLOAD])]]]}
    made = [[["http://googleusercontent.com/image_generation_content/3"], [file("watermarked.png", PREVIEW, "image/png")]], [file("other.png", PREVIEW + "o", "image/png")]]
    text = "* un\n* deux\n\n```python?code_reference&code_event_index=1\nprint(1)\n\n```\n`true`[cite: 5] [cite: 9]\n\n\n\n[file-tag: f1] [file-tag: gone]\nhttp://googleusercontent.com/image_generation_content/3\nhttp://googleusercontent.com/image_generation_content/4"
    used = [file("p.png", PREVIEW, "image/png"), [file("v.mp4", None, "video/mp4", [PREVIEW, DOWNLOAD])], file("plain.bin"), file("p.png", PREVIEW, "image/png"), file("lost.png", None, "image/png")]
    steps = [[1, ["google", ["Search"]]], [2, ["data_analysis_tool", ["Imagen", "x"]]], [3, ["data_analysis_tool", []]], [4, ["new_tool", 3]], [5], "x", [6, ["google"]]]
    user, answer = mapped(spark, "gemini", {"turns": [lists("* hi", text, [[2], [cited, [tagged]], made], used, steps)]})
    assert (user.role, user.message_id, user.model, user.ts, user.tools) == ("user", "r_1", None, answer.ts, [])
    assert user.texte == f"- hi\n\n![p.png]({PREVIEW})\n\n![v.mp4]({PREVIEW})\n\n[v.mp4]({DOWNLOAD})\n\nplain.bin"
    assert answer.texte == f"- un\n- deux\n\n```python\nprint(1)\n```\n`true` \n\n[pro\\[d\\].csv]({DOWNLOAD}) \n![watermarked.png]({PREVIEW})"
    assert (answer.message_id, answer.model, answer.sources) == ("rc_1", "gemini-test", ["JSON: donnees.json"])
    assert answer.tools == ["Recherche web", "Génération d'images", "Exécution de code", "new_tool", "Analyse vidéo"] and answer.ts.timestamp() == 1790236042


def test_positional_turns_of_other_forms(spark):
    two_parts, one_list = lists(), lists()
    two_parts[2] = [[["first", None], ["second"], 7]]
    one_list[2] = [["alone"]]
    drawn = lists("draw", "```xml\n<svg>\n```")
    empty, unnamed = lists("q1", None), lists("q2", None, candidate=None)
    silent = lists("", "said")
    got = mapped(spark, "gemini", {"turns": [two_parts, one_list, None, drawn]}, {"turns": [empty, unnamed, silent]}, {"turns": []}, {}, None, "{", "[1]", {"turns": [[], [None], [["a"]], lists("", None)]})
    assert [m.texte for m in got[0]] == ["first\n\nsecond", "a", "alone", "a", "draw", "```xml\n<svg>\n```"] and got[0][5].artifacts == ["SVG"] and got[0][5].tools == ["Canvas"]
    assert [(m.role, m.texte, m.message_id) for m in got[1]] == [("user", "q1", "r_1"), ("assistant", "", "rc_1"), ("user", "q2", "r_1"), ("assistant", "", "rc_place"), ("assistant", "said", "rc_1")]
    assert got[2:] == [[]] * 6


def test_made_images_come_from_the_smallest_node():
    """Against trying every node."""
    deal = random.Random(8)
    url = "http://googleusercontent.com/image_generation_content/"

    def tree(depth):
        kind = deal.random()
        if depth == 0 or kind < 0.2:
            return deal.choice([url + str(deal.randint(0, 3)), "text", None, 4, file(f"f{deal.randint(0, 99)}.png", deal.choice([PREVIEW, None]), "image/png"), file(f"g{deal.randint(0, 99)}.txt")])
        below = [tree(depth - 1) for _ in range(deal.randint(0, 4))]
        return below if kind < 0.8 else {str(k): x for k, x in enumerate(below)}

    def every(node):
        return list(positional.walk(node))

    for _ in range(400):
        node, best = [tree(5)], {}
        for x in every(node):
            files = positional.files_below(x)
            for u in {s for y in every(x) for s in positional.children(y) if isinstance(s, str) and s.startswith(url)}:
                if files and positional.shown(files[0]) and (u not in best or len(every(x)) < best[u][0]):
                    best[u] = len(every(x)), files[0]
        found = {m["mark"]: m["file"] for m in positional.made_images(node)}
        assert found.keys() == best.keys()
        for u, (size, _) in best.items():
            assert found[u] in [positional.files_below(x)[0] for x in every(node) if len(every(x)) == size and positional.files_below(x)]
    deep = node = []
    for _ in range(50_000):
        node.append([])
        node = node[0]
    node.extend([url + "1", file("a.txt")])
    assert positional.made_images(deep)[0]["file"]["name"] == "a.txt" and len(positional.files_below(deep)) == 1


def said(role, i, *parts, kind="text", recipient="all", **metadata):
    return {"id": i, "author": {"role": role}, "recipient": recipient, "create_time": 1700000000.5, "content": {"content_type": kind, "parts": list(parts)}, "metadata": metadata}


def picture(fid):
    return {"content_type": "image_asset_pointer", "asset_pointer": f"sediment://{fid}"}


def thought(summary=None, content=None, kind="thoughts"):
    return {"id": "t", "author": {"role": "assistant"}, "content": {"content_type": kind, "thoughts": [{"summary": summary, "content": content}]}}


MADE = f"![Generated image: Titre]({parsers.CHATGPT_FILE}g1{END}"


def drawn(fid="g1", title="Titre"):
    return said("tool", "x", picture(fid), kind="multimodal_text", **({"image_gen_title": title} if title else {}))


def test_parts_and_images(spark):
    sound = {"content_type": "audio_asset_pointer", "asset_pointer": "sediment://a"}
    user = said("user", "u", "look ", picture("f1"), {"content_type": "audio_transcription", "text": " heard "}, sound, picture("f2"), {"content_type": "image_asset_pointer"}, "  ", 7, None, kind="multimodal_text", attachments=[{"id": "f1", "name": " ph[o]to.png "}, {"id": "f1", "name": "other"}])
    pasted = said("user", "v", '{"content_type": "image_asset_pointer", "asset_pointer": "sediment://no"}')
    a, b = mapped(spark, "chatgpt", {"messages": [user, pasted]})
    assert a.texte == f"look \nheard\n\n![ph(o)to.png]({parsers.CHATGPT_FILE}f1{END}\n\n![image]({parsers.CHATGPT_FILE}f2{END}"
    assert b.texte == pasted["content"]["parts"][0] and b.ts.timestamp() == 1700000000.5


def test_references_are_spliced(spark):
    group = lambda mark, alt: {"type": "image_group", "matched_text": mark, "alt": alt}
    refs = [{"type": "url", "title": "E", "url": "https://a"}, {"type": "foot", "title": "no", "url": "https://no", "sources": [{"title": "B", "url": " https://b "}, {"title": "x"}]}, group("M1", "![1](u1)"), group("M1", "![2](u2)"), group("none", "![3](u3)"), group("", "![1](u1)"), group("M2", " "), group("d M1 M1", "![4](u4)")]
    cites = [{"metadata": {"title": "C", "url": "https://c"}}, {"title": "D", "url": "https://d", "metadata": None}, {"metadata": {"url": "https://a"}, "title": "E"}]
    cards = [{"type": "async_image", "safe_urls": [{"url": "https://s/p"}, {"url": "https://s/x?purpose=fullsize"}]}, {"type": "chart", "safe_urls": [{"url": "https://no"}]}, {"type": "image", "safe_urls": [{"url": "ftp://x"}, {"url": "https://s/y"}]}, {"type": "image", "safe_urls": []}]
    m = mapped(spark, "chatgpt", {"messages": [said("user", "u", "q"), said("assistant", "a", "M1 and M1 M1 M2", content_references=refs, citations=cites, genui_components=cards)]})[1]
    assert m.texte == "![1](u1) and ![2](u2) M1 M2\n\n![3](u3)\n\n![4](u4)\n\n![image](https://s/x?purpose=fullsize)\n\n![image](https://s/y)"
    assert m.sources == ["E — https://a", "B — https://b", "C — https://c", "D — https://d"]


def chain(messages):
    """Reference for what comes between visible messages, one after the other."""
    out, held = [], ([], [], [])

    def give(m):
        images, reasoning, tools = (list(dict.fromkeys(x)) for x in held)
        m[1] = "\n\n".join([x for x in [m[1]] if x] + images)
        m[2] = m[2] or "\n\n".join(reasoning)
        m[3] = list(dict.fromkeys(m[3] + tools))

    def close(before_user):
        if (not before_user and any(held) and out or held[0]) and (out or before_user):
            if out and out[-1][0] == "assistant":
                if held[0]:
                    give(out[-1])
            else:
                out.append(["assistant", "", "", []])
                give(out[-1])
        for x in held:
            x.clear()

    for m in messages:
        kind, role = m["content"]["content_type"], m["author"]["role"]
        if kind == "thoughts":
            t = m["content"]["thoughts"][0]
            held[1].extend(filter(None, [t["content"]]))
            held[2].extend(filter(None, [t["summary"]]))
        elif role == "tool":
            held[0].append(f"![Generated image: {m['metadata']['image_gen_title']}]({parsers.CHATGPT_FILE}{m['content']['parts'][0]['asset_pointer'][11:]}{END}")
        elif role == "user":
            close(True)
            out.append(["user", m["content"]["parts"][0], "", []])
        elif m["recipient"] == "all":
            out.append(["assistant", m["content"]["parts"][0], "", []])
            give(out[-1])
            for x in held:
                x.clear()
    close(False)
    return [tuple(m[:3]) + (tuple(m[3]),) for m in out]


def test_what_comes_between_messages(spark):
    deal = random.Random(6)
    kinds = [lambda k: said("user", f"u{k}", f"q{k}"), lambda k: said("assistant", f"a{k}", f"r{k}"), lambda k: said("assistant", f"c{k}", "call", recipient="browser"), lambda k: thought(deal.choice([None, "step", f"s{k}"]), deal.choice([None, "why", f"w{k}"])), lambda k: drawn(f"g{deal.randint(0, 2)}")]
    threads = [[deal.choice(kinds)(k) for k in range(deal.randint(1, 9))] for _ in range(120)]
    for thread, got in zip(threads, mapped(spark, "chatgpt", *({"messages": t} for t in threads)), strict=True):
        assert [(m.role, m.texte, m.reasoning, tuple(m.tools)) for m in got] == chain(thread)


def test_hidden_and_internal_messages(spark):
    recap = lambda kind: {"author": {"role": "assistant"}, "content": {"content_type": "reasoning_recap", "content": " kept "}, "metadata": {"reasoning_recap_type": kind}}
    messages = [said("system", "s", "x"), said("user", "u", "q"), None, said("user", "h", "x", is_visually_hidden_from_conversation=True), said("assistant", "k", "x", kind="code"), said("user", "e", "x", kind="model_editable_context"), recap("hide_all"), recap("collapse"), said("tool", "o", "text of a tool"), said("assistant", "a", "\\(x\\)", model_slug="m")]
    user, answer = mapped(spark, "chatgpt", {"messages": messages})
    assert (user.message_id, answer.texte, answer.reasoning, answer.model, user.model) == ("u", "$x$", "kept", "m", None)
    assert mapped(spark, "chatgpt", {"messages": []}, {}, None, "no", {"messages": [drawn()]}) == [[]] * 5


def block(usage, answer="", chunks=(), offset=0):
    return {"intended_usage": usage, "markdown_block": {"answer": answer, "chunks": list(chunks), "chunk_starting_offset": offset}}


def entry(*blocks, **more):
    return {"uuid": "e", "query_str": "Q", "display_model": "turbo", "entry_created_datetime": "2026-06-08T19:08:12Z", "entry_updated_datetime": "2026-06-08T19:12:12Z", "blocks": list(blocks)} | more


def steps(*items, title=None):
    return {"workflow_block": {"steps": [{"title": title, "items": list(items)}]}}


def answer_item(text, variant="answer", kind="WORKFLOW_ITEM_TEXT"):
    return {"type": kind, "payload": {"text_payload": {"variant": variant, "text": text}}}


@pytest.mark.parametrize(
    ("blocks", "want"),
    [
        ([block("ask_text_1_markdown", "second"), block("ask_text_0_markdown", "first")], "first\nsecond"),
        ([block("ask_text_10_markdown", "c"), block("ask_text_9_markdown", "b"), block("ask_text_11_markdown", "a", offset=-1), block("ask_text_2_markdown", " ")], "a\nb\nc"),
        ([block("ask_text_0_markdown", "part"), block("ask_text", "whole")], "whole"),
        ([block("ask_text", "old"), block("ask_text", "new")], "new"),
        ([block("ask_text", "", ["Bonjour", " le", " monde"])], "Bonjour le monde"),
        ([block("ask_text"), block("ask_text_3_markdown", "", ["x", "y "])], "xy"),
        ([block("ask_text", "whole"), steps(answer_item(" one "), answer_item("no", "query"), answer_item("no", kind="OTHER")), steps(answer_item("two"))], "one\n\ntwo"),
        ([block("ask_text", "\\[x\\] \\(y\\)")], "$$x$$ $y$"),
        ([None, {"intended_usage": "ask_text"}, block("other", "no"), block("ask_text_x_markdown", "no")], None),
    ],
)
def test_assembled_answers(spark, blocks, want):
    got = mapped(spark, "perplexity", {"entries": [entry(*blocks)]})
    assert [m.texte for m in got] == ["Q"] + [want] * (want is not None)


def test_results_files_assets_and_media(spark):
    page = lambda url, name, **more: {"url": url, "name": name} | more
    own = {"web_result_block": {"web_results": [page("https://a", "A"), page("s3://f?x", "notes.txt", is_attachment=True), page("https://i/x.PNG?s", "", is_attachment=True)]}, "sources_mode_block": {"web_results": [page("https://a", "again"), page("", "named", is_attachment=True), page("", "")]}}
    context = steps({"type": "WORKFLOW_ITEM_SOURCES", "payload": {"sources_payload": {"sources": [page("https://b", "https://b"), page("https://a", "no"), page("https://old.png", "of before", is_attachment=True)]}}}, answer_item("said"), title=" Look ")
    assets = {"unified_assets_block": {"assets": [{"asset_type": "CODE_ASSET", "code_file": {"filename": "n.yaml"}}, {"asset_type": "GENERATED_IMAGE", "image": {"url": "https://g/1", "name": "G"}}, {"asset_type": "IMAGE", "url": "data:x"}, {"asset_type": "CODE_FILE", "code_file": {"name": "n.yaml"}}]}}
    item = lambda medium, **more: {"medium": medium} | more
    media = [{"media_block": {"media_items": [item("video", url="https://v", name=""), item("image", image="https://p", name="P")], "generated_media_items": [item(None, thumbnail="https://t", caption="T")]}}, {"inline_entity_block": {"media_block": {"media_items": [item("image", image="https://p", name="again"), item("image", image="x"), item("image", image="https://g/1", name="G")]}}}]
    user, answer = mapped(spark, "perplexity", {"entries": [entry(own, context, assets, *media, steps(title="Look"), steps(title="Then"))]})
    assert user.texte == "Q\n\n[notes.txt](s3://f?x)\n\n![fichier](https://i/x.PNG?s)\n\nnamed"
    assert answer.texte == "said\n\n![G](https://g/1)\n\n![P](https://p)\n\n![T](https://t)\n\n[https://v](https://v)"
    assert (answer.reasoning, answer.artifacts, answer.tools, answer.sources) == ("Look\n\nThen", ["n.yaml"], ["Recherche", "Code", "Génération d'image"], ["A — https://a", "https://b"])
    assert (user.model, answer.model, user.message_id, answer.ts > user.ts) == ("turbo", "turbo", "e", True)


def test_entries_without_answers(spark):
    got = mapped(spark, "perplexity", {"entries": [entry(), None, entry(query_str=" ", blocks=None), entry(steps(title="only reasoning")), entry(sources={"sources": ["WEB"]}, display_model="", user_selected_model="own")]}, {"entries": []}, None, "x")
    assert [(m.role, m.texte, m.reasoning, m.model) for m in got[0]] == [("user", "Q", "", "turbo"), ("user", "Q", "", "turbo"), ("assistant", "", "only reasoning", "turbo"), ("user", "Q", "", "own")]
    assert got[1:] == [[], [], []]


def test_payloads_may_come_as_copies(spark):
    payload = {"entries": [entry(block("ask_text", "x"))]}
    a, b = mapped(spark, "perplexity", payload, copy.deepcopy(payload))
    assert [m[1:] for m in a] == [m[1:] for m in b]


def test_files_and_errors_of_responses(spark):
    card = lambda **x: json.dumps(x)
    file = lambda key, name="n", mime="text/plain": {"key": key, "name": name, "mimeType": mime}
    r = [
        {"sender": "human", "message": "see", "fileAttachmentAssetMetadata": [file("/users/1/content", " a[1].png ", "IMAGE/png"), file("", "no"), file("k/2", "")], "fileAttachmentsMetadata": [{"fileUri": "unused"}]},
        {"sender": "assistant", "message": "", "streamErrors": [{"message": " "}, {"message": "limit"}], "cardAttachmentsJson": [card(type="render_file", file_name="r.txt", mime_type="text/plain", file_size=7), "broken{"]},
        {"sender": "human", "message": " ", "fileAttachmentsMetadata": [{"fileUri": "u/3", "fileName": "d.pdf"}]}, {"sender": "assistant", "message": None, "cardAttachmentsJson": [card(cardType="rendered_file_card", file_name="x.docx", file_size="big"), card(type="canvas", title="C")]},
        {"sender": "human", "message": ""}, {"sender": "assistant", "message": "", "generatedImageUrls": ["https://g/1", "g/2", ""]}, {"sender": "assistant", "message": "", "metadata": {"request_metadata": {"stream_errors": [{"message": "late"}]}}}, {"sender": "assistant"},
    ]
    got = mapped(spark, "grok", {"responses": r})
    assets = parsers.GROK_ASSETS
    assert [(m.role, m.texte, m.artifacts) for m in got] == [
        ("user", f"see\n\n![a\\[1\\].png]({assets}/users/1/content)\n\n[fichier]({assets}/k/2)", []), ("assistant", "limit\n\nFichier généré : r.txt (text/plain, 7 o)", ["r.txt"]), ("user", f"[d.pdf]({assets}/u/3)", []),
        ("assistant", "Fichier généré : x.docx", ["x.docx", "C"]), ("assistant", f"![image](https://g/1)\n\n![image]({assets}/g/2)", []), ("assistant", "late", []), ("assistant", "", []),
    ]


def test_canvases_steps_and_sources(spark):
    item = lambda i, role, at, parent=None, chunks=(), **more: {"id": i, "version": 0, "parentId": parent, "role": role, "createdAt": f"2026-01-01T00:00:0{at}Z", "contentChunks": list(chunks)} | more
    step = lambda name, kind=None, results=None: {"type": "tool_call", "name": name, "publicMetadata": {"display": {"kind": kind}}, "publicResult": {"results": results}}
    text = lambda t, why=False: {"type": "text", "text": t, "_context": {"type": "reasoning"} if why else None}
    found = [{"url": "https://b", "title": "B  b"}, {"url": "ftp://x"}, {"url": "https://a", "title": "again"}]
    rich = [text(" why ", True), text("one \\\\(x\\\\)".replace("\\\\", "\\")), {"type": "file_reference", "fileUrl": "https://f", "fileAlt": "a"}, {"type": "image_url", "imageUrl": "https://i"}, {"type": "custom_element", "element": {"type": "table-metadata", "attributes": {"title": "Table"}}}, step("web_search", None, found), step("gmail_send"), step("odd name of a step"), step("new_step"), step("x", "canvas-1"), {"type": "canva", "id": "k", "version": "1"}]
    items = [item("u", "user", 0, content="Q", files=[{"name": "n", "url": "u"}]), item("a", "assistant", 1, "u", rich, references=[{"url": "https://a", "title": "A"}], citedSources=[{"url": "https://host/c", "title": "host"}]), item("v", "user", 2, "a", content="more"), item("b", "assistant", 3, "v", [{"type": "canva", "id": "k", "version": 1}], content="not this"), item("w", "user", 4, "b", [text("of chunks")]), item("c", "assistant", 5, "w", content=" whole ")]
    payload = {"messages": {"items": items}, "canvases": {"items": [{"id": "k", "version": 0, "title": "old"}, {"id": "k", "version": 1, "title": "Plan", "type": "text/html", "content": "<b>"}]}}
    got = mapped(spark, "mistral", payload)
    assert [m.texte for m in got] == ["Q\n\n[n](u)", "one $x$\n\n[a](https://f)\n\n![image](https://i)\n\nTable", "more", "<b>", "of chunks", "whole"]
    a = got[1]
    assert (a.reasoning, a.tools, a.artifacts) == ("why", ["Recherche web", "Gmail", "new_step", "Canvas"], ["Plan (text/html)"])
    assert a.sources == ["A — https://a", "B b — https://b", "host"]

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from convolake.functions import markdown as MD
from convolake.functions import text as T
from convolake.operators import archive, calibration, lookup, media, normalize, pages, parsers, reparse, reports, sanitize, wire
from convolake.plans import catalog


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string").coalesce(1)
    return [r.y for r in rows.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


def odd_texts(seed, bits, n=300):
    deal = random.Random(seed)
    return ["", "```", "a", "\n\n\n"] + ["".join(deal.choice(bits) for _ in range(deal.randint(0, 25))) for _ in range(n)]


def test_lines_in_and_out_of_fences(spark):
    def want(text):
        text = re.sub("[​‌‍⁠﻿]", "", re.sub("[  ]", " ", text))
        out, inside = [], False
        for line in text.splitlines():
            if line.lstrip().startswith("```"):
                inside = not inside
            elif not inside:
                line = re.sub(r"[ \t]+", " ", line).strip()
            out.append(line.rstrip())
        return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()

    texts = odd_texts(1, ["a", " ", "  ", "\n", "\n", "\r\n", "\t", "```", "\n```", "```py\n", " ", "​", "x  y", "\n\n"])
    assert column(spark, [*texts, None], MD.normalise_text) == [*map(want, texts), ""]


def test_blank_lines(spark):
    def want(text):
        out, inside = [], False
        for line in text.split("\n"):
            if line.startswith("```"):
                inside = not inside
            elif not inside and not line.strip() and out and not out[-1].strip():
                continue
            out.append(line)
        return "\n".join(out)

    texts = odd_texts(2, ["a", " ", "\n", "\n", "\n```", "```", "\n\n", "\n \n", "b"])
    assert column(spark, texts, MD.tidy_blank_lines) == list(map(want, texts))


def test_ends_of_fences(spark):
    def one(m):
        return m[0] if not m[2].strip() else f"```{m[1]}\n{m[2].rstrip()}\n```"

    want = lambda t: re.sub(r"(?ms)^```([^\n`]*)\n(.*?)^```[ \t]*$", one, t)
    texts = odd_texts(3, ["a\n", " ", "\n", "```\n", "\n```\n", "```py\n", "x = 1\n", "\n\n"])
    assert column(spark, texts, MD.trim_fences) == list(map(want, texts))


def test_fold_is_compatible(spark):
    assert column(spark, ["ﬁn ①", "ＦＵＬＬ Été", "plain ASCII", "กำ", None], T.fold) == ["fin 1", "full ete", "plain ascii", "กํา", ""]


def test_wire(spark):
    ok = json.dumps([["wrb.fr", "x", json.dumps([1, ["é"]]), None, [3]], ["di", 5]])
    texts = [")]}'\n\n9\n" + ok, json.dumps([["wrb.fr", "x", None, None]]) + "\n" + ok, "[broken\n" + ok, json.dumps([["wrb.fr", "x", "{no"]]), "", None, json.dumps([["er", None, 401, 3]])]
    assert column(spark, texts, lambda c: wire.batch_payload(c, "x")) == ['[1, ["\\u00e9"]]', None, '[1, ["\\u00e9"]]', None, None, None, None]
    assert column(spark, ['["er",null,null,429,1]', 'BardErrorInfo",[1096]', "fine"], wire.error_code) == [429, 1096, None]
    assert column(spark, ['["er",null,401]', "401", None], wire.is_auth_error) == [True, False, False]
    page = 'a self.__next_f.push([1,"x\\"\\n"]) self.__next_f.push([1,"\\u00e9"]) self.__next_f.push([1,7])'
    assert column(spark, [page, "none"], wire.page_payload) == ['x"\né', ""]
    text = 'z{"role":"user","id":"a","t":"}{"}{"role": "assistant", "id":"b"} {"role":"user","id":"a","t":2} {"role":"user"} {"role":"user","id":"open'
    got = wire.objects(spark.createDataFrame([(1, text), (2, None)], "page_id int, payload string")).collect()
    assert [(r.page_id, r.object_id, json.loads(r.object).get("t")) for r in got] == [(1, "a", "}{"), (1, "b", None)]


def test_long_fragments_of_pages(spark):
    push = lambda c, n: F.concat(F.lit('self.__next_f.push([1,"'), F.repeat(c, n), F.lit('"])'))
    said = ["a", '\\"', "\\\\", "\\u00e9", "ab\\n"]
    for n in (2000, 200_000):
        assert column(spark, said, lambda c: wire.page_payload(F.concat(push(c, n), push(c, 1)))) == [json.loads(f'"{x}"') * (n + 1) for x in said]
    assert column(spark, ["abcdefgh\\n"], lambda c: F.length(wire.page_payload(push(c, 2_400_000)))) == [9 * 2_400_000]


def test_fragments_of_odd_pages(spark):
    def want(page):
        parts = []
        for found in re.finditer(r"self\.__next_f\.push\(\[1,(\"(?:[^\"\\]|\\.)*\")\]\)", page):
            try:
                parts.append(json.loads(found[1]))
            except ValueError:
                continue
        return "".join(parts)

    texts = odd_texts(8, ['self.__next_f.push([1,"', 'self.__next_f.push([1,"', '"])', '"])', '"', "\\", "\\\\", '\\"', "\\n", "\\u00e9", "é", "a", "\n", "\r", "\u2028", "😀", "])", "[1,7])"], 1000)
    assert sum(map(bool, map(want, texts))) > 100
    assert column(spark, texts, wire.page_payload) == list(map(want, texts))


def test_lookups(spark):
    rows = spark.createDataFrame([("p", "abc1", "Été ﬁn", "z.json"), ("p", "abc1", "Été", "a.json"), ("p", "abc2", None, "b.json"), ("p", "ab", "x", "c.json"), ("q", "zz", "y", "d.json")], "platform string, conversation_id string, title string, file string")
    assert lookup.locate(rows, "p", "abc1").first().file == "a.json"
    assert lookup.locate(rows, "p", " ab ").first().conversation_id == "ab" and lookup.locate(rows, "q", "z").first().file == "d.json"
    for platform, wanted in (("p", "abc"), ("p", "no"), ("q", "ab"), ("p", ""), ("p", None)):
        with pytest.raises(lookup.NotFound):
            lookup.locate(rows, platform, wanted)
    assert {r.file for r in lookup.by_title(rows, "ETE FIN").collect()} == {"z.json"} and lookup.by_title(rows, "zz").count() == 1
    assert lookup.checked_date("2024-01-02", True) == "2024-01-02T23:59:59Z" and lookup.checked_date("2024-01-02T01:00:00+02:00") == "2024-01-01T23:00:00Z" and lookup.checked_date(" ") is None
    assert lookup.checked_id("a.b-c") == "a.b-c" and lookup.checked_range(3, 1, 3) == 3
    for f, a in ((lookup.checked_date, ("soon",)), (lookup.checked_id, ("a/b",)), (lookup.checked_range, (4, 1, 3)), (lookup.checked_range, (True, 0, 3))):
        with pytest.raises(ValueError):
            f(*a)


def test_reports_are_coerced(spark):
    odd = {"verdict": "<b>", "checked": "7", "ok": "x", "degraded": 2.9, "failed": None, "retention": "inf", "seed": 3, "conversations": [{"conversation_id": "a", "status": "ok"}, {"conversation_id": "b", "status": "degrade", "lost": ["images", "links"], "old_messages": "5", "new_messages": "?"}, {"conversation_id": "c", "title": "T", "error": "e", "lost": ["x"]}]}
    texts = [json.dumps(odd), json.dumps({"verdict": "ok", "compared": 3}), "[1]", "broken{", "{}"]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "platform string, report string")
    got = {r.platform: r for r in reports.read_recheck(rows).collect()}
    assert set(got) == {"0", "1", "4"}
    r = got["0"]
    assert (r.verdict, r.checked, r.compared, r.ok, r.degraded, r.failed, r.retention) == ("inconnu", 7, 7, 0, 2, 0, None)
    assert [(i.title, i.reason, i.old_messages, i.new_messages) for i in r.issues] == [("b", "images, links", 5, None), ("T", "e", None, None)]
    assert (got["1"].verdict, got["1"].compared, got["1"].issues) == ("ok", 3, [])
    targets = spark.createDataFrame([("a", None, 4)], "conversation_id string, title string, message_count long")
    failed = reports.failures(targets, "echec", "down").first()
    assert (failed.title, failed.status, failed.old_messages, failed.new_messages, failed.retention, failed.lost) == ("", "echec", 4, 0, None, [])


def test_canaries_outcomes_and_supplements(spark):
    config = json.dumps({"claude": {"conversation_id": "c1", "title": "T", "expected": ["a", "b"]}, "grok": {"title": "none"}})
    got = reports.read_canaries(spark.createDataFrame([(config,), ("x",)], "config string")).collect()
    assert [(r.platform, r.conversation_id, r.expected) for r in got] == [("claude", "c1", ["a", "b"])]
    told = {r.conversation_id: (r.status, r.stop, r.unavailable) for r in reports.outcomes(spark.createDataFrame([("a", None), ("b", "blocked"), ("c", "unavailable"), ("d", "odd")], "conversation_id string, error string")).collect()}
    assert told == {"a": ("exported", False, False), "b": ("blocked", True, False), "c": ("skipped", False, True), "d": ("failed", False, False)}
    of = "capability string, prompt string"
    got = reports.apply_supplements(spark.createDataFrame([("a", "p")], of), spark.createDataFrame([("a", "q"), ("b", "s"), ("b", "r")], of)).collect()
    assert sorted(map(tuple, got)) == [("a", "p", "suite"), ("b", "r", "supplement")]


PAGE = {
    "chatgpt": '<div data-message-author-role="user" data-message-id="u1"><div class="x whitespace-pre-wrap">Hi &amp; <b>bye</b></div></div><div data-message-author-role="assistant" data-message-model-slug="m5"><p>no</p><div class="markdown"><h2>T</h2><ul><li>a<li>b</ul></div><button>Copy</button></div>',
    "claude": '<div data-testid="user-message"><p>Q</p></div><div class="font-claude-response"><details>steps</details><div data-testid="assistant-message-text"><div data-testid="thinking-block">because</div><div class="standard-markdown"><p>A</p></div></div></div>',
    "gemini": "<user-query><div class='query-text'>Q1</div></user-query><model-response></model-response><user-query><div class='query-text'>Q2</div></user-query><model-response><message-content><div class='model-response-text'><p>A2</p></div></message-content><message-actions>Share</message-actions></model-response>",
    "mistral": "<div data-message-author-role='user' data-message-id='m1'><div class='text-hint'>hier</div>Q</div><div data-message-author-role='tool'><pre><code>x  =  1</code></pre></div>",
    "perplexity": "<div class='a group/user-bubble'>Q</div><div data-workflow-final-text>A<span class='citation'>s+1</span></div>",
}
WANT = {
    "chatgpt": [("user", "Hi & **bye**", "u1", None), ("assistant", "## T\n\n- a\n- b", "", "m5")], "claude": [("user", "Q", "", None), ("assistant", "A", "", None)], "gemini": [("user", "Q1", "", None), ("assistant", "", "", None), ("user", "Q2", "", None), ("assistant", "A2", "", None)],
    "mistral": [("user", "Q", "m1", None), ("assistant", "```\nx  =  1\n```", "", None)], "perplexity": [("user", "Q", "", None), ("assistant", "A", "", None)],
}


@pytest.mark.parametrize("platform", sorted(PAGE))
def test_pages(spark, platform):
    rows = spark.createDataFrame([("c", f"<html><nav>x</nav>{PAGE[platform]}</div></p><p>end"), ("d", "<p>nothing"), ("e", ""), ("f", None)], "conversation_id string, html string")
    got = pages.read_pages(rows, platform).orderBy("conversation_id", "pos").collect()
    assert [(r.role, r.texte, r.message_id, r.model) for r in got if r.conversation_id == "c"] == WANT[platform] and {r.conversation_id for r in got} == {"c"}
    if platform == "claude":
        assert [r.reasoning for r in got] == ["", "because"]


def test_versions_are_variants(spark):
    m = lambda i, parent, k, who, t: {"uuid": i, "parent_message_uuid": parent, "sender": who, "index": k, "content": [{"type": "text", "text": t}]}
    talk = {"current_leaf_message_uuid": "d", "chat_messages": [m("a", None, 0, "human", "q"), m("b", "a", 1, "assistant", "old"), m("d", "a", 3, "assistant", "new"), m("z", None, 4, "human", "q2")]}
    got = parsers.claude(spark.createDataFrame([("c", json.dumps(talk))], "conversation_id string, payload string")).orderBy("pos").collect()
    assert [[(v.kind, v.texte, v.message_id, v.active) for v in r.variants] for r in got] == [[("edit", "q", "a", True), ("edit", "q2", "z", False)], [("regeneration", "old", "b", False), ("regeneration", "new", "d", True)]]
    i = lambda i, v, parent, pv, role, t, at: {"id": i, "version": v, "parentId": parent, "parentVersion": pv, "role": role, "createdAt": f"2024-01-01T00:00:0{at}Z", "contentChunks": [{"type": "text", "text": t}]}
    items = [i("u", 0, None, None, "user", "one", 0), i("u", 1, None, None, "user", "two", 1), i("a", 0, "u", 1, "assistant", "x", 2), i("b", 1, "u", 1, "assistant", "y", 3), i("o", 0, "u", 0, "assistant", "z", 1)]
    got = parsers.mistral(spark.createDataFrame([("c", json.dumps({"messages": {"items": items}}))], "conversation_id string, payload string")).orderBy("pos").collect()
    assert [(r.texte, [(v.kind, v.texte, v.active) for v in r.variants]) for r in got] == [("two", [("edit", "one", False), ("edit", "two", True)]), ("y", [("regeneration", "x", False), ("regeneration", "y", True)])]


def test_reparse(spark):
    own = [(p, c, k, f"{c}{k}", ("user", "assistant")[k % 2], None, None, t) for p, c, n, t in (("grok", "kept", 3, "t"), ("grok", "more", 1, "q"), ("chatgpt", "page", 2, "t"), ("grok", "bad", 1, "t"), ("grok", "clean", 1, "a<br>b"), ("perplexity", "x", 1, "a<br>b")) for k in range(n)]
    schema = "platform string, conversation_id string, pos int, message_id string, role string, model string, ts timestamp, texte string"
    messages = spark.createDataFrame(own, schema).withColumn("model", F.when(F.col("pos") == 0, "m"))
    r = lambda i, who, t: {"responseId": i, "sender": who, "message": t}
    payload = lambda *rs: json.dumps({"responses": list(rs)})
    payloads = spark.createDataFrame([("grok", "kept", payload(r("kept0", "human", "t"))), ("grok", "more", payload(r("more0", "human", "q"), r("n", "assistant", "new"))), ("grok", "bad", "broken"), ("grok", "unknown", payload(r("u", "human", "t")))], "platform string, conversation_id string, payload string")
    shown = spark.createDataFrame([("chatgpt", "page", PAGE["chatgpt"]), ("grok", "more", "<p>")], "platform string, conversation_id string, html string")
    out, told = reparse.reparse(messages, payloads, shown)
    assert {x.conversation_id: (x.origin, x.kept, x.messages) for x in told.collect()} == {"kept": ("remapped", True, 3), "more": ("remapped", False, 2), "page": ("reparsed", False, 2), "bad": ("failed", False, 1), "clean": ("cleaned", False, 1), "x": ("cleaned", False, 1)}
    said = {}
    for x in out.orderBy("conversation_id", "pos").collect():
        said.setdefault(x.conversation_id, []).append((x.message_id, x.texte, x.model))
    assert said["more"] == [("more0", "q", "m"), ("n", "new", None)] and len(said["kept"]) == 3 and said["clean"] == [("clean0", "a\nb", "m")] and said["x"] == [("x0", "a<br>b", "m")] and said["bad"] == [("bad0", "t", "m")]
    assert [t for _, t, _ in said["page"]] == ["Hi & **bye**", "## T\n\n- a\n- b"]
    assert {(x.platform, x.what): x.n for x in reparse.counters(told).collect()} == {("grok", "remapped"): 2, ("grok", "kept"): 1, ("grok", "failed"): 1, ("grok", "cleaned"): 1, ("chatgpt", "reparsed"): 1, ("perplexity", "cleaned"): 1}


def test_media_of_one_content_count_once(spark):
    rows = spark.createDataFrame([(k, "p" if k != 3 else "odd", "image", ["a", "a", None, "b", None][k]) for k in range(5)], "media_id int, platform string, kind string, content_key string")
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "media_id int, embedding array<double>")
    got = media.for_query(rows, vectors, [1.0, 0.0], 3, ["p"]).collect()
    assert [r.media_id for r in got] == [0, 2, 4] and got[0].score == 1.0
    assert [r.media_id for r in archive.media_dedupe(rows.where("media_id < 2")).collect()] == [0]


def test_sanitising_of_more_kinds(spark):
    u = "0A0a0a0a-0a0a-0a0a-0a0a-0a0a0a0a0a0a"
    text = f'gemini.google.com/app/0123456789abcdef "conversation_id" : "0123456789abcdef" {"k" * 24}@o12.ingest.de.sentry.io {u} {u.lower()} keep Me real@x.org /home/a 0123456789abcdef'
    make = lambda c: sanitize.sanitize(c, emails={"real@x.org": "fake@example.com"}, paths={"/home/a": "/home/x"}, names={"Me": "You"}, protected=("keep Me", "Keep me"))
    got = column(spark, [text, "Keep me"], make)
    ids = re.findall(r"feed[0-9a-f]{12}", got[0])
    assert len(ids) == 2 and ids[0] == ids[1] and len(re.findall("f0000000-0000-4000-8000-[0-9a-f]{12}", got[0])) == 2 and len(set(re.findall("f0000000[-0-9a-f]{28}", got[0]))) == 1
    assert "key@example.invalid" in got[0] and "keep Me fake@example.com /home/x 0123456789abcdef" in got[0] and got[1] == "keep Me"
    assert column(spark, got, make) == got
    docs = spark.createDataFrame([(1, f"a\n{u}\nsecret TERM"), (2, "clean")], "doc_id int, text string")
    assert sorted((r.line, r.kind) for r in sanitize.findings(docs, terms=("term",)).collect()) == [(2, "uuid"), (3, "terme-local")]
    assert sanitize.audit(docs, apply=True)[1].count() == 0


def test_least_cover_of_a_table(spark, sf_dir):
    m = catalog._table(spark, sf_dir, "messages")
    own = {}
    for r in catalog._tagged(m).collect():
        own.setdefault(r.platform, {})[r.place] = set(r.capabilities)
    want = set()
    for p, tests in own.items():
        left = set().union(*tests.values())
        while left:
            best = max(sorted(tests), key=lambda k: len(tests[k] & left))
            want.add((p, best))
            left -= tests[best]
    assert {tuple(r) for r in calibration.minimum_cover(catalog._tagged(m), "platform").collect()} == want


def test_folds_of_a_table(spark, sf_dir):
    m = catalog._table(spark, sf_dir, "messages").withColumn("role", F.when(F.col("pos") % 3 == 2, F.lit("user")).otherwise(F.col("role")))
    want, last = [], None
    for r in m.orderBy("conversation_id", "pos").collect():
        if last and last[0] == r.conversation_id and last[1] == r.role:
            a, b = last[2].strip(), r.texte.strip()
            if b and b not in a:
                last[2] = r.texte if a and a in b else (last[2] + "\n\n" + r.texte).strip()
        else:
            last = [r.conversation_id, r.role, r.texte]
            want.append(last)
    got = [[r.conversation_id, r.role, r.texte] for r in normalize.fold_runs(m).orderBy("conversation_id", "run").collect()]
    assert got == want


def test_page_links_of_a_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = set()
    for r in rows:
        urls = [u for u, _ in re.findall(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", r.html)]
        want |= {(r.page_id, u) for u in urls if re.search("^https?://|^/", u)}
    assert {(r.page_id, r.url) for r in catalog.queries()["a22_page_links"](spark, sf_dir).collect()} == want


def test_random_conversations(spark, sf_dir):
    ids = lambda: [r.conversation_id for r in catalog.queries()["t6_random"](spark, sf_dir).collect()]
    assert len(set(ids())) == 8 and ids() == ids()


def test_times_are_utc(spark):
    rows = spark.createDataFrame([("p", "c", datetime.datetime(2024, 1, 1)), ("p", "c", datetime.datetime(2023, 1, 1))], "platform string, conversation_id string, ts timestamp")
    convs = spark.createDataFrame([("p", "c", None, None), ("p", "d", None, None)], "platform string, conversation_id string, started_at timestamp, last_message_at timestamp")
    got = {r.conversation_id: (r.started_at, r.last_message_at) for r in reparse.derive_times(convs, rows).collect()}
    assert got == {"c": (datetime.datetime(2023, 1, 1), datetime.datetime(2024, 1, 1)), "d": (None, None)}


def test_cited_sources_and_tools(spark):
    said = 'a<grok:render card_id="k" x><argument name="citation_id">2</argument></grok:render> b'
    one = {"responseId": "r", "sender": "ASSISTANT", "message": said, "webSearchResults": [{"url": "https://w"}], "cardAttachmentsJson": [json.dumps({"id": "k", "cardType": "citation_card", "url": "https://c"}), "x"], "steps": [{"tags": ["tool_usage_card"], "text": ["<xai:tool_name>browse_page</xai:tool_name>"], "citedWebSearchResults": [{"url": "https://d"}]}]}
    two = {"responseId": "s", "sender": "human", "message": "q", "xposts": [{"username": "u", "postId": "5"}, {"url": "https://p"}]}
    got = parsers.grok(spark.createDataFrame([("c", json.dumps({"responses": [one, two]}))], "conversation_id string, payload string")).orderBy("pos").collect()
    assert [(r.texte, list(r.sources), list(r.tools)) for r in got] == [("a[2](https://c) b", ["https://d", "https://c"], ["Navigation web", "Recherche web"]), ("q", ["https://x.com/u/status/5", "https://p"], ["Recherche X"])]


def test_media_files_and_their_content(spark, tmp_path):
    from hashlib import md5

    from convolake.sources import archive as archives

    part = 256 * 1024
    files = {"chatgpt/images/a.png": b"x" * 10, "chatgpt/images/b.png": b"x" * 10, "claude/files/c.mp3": bytes(range(256)) * 4096, "claude/files/d.txt": b"no", "claude/raw/e.png": b"no", "claude/f.json": b"{}"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    key = lambda b: f"{len(b)}:" + md5(b[:part] + (b[-part:] if len(b) > 2 * part else b"")).hexdigest()
    got = {r.path.split(str(tmp_path))[1][1:]: (r.folder, r.kind, r.content_key) for r in archives.read_media(spark, str(tmp_path)).collect()}
    assert got == {n: (n.split("/")[1], "audio" if n.endswith("mp3") else "image", key(files[n])) for n in ("chatgpt/images/a.png", "chatgpt/images/b.png", "claude/files/c.mp3")}


def test_thread_sources_gain_titles(spark):
    rows = spark.createDataFrame([("c", 0, "user", [], None), ("c", 1, "assistant", ["https://a", "B — https://b"], None), ("c", 3, "assistant", ["https://c"], None)], "conversation_id string, pos int, role string, sources array<string>, source_count int")
    thread = spark.createDataFrame([("c", 1, "A", "https://a"), ("c", 2, "X", "https://b"), ("c", 3, None, "https://new")], "conversation_id string, place int, title string, url string")
    got = {r.pos: list(r.sources) for r in parsers.attach_thread_sources(rows, thread).collect()}
    assert got == {0: [], 1: ["A — https://a", "B — https://b"], 3: ["https://c", "https://new"]}


def test_files_of_prompts(spark):
    of = F.when(F.col("k") < 2, F.array(F.lit("photo.png"), F.lit("notes.txt"), F.lit("more.txt")))
    rows = spark.createDataFrame([(0, "open a.jpg, b.txt, c.txt, d.TXT, e.pdf and f.png."), (1, ""), (2, "a.txt")], "k int, x string")
    got = [r.y for r in rows.orderBy("k").select("k", calibration.align_filenames(F.col("x"), of).alias("y")).collect()]
    assert got == ["open photo.png, notes.txt, more.txt, more.txt, e.pdf and photo.png.", "", "a.txt"]

"""Grep with one budget, media caches, histograms of keys, capabilities, audits and times, against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.operators import media, quality, search, shapes
from convolake.sources import archive as archives


def one_column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").coalesce(1)
    return [r.y for r in rows.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


def test_places_of_matches(spark):
    deal = random.Random(2)
    texts = ["", "aaa", "\x00a\x01", None] + ["".join(deal.choice("abA é\n.*") for _ in range(deal.randint(0, 20))) for _ in range(150)]
    for pattern in ("a", "a+", "(?i)a|b", r"\ba", "x*", "(a)(b)?", "a*", "^", "é", r"(?s)a.b"):
        got = one_column(spark, texts, lambda c, p=pattern: search.occurrences(c, p))
        want = [[(m.start(), m.end()) for m in re.finditer(pattern, t or "") if m.end() > m.start()] for t in texts]
        if pattern == r"\ba":
            want = [[(m.start(), m.end()) for m in re.finditer(r"(?a:\ba)", (t or "").replace("é", "e"))] for t in texts]
        assert [[tuple(s) for s in g or []] for g in got] == want, pattern


CONVERSATION = "platform string, conversation_id string, file string, title string, url string, model string"
MESSAGE = "platform string, conversation_id string, pos int, message_id string, role string, model string, texte string, reasoning string, sources array<string>, tools array<string>, artifacts array<string>, variants array<struct<texte:string>>"


def files(deal):
    said = lambda: "".join(deal.choice(["cat", "Cat", "dog", " ", "c.t", "\n"]) for _ in range(deal.randint(0, 6)))
    conversations = [(p, f"{p}{k}", f"{deal.randint(0, 99):02}-{p}{k}.json", said(), None if k % 2 else said(), said()) for p in "pq" for k in range(7)]
    messages = [(c[0], c[1], k, f"m{k}", "user", said(), said(), said(), [said(), said()], [], None, [(said(),), (None,)] if k % 2 else None) for c in conversations for k in range(deal.randint(0, 3))]
    return conversations, messages


def loop(conversations, messages, pattern, limit, inventory=()):
    """All files in order, up to the budget."""
    out, truncated = [], False
    for c in sorted(conversations, key=lambda c: (c[0], c[2], c[1])):
        if len(out) >= limit:
            truncated = True
            break
        fields = [("title", c[3]), ("url", c[4]), ("conversation_id", c[1]), ("model", c[5])]
        for m in sorted((m for m in messages if m[:2] == c[:2]), key=lambda m: m[2]):
            fields += [("texte", m[6]), ("reasoning", m[7]), ("message_id", m[3]), ("model", m[5])]
            fields += [(f"{n}[{i}]", v) for n, a in (("sources", m[8]), ("tools", m[9]), ("artifacts", m[10])) for i, v in enumerate(a or [])]
            fields += [(f"variants[{i}].texte", v[0]) for i, v in enumerate(m[11] or [])]
        out += [(c[0], c[1], f, x.start()) for f, v in fields for x in re.finditer(pattern, v or "", re.I)]
    for e in sorted(inventory):
        if len(out) < limit and not e[3]:
            out += [(e[0], e[1], f"list.{f}", x.start()) for f, v in (("title", e[2]), ("conversation_id", e[1])) for x in re.finditer(pattern, v or "", re.I)]
    return out[:limit], truncated


@pytest.mark.parametrize(("limit", "regex"), [(1, False), (7, True), (40, False), (200, True)])
def test_grep_equals_a_loop_over_files(spark, limit, regex):
    conversations, messages = files(random.Random(limit))
    inventory = [("p", "cat1", "a cat", False), ("q", "x", "cat cat", True), ("r", "y", None, None)]
    c, m, i = spark.createDataFrame(conversations, CONVERSATION), spark.createDataFrame(messages, MESSAGE), spark.createDataFrame(inventory, "platform string, conversation_id string, title string, scraped boolean")
    found, cut = search.grep_archive(c, m, "c.t", regex, limit, i)
    got = [(r.platform, r.conversation_id, r.field, r.start) for r in found.orderBy("source", "place", "pos", "k", "platform", "conversation_id", "start").collect()]
    assert (got, cut) == loop(conversations, messages, "c.t" if regex else r"c\.t", limit, inventory)
    assert search.grep_archive(c, m, "no such thing")[0].collect() == [] and search.grep_archive(c.limit(0), m, "cat") [1] is False
    with pytest.raises(ValueError):
        search.grep_archive(c, m, "")
    with pytest.raises(re.error):
        search.grep_archive(c, m, "(", True)


def test_media_are_cached_once(spark):
    png, html = bytes.fromhex("89504e470d0a1a0a00"), b" <!DOCTYPE html>"
    texts = ["![a](https://x/1.png) and ![b](https://x/2)", "[doc](https://x/f.pdf?k=1) ![a](https://x/1.png) [page](https://x/p.pdf)", "[site](https://x/about) https://x/bare.pdf", None, "![long](https://x/1.png?full)"]
    m = spark.createDataFrame(list(enumerate(texts)), "msg_seq int, texte string")
    wanted = media.addresses(m)
    assert {(r.url, r.folder) for r in wanted.collect()} == {("https://x/1.png", "images"), ("https://x/2", "images"), ("https://x/f.pdf?k=1", "files"), ("https://x/p.pdf", "files"), ("https://x/1.png?full", "images")}
    got = spark.createDataFrame([("https://x/1.png", "image/png", png), ("https://x/1.png", "image/png", png), ("https://x/2", "image/jpeg; q=1", b"\xff\xd8\xff\xe0"), ("https://x/f.pdf?k=1", "application/pdf", b"%PDF"), ("https://x/p.pdf", None, html), ("https://x/other", None, png)], "url string, content_type string, content binary")
    empty = spark.createDataFrame([], media.CACHE)
    new, counts = media.refresh_cache(wanted, empty, got)
    assert {r.state: r["count"] for r in counts.collect()} == {"new": 3, "failed": 2}
    cache = {r.url: f"{r.folder}/{r.name}" for r in new.collect()}
    assert {u: n[-4:] for u, n in cache.items()} == {"https://x/1.png": ".png", "https://x/2": ".jpg", "https://x/f.pdf?k=1": ".pdf"}
    said = {r.msg_seq: r.texte for r in media.localised(m, new).collect()}
    assert said == {0: f"![a]({cache['https://x/1.png']}) and ![b]({cache['https://x/2']})", 1: f"[doc]({cache['https://x/f.pdf?k=1']}) ![a]({cache['https://x/1.png']}) [page](https://x/p.pdf)", 2: texts[2], 3: None, 4: said[4]}
    again, counts = media.refresh_cache(wanted, new, got)
    assert again.collect() == [] and {r.state: r["count"] for r in counts.collect()} == {"cached": 3, "failed": 2}


def test_histograms_merge_in_any_order(spark):
    deal = random.Random(4)
    payload = lambda: json.dumps({k: deal.choice([1, "x", None, [1, 2], {"z": 1}]) for k in deal.sample("abcdefg", deal.randint(1, 7))})
    rows = spark.createDataFrame([(k, payload()) for k in range(40)], "payload_id long, payload string")
    ref = shapes.merge(shapes.shape_rows(spark.createDataFrame([(0, '{"a": 1, "b": "x", "c": 1, "d": {"z": 1}}')], "payload_id long, payload string")))
    health = shapes.payload_health(ref, shapes.shape_rows(rows)).cache()
    each = {r.payload_id: r for r in health.collect()}
    for k in (0, 7, 31):
        alone = shapes.compare(ref, shapes.merge(shapes.shape_rows(rows.where(f"payload_id = {k}"))))
        s = shapes.score(alone).first()
        changed = sorted((shapes.CHANGES.index(r.change), r.path) for r in alone.collect() if r.change != "same")
        assert (each[k].score, each[k].level, each[k].keys) == (s.score, s.level, [p for _, p in changed])
    said = lambda df: [(r.n, r.matches, r.drifts, r.breaks, r.additions, r.least, r.mean, r.drift_keys, r.new_keys) for r in df.collect()]
    whole = said(shapes.key_histogram(health))
    parts = [shapes.key_histogram(health.where(F.col("payload_id") % 5 == k)) for k in range(5)]
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1]):
        df = parts[order[0]]
        for k in order[1:]:
            df = shapes.merged_histograms(df.unionByName(parts[k]))
        assert said(df) == whole
    assert whole[0][0] == 40 and whole[0][2] == sum(x.n for x in whole[0][7] if x.key == "$.a") + whole[0][2] - sum(x.n for x in whole[0][7] if x.key == "$.a")


def test_capabilities_of_files_tools_and_pages(spark):
    kind = "platform string, conversation_id string, pos int, texte string, code_blocks array<struct<language:string,code:string>>, tools array<string>, reasoning string"
    rows = [("p", "a", 0, "see DOCUMENT-x.pdf", [("py", "x\n" * 8)], ["Lecture de fichier"], None), ("p", "a", 1, "x", [], ["python 3"], " "), ("p", "b", 0, "```\nq\n```", [], None, "why"), ("p", "c", 0, None, None, [None], None)]
    pages = spark.createDataFrame([("p", "c", "<VIDEO src=x>"), ("p", "c", "<AUDIO>"), ("q", "z", "<audio>")], "platform string, conversation_id string, html string")
    got = {r.conversation_id: r.capabilities for r in quality.capabilities(spark.createDataFrame(rows, kind), pages).collect()}
    assert got == {"a": ["code_block", "code_execution", "code_languages", "code_long", "upload_pdf"], "b": ["reasoning"], "c": ["audio"]}
    assert len(quality.DETECTORS) + len(quality.FILES) + len(quality.TOOL_WORDS) + 7 == 35


def test_audits_count_what_is_missing(spark):
    m = spark.createDataFrame([("p", "a", "assistant", "ok"), ("p", "a", "user", "<div>"), ("q", "b", "assistant", "```py\n<div>\n```")], "platform string, conversation_id string, role string, texte string")
    c = spark.createDataFrame([("p", None, "m"), ("p", "t", None), ("r", None, None)], "platform string, started_at string, model string")
    got = {r.platform: (r.conv, r.msgs, r.code_blocks, r.residual_html, r.near_empty, r.without_time, r.without_model) for r in quality.audit(m, c).collect()}
    assert got == {"p": (2, 2, 0, 1, 1, 1, 1), "q": (1, 1, 1, 0, 0, 0, 0), "r": (1, 0, 0, 0, 0, 1, 1)}


def test_times_that_are_numbers(spark, tmp_path):
    (tmp_path / "claude").mkdir()
    times = [1700000000, 1700000000.9, "1700000000", "2023-11-14T22:13:20Z", None, True, "soon"]
    (tmp_path / "claude" / "c.json").write_text(json.dumps({"conversation_id": "c", "title": "t", "messages": [{"role": "user", "texte": str(k), "timestamp": t} for k, t in enumerate(times)]}))
    got = archives.messages(archives.read_conversations(spark, str(tmp_path))).orderBy("pos").collect()
    assert [r.ts and r.ts.timestamp() for r in got] == [1700000000, 1700000000, None, 1700000000, None, None, None]


def test_scores_fold_a_text_once(spark):
    df = spark.createDataFrame([("Été d'été ﬁn, ete",), (None,), ("rien",)], "x string").select(T.keyword_score(F.col("x"), ["été", "ete", "fin", "absent"], "été d'").alias("y"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("reflect(") == 1
    assert [r.y for r in df.collect()] == [1.0, 0.0, 0.0]

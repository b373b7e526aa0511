import datetime
import hashlib
import html
import json
import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.operators import archive, calibration, normalize, parsers, quality, sanitize, search, shapes
from convolake.plans import catalog
from convolake.sources import archive as archives
from convolake.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def one_fold(said):
    return "".join(c for c in unicodedata.normalize("NFKD", said.lower()) if not unicodedata.combining(c))


def test_text(spark):
    assert one(spark, T.slug(F.lit("Été à la Plage!! (2)"))) == "ete-a-la-plage-2"
    assert one(spark, T.slug(F.lit("!!!"))) == "untitled"
    assert one(spark, T.tokens(F.lit("L'IA, sous-titre l'ia X"))) == ["ia", "sous-titre"]
    assert one(spark, T.keyword_score(F.lit("La maison sociale"), ["ia"])) == 0.0
    assert one(spark, T.keyword_score(F.lit("Été à Paris"), ["ete", "paris", "x"], "été à")) == pytest.approx(2 / 3 + 0.3)
    assert [tuple(b) for b in one(spark, T.code_blocks(F.lit("a\n```py\nx\n\n```\n```\ny```\nz\n```")))] == [("py", "x\n"), ("", "y```\nz")]
    assert one(spark, T.iso_z(T.parse_iso(F.lit("2024-01-01T01:00:00+02:00")))) == "2023-12-31T23:00:00Z"
    assert one(spark, T.parse_iso(F.lit("soon"))) is None
    assert one(spark, T.canonical_url(F.lit("<link rel=x href=a><LINK href=' https://a ' rel='canonical'>"))) == "https://a"
    assert one(spark, T.autolink(F.lit("see https://a.b/c. and (https://d)"))) == "see <https://a.b/c>. and (https://d)"
    assert one(spark, T.markdown_text(F.lit("# A\n- **b** [c](http://d) `e`"))) == "A b c e"
    assert one(spark, T.extract(F.lit("aaaa bbbb cccc"), 7)) == "aaaa…" and one(spark, T.extract(F.lit("aaaaaaaaa"), 4)) == "aaaa…"
    assert one(spark, T.masked_key(F.lit("0a0a0a0a-0a0a-0a0a-0a0a-0a0a0a0a0a0a:3"))) == "<uuid>:3"


def test_fold_of_runs(spark):
    rows = [("c", 0, "user", "a", "1", None), ("c", 1, "user", "a", "2", "m"), ("c", 2, "assistant", "", "3", None), ("c", 3, "assistant", "x", "", "n"), ("c", 4, "assistant", "x y", "5", "o"), ("c", 5, "assistant", "z", "6", None), ("c", 6, "user", None, "7", None)]
    df = spark.createDataFrame([("p", *r, None) for r in rows], "platform string, conversation_id string, pos int, role string, texte string, message_id string, model string, ts timestamp")
    got = [(r.role, r.texte, r.message_id, r.model) for r in normalize.fold_runs(df).orderBy("run").collect()]
    assert got == [("user", "a", "1", "m"), ("assistant", "x y\n\nz", "3", "n"), ("user", "", "7", None)]


def test_merge_keeps_the_archive(spark):
    schema = "platform string, conversation_id string, pos int, role string, message_id string, texte string"
    talk = lambda c, ids, t="t": [("p", c, k, "user", i, t) for k, i in enumerate(ids)]
    old = spark.createDataFrame(talk("same", "ab") + talk("more", "ab") + talk("start", "abc") + talk("end", "abc") + talk("other", "ab") + talk("edited", "ab") + talk("gone", "a"), schema)
    new = spark.createDataFrame(talk("same", "ab") + talk("more", "abc") + talk("start", "ab") + talk("end", "bc") + talk("other", "xy") + talk("edited", "ab", "u") + talk("new", "a"), schema)
    status = {r.conversation_id: (r.status, r.appended) for r in archive.merge_status(old, new).collect()}
    assert status == {"same": ("unchanged", 0), "more": ("patched", 1), "start": ("kept", 0), "end": ("kept", 0), "other": ("rewritten", 2), "edited": ("rewritten", 2), "gone": ("absent", 0), "new": ("written", 1)}
    kept = {}
    for r in incremental.merged_messages(old, new).orderBy("pos").collect():
        kept.setdefault(r.conversation_id, []).append(r.message_id)
    assert {k: "".join(v) for k, v in kept.items()} == {"same": "ab", "more": "abc", "start": "abc", "end": "abc", "other": "xy", "edited": "ab", "gone": "a", "new": "a"}


def test_stream_merges_and_counts(spark, tmp_path):
    schema = "platform string, conversation_id string, pos int, role string, message_id string, texte string"
    for k, ids in enumerate(("ab", "abc", "bc")):
        spark.createDataFrame([("p", "c", i, "user", m, "t") for i, m in enumerate(ids)], schema).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    import shutil

    (tmp_path / "in").mkdir()
    for k in range(3):
        part = next((tmp_path / f"in{k}").glob("*.parquet"))
        shutil.copy(part, tmp_path / "in" / f"{k}.parquet")
        q = incremental.follow_archive(incremental.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(part)).schema), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(60)
    assert sorted(r.message_id for r in incremental.read_archive(spark, f"{tmp_path}/out").collect()) == ["a", "b", "c"]

    spark.createDataFrame([("a", 99.0), ("a", 85.0), ("b", 10.0)], "service string, score double").write.parquet(f"{tmp_path}/scores")
    stream = spark.readStream.schema("service string, score double").parquet(f"{tmp_path}/scores")
    incremental.follow_health(stream, "health", str(tmp_path / "check2")).awaitTermination(60)
    assert {(r.service, r.n, r.matches, r.drifts, r.breaks) for r in spark.table("health").collect()} == {("a", 2, 1, 1, 0), ("b", 1, 0, 0, 1)}


def test_archive_tree(spark, tmp_path):
    talk = {"platform": "p", "conversation_id": "c", "title": "t", "started_at": "bad", "messages": [{"role": "user", "content": "hi ```\nx\n```", "message_id": None}, {"role": "robot", "texte": "see ![a](images/b.png)", "sources": ["s", None]}]}
    for sub in ("p/raw", "p/images", "p/files", "q"):
        (tmp_path / sub).mkdir(parents=True)
    (tmp_path / "p/c.json").write_text(json.dumps(talk))
    (tmp_path / "p/broken.json").write_text("{")
    (tmp_path / "p/conversation_list.json").write_text(json.dumps({"platform": "p", "conversations": [{"conversation_id": "c", "title": "old"}, {"conversation_id": "c", "title": "new"}, {"title": "none"}]}))
    (tmp_path / "p/raw/c.json").write_text('{"a": 1}')
    (tmp_path / "p/raw/bad.json").write_text("{")
    (tmp_path / "p/images/b.png").write_bytes(b"x" * 10)
    (tmp_path / "p/files/b.mp3").write_bytes(b"y" * 600_000)
    (tmp_path / "p/files/b.png").write_bytes(b"z")
    got = archives.read_conversations(spark, str(tmp_path)).cache()
    assert [r.conversation_id for r in got.collect()] == ["c"]
    assert archives.violations(got).first().violations == ["role", "started_at"]
    rows = archives.messages(got).orderBy("pos").collect()
    assert [(r.texte[:3], len(r.code_blocks), r.sources) for r in rows] == [("hi ", 0, []), ("see", 0, ["s"])] or rows[0].code_blocks
    assert [(r.conversation_id, r.title) for r in archives.read_inventories(spark, str(tmp_path)).collect()] == [("c", "new")]
    assert [r.conversation_id for r in archives.read_payloads(spark, str(tmp_path)).collect()] == ["c"]
    assert sorted(r.kind for r in archives.read_media(spark, str(tmp_path)).collect()) == ["audio", "image"]
    assert archives.media_references(archives.messages(got)).first().name == "b.png"
    archives.write_table(archives.messages(got).select("platform", "conversation_id", "pos"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    archives.write_inventories(archives.read_inventories(spark, str(tmp_path)), str(tmp_path / "inventory"))
    assert spark.read.json(str(tmp_path / "inventory")).first()["count"] == 1


def test_pages():
    title, said = parsers.to_markdown("<html><head><title> A  b</title><style>x</style></head><body><h2>Head</h2><p>a <b>bold</b> <a href='https://x'>link</a> <a href='javascript:1'>no</a></p><ul><li>one<ul><li>two</li></ul></li></ul><ol start=3><li>c</li></ol><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><pre>  x\n y</pre><img src='data:x'><img src='i.png' alt='i'></body>")
    assert title == "A b"
    for part in ("## Head", "a **bold** [link](https://x) no", "- one\n  - two", "3. c", "| a | b |\n| --- | --- |\n| 1 |  |", "```\n  x\n y\n```", "![i](i.png)"):
        assert part in said, (part, said)


def test_text_of_whole_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in catalog._table(spark, sf_dir, "pages").collect()}
    got = {r.page_id: r.value for r in catalog.queries()["c43_html_text_pages"](spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for k, said in pages.items():
        said = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", said)
        said = re.sub(r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|pre|blockquote)>", "\n", said)
        assert got[k] == html.unescape(re.sub(r"<[^>]+>", "", said))


def test_whole_ids_and_words(spark, sf_dir):
    ids = {r.doc_id: r.value for r in catalog.queries()["c14_safe_id"](spark, sf_dir).collect()}
    for r in catalog._table(spark, sf_dir, "documents").collect():
        assert ids[r.doc_id] == hashlib.md5((re.sub(r"[^A-Za-z0-9._-]", "_", r.text.strip()) or "unknown").encode()).hexdigest()
    words = {r.msg_seq: r.value for r in catalog.queries()["u6_ordered_distinct"](spark, sf_dir).collect()}
    for r in catalog._table(spark, sf_dir, "messages").collect():
        assert words[r.msg_seq] == hashlib.md5(" ".join(dict.fromkeys(re.sub(r"\s+", " ", r.texte).split(" "))).encode()).hexdigest()


def test_pending_reasoning(spark):
    m = lambda role, kind, **c: {"id": c.pop("id", ""), "author": {"role": role}, "content": {"content_type": kind, **c}, "metadata": {}}
    talk = [m("system", "text", parts=["no"]), m("user", "text", id="u", parts=["q"]), m("assistant", "thoughts", thoughts=[{"summary": "s", "content": "t"}]), m("assistant", "text", id="a", parts=["r \\(x\\)"]), m("assistant", "thoughts", thoughts=[{"summary": "lost", "content": ""}]), m("user", "text", id="v", parts=["p"])]
    df = spark.createDataFrame([("c", json.dumps({"messages": talk}))], "conversation_id string, payload string")
    got = [(r.role, r.texte, r.reasoning, r.message_id, r.tools) for r in parsers.chatgpt(df).orderBy("pos").collect()]
    assert got == [("user", "q", "", "u", []), ("assistant", "r $x$", "t", "a", ["s"]), ("user", "p", "", "v", [])]


def test_branch_of_a_tree(spark):
    m = lambda i, parent, k, t: {"uuid": i, "parent_message_uuid": parent, "sender": "human" if k % 2 == 0 else "assistant", "index": k, "content": [{"type": "text", "text": t}, {"type": "thinking", "thinking": "why"}, {"type": "tool_use", "name": "search"}]}
    talk = {"current_leaf_message_uuid": "d", "chat_messages": [m("a", None, 0, "q"), m("b", "a", 1, "old"), m("d", "a", 3, "new")]}
    df = spark.createDataFrame([("c", json.dumps(talk))], "conversation_id string, payload string")
    got = [(r.role, r.texte, r.reasoning, list(r.tools)) for r in parsers.claude(df).orderBy("pos").collect()]
    assert got == [("user", "q", "", []), ("assistant", "new", "why", ["search"])]


def test_walks_of_long_chains(spark):
    rows = [("c", k, 10 * k) for k in range(700)] + [("d", 0, 7), ("e", 0, 1), ("e", 1, 2)]
    df = spark.createDataFrame(rows, "conversation_id string, pos int, msg_seq long")
    branch, at = [], 699
    while at >= 0:
        branch.append(("c", at, len(branch)))
        at -= 2 if at % 4 == 3 else 1
    branch += [("d", 0, 0), ("e", 1, 0), ("e", 0, 1)]
    tree = df.withColumns({"parent": F.when(F.col("pos") % 4 == 3, F.col("pos") - 2).otherwise(F.col("pos") - 1), "leaf": F.expr("(conversation_id = 'c' AND pos = 699) OR (conversation_id = 'd') OR (conversation_id = 'e' AND pos = 1)")})
    assert sorted(map(tuple, normalize.active_branch(tree).collect())) == sorted(branch)
    windows = df.select("conversation_id", F.explode(F.array(F.floor(F.col("pos") / 5), F.floor((F.col("pos") + 2) / 5))).alias("window"), "pos", F.col("msg_seq").alias("key")).distinct()
    want = [("c", 10 * k, k) for k in range(700)] + [("d", 7, 0), ("e", 1, 0), ("e", 2, 1)]
    assert sorted(map(tuple, normalize.window_chain(windows).collect())) == want
    steps = spark.createDataFrame([("c", "a", "b", True), ("c", "b", "c", False), ("c", "c", "b", False), ("d", "a", "z", True), ("d", "b", None, True)], "conversation_id string, id string, next string, start boolean")
    assert sorted(map(tuple, normalize.follow(steps, "id").collect())) == [("c", "a", 0), ("c", "b", 1), ("c", "c", 2), ("d", "a", 0), ("d", "b", 0)]


def test_chain_of_edges(spark):
    keys = spark.createDataFrame([("c", k, i) for i, k in enumerate("dabcexy")], "conversation_id string, key string, seen int")
    edges = spark.createDataFrame([("c", *e, i) for i, e in enumerate(["ab", "ac", "bc", "zd", "cc", "xy", "yx", "cd"])], "conversation_id string, key string, next string, seen int")
    edges = edges.select("conversation_id", "key", "next", "seen")
    place = lambda e: "".join(r.key for r in sorted(normalize.chain(keys, e).collect(), key=lambda r: r.place))
    assert place(edges) == "abcdexy"  # x and y follow each other: a cycle starts where it was discovered
    assert place(edges.limit(0)) == "dabcexy"
    assert normalize.chain(keys.limit(0), edges).collect() == []


def test_metadata_of_the_archive(spark):
    schema = "platform string, conversation_id string, pos int, message_id string, ts timestamp, model string, texte string"
    at = datetime.datetime(2024, 1, 2)
    new = spark.createDataFrame([("p", "c", 0, "a", None, "", "x"), ("p", "c", 1, "", None, None, "y"), ("p", "c", 2, "z", None, "own", "w"), ("p", "d", 0, "a", None, None, "v")], schema)
    old = spark.createDataFrame([("p", "c", 5, "a", at, "m", "x"), ("p", "c", 1, "b", at, "n", "y"), ("p", "c", 2, "q", at, "o", "w")], schema)
    got = {(r.conversation_id, r.pos): (r.message_id, r.ts, r.model, r.matched) for r in archive.metadata_fallback(new, old).collect()}
    assert got == {("c", 0): ("a", at, "m", "id"), ("c", 1): ("b", at, "n", "place"), ("c", 2): ("z", at, "own", "place"), ("d", 0): ("a", None, None, "none")}


def test_branches_of_long_trees(spark):
    ids = [f"m{k}" for k in range(6000)]
    tree = [{"uuid": i, "parent_message_uuid": p, "sender": "human", "index": k, "content": [{"type": "text", "text": i}]} for k, (i, p) in enumerate(zip(ids, [None, *ids]))]
    items = [{"id": i, "version": 0, "parentId": p, "role": "user", "createdAt": f"2024-01-01T{k:06}", "contentChunks": [{"type": "text", "text": i}]} for k, (i, p) in enumerate(zip(ids, [None, *ids]))]
    for mapper, talk in ((parsers.claude, {"current_leaf_message_uuid": ids[-1], "chat_messages": tree}), (parsers.mistral, {"messages": {"items": items}})):
        got = mapper(spark.createDataFrame([("c", json.dumps(talk))], "conversation_id string, payload string"))
        assert [r.texte for r in got.orderBy("pos").collect()] == ids


def test_suites_and_covers(spark):
    suite = "# Media\n## Test 1 — Images\n```\nsend it\n```\n## Test 2 : Audio\n```\nplay\n```\n# End\n"
    df = spark.createDataFrame([("s", suite)], "suite_id string, text string")
    got = [(r.capability, r.section, r.prompt) for r in calibration.extract_tests(df).orderBy("place").collect()]
    assert got == [("Images", "Media", "send it"), ("Audio", "Media", "play")]
    tests = spark.createDataFrame([("p", 1, ["a"]), ("p", 2, ["a", "b"]), ("p", 3, ["c"]), ("p", 4, ["b", "c"])], "key string, place int, capabilities array<string>")
    assert sorted(r.place for r in calibration.minimum_cover(tests, "key").collect()) == [2, 3]


def test_tags_of_whole_texts(spark, sf_dir):
    df = spark.createDataFrame([("p", 7, 1, "x " * 300 + "ÜND"), ("p", 0, 2, "the end"), ("q", 9, 3, "the les")], "platform string, pos int, msg_seq long, texte string")
    assert {r.place: r.capabilities for r in catalog._tagged(df).collect()} == {1: ["german"], 2: ["articles"], 3: ["articles", "french"]}
    own = {}
    for r in catalog._table(spark, sf_dir, "messages").collect():
        own.setdefault(r.platform, {})[r.msg_seq] = {i for i, k in catalog._TAXONOMY if k in one_fold(r.texte)}
    cover = {}
    for platform, tags in own.items():
        left = set().union(*tags.values())
        while left:
            best = max(sorted(tags), key=lambda p: len(tags[p] & left))
            cover.setdefault(platform, []).append(best)
            left -= tags[best]
    got = {}
    for r in catalog.queries()["q5_min_cover"](spark, sf_dir).collect():
        got.setdefault(r.platform, []).append(r.place)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in cover.items()}
    every = {i for i, _ in catalog._TAXONOMY}
    want = {k: (sorted(set().union(*v.values())), sorted(every - set().union(*v.values()))) for k, v in own.items()}
    m = catalog._table(spark, sf_dir, "messages")
    told = calibration.payload(catalog._tagged(m), spark.createDataFrame(catalog._TAXONOMY, "id string, keyword string"), "platform")
    assert {r.platform: (r.covered, r.missing) for r in told.collect()} == want
    assert {r.platform: (r.covered, r.missing) for r in catalog.queries()["q7_payload"](spark, sf_dir).collect()} == {k: tuple(map(",".join, v)) for k, v in want.items()}


def greedy_coverage(queue, seen):
    used, present = set(), []
    for short, long in queue:
        near = [j for j, (s, _) in enumerate(seen) if j not in used and s and short and (short in s or s in short)]
        if near:
            used.add(max(near, key=lambda j: SequenceMatcher(None, long, seen[j][1]).ratio()))
        present.append(bool(near))
    return present


def test_coverage_of_a_whole_queue(spark, sf_dir):
    deal = random.Random(3)
    words = ["".join(deal.choice("ab") for _ in range(deal.randint(0, 4))) for _ in range(400)]
    words += [deal.choice(("the first turn of a talk that is ", "x" * 30)) + deal.choice(("", "one", "two", "long " * 30)) for _ in range(200)] + [None, "!?"]
    deal.shuffle(words)
    frame = lambda some: spark.createDataFrame([(deal_key(k), k, t) for k, t in enumerate(some)], "platform string, place long, texte string")
    deal_key = lambda k: "pq"[k % 2]
    queue, seen = frame(words), frame(sorted(words[:300], key=str))
    keys = lambda d: d.select("platform", "place", T.match_key(F.col("texte"), 25).alias("short"), T.match_key(F.col("texte"), 120).alias("long")).orderBy("place").collect()

    def held(queue, seen):
        left, right = keys(queue), keys(seen)
        want = {}
        for p in {r.platform for r in left}:
            own = [r for r in left if r.platform == p]
            want |= {(p, r.place): x for r, x in zip(own, greedy_coverage([(r.short, r.long) for r in own], [(r.short, r.long) for r in right if r.platform == p]), strict=True)}
        return want

    assert {(r.platform, r.place): r.present for r in calibration.queue_coverage(queue, seen).collect()} == held(queue, seen)
    asked = catalog._table(spark, sf_dir, "messages").where("role = 'user'").withColumn("place", F.col("msg_seq"))
    assert {(r.platform, r.place): r.present for r in catalog.queries()["j19_queue_coverage"](spark, sf_dir).collect()} == held(asked, asked.where("conv_id % 3 <> 0"))


def test_shape_scores(spark):
    rows = lambda *said: spark.createDataFrame([(k, s) for k, s in enumerate(said)], "payload_id int, payload string")
    ref = shapes.merge(shapes.shape_rows(rows('{"id": "x", "messages": [{"role": "u", "n": 1}]}', "not json")))
    same = shapes.score(shapes.compare(ref, ref)).first()
    assert (same.score, same.level) == (100.0, "OK")
    empty = shapes.score(shapes.compare(ref, shapes.merge(shapes.shape_rows(rows('{"id": "x", "messages": []}'))))).first()
    assert empty.emptied == 1 and empty.level == "BREAK"
    other = shapes.compare(ref, shapes.merge(shapes.shape_rows(rows('{"id": 1, "messages": [{"role": null}], "b": 2}'))))
    assert {r.path: r.change for r in other.collect() if r.change != "same"} == {"$.id": "type", "$.b": "added", "$.messages[].n": "removed"}
    assert shapes.signature(ref).first().n_paths == 6


def test_sanitising(spark):
    said = "a@b.co 1b4e28ba-2fa1-11d2-883f-0016d3cca427 eyJabcdefghijk.abcdefghijkl?sig=zz&x /home/me/Documents/code x@example.com"
    clean = one(spark, sanitize.sanitize(F.lit(said)))
    assert "sig=REDACTED" in clean or "eyJhbGci" in clean
    assert "1b4e28ba" not in clean and sanitize.FAKE_UUID in clean
    found = {r.kind for r in sanitize.findings(spark.createDataFrame([(1, said)], "doc_id int, text string")).collect()}
    assert found >= {"email", "uuid", "jwt", "chemin"}


def test_search_semantics(spark):
    m = spark.createDataFrame([(1, "p", "c1", "user", "the cat", None), (2, "q", "c1", "user", "dog", None), (3, "p", "c2", "assistant", "CAT nap", None)], "msg_seq long, platform string, conversation_id string, role string, texte string, ts timestamp")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "msg_seq long, embedding array<float>")
    assert [r.msg_seq for r in search.knn_prefiltered(m, v, [1.0, 0.0], 1, platform="q").collect()] == [2]
    assert search.knn_postfiltered(m, v, [1.0, 0.0], 1, platforms=["q"]).collect() == []
    assert [r.msg_seq for r in search.hybrid(m, v, [1.0, 0.0], "cat", k=2).collect()] == [1, 2]
    assert [r.msg_seq for r in search.hybrid(m, v, [1.0, 0.0], "cat", k=2, alpha=0.0).collect()] == [1, 3]
    assert [(r.conversation_id, r.hit_count) for r in search.group_results(search.hybrid(m, v, [1.0, 0.0], "cat", k=3)).orderBy("place").collect()] == [("c1", 1), ("c1", 1), ("c2", 1)]


def test_rechecks_of_real_texts(spark):
    rich = "![i](u)\n- a\n1. b\n| --- |\n```py\nx\n```\n$x$"
    rows = [("p", f"c{c}", c, k, "user" if k % 2 == 0 else "assistant", t) for c in (3, 4) for k, t in enumerate(("hi", "ho", rich))]
    rows += [("p", "c7", 7, k, "user" if k % 2 == 0 else "assistant", rich) for k in range(3)] + [("p", "c10", 10, k, "user", "") for k in range(4)]
    df = spark.createDataFrame(rows, "platform string, conversation_id string, conv_id long, pos int, role string, texte string")
    got = {r.conversation_id: (r.old_messages, r.new_messages, r.lost, r.status) for r in catalog._rechecked(df).collect()}
    assert got == {"c3": (3, 3, [], "ok"), "c4": (3, 2, ["images", "tables", "lists", "code_langs", "latex"], "degrade"), "c7": (3, 2, [], "degrade"), "c10": (4, 2, ["messages"], "degrade")}


def test_verdicts(spark):
    df = spark.createDataFrame([("a", "ok", 1.0), ("a", "vide", 0.0), ("b", "ok", 1.0), ("b", "degrade", 0.9), ("b", "ignore", None), ("c", "ignore", None), ("d", "ok", 1.2)], "platform string, status string, retention double")
    assert {r.platform: r.verdict for r in quality.verdicts(df).collect()} == {"a": "critique", "b": "attention", "c": "inconnu", "d": "ok"}


def test_queue_index_is_bounded():
    """what is held for a queue grows with its rows, not with all the parts of its keys."""
    import tracemalloc
    from random import Random

    import pandas as pd

    made = Random(5)
    key = lambda n: "".join(made.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    shorts = [key(n) for n in range(1, 25)] + [key(25) for _ in range(4000)]
    frame = pd.DataFrame({"platform": "p", "place": range(len(shorts)), "short": shorts, "long": [s + "." for s in shorts]})
    tracemalloc.start()
    try:
        assert calibration.assign(frame, frame, "platform", "place")["present"].all()
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()


def test_fold_turns_letters_away_fast(spark):
    """a letter isn't held against all ranges of marks. The class is that of the marks, all code points of this version over."""
    import time

    rows = spark.range(60).select(F.repeat(F.lit("motélong "), 12_000).alias("t"))
    rows.limit(1).select(T.match_key(F.col("t"), 40)).collect()
    began = time.time()
    assert rows.select(F.sum(F.length(F.regexp_replace("t", T.combining(), "")))).first()[0] == 60 * 12_000 * 9
    assert time.time() - began < 6
    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    want = "".join(c for c in every if not unicodedata.combining(c))
    assert spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", T.combining(), "").alias("x")).first().x == want


def test_slug_folds_once(spark):
    """the text is folded once, and runs of dashes at the ends go."""
    plan = spark.createDataFrame([("x",)], "t string").select(T.slug(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("decompose") == 1
    assert [one(spark, T.slug(F.lit(s))) for s in ("--.a--.", ".-", "", "a" + "-" * 9 + "b..", "É" * 79 + "--b")] == ["a", "untitled", "untitled", "a-b", "e" * 79]


def test_safe_id_is_worked_out_once(spark):
    """F8: one replacement a text; white space goes at the ends alone, as before the runs were taken whole."""
    plan = spark.createDataFrame([("x",)], "t string").select(T.safe_id(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("A-Za-z0-9") == 1
    said = [" \n a  b\t ", "  ", "", "a  ", "a  b \n\n", " x "]
    before = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = spark.createDataFrame([(s,) for s in said], "t string").select(T.strip(F.col("t")).alias("x"), before(F.col("t")).alias("y"), T.safe_id(F.col("t")).alias("z")).collect()
    assert [r.x for r in rows] == [r.y for r in rows] and [r.z for r in rows][:3] == ["a__b", "unknown", "unknown"]


def test_sanitising_reads_long_runs_once(spark):
    """each expression is applied once, in time linear in a run of letters, and finds what it found when it tried every start."""
    import time

    plan = spark.createDataFrame([("x",)], "t string").select(sanitize.sanitize(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ingest") == 1
    began = time.time()
    run = "aB3" * 60_000
    assert one(spark, sanitize.sanitize(F.concat(F.repeat(F.lit("aB3"), 60_000), F.lit(" x")))) == run + " x"
    assert time.time() - began < 10
    calendar, sentry = r"[A-Za-z0-9._%+-]+@group\.(?:v\.)?calendar\.google\.com", r"[A-Za-z0-9]{20,}@o\d+\.ingest\.[A-Za-z0-9.]+\.sentry\.io"
    parts = ["a@group.calendar.google.com", "b.c@group.v.calendar.google.com", "@group.calendar.google.com", "k" * 20 + "@o1.ingest.us.sentry.io", "k" * 19 + "@o1.ingest.us.sentry.io", " ", "x", "@", "é"]
    drawn = random.Random(3)
    texts = ["".join(drawn.choices(parts, k=8)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", sanitize.CALENDAR, "<>").alias("c"), F.regexp_replace("t", sanitize.SENTRY_KEY, "<>").alias("s")).collect()
    assert [(r.c, r.s) for r in rows] == [(re.sub(calendar, "<>", t), re.sub(sentry, "<>", t)) for t in texts]


def test_health_is_worked_out_by_shape(spark, sf_dir):
    """payloads are read by Python once, and those of one shape have the health that each has alone."""
    plan = catalog.queries()["g16_key_histogram"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 0  # what is read once has been written
    said = ['{"a": 1, "b": [1, 2]}', '{"a": 2, "b": [7]}', '{"a": "x", "b": []}', '{"b": [null], "c": {"d": 1}}', "[]", "no json", '{"a": 1, "b": [1, 2]}', '{"a": 1, "b": [], "c": "2024-01-01"}', '{"a": 1, "b": [], "c": "x"}']
    rows = shapes.shape_rows(spark.createDataFrame(list(enumerate(said)), "payload_id long, payload string"))
    ref = shapes.merge(shapes.shape_rows(spark.createDataFrame([(0, said[0])], "payload_id long, payload string")))
    sides = ref.select("path", F.col("kinds").alias("ref_kinds"), F.col("bucket_rank").alias("ref_rank"), F.col("tags").alias("ref_tags"))
    live = shapes.merge(rows, "payload_id")
    alone = live.select("payload_id").distinct().crossJoin(sides).join(live, ["payload_id", "path"], "full_outer")
    want = {r.payload_id: r for r in shapes.differences(alone, "payload_id", 95.0).collect()}
    assert len(want) == len(said) - 1
    assert {r.payload_id: r for r in shapes.payload_health(ref, rows).collect()} == want


def test_exports_of_many_conversations(spark, sf_dir, tmp_path):
    """the number of files doesn't grow with the conversations, and files of lines are read as files of one."""
    told = catalog.queries()["a1_export_scan"](spark, sf_dir)
    assert len(told.inputFiles()) < told.count() / 2
    said = [json.dumps({"platform": "p", "conversation_id": f"c{k}", "messages": [{"role": "user", "texte": f"t{k}"}] * (k + 1)}) for k in range(3)]
    (tmp_path / "one" / "p").mkdir(parents=True), (tmp_path / "many" / "p").mkdir(parents=True)
    for k, s in enumerate(said):
        (tmp_path / "one" / "p" / f"{k}.json").write_text(s)
    (tmp_path / "many" / "p" / "all.json").write_text("\n".join([*said[:2], "{broken", said[2]]))
    read = lambda of, **how: sorted((r.platform, r.conversation_id, len(r.messages)) for r in archives.read_conversations(spark, str(tmp_path / of), **how).collect())
    assert read("one") == read("many", lines=True) == read("many", lines=True, max_bytes=1) == [("p", f"c{k}", k + 1) for k in range(3)]

"""Calibration suites: tests of capabilities, tagging, the least cover, and how a queue is covered by an export."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions import text as T


def extract_tests(suites: DataFrame, id_col: str = "suite_id", text_col: str = "text") -> DataFrame:
    """Tests of suites under headings "Test N": (suite, place, capability, section, prompt), the prompt being the first fenced block."""
    lines = suites.select(id_col, F.posexplode(F.split(text_col, r"(?m)(?=^#{1,6} )")).alias("place", "block"))
    title = T.collapse(F.regexp_extract("block", r"^#{1,6} +([^\n]*)", 1))
    rows = lines.withColumn("title", title).withColumn("test", F.col("title").rlike(r"(?i)^test\s*\d+"))
    before = Window.partitionBy(id_col).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(~F.col("test") & (F.col("title") != ""), F.col("title")), ignorenulls=True).over(before), F.lit("")))
    prompt = F.trim(F.get(F.transform(T.code_blocks(F.col("block")), lambda b: b["code"]), 0))
    capability = F.regexp_replace("title", r"(?i)^test\s*\d+(?:\.\d+)?\s*[—\-–:.]*\s*", "")
    return rows.where("test").select(id_col, "place", capability.alias("capability"), "section", prompt.alias("prompt")).where("prompt <> ''")


#: Most keywords of a taxonomy, which is broadcast.
MOST_KEYWORDS = 10_000


def _bounded(taxonomy: DataFrame) -> DataFrame:
    if taxonomy.limit(MOST_KEYWORDS + 1).count() > MOST_KEYWORDS:
        raise ValueError(f"a taxonomy has at most {MOST_KEYWORDS} keywords")
    return taxonomy


#: Extensions that a suite names and those of the files that stand for them; names of files in a prompt. Fixed values.
EXTENSIONS = {"jpg": "png", "jpeg": "png", "wav": "mp3", "mov": "mp4", "m4a": "mp3"}
FILE_NAME = r"(?iU)\b[\w\-]+\.(?:txt|md|csv|json|pdf|png|jpg|jpeg|mp3|wav|mp4|mov|m4a|docx|xlsx|pptx|zip)\b"


def align_filenames(prompt: Column, attachments: Column) -> Column:
    """File names in a prompt as those of its attachments: of one extension in order, the last one again when they run out; names without such a file stay."""
    ext = lambda name: F.lower(F.element_at(F.split(name, r"\."), -1))
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    names = F.regexp_extract_all(prompt, F.lit(FILE_NAME), F.lit(0))
    kinds = F.transform(names, lambda n: F.coalesce(F.try_element_at(known, ext(n)), ext(n)))
    pool = lambda kind: F.filter(attachments, lambda a: ext(a) == kind)
    nth = lambda i: F.size(F.filter(F.slice(kinds, 1, i), lambda k: k == F.get(kinds, i)))
    given = F.transform(names, lambda n, i: F.coalesce(F.get(pool(F.get(kinds, i)), F.least(nth(i), F.size(pool(F.get(kinds, i))) - 1)), n))
    stretches = F.split(prompt, FILE_NAME, -1)
    made = F.array_join(F.flatten(F.zip_with(stretches, given, lambda s, n: F.array(s, F.coalesce(n, F.lit(""))))), "")
    return F.when(F.coalesce(F.size(attachments), F.lit(0)) > 0, made).otherwise(prompt)


def tag_tests(tests: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Tests with the ids of the capabilities of which a keyword occurs; taxonomy (id, keyword) has at most MOST_KEYWORDS rows."""
    said = T.fold(F.concat_ws(" ", "capability", "prompt"))
    known = _bounded(taxonomy).select("id", T.fold(F.col("keyword")).alias("folded"))
    rows = tests.withColumn("said", said).join(F.broadcast(known), F.contains(F.col("said"), F.col("folded")), "left")
    return rows.groupBy(*tests.columns).agg(F.sort_array(F.collect_set("id")).alias("capabilities"))


def minimum_cover(tests: DataFrame, key: str, place: str = "place", found: str = "capabilities") -> DataFrame:
    """For each key the greedy least set of tests that covers all that its tests can: the first of the largest gain each time. Of tests with the same capabilities only the first can be chosen, so a group has a row for each distinct set."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(place)
        own = {p: set(c) for p, c in zip(frame[place], frame[found], strict=True)}
        left, chosen = set().union(*own.values()), []
        while left:
            best = max(own, key=lambda p: len(own[p] & left))
            chosen.append(best)
            left -= own[best]
        return frame[frame[place].isin(chosen)][[key, place]]

    kinds = dict(tests.dtypes)
    distinct = tests.withColumn(found, F.array_sort(found)).groupBy(key, found).agg(F.min(place).alias(place))
    return distinct.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {place} {kinds[place]}")


def assign(left: pd.DataFrame, right: pd.DataFrame, key: str, place: str) -> pd.DataFrame:
    """queue_coverage() of one key. Of the parts of an export's short key only those are held that an entry asks for, so what is held grows with the rows and the pairs that do contain one another."""
    left, right, out = left.sort_values(place), right.sort_values(place), []
    asked = {s for s in left["short"] if s}
    sizes = {len(s) for s in asked}
    parts = lambda s, of: {s[i : i + n] for n in of if n <= len(s) for i in range(len(s) - n + 1)}
    unused, later, last, shorts, exact, inside = {}, {}, {}, {}, {}, {}  # first place by long key, next place of its key by place, last place and short key by long key, long keys by short key, short keys by part
    for j, (s, long) in enumerate(zip(right["short"], right["long"], strict=True)):
        if not s:
            continue
        if long in last:
            later[last[long]] = j
        else:
            unused[long] = j
        last[long] = j
        shorts[long] = s
        if s not in exact:
            exact[s] = {}
            for x in parts(s, sizes) & asked:
                inside.setdefault(x, {})[s] = None
        exact[s][long] = None
    own = {len(s) for s in exact}
    for k, p, short, long in left[[key, place, "short", "long"]].itertuples(index=False):
        best = None
        if short and long in unused:
            best = long  # no other is as like
        elif short:
            keys = dict.fromkeys(inside.get(short, ())) | dict.fromkeys(x for x in parts(short, own) if x in exact)
            near = [x for s in keys for x in exact[s]]
            best = max(near, key=lambda x: (SequenceMatcher(None, long, x).ratio(), -unused[x])) if len(near) > 1 else near[0] if near else None
        if best is not None:
            unused[best] = later.pop(unused[best], None)
            if unused[best] is None:  # the last export of this key leaves the index
                s = shorts[best]
                del unused[best], exact[s][best]
                if not exact[s]:
                    del exact[s]
                    for x in parts(s, sizes) & asked:
                        inside[x].pop(s)
        out.append((k, p, best is not None))
    return pd.DataFrame(out, columns=[key, place, "present"])


def queue_coverage(queue: DataFrame, exported: DataFrame, key: str = "platform", place: str = "place", text_col: str = "texte") -> DataFrame:
    """Entries of a queue with whether the export has them: one to one, by containment of the short keys, ties by the likeness of the long ones. Candidates come from an index of the parts of short keys; exports of one long key are one candidate, the first unused. A platform's queue is one group."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return assign(left, right, key, place)

    def keyed(d: DataFrame) -> DataFrame:
        return d.select(key, place, T.match_key(F.col(text_col), 25).alias("short"), T.match_key(F.col(text_col), 120).alias("long"))

    kinds = dict(queue.dtypes)
    return keyed(queue).groupBy(key).cogroup(keyed(exported).groupBy(key)).applyInPandas(run, f"{key} {kinds[key]}, {place} {kinds[place]}, present boolean")


def payload(tests: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """By key: capabilities that a test covers and those that none does."""
    every = F.array_sort(F.collect_set("id"))
    own = tests.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("capabilities")))).alias("covered"))
    return own.join(F.broadcast(_bounded(taxonomy).agg(every.alias("every"))), F.lit(True)).select(key, "covered", F.array_except("every", "covered").alias("missing"))

"""Shapes of JSON payloads, free of their values: path tables, their union, comparison and drift."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.operators.base import sql_operator
from convolake.scratch import saved

#: Weights of the score, floor of coverage, penalty of an emptied list. Fixed values.
STRUCTURE, TYPES, CARDINALITY, FLOOR, EMPTIED = 0.60, 0.25, 0.15, 0.75, 20.0
#: Deepest level and most items of a list that a shape has. Fixed values.
MAX_DEPTH, MAX_ITEMS = 12, 200


def _kind(v) -> str:
    return "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str" if isinstance(v, str) else "list" if isinstance(v, list) else "object"


def paths(payload) -> list[tuple[str, str, int, str]]:
    """(path, kind, items, value for the tags) of every node; of long lists evenly spaced items. Keys are not masked yet."""
    out, todo = [], [("$", payload, 0)]
    while todo:
        path, v, depth = todo.pop()
        kind = _kind(v)
        out.append((path, kind, len(v) if kind == "list" else -1, v if kind == "str" else ""))
        if depth >= MAX_DEPTH:
            continue
        if kind == "object":
            todo += [(f"{path}.{k}", x, depth + 1) for k, x in v.items()]
        elif kind == "list":
            n = min(len(v), MAX_ITEMS)
            todo += [(f"{path}[]", v[i * len(v) // n], depth + 1) for i in range(n)]
    return out


def shape_rows(payloads: DataFrame, id_col: str = "payload_id", json_col: str = "payload") -> DataFrame:
    """A row for each node of each payload: (payload_id, path, kind, bucket, tags). Text that is no JSON gives none; recursion is beyond Spark's own functions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, said in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                try:
                    rows += [(i, *x) for x in paths(json.loads(said))]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["payload_id", "path", "kind", "items", "value"])

    kind = dict(payloads.dtypes)[id_col]
    rows = payloads.select(id_col, json_col).mapInPandas(run, f"payload_id {kind}, path string, kind string, items long, value string")
    return rows.select("payload_id", T.masked_key(F.col("path")).alias("path"), "kind", F.when(F.col("items") >= 0, T.bucket(F.col("items"))).alias("bucket"), T.format_tags(F.col("value")).alias("tags"))


def merge(rows: DataFrame, *keys: str) -> DataFrame:
    """Union of shapes by keys and path: kinds and tags together, the largest bucket. It is commutative and associative, so it combines before the shuffle."""
    return rows.groupBy(*keys, "path").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.max(T.bucket_rank(F.col("bucket"))).alias("bucket_rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))


def compare(reference: DataFrame, live: DataFrame) -> DataFrame:
    """Paths of both merged shapes and how they differ."""
    r = reference.select("path", F.col("kinds").alias("ref_kinds"), F.col("bucket_rank").alias("ref_rank"), F.col("tags").alias("ref_tags"))
    both = r.join(live, "path", "full_outer")
    return both.select("path", "ref_kinds", "kinds", "ref_rank", "bucket_rank", change().alias("change"))


def change() -> Column:
    """How a path differs, from its sides' kinds, ranks and tags."""
    fits = F.arrays_overlap("ref_kinds", "kinds") | F.array_contains("ref_kinds", "null") | F.array_contains("kinds", "null")
    return F.when(F.col("ref_kinds").isNull(), "added").when(F.col("kinds").isNull(), "removed").when(~fits, "type").when(F.coalesce(F.col("bucket_rank") > F.col("ref_rank"), F.lit(False)), "cardinality").when(F.size(F.array_except("tags", "ref_tags")) > 0, "format").otherwise("same")


def score(compared: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each of by: structure, types, cardinality, coverage, emptied lists, score and level."""
    live, ref = F.col("kinds").isNotNull(), F.col("ref_kinds").isNotNull()
    fits = live & ref & (F.col("change") != "type")
    lists = fits & F.array_contains("ref_kinds", "list")
    top = F.col("path").rlike(r"^\$\.[^.\[\]]+$")
    covered = top | F.col("path").rlike(r"^\$\.[^.\[\]]+\[\]\.[^.\[\]]+$")
    emptied = top & lists & F.array_contains("kinds", "list") & (F.coalesce("bucket_rank", F.lit(0)) == 0) & F.coalesce(F.col("item_objects"), F.lit(False))
    items = compared.where(F.col("path").endswith("[]") & F.col("kinds").isNull()).select(*by, F.expr("substring(path, 1, length(path) - 2)").alias("path"), F.array_contains("ref_kinds", "object").alias("item_objects"))
    counts = compared.join(items, [*by, "path"], "left").groupBy(*by).agg(
        F.count_if(live).alias("live"), F.count_if(live & ref).alias("common"), F.count_if(fits).alias("fits"), F.count_if(lists).alias("lists"), F.count_if(lists & (F.col("change") == "cardinality")).alias("grown"),
        F.count_if(ref & covered).alias("ref_cover"), F.count_if(ref & live & covered).alias("both_cover"), F.count_if(emptied).alias("emptied"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.lit(100.0) * a / F.col(b)).otherwise(F.lit(100.0))
    parts = counts.select(*by, "emptied", share(F.col("fits"), "live").alias("structure"), share(F.col("fits"), "common").alias("types"), share(F.col("lists") - F.col("grown"), "lists").alias("cardinality"), share(F.col("both_cover"), "ref_cover").alias("coverage"))
    raw = (STRUCTURE * F.col("structure") + TYPES * F.col("types") + CARDINALITY * F.col("cardinality")) * (FLOOR + (1 - FLOOR) * F.col("coverage") / 100) - EMPTIED * F.col("emptied")
    total = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2)
    return parts.select(*by, total.alias("score"), *(F.round(c, 2).alias(c) for c in ("structure", "types", "cardinality", "coverage")), "emptied", level(total).alias("level"))


def level(c):
    """OK, WARN or BREAK."""
    return F.when(c >= 95, "OK").when(c >= 80, "WARN").otherwise("BREAK")


def signature(merged: DataFrame) -> DataFrame:
    """SHA-256 of a merged shape in order of its paths."""
    line = F.concat_ws("|", "path", F.array_join("kinds", "+"), F.coalesce(F.col("bucket_rank").cast("string"), F.lit("-")), F.array_join("tags", "+"))
    return merged.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("signature"), F.count(F.lit(1)).alias("n_paths"))


#: Most keys of one payload that are counted. A fixed value.
MOST_KEYS = 50
#: Ways in which a path may differ, in the order in which they are listed. Fixed values.
CHANGES = ("added", "removed", "type", "cardinality", "format")


def payload_health(reference: DataFrame, rows: DataFrame, key: str = "payload_id", threshold: float = 95.0) -> DataFrame:
    """Per payload of shape rows: its score against the merged reference, whether it only adds paths, its level, and the first MOST_KEYS paths that differ, by kind of change and then path. Payloads of one shape share all of this, so rows are read once, and what is compared grows with the distinct shapes."""
    entry = F.struct("path", "kinds", "bucket_rank", "tags")
    own = merge(rows, key).groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("shape"))
    own = saved(own.withColumn("named", F.sha2(F.to_json("shape"), 256)), "shapes")
    distinct = own.groupBy("named").agg(F.any_value("shape").alias("shape"))
    ref = distinct.select("named").join(F.broadcast(reference.select("path", F.col("kinds").alias("ref_kinds"), F.col("bucket_rank").alias("ref_rank"), F.col("tags").alias("ref_tags"))), F.lit(True))  # a reference is one shape
    both = ref.join(distinct.select("named", F.inline("shape")), ["named", "path"], "full_outer")
    told = saved(differences(both, "named", threshold), "shape-health")  # its size on disk tells whether it is broadcast
    return own.select(key, "named").join(told, "named").select(key, "score", "level", "additive", "keys", "fits")


def differences(both: DataFrame, key: str, threshold: float) -> DataFrame:
    """Health by key of paths side by side."""
    changed = both.withColumn("change", change())
    lists = F.collect_list(F.when(F.col("change") != "same", F.struct(F.array_position(F.array(*map(F.lit, CHANGES)), F.col("change")).alias("k"), "path")))
    told = changed.groupBy(key).agg(F.slice(F.transform(F.sort_array(lists), lambda x: x["path"]), 1, MOST_KEYS).alias("keys"), (F.count_if(~F.col("change").isin("same", "added")) == 0).alias("additive"))
    return told.join(score(changed, key), key).select(key, "score", "level", "additive", "keys", (F.col("score") >= threshold).alias("fits"))


def key_histogram(health: DataFrame, *by: str) -> DataFrame:
    """Counts over payload_health(): payloads, matches, drifts, breaks, additions, least and mean score, and how many payloads had each key, of drifts and of additions apart. Every part is a sum or a least, so it may be merged in any order (merged_histograms)."""
    kind = F.when(F.col("fits"), "match").when(F.col("additive"), "new").otherwise("drift")
    rows = health.withColumn("kind", kind)
    total = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") != "drift").alias("matches"), F.count_if(F.col("kind") == "drift").alias("drifts"), F.count_if((F.col("level") == "BREAK") & ~F.col("additive")).alias("breaks"), F.count_if(F.col("kind") == "new").alias("additions"),
        F.min("score").alias("least"), F.sum(F.col("score").cast("decimal(30,4)")).alias("total"),
    )
    keys = rows.where("kind <> 'match'").select(*by, "kind", F.explode("keys").alias("key")).groupBy(*by, "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    return _with_keys(total, keys, by)


def _with_keys(total: DataFrame, keys: DataFrame, by: tuple[str, ...]) -> DataFrame:
    entry = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("less"), "key"))))
    listed = keys.groupBy(*by).agg(*(F.transform(entry(kind), lambda x: F.struct(x["key"].alias("key"), (-x["less"]).alias("n"))).alias(name) for kind, name in (("drift", "drift_keys"), ("new", "new_keys"))))
    out = total.join(listed, list(by), "left") if by else total.join(listed, F.lit(True), "left")
    none = F.expr("CAST(array() AS array<struct<key:string,n:bigint>>)")
    return out.withColumns({c: F.coalesce(c, none) for c in ("drift_keys", "new_keys")}).withColumn("mean", F.round((F.col("total") / F.col("n")).cast("double"), 2))


def merged_histograms(parts: DataFrame, *by: str) -> DataFrame:
    """Several key_histogram() as one: as if their payloads had been counted together."""
    sums = [F.sum(c).alias(c) for c in ("n", "matches", "drifts", "breaks", "additions", "total")]
    total = parts.groupBy(*by).agg(*sums, F.min("least").alias("least")).withColumn("total", F.col("total").cast("decimal(30,4)"))
    each = lambda c, kind: parts.select(*by, F.lit(kind).alias("kind"), F.explode(c).alias("x")).select(*by, "kind", "x.key", "x.n")
    keys = each("drift_keys", "drift").unionByName(each("new_keys", "new")).groupBy(*by, "kind", "key").agg(F.sum("n").alias("n"))
    return _with_keys(total, keys, by).select(*parts.columns)


#: Health over a run of fetches, from (service, score).
monitor = sql_operator("SELECT service, count(*) AS n, count(CASE WHEN score >= 95 THEN 1 END) AS matches, count(CASE WHEN score < 95 AND score >= 80 THEN 1 END) AS drifts, count(CASE WHEN score < 80 THEN 1 END) AS breaks, min(score) AS least, round(CAST(avg(score) AS DOUBLE), 4) AS mean FROM {scores} GROUP BY service", "scores")

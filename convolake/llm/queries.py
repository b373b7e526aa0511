"""The registered queries over the corpus tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm import decontamination, exact_dedup, filter_audit, fm_dedup, licenses, ngram_join, piece_codec, quality, secrets, sequences, spelling, suffix_dedup, token_counts
from convolake.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_key")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["strong"])
    return spans.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeated_words(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


def _misspelt(doc: Column, run: Column) -> Column:
    """The contract's misspellings: a run whose hash 199 divides lacks the character that the hash points to."""
    h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    return F.when(h % 199 == 0, spelling.without(run, (h % F.length(run)).cast("int"))).otherwise(run)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(table(spark, sf_dir, "documents"), change=_misspelt))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_id_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.read_documents(sequences.write_sequences(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_exact_dedup, op3_benchmark_decontamination, op4_secret_scans, op5_suffix_array_dedup, op6_sentencepiece, op7_substring_dedup, op8_token_counts, op9_license_scans, op10_ngram_jaccard_join, op11_spelling_variants, op12_filter_interaction_audit, op13_token_id_sequences)}

#: Words, and their shingles of five or of all words of a shorter text, for DuckDB.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))"
_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
_LOWER = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_RUNS = "list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))"

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op3_benchmark_decontamination": f"""
        WITH i AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) t WHERE len(w) > 0),
        n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
        d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) t WHERE len(w) > 0)
        SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / n_shingles AS containment
        FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles""",
    "op7_substring_dedup": f"""
        WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) - 33)) AS i FROM t),
        x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(w[i:i + 34], ' '))) AS times FROM p),
        c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM x WHERE times > 1) y GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
               sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT coalesce(list_contains(gone, z[2]), FALSE)), lambda z: z[1]), ' '), '')) AS kept_sha256
        FROM t LEFT JOIN c USING (doc_id)""",
    "op9_license_scans": f"""
        WITH l AS (SELECT license, {_RUNS} AS s FROM (SELECT license, {_LOWER} AS w FROM (VALUES {_TEMPLATES}) v(license, text)) t),
        d AS (SELECT doc_id, {_RUNS} AS own FROM (SELECT doc_id, {_LOWER} AS w FROM documents) t WHERE len(w) > 4),
        i AS (SELECT license, len(s) AS n, unnest(s) AS s FROM l), u AS (SELECT doc_id, unnest(own) AS s FROM d)
        SELECT doc_id, license, n AS n_shingles, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / n AS containment FROM u JOIN i USING (s) GROUP BY doc_id, license, n HAVING count(*) >= 0.8 * n""",
    "op10_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) t WHERE len(w) > 0),
        n AS (SELECT doc_id, len(s) AS n FROM d), u AS (SELECT doc_id, unnest(s) AS s FROM d),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b USING (s) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*))),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        class AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS class_id FROM documents d LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id)
        SELECT c.doc_id, c.class_id, count(*) OVER (PARTITION BY c.class_id) AS class_size, coalesce(k.n_links, 0) AS n_links, c.doc_id = c.class_id AS kept
        FROM class c LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = c.doc_id""",
    "op11_spelling_variants": """
        WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) x WHERE length(run) > 5 GROUP BY ALL),
        bytes AS (SELECT run, doc, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM runs),
        hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
        said AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) > 5 GROUP BY word HAVING sum(n) > 4),
        cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words) x),
        near AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d WHERE a.word <> b.word UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.d = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.d = w.word),
        best AS (SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS k FROM near JOIN words w ON w.word = b),
        forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.b END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON b.a = w.word AND b.k = 1),
        follow AS (SELECT word, word AS last FROM forms UNION SELECT f.word, x.form FROM follow f JOIN forms x ON x.word = f.last WHERE x.form IS NOT NULL)
        SELECT f.word, form, last AS root, n, n_near, form_n FROM forms f JOIN follow g ON g.word = f.word WHERE (SELECT form FROM forms x WHERE x.word = g.last) IS NULL""",
    "op12_filter_interaction_audit": f"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        f AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)] AS fails FROM t),
        g AS (SELECT part, fails, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM f),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT g.*, filter_order, list_transform(range(1, 6), lambda i: fails[unicode(filter_order[i]) - 64]) AS now FROM g, o),
        u AS (SELECT *, coalesce(list_position(now, TRUE), 6) AS gone, len(list_filter(fails, lambda x: x)) AS n_fails, unnest(range(1, 6)) AS step FROM s),
        r AS (SELECT part, filter_order, step, count_if(gone > step) AS kept, count_if(gone = step) AS removed, count_if(now[step] AND gone < step) AS redundant, count_if(now[step] AND n_fails = 1) AS unique_fails,
                     count_if(gone = step AND good) AS good_lost, count_if(gone = step AND toxic) AS toxic_lost FROM u GROUP BY part, filter_order, step)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM r""",
}

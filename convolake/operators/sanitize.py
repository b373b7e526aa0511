"""Replacing and finding personal data in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions.text import let

#: What is looked for. Fixed values. Runs are taken from their start or the end of the match before, and not given back, so that a long run is read once.
UUID = r"(?=[0-9a-fA-F])\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
JWT = r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?"
SAS = r"(?i)(?=[?&\\])((?:[?&]|\\u0026|&amp;)(?:sig|sv|spr|se|skoid|sktid|skt|ske|sks|skv|sr|sp)=)(?!REDACTED)[^&\"\\<>)\s]+"
SENTRY = r"(?i)(sentry-[a-z_]+=)(?!REDACTED)[^&\"'\s,]+"
CALENDAR = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@group\.(?:v\.)?calendar\.google\.com"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SAFE_EMAIL = r"(?i)@(?:example\.(?:com|work|invalid)|group\.(?:v\.)?calendar\.google\.com)\b"
LOCAL_PATH = r"/(?:home|Users)/[^/\"'\s*]+/Documents/code"
SENTRY_KEY = r"(?:\G|(?<![A-Za-z0-9]))[A-Za-z0-9]{20,}+@o\d+\.ingest\.[A-Za-z0-9.]+\.sentry\.io"
HEX_ID = r"gemini\.google\.com/app/[0-9a-f]{16}\b|\"conversation_id\"\s*:\s*\"[0-9a-f]{16}\""
HEX = r"[0-9a-f]{16}"
#: What stands in their place. Fixed values.
FAKE_JWT = "eyJhbGciOiJIUzI1NiJ9.eyJmYWtlIjp0cnVlfQ"
FAKE_UUID, FAKE_HEX = "f0000000-0000-4000-8000-", "feed"
#: Stands for protected terms while the rest is replaced.
SENTINEL = "\ue000"
#: A text without any of these has nothing to find.
ANY = r"@|eyJ|/Documents/code|(?i:sentry-)|(?i:s[a-z]{1,4}=)|[0-9a-fA-F]{4}-[0-9a-fA-F]{4}"


def _replaced(c: Column, pairs: dict[str, str] | None) -> Column:
    for real, fake in (pairs or {}).items():
        c = F.replace(c, F.lit(real), F.lit(fake))
    return c


def sanitize(c: Column, emails: dict[str, str] | None = None, paths: dict[str, str] | None = None, names: dict[str, str] | None = None, protected: tuple[str, ...] = (), namespace: str = "") -> Column:
    """Tokens, signed parameters, keys of error trackers, calendars and identifiers replaced; the stand-in of an identifier follows from it alone, in lower case, and the namespace. A text that is clean stays.

    emails, paths, names: what is replaced besides, and by what. protected: terms that nothing is replaced in; all become the first of them, as spellings of one name."""
    for term in protected:
        c = F.replace(c, F.lit(term), F.lit(SENTINEL))
    c = F.regexp_replace(F.regexp_replace(c, JWT, FAKE_JWT), SAS, "$1REDACTED")
    c = F.regexp_replace(_replaced(c, emails), CALENDAR, "calendar@example.com")
    c = F.regexp_replace(F.regexp_replace(c, SENTRY_KEY, "key@example.invalid"), SENTRY, "$1REDACTED")

    def stood_in(c: Column, pattern: str, of: str, start: str) -> Column:
        """What of matches in each match of pattern, replaced there."""
        own = lambda x: F.regexp_extract(x, of, 0)
        fake = lambda u: F.when(F.lower(u).startswith(start), u).otherwise(F.concat(F.lit(start), F.substring(F.sha1(F.concat(F.lit(namespace), F.lower(u))), 1, 12)))
        return let(c, lambda said: F.aggregate(F.array_distinct(F.regexp_extract_all(said, F.lit(pattern), F.lit(0))), said, lambda t, x: F.replace(t, x, F.replace(x, own(x), fake(own(x))))))

    c = stood_in(c, HEX_ID, HEX, FAKE_HEX)
    c = stood_in(_replaced(_replaced(c, paths), names), UUID, UUID, FAKE_UUID)
    return F.replace(c, F.lit(SENTINEL), F.lit(protected[0])) if protected else c


def findings(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: tuple[str, ...] = ()) -> DataFrame:
    """(id, line from 1 on, kind, n) of what is left to replace; terms are looked for in any case, as terme-local. Texts that can hold none are left out before they are parted into lines."""
    local = "|".join(r"\Q" + t + r"\E" for t in terms)
    rows = texts.where(F.col(text_col).rlike(ANY + (f"|(?i:{local})" if terms else "")))
    lines = rows.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "said")).where(F.col("said") != "")
    safe = lambda p, keep: F.size(F.filter(F.regexp_extract_all("said", F.lit(p), F.lit(0)), keep))
    every = {
        "chemin": F.regexp_count("said", F.lit(LOCAL_PATH)), "sas": F.regexp_count("said", F.lit(SAS)), "sentry": F.regexp_count("said", F.lit(SENTRY)), "email": safe(EMAIL, lambda x: ~x.rlike(SAFE_EMAIL)),
        "uuid": safe(UUID, lambda x: ~F.lower(x).startswith(FAKE_UUID)), "jwt": safe(JWT, lambda x: x != FAKE_JWT),
    } | ({"terme-local": F.regexp_count("said", F.lit(f"(?i:{local})"))} if terms else {})
    rows = lines.select(id_col, (F.col("at") + 1).alias("line"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), n.alias("n")) for k, n in every.items()))).alias("x"))
    return rows.select(id_col, "line", "x.kind", F.col("x.n").cast("long").alias("n")).where("n > 0")


def audit(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", apply: bool = False, terms: tuple[str, ...] = (), **settings) -> tuple[DataFrame, DataFrame]:
    """(texts, findings): a check of the texts as they are, or of what sanitize() makes of them."""
    made = texts.withColumn(text_col, sanitize(F.col(text_col), **settings)) if apply else texts
    return made, findings(made, id_col, text_col, terms)

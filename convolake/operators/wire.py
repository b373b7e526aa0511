"""Payloads inside other formats: frames of remote calls, fragments in page scripts, objects inside a longer text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a result is marked among the frames of a batch call; how a page pushes a fragment (possessive, as a choice that is repeated takes stack for each letter of it); how a message begins. Fixed values.
RESULT = "wrb.fr"
PUSH = r"self\.__next_f\.push\(\[1,(\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\")\]\)"
MESSAGE_START = r'\{"role"\s*:\s*"(?:user|assistant)"'


def batch_payload(c: Column, call: str) -> Column:
    """Payload of the first result of a call in a response of JSON lines; null if there is none. A payload that isn't JSON itself is null."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), F.trim), lambda x: x.startswith("["))
    rows = F.flatten(F.filter(F.transform(lines, lambda x: F.from_json(x, "array<array<string>>")), lambda x: x.isNotNull()))
    found = F.filter(rows, lambda r: (F.size(r) > 2) & (F.get(r, 0) == RESULT) & (F.get(r, 1) == call))
    payload = F.get(F.get(found, 0), 2)
    return F.when(F.call_function("try_parse_json", payload).isNotNull(), payload)


def error_code(c: Column) -> Column:
    """Code of an error that a response reports in place of a payload: of a quota, or 4xx and 5xx; else null."""
    soft, hard = F.regexp_extract(c, r'BardErrorInfo"\s*,\s*\[\s*(\d+)', 1), F.regexp_extract(c, r'"er"[^\n]*?,\s*(4\d\d|5\d\d)\s*,', 1)
    return F.coalesce(F.nullif(soft, F.lit("")), F.nullif(hard, F.lit(""))).cast("int")


def is_auth_error(c: Column) -> Column:
    """Whether a response reports a lost session."""
    return F.coalesce(c.rlike(r'"er"[^\n]*\b(?:401|403)\b'), F.lit(False))


def page_payload(c: Column) -> Column:
    """What a page's scripts push, fragment by fragment, as one text; fragments that can't be read are left out."""
    parts = F.transform(F.regexp_extract_all(c, F.lit(PUSH), F.lit(1)), lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>", {"maxStringLen": str((1 << 31) - 1)}), 0))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "")


def objects(rows: DataFrame, start: str = MESSAGE_START, id_col: str = "page_id", text_col: str = "payload") -> DataFrame:
    """JSON objects that begin where start matches inside a text: (id, object_id, object as JSON). Of objects of one id the first counts; those without an id or an end are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, read = re.compile(start), json.JSONDecoder().raw_decode
        for batch in batches:
            ids, keys, said = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set()
                for match in begins.finditer(text or ""):
                    try:
                        found = read(text, match.start())[0]
                    except (ValueError, RecursionError):
                        continue
                    if isinstance(found, dict) and found.get("id") and str(found["id"]) not in seen:
                        seen.add(str(found["id"]))
                        ids.append(row)
                        keys.append(str(found["id"]))
                        said.append(json.dumps(found, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.string()), pa.array(said, pa.string())], [id_col, "object_id", "object"])

    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, object_id string, object string")

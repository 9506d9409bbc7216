"""Attachments that need an outside service: uuencoded files, and an interface for reading their pages."""

from __future__ import annotations

import binascii
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: HTTP answers after which trying again makes sense.
TRANSIENT = frozenset({408, 409, 425, 429, 500, 502, 503, 504})
SKIPPED = "<!-- PDF attachment skipped: no reader for page images is set up -->"


class OcrBackend(Protocol):
    """Reads the pages of a file. Instances travel to the executors; ``pages`` must be repeatable, as a task can run twice."""

    def pages(self, data: bytes, name: str) -> list[str]: ...


class SkipBackend:
    """Leaves a note in place of the pages."""

    def pages(self, data: bytes, name: str) -> list[str]:
        return [SKIPPED]


def retry_delay(attempt: int, first: float = 0.5, most: float = 60.0) -> float:
    """Seconds before a try: doubling from the first, up to the most."""
    return min(most, first * 2**attempt)


def key_state(status: Column, message: Column) -> Column:
    """What an answer says about a service key: ok, cooldown, exhausted or invalid."""
    return (
        F.when(status < 300, "ok")
        .when(status.isin(401, 403), "invalid")
        .when((status == 402) | F.lower(F.coalesce(message, F.lit(""))).rlike("quota|monthly limit|billing"), "exhausted")
        .when(status.isin(*sorted(TRANSIENT)), "cooldown")
        .otherwise("ok")
    )


def uudecode(text: str | None) -> tuple[str | None, bytes | None]:
    """Name and bytes of the first uuencoded file; lines with rubbish behind the data count by their own length."""
    name, out = None, bytearray()
    for line in (text or "").splitlines():
        if name is None:
            if line.startswith("begin ") and len(line.split(" ", 2)) == 3:
                name = line.split(" ", 2)[2].strip()
            continue
        if line.strip() == "end":
            break
        try:
            out += binascii.a2b_uu(line)
        except binascii.Error:
            n = (((ord(line[0]) - 32) & 63) * 4 + 5) // 3 if line else 0
            try:
                out += binascii.a2b_uu(line[:n])
            except binascii.Error:
                continue
    if name and name.lower().endswith(".pdf") and out.startswith(b"%PDF") and b"%%EOF" not in out[-1024:]:
        out += b"\n%%EOF\n"
    return (name, bytes(out)) if name else (None, None)


def decode_attachments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, data) of the attachments encoded in a text."""

    @F.pandas_udf("struct<name:string,data:binary>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([uudecode(t) for t in texts], columns=["name", "data"])

    return df.select(key, run(F.col(text)).alias("f")).select(key, "f.name", "f.data").where("name is not null")


def read_pages(attachments: DataFrame, key: str, backend: OcrBackend | None = None) -> DataFrame:
    """(key, page_no, content), by the backend that is set up; the number of partitions bounds how many ask at once."""
    reader = backend or SkipBackend()
    kind = attachments.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i + 1, p) for k, n, d in zip(b[key], b["name"], b["data"]) for i, p in enumerate(reader.pages(d, n))]
            yield pd.DataFrame(out, columns=[key, "page_no", "content"])

    return attachments.select(key, "name", "data").mapInPandas(run, f"{key} {kind}, page_no int, content string")

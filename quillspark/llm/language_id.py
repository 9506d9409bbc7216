"""Language identification by compression.

A bounded sample of labelled texts per language, each whole, becomes a raw-content zstandard dictionary. Of a
text all letters count, in lower case; it is cut into blocks, every block is compressed with every dictionary, and the
language with the smallest total wins. Where the margin over the runner-up is narrow, ``sure`` is false.

Defined results: ``und`` for a null text or one without a letter; with no labelled rows every text is
``und``; ties go to the language with more labelled documents, then by name; repeated rows each get the same result; texts of any
length count whole; an empty table gives no rows; extra columns are carried along by ``identify``, where columns of the names
of its results are replaced, and left out by ``digest``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F, Window as W

#: Labelled documents per language that the dictionaries are fitted on: the bound of the sample. Each counts whole; those of over
#: SAMPLE_LENGTH characters are taken only where a language has too few others.
SAMPLE_DOCS = 200
SAMPLE_LENGTH = 8_000
#: Characters compressed at once: a text must not teach the compressor more than the dictionary does.
BLOCK = 4_096
LEVEL = 5
_LETTERS = re.compile(r"[^\W\d_]+")
#: Relative margin below which a prediction is not sure.
MARGIN = 0.01


def learn(labelled: DataFrame, id_col: str, text: str, lang: str, docs: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(language, dictionary), languages with more labelled rows first. At most ``docs`` rows a language reach the driver: those with the smallest hash.

    A language's hashes below a bound that some times as many rows as wanted fall under are looked at, so no task sorts a language.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(id_col).alias("i"), F.col(text).alias("t"))
    rows = rows.withColumns({"long": F.length("t") > SAMPLE_LENGTH, "h": F.xxhash64("i", "t")})
    found = rows.groupBy("l").agg(F.count("*").alias("n"), F.count_if(~F.col("long")).alias("short")).collect()
    if not found:
        return []
    counts = {r["l"]: r["n"] for r in found}
    # Of short texts, and of long ones where those are too few, the share of the hashes that holds enough.
    enough = {(r["l"], kind): min(1.0, 8 * docs / max(1, n)) for r in found for kind, n in ((False, r["short"]), (True, (r["n"] - r["short"]) if r["short"] < 2 * docs else 10**18))}
    bound = F.lit(-(2**63)).cast("bigint")
    for (name, kind), share in enough.items():
        bound = F.when((F.col("l") == name) & (F.col("long") == kind), F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).otherwise(bound)
    near = rows.where(F.col("h") <= bound).select("l", "i", "long", "h")
    w = W.partitionBy("l").orderBy("long", "h", "i")
    picked = near.distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= docs)
    keys = {(r["l"], r["h"], r["i"]): r["k"] for r in picked.collect()}
    texts: dict[str, dict[int, str]] = {}
    for r in rows.where(F.col("h").isin([h for _, h, _ in keys])).select("l", "h", "i", "t").dropDuplicates(["l", "h", "i"]).collect() if keys else ():
        if k := keys.get((r["l"], r["h"], r["i"])):
            texts.setdefault(r["l"], {})[k] = r["t"]
    return [(k, "\n".join(plain(t) for _, t in sorted(texts[k].items())).encode("utf-8", "replace")) for k in sorted(texts, key=lambda k: (-counts[k], k))]


def plain(text: str) -> str:
    """What is compressed: the words in lower case, one blank between two."""
    return " ".join(_LETTERS.findall(text.lower()))


class Classifier:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.names = [k for k, _ in dictionaries]
        self.coders = []
        for _, data in dictionaries:
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.coders.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params))

    def sizes(self, text: str) -> list[int]:
        low = plain(text)
        blocks = [low[i : i + BLOCK].encode("utf-8", "replace") for i in range(0, len(low), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether the margin is wide."""
        if not text or not self.names or not any(c.isalpha() for c in text):
            return "und", 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (rest - sizes[best]) / max(rest, 1)
        return self.names[best], min(1.0, margin / (margin + MARGIN)) if margin > 0 else 0.0, margin >= MARGIN


def identify(df: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """Add lang_pred, score and sure. The dictionaries are the texts of at most SAMPLE_DOCS rows a language."""
    @F.pandas_udf("struct<lang_pred:string,score:double,sure:boolean>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(dictionaries)
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "sure"])

    made = "__lang"
    while made in df.columns:
        made += "_"
    return df.withColumn(made, guess(F.col(f"`{text}`"))).withColumns({c: F.col(f"{made}.{c}") for c in ("lang_pred", "score", "sure")}).drop(made)


def digest(documents: DataFrame) -> DataFrame:
    """Predictions for every document; learned only from those whose crc32 is not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    dictionaries = learn(documents.where(~held_out), "doc_id", "text", "lang")
    out = identify(documents.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "sure")

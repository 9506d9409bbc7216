"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule rejects a document. On a sample, what each rule would cost and reject is estimated; rules
are then put in the order of rejections per cost, the second chosen by what the first leaves, and so on.
A document is tried in that order until a rule rejects it. The order changes the work, never the verdict.

Cost is counted on the sample, in characters read and written and array cells made, not in seconds, so that reruns
take the same order. A rule over a figure that the result has anyway costs one.

Defined results: a null text has no words and fails; an empty table gives an empty table; repeated rows
are judged alike; texts of any length are judged whole; columns of any other name are carried along by ``keep_good`` and not read by ``digest``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import WORD

#: Share of rows in the sample, by a hash of the text, on which costs and rejections are estimated.
SAMPLE_SHARE = 0.01
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lines_of(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def word_chars_of(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("bigint")


def symbols_of(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, rf"[^{SYMBOLS}]+", "")), F.lit(0)).cast("bigint")


def dup_lines_of(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def letters_of(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.lit(0)).cast("bigint")


def let(value: Column, f) -> Column:
    """f of a value that is computed once, and only if it is asked for."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeat_words_of(words: Column) -> Column:
    """Words in 3-word windows found twice or more. words: a column or a bound value, not an expression."""
    return let(repeat_keys_of(words), lambda keys: let(repeat_places_of(words, keys), covered))


def _shift(kind: str, x: Column, by: Column) -> Column:
    return F.call_function(kind, x, by)


def repeat_keys_of(words: Column) -> Column:
    """For every 3-word window the high bits of its hash with its place in the low bits, sorted: windows alike stand together."""
    n, bits = F.size(words), F.length(F.bin(F.size(words).cast("bigint")))
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: _shift("shiftleft", window(i), bits).bitwiseOR(i.cast("bigint")))
    return F.when(n >= 3, F.sort_array(keys)).otherwise(F.array().cast("array<bigint>"))


def repeat_places_of(words: Column, keys: Column) -> Column:
    """Places of the windows that are there twice or more, ascending. Equal hashes count only if the words agree."""
    bits, last = F.length(F.bin(F.size(words).cast("bigint"))), F.size(keys) - 1
    place = lambda x: x.bitwiseAND(_shift("shiftleft", F.lit(1).cast("bigint"), bits) - 1).cast("int")

    def alike(a: Column, b: Column) -> Column:
        return (_shift("shiftright", a, bits) == _shift("shiftright", b, bits)) & (F.slice(words, place(a) + 1, 3) == F.slice(words, place(b) + 1, 3))

    same = F.filter(keys, lambda x, i: ((i > 0) & alike(F.get(keys, i - 1), x)) | ((i < last) & alike(F.get(keys, i + 1), x)))
    return F.sort_array(F.transform(same, place))


def covered(places: Column) -> Column:
    """Words in the windows of three that begin at ascending places."""
    step = F.transform(places, lambda x, i: F.when(i == F.size(places) - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get(places, i + 1) - x)))
    return F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x)


def with_features(df: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """Add the base features, each under the prefix. Arrays are projected in steps, so that each is made once."""
    p, t = prefix, F.col(f"`{text}`")
    df = df.withColumns({f"{p}words": words_of(t), f"{p}lines": lines_of(t)})
    words = F.col(f"{p}words")
    df = df.withColumn(f"{p}keys", repeat_keys_of(words))
    df = df.withColumn(f"{p}places", repeat_places_of(words, F.col(f"{p}keys")))
    return df.withColumns(
        {
            f"{p}n_words": F.size(words).cast("bigint"),
            f"{p}word_chars": word_chars_of(words),
            f"{p}n_symbols": symbols_of(t),
            f"{p}n_lines": F.size(f"{p}lines").cast("bigint"),
            f"{p}n_dup_lines": dup_lines_of(F.col(f"{p}lines")),
            f"{p}n_repeat_words": covered(F.col(f"{p}places")),
        }
    ).drop(f"{p}words", f"{p}lines", f"{p}keys", f"{p}places")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``fails`` holds; ``work`` counts the characters and cells that finding that out takes."""

    name: str
    fails: Column
    work: Column


def digits_of(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, "[^0-9]+", "")), F.lit(0)).cast("bigint")


def capitals_of(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), F.lit(0)).cast("bigint")


def cut_off_lines_of(lines: Column) -> Column:
    """Lines that end in three dots."""
    return F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("bigint")


def bounds(n: Column, chars: Column, symbols: Column, letters: Column, digits: Column, capitals: Column) -> dict[str, Column]:
    """The rules over counts: plain prose, also of short or long words, is well inside."""
    return {
        "few_words": n < 50,
        "word_length": (chars < 3 * n) | (chars > 10 * n),
        "symbols": symbols * 10 > n,
        "letters": letters * 100 < 60 * chars,
        "digits": digits * 100 > 40 * chars,
        "capitals": (capitals * 100 > 70 * letters) & (letters > 0),
    }


def rules(text: Column, words: Column) -> list[Rule]:
    """The rules in no particular order, over a text and its words as columns."""
    n, chars = F.size(words), F.coalesce(F.length(text), F.lit(0)).cast("double")
    count = bounds(n, word_chars_of(words), symbols_of(text), letters_of(text), digits_of(text), capitals_of(text))
    windows = F.greatest(n - 2, F.lit(0)).cast("double")
    reading = {
        "few_words": F.lit(1.0),
        "word_length": word_chars_of(words) + n,
        "symbols": chars + symbols_of(text),
        "letters": chars + letters_of(text) + word_chars_of(words),
        "digits": chars + digits_of(text) + word_chars_of(words),
        "capitals": 2 * chars + capitals_of(text) + letters_of(text),
    }
    many = lambda f: let(lines_of(text), lambda ls: (F.size(ls) >= 4) & (f(ls) * 2 > F.size(ls)))
    return [
        *[Rule(k, count[k], reading[k].cast("double")) for k in count],
        Rule("cut_off_lines", many(cut_off_lines_of), 2 * chars + F.size(lines_of(text))),
        Rule("dup_lines", many(dup_lines_of), 2 * chars + F.size(lines_of(text))),
        Rule("repeats", repeat_words_of(words) * 100 > 50 * n, windows * (4 + F.log2(windows + 2))),
    ]


def order_by_yield(counts: dict[int, int], costs: Sequence[float]) -> list[int]:
    """Rule numbers, best first: each time the most rejections per cost among what the rules before leave. counts: rows by the bit set of the rules that fail."""
    left, out = dict(counts), []
    while len(out) < len(costs):
        rest = [i for i in range(len(costs)) if i not in out]
        out.append(max(rest, key=lambda i: (sum(n for m, n in left.items() if m >> i & 1) / max(costs[i], 1e-9), -costs[i], -i)))
        left = {m: n for m, n in left.items() if not m >> out[-1] & 1}
    return out


def estimate(df: DataFrame, found: Sequence[Rule], text: Column, prepared=lambda sample: sample, share: float = SAMPLE_SHARE) -> list[int]:
    """The rules' order from a sample by hash, prepared as the rules want it. At most 2 ** len(found) lines of counts reach the driver."""
    sample = prepared(df.where(F.pmod(F.xxhash64(text), F.lit(10_000)) < int(share * 10_000)))
    mask = sum((F.coalesce(r.fails, F.lit(True)).cast("int") * (1 << i) for i, r in enumerate(found)), F.lit(0))
    rows = sample.select(mask.alias("m"), *[r.work.alias(f"w{i}") for i, r in enumerate(found)]).groupBy("m").agg(F.count("*").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(found))]).collect()
    total = max(1, sum(r["n"] for r in rows))
    return order_by_yield({r["m"]: r["n"] for r in rows}, [sum(r[f"w{i}"] for r in rows) / total or 1.0 for i in range(len(found))])


def first_failed(found: Sequence[Rule], order: Sequence[int]) -> Column:
    """The name of the first rule that rejects, null if none does. Later rules aren't evaluated."""
    out = None
    for i in order:
        fails = F.coalesce(found[i].fails, F.lit(True))
        out = F.when(fails, found[i].name) if out is None else out.when(fails, found[i].name)
    return out


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, columns as they were."""
    t = F.col(f"`{text}`")
    order = estimate(df.select(t.alias("t")).withColumn("w", words_of(F.col("t"))), rules(F.col("t"), F.col("w")), F.col("t"))
    # The words are bound within the condition: as a column they would be put in for every use when the filter is pushed down.
    return df.where(let(words_of(t), lambda w: first_failed(rules(t, w), order)).isNull())


def digest(documents: DataFrame) -> DataFrame:
    """Base features, base verdict and the cascade's verdict per document."""
    docs = documents.select("doc_id", "text")
    p, t = "__q_", F.col("text")
    f = lambda c: F.col(p + c)
    # What the result shows anyway costs one to look at; what it doesn't is computed only where no rule before it has rejected.
    count = bounds(f("n_words"), f("word_chars"), f("n_symbols"), letters_of(t), digits_of(t), capitals_of(t))
    chars, read = F.coalesce(F.length(t), F.lit(0)).cast("double"), {"letters": letters_of(t), "digits": digits_of(t), "capitals": capitals_of(t)}
    many = lambda n: (f("n_lines") >= 4) & (n * 2 > f("n_lines"))
    found = [Rule(k, count[k], chars * (2 if k == "capitals" else 1) + read[k] if k in read else F.lit(1.0)) for k in count]
    found.append(Rule("cut_off_lines", many(cut_off_lines_of(lines_of(t))), 2 * chars + f("n_lines")))
    found.append(Rule("dup_lines", many(f("n_dup_lines")), F.lit(1.0)))
    found.append(Rule("repeats", f("n_repeat_words") * 100 > 50 * f("n_words"), F.lit(1.0)))
    order = estimate(docs, found, t, lambda sample: with_features(sample, "text", p))
    out = with_features(docs, "text", p).withColumn("rejected_by", first_failed(found, order))
    base_failed = (f("n_words") < 50) | (100 * f("n_repeat_words") > 50 * f("n_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[f(c).alias(c) for c in names], base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
r AS (SELECT row_number() OVER () AS rid, * FROM w),
g AS (SELECT rid, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM r WHERE len(ws) >= 3),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
c AS (SELECT rid, count(DISTINCT x) AS reps FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS x FROM k WHERE n > 1) GROUP BY rid),
f AS (SELECT doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_off,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(reps, 0)::BIGINT AS n_repeat_words FROM r LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR n_symbols * 10 > n_words
            OR letters * 100 < 60 * word_chars OR length(regexp_replace(t, '[^0-9]+', '', 'g')) * 100 > 40 * word_chars
            OR (letters > 0 AND length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) * 100 > 70 * letters)
            OR (n_lines >= 4 AND (n_dup_lines * 2 > n_lines OR n_cut_off * 2 > n_lines))) AS kept
FROM b
"""

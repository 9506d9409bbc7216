"""Secret scans: fixed patterns, and guess costs of values that stand in a credential context.

The base kinds are patterns over the whole text. The method adds the kind ``guess``: a value
behind a credential word (``pwd: ...``, ``passphrase is ...``, ``Authorization: Bearer ...``) counts
as a secret if an attacker needs many guesses for it. The number of guesses is the cheapest
segmentation of the value into dictionary words, dates, repeats, keyboard walks and brute-force
spans, found by dynamic programming over its end positions; values are scored whole, whatever their length:

* a brute-force character costs as many tries as the kinds of characters in the value have members;
* a word costs its rank, four times that with capitals and again with digits for letters. The dictionaries are COMMON_WORDS and
  the words and parts of words of the public piece model, each ranked by itself; a word counts with its best rank;
* a date costs the days (of LIKELY_YEARS years) or months or years it could be;
* a keyboard walk of three keys or more costs its first key and way, and for every further key a little if it goes on straight
  and as many tries as a key has neighbours if it turns;
* a repeat costs what its unit of up to LONGEST_UNIT characters costs, times how often that comes.

Defined results: a null or empty text has no spans; a null doc_id stays null; repeated rows each get their
own result; overlapping spans of two kinds are both kept; an empty table gives no rows; extra input columns are carried along by
``with_secrets``, where a column of the name of one that is added is replaced, and left out by ``digest``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.sentencepiece_codec import MARK, MODEL

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: A credential word can stand behind an underscore, as in DB_PASSWORD, but not behind a letter or digit.
CONTEXT = re.compile(
    r"(?ai:(?<![a-z0-9])(?:pwd|pass|passphrase|passcode|password|passwd|credentials?|secret|client_secret|private_key|access_key|auth_token|token|api_?key|authorization|bearer))"
    r"[\"']?(?:\x20*(?::=|=>|[:=])\x20*|\x20(?:is|was)\x20)(?ai:(?:bearer|basic)\x20+)?[\"']?([^\s\"'<>,;]{6,})"
)
KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret.
MIN_LOG_GUESSES = 10.0
#: Characters of the longest unit of a repeat.
LONGEST_UNIT = 64
LIKELY_YEARS = 60
#: Kinds of characters that brute force tries, and how many of each there are; others are symbols.
CLASSES = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10), (re.compile("[^a-zA-Z0-9]"), 33))

#: Words that guessers try first, in the order of trying.
COMMON_WORDS = (
    "password qwerty dragon monkey letmein football baseball master hello freedom whatever shadow michael jordan superman "
    "batman trustno secret summer winter spring autumn welcome ninja princess flower sunshine admin root login user guest test "
    "changeme default access love money star tiger computer internet server system company london paris berlin madrid "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september "
    "october november december example sample token value none null true false your here enter insert placeholder dummy the and for"
).split()
#: Rows of keys.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_LEET = str.maketrans("430157$@!", "aeoistsai")
_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
#: Letters of the shortest word, and of the shortest part of a word, that come from the piece model.
SHORTEST_WORD, SHORTEST_PART = 3, 4
LONGEST_WORD = 24
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
#: Kinds of dates and log10 of how many there are.
DATES = (
    (re.compile(_YEAR), math.log10(LIKELY_YEARS)),
    (re.compile(rf"{_YEAR}[-/.]?{_MONTH}"), math.log10(12 * LIKELY_YEARS)),
    (re.compile(rf"{_YEAR}[-/.]?{_MONTH}[-/.]?{_DAY}|{_DAY}[-/.]?{_MONTH}[-/.]?{_YEAR}|{_DAY}[-/.]{_MONTH}[-/.]\d\d"), math.log10(365 * LIKELY_YEARS)),
    (re.compile(rf"{_DAY}[-/.]{_MONTH}"), math.log10(365)),
)
SHORTEST_DATE, LONGEST_DATE = 3, 10
#: log10 of the tries for the first key of a walk and its way, for a key straight on, and for a turn.
WALK_START, STRAIGHT, TURN = math.log10(4 * 47), 0.05, math.log10(6)
#: log10 of the tries that any word, date, walk or repeat costs at least.
LEAST = 0.3


def _ways() -> dict[str, tuple[int, int]]:
    """Two keys that lie side by side, and the way from one to the other."""
    ways = {r[i] + r[i + d]: (0, d) for r in KEY_ROWS for i in range(len(r)) for d in (-1, 1) if 0 <= i + d < len(r)}
    for up, low in zip(KEY_ROWS, KEY_ROWS[1:]):
        for i, a in enumerate(up):
            for d in (-1, 0):
                if 0 <= i + d < len(low):
                    ways[a + low[i + d]], ways[low[i + d] + a] = (1, d), (-1, -d)
    return ways


_WAYS = _ways()


@cache
def dictionary(path: str = MODEL) -> dict[str, int]:
    """The best rank of every word among the common ones or those of the piece model. To be read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = map(sp.id_to_piece, range(sp.get_piece_size()))
    words = dict.fromkeys(w.lower() for p in pieces if (w := p.lstrip(MARK)).isalpha() and len(w) >= (SHORTEST_WORD if p.startswith(MARK) else SHORTEST_PART))
    ranks = {w: i for i, w in enumerate(words, 1)}
    return ranks | {w: min(i, ranks.get(w, i)) for w, i in _RANK.items()}


def brute_cost(value: str) -> float:
    """log10 of the tries for one more character that nothing explains."""
    return math.log10(sum(n for kind, n in CLASSES if kind.search(value)) or 1)


def word_cost(part: str, ranks: dict[str, int]) -> float | None:
    """log10 of the guesses for a part of a value as a word, None if it is none."""
    low = part.lower()
    plain = low.translate(_LEET)
    if rank := ranks.get(low) or ranks.get(plain):
        return max(LEAST, math.log10(rank) + math.log10(4) * ((low != part) + (plain != low)))
    return None


def date_cost(part: str) -> float | None:
    """log10 of the guesses for a part of a value as a date, None if it is none."""
    return min((cost for kind, cost in DATES if kind.fullmatch(part)), default=None)


class _Repeats:
    """The cheapest repeats that end at a place of a value, place after place.

    Repeats of one unit that end here differ in where they began. Their costs grow by the logarithm of how often the unit came, the slower
    the earlier they began: an earlier one that is no dearer now never will be, and later ones behind it are dropped.
    """

    def __init__(self, value: str, unit_cost):
        self.value, self.unit_cost = value, unit_cost
        self.alike: dict[int, int] = {}  # by period: how many characters up to here equal the one a period before
        self.began: dict[tuple[int, int], list[int]] = {}  # by period and place within it: where repeats began

    def until(self, j: int, best: list[float]) -> float:
        """log10 of the guesses for the value up to j, if a repeat ends there."""
        value, alike, c = self.value, self.alike, self.value[j - 1]
        now: dict[int, int] = {}
        first, k = max(0, j - 1 - LONGEST_UNIT), value.rfind(c, max(0, j - 1 - LONGEST_UNIT), j - 1)
        while k >= 0:
            now[j - 1 - k] = alike.get(j - 1 - k, 0) + 1
            k = value.rfind(c, first, k)
        for p in [p for p in self.alike if p not in now]:
            for at in range(p):
                self.began.pop((p, at), None)
        self.alike, least = now, math.inf
        for p, n in now.items():
            if n < p:
                continue
            unit = value[j - p : j]
            cost = max(LEAST, self.unit_cost(unit))
            # A unit that is itself a repeat and costs no less than as one adds nothing to the repeat of its own unit.
            if any(p % q == 0 and now[q] >= p - q and cost >= max(LEAST, self.unit_cost(unit[:q])) + math.log10(p // q) for q in now if q < p):
                continue
            began = self.began.setdefault((p, j % p), [])
            if j - 2 * p >= 0 and (not began or began[-1] < j - 2 * p):
                began.append(j - 2 * p)
            # One character has to come three times.
            costs = [best[i] + math.log10((j - i) // p) if j - i >= 3 else math.inf for i in began]
            kept = [k for k, x in enumerate(costs) if x == math.inf or x < min(costs[:k], default=math.inf)]
            self.began[p, j % p] = [began[k] for k in kept]
            if (cheapest := min(costs)) < math.inf:
                least = min(least, cheapest + cost)
        return least


def log_guesses(value: str, ranks: dict[str, int] | None = None, brute: float | None = None, units: dict[str, float] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of a value needs. units: what units of repeats in it cost, filled on the way."""
    ranks, brute = dictionary() if ranks is None else ranks, brute_cost(value) if brute is None else brute
    n, low = len(value), value.lower()
    if len(low) != n:  # a few capitals have a lower case of two characters
        low = "".join(x if len(x) == 1 else c for c in value for x in [c.lower()])
    units = {} if units is None else units

    def unit_cost(unit: str) -> float:
        if unit not in units:
            units[unit] = brute if len(unit) == 1 else log_guesses(unit, ranks, brute, units)
        return units[unit]

    repeats = _Repeats(value, unit_cost)
    best = [0.0]
    two = walk = math.inf  # the cheapest ends in a walk of two keys, of three or more
    way = None
    for j in range(1, n + 1):
        least = best[j - 1] + brute
        for i in range(max(0, j - LONGEST_WORD), j - SHORTEST_WORD + 1):
            if best[i] < least and (cost := word_cost(value[i:j], ranks)) is not None:
                least = min(least, best[i] + cost)
        if value[j - 1].isdigit():
            for i in range(max(0, j - LONGEST_DATE), j - SHORTEST_DATE + 1):
                if best[i] < least and value[i].isdigit() and (cost := date_cost(value[i:j])) is not None:
                    least = min(least, best[i] + cost)
        before, way = way, _WAYS.get(low[j - 2 : j]) if j > 1 else None
        if way is None:
            two = walk = math.inf
        else:
            walk = min(two, walk) + (STRAIGHT if way == before else TURN)
            two = best[j - 2] + WALK_START
        best.append(min(least, walk, repeats.until(j, best)))
    return best[-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base kinds, in order of kind, then place."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def guess_spans(text: str, min_log_guesses: float = MIN_LOG_GUESSES, ranks: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """The values in a credential context that need many guesses."""
    found = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:)!?")
        # No value of fewer characters than the pattern asks for can reach the threshold.
        if len(value) >= 6 and log_guesses(value, ranks) >= min_log_guesses:
            found.append(("guess", m.start(1), m.start(1) + len(value)))
    return found


def find_spans(text: str | None, min_log_guesses: float = MIN_LOG_GUESSES, ranks: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, end exclusive, by start, then kind."""
    if not text:
        return []
    return sorted(base_spans(text) + guess_spans(text, min_log_guesses, ranks), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, put as the mask."""
    out, at = [], 0
    for _, i, j in sorted(spans, key=lambda s: s[1:]):
        if j > at:
            out += [text[at:i], mask] if i >= at else []
            at = j
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Texts that a worker holds as Python strings at once.
TEXTS_AT_ONCE = 256


def with_secrets(df: DataFrame, text: str = "text", spans: str = "spans", redacted: str | None = None, min_log_guesses: float = MIN_LOG_GUESSES) -> DataFrame:
    """Add the spans found in a text column and, if named, the text with them masked; a column of either name is replaced. One pass, no shuffle."""
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (spans, redacted)]) if text not in (spans, redacted) else df
    place = kept.columns.index(text)
    schema = kept.select("*", F.expr(f"cast(null as {SPANS})").alias(spans), *([F.expr("cast(null as string)").alias(redacted)] if redacted else [])).schema

    ranks = dictionary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS_AT_ONCE):
                b = whole.slice(i, TEXTS_AT_ONCE)
                texts = b.column(place).to_pylist()
                found = [find_spans(t, min_log_guesses, ranks) for t in texts]
                columns = [*b.columns, pa.array([[{"kind": k, "start": i, "end": j} for k, i, j in x] for x in found], _SPANS)]
                if redacted:
                    columns.append(pa.array([redact(t, x) if x else t for t, x in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def digest(documents: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the SHA-256 of the base spans, and all spans."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "guess")
    say = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    found = with_secrets(documents.select("doc_id", "text"))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(say(base).cast("binary"), 256).alias("base_sha256"), say(spans).alias("spans"))

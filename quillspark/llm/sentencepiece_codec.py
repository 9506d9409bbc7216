"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (a run of word marks with what follows; no piece goes past one) are
laid end to end and indexed by a suffix array, as deep as the longest piece. Every piece is looked up by
binary search; its range in the array are its occurrences. These are the edges of a lattice over the
text. Sorted by where they end, they are relaxed: at each place the one edge stays whose piece can follow
the last piece of the best path to its start.

For a merge model (BPE) the best path is what merging the best-scored pair again and again, leftmost
first, leads to. A path is that one exactly if in every pair of neighbours no merge across their border
would have come first, which the pieces' own merge trees decide (``can_follow``); the merges themselves are
never run on the text. Characters in no piece become byte pieces.

The model's pieces, some 32,000, are read on the driver and travel with the task. Models are taken to use
identity normalisation with a word mark in front, as the public one does.

A segment of over LONG characters is indexed in windows that overlap by the longest piece, its edges relaxed from
window to window. The pieces of a run of word marks share one score, so that merging goes from left to right: a
run is as many of the longest of them as fit, and what merging makes of the rest; that this holds for a model is tried out when it is set up.

Defined results: a null text has null ids, an empty one none. Decoding gives the text back; a word mark
character in the text comes back as a blank, which it is to the model. Texts are encoded whole; repeated rows each get the same ids; an
empty table gives no rows; extra columns stay, those of the names of the results are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of new segments that one suffix array indexes, and of a segment that is indexed in windows of so many.
INDEXED, LONG = 200_000, 20_000
#: Segments whose ids a worker remembers: so many new ones, and those before them as long as these come up again.
REMEMBERED = 150_000
#: Pairs of neighbours of which a worker remembers whether they can be, as a power of two; one in the same place is forgotten.
PAIRS = 20
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = 1 << 30


def merge(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain merging of a short string: its pieces and the last pair merged. For the pieces themselves and for tests."""
    parts, last = list(text), None
    while True:
        at = min(((rank.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(_NONE, 0))
        if at[0] == _NONE:
            return parts, last
        i = at[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@dataclass
class Pieces:
    """The tables of a model: text, rank, whether merging reaches it, and its two halves, of every piece."""

    texts: list[str]
    rank: np.ndarray
    reached: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first_byte: int
    unknown: int
    memo: dict = field(default_factory=dict, repr=False)

    def setup(self) -> None:
        """What is derived in each worker: symbols of characters, packed pieces, the decoding table."""
        if self.memo:
            return
        use = np.array([i for i in np.flatnonzero(self.reached) if not self.texts[i].startswith(MARK * 2)])
        self.by_text = {self.texts[i]: int(self.rank[i]) for i in np.flatnonzero(self.rank < _NONE)}
        self.ids = {self.texts[i]: int(i) for i in np.flatnonzero(self.rank < _NONE)}
        self.edges = {}
        self.pairs, self.can = np.full(1 << PAIRS, -1, np.int64), np.zeros(1 << PAIRS, bool)
        # If the longest piece of marks comes off the front of every run of up to three of it, it does so of all: merging goes on from the left, piece by piece.
        most = max((k for k in range(2, max(map(len, self.texts)) + 1) if MARK * k in self.by_text), default=0)
        runs = [merge(MARK * k, self.by_text)[0] for k in range(3 * most + 1)]
        same = len({r for t, r in self.by_text.items() if len(t) > 1 and not t.strip(MARK)}) == 1
        self.longest_run = most if same and all(runs[k] == [MARK * most, *runs[k - most]] for k in range(most, len(runs))) else 0
        symbols = sorted({c for i in use for c in self.texts[i]})
        table = np.zeros(0x110000 + 1, np.uint16)
        table[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        self.depth = max(len(self.texts[i]) for i in use)
        low = np.zeros((len(use), self.depth), np.uint16)
        for k, i in enumerate(use):
            low[k, : len(self.texts[i])] = table[[ord(c) for c in self.texts[i]]]
        self.lens = np.array([len(self.texts[i]) for i in use])
        high = low.copy()
        high[np.arange(low.shape[1])[None, :] >= self.lens[:, None]] = 0xFFFF
        self.use, self.table, self.low, self.high = use, table, self._pack(low), self._pack(high)
        self.wide = low.shape[1]
        self.id_of = {self.texts[i]: int(i) for i in use}
        self.bytes_of = [t.replace(MARK, " ").encode() for t in self.texts]
        for b in range(256):
            self.bytes_of[self.first_byte + b] = bytes([b])
        self.memo["ready"] = True

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("texts", "rank", "reached", "left", "right", "first_byte", "unknown")} | {"memo": {}}

    @staticmethod
    def _pack(symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols as strings of bytes that compare as they do."""
        return np.ascontiguousarray(symbols.astype(">u2")).view(f"S{2 * symbols.shape[1]}").ravel()

    # -- merge trees ---------------------------------------------------------------------------------

    def _edge(self, piece: int, inner: np.ndarray) -> list[tuple[int, int]]:
        """Along one side of a piece's tree, from the character up: (part, rank of the merge that ends it)."""
        key, ends = (piece, inner is self.right), _NONE
        if (out := self.edges.get(key)) is None:
            out = []
            while piece >= 0:
                out.append((piece, ends))
                ends, piece = int(self.rank[piece]), int(inner[piece])
            self.edges[key] = out = out[::-1]
        return out

    def run_of_marks(self, k: int) -> bytes:
        """The ids of k word marks."""
        whole, rest = divmod(k, self.longest_run) if self.longest_run else (0, k)
        parts = [MARK * self.longest_run] * whole + merge(MARK * rest, self.by_text)[0]
        return np.array([self.ids.get(t, self.unknown) for t in parts], np.int32).tobytes()

    def behind_run(self, k: int, core: bytes) -> bytes:
        """The ids of a segment with k more marks in front of it."""
        one = self.run_of_marks(1)
        return self.run_of_marks(k) + core if core[:4] != one else self.run_of_marks(k + 1) + core[4:]

    def can_follow(self, a: int, b: int) -> bool:
        """Whether pieces a, b stand side by side when their joined text is merged."""
        xs, ys = self._edge(a, self.right), self._edge(b, self.left)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            joint = self.id_of.get(self.texts[x] + self.texts[y])
            if joint is not None and self.rank[joint] < x_ends and self.rank[joint] <= y_ends:
                return False
            if x_ends == _NONE and y_ends == _NONE:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def follows(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """can_follow of many pairs; those asked for before are mostly remembered."""
        keys = before.astype(np.int64) * len(self.texts) + after
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS)).astype(np.int64)
        out, new = self.can[slots], self.pairs[slots] != keys
        if new.any():
            fresh, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            size = len(self.texts)
            can = np.array([self.can_follow(k // size, k % size) for k in fresh.tolist()], bool)
            out[new] = can[inverse]
            at = slots[new][first]
            self.pairs[at], self.can[at] = fresh, can
        return out

    # -- lattice -------------------------------------------------------------------------------------

    def _occurrences(self, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, number among the used pieces) of all occurrences of all pieces in n symbols (padded behind)."""
        keys = self._pack(np.lib.stride_tricks.sliding_window_view(symbols[: n + self.wide - 1], self.wide))
        array = np.argsort(keys)
        keys = keys[array]
        begin, end = np.searchsorted(keys, self.low), np.searchsorted(keys, self.high)
        counts = end - begin
        piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        place = np.arange(counts.sum(), dtype=np.int32)
        place += np.repeat((begin - np.cumsum(counts) + counts).astype(np.int32), counts)
        return array[place].astype(np.int32), piece

    def encode_long(self, segment: str) -> bytes:
        """The ids of one segment, as int32 bytes: indexed in windows, edges relaxed in order of their ends."""
        n = len(segment)
        symbols = np.zeros(n + self.wide, np.uint16)
        symbols[:n] = self.table[np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)]
        last, taken = array("i", [-2]) * (n + 1), bytearray(n + 1)  # last piece of the best path to a place, and its length
        size, memo, over = len(self.texts), {}, np.zeros((0, 3), np.int64)
        for lo in range(0, n, LONG):
            hi = min(n, lo + LONG)
            start, number = self._occurrences(symbols[lo : hi + self.wide], hi - lo)
            odd = np.flatnonzero(symbols[lo:hi] == 0)
            edges = np.concatenate([over, np.stack([start + self.lens[number] + lo, start + lo, self.use[number]], 1), np.stack([odd + 1 + lo, odd + lo, np.full(len(odd), -1)], 1)])
            edges = edges[np.argsort(edges[:, 0], kind="stable")]
            over, edges = edges[edges[:, 0] > hi], edges[edges[:, 0] <= hi]
            for e, at, p in edges.tolist():
                before = last[at]
                if at and p >= 0 and before != -1:
                    if before == -2:
                        continue
                    if (can := memo.get(key := before * size + p)) is None:
                        can = memo[key] = self.can_follow(before, p)
                    if not can:
                        continue
                last[e], taken[e] = p, e - at
        if not taken[n]:
            raise ValueError(f"no path through a segment of {n} characters")
        out, e = [], n
        while e:
            at = e - taken[e]
            out += [last[e]] if last[e] >= 0 else [self.first_byte + b for b in reversed(segment[at:e].encode("utf-8", "replace"))]
            e = at
        return np.array(out[::-1], np.int32).tobytes()

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment, as int32 bytes."""
        lens = np.array([len(s) for s in segments])
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(lens) - lens + np.arange(len(lens))  # one empty place after each segment
        n = int(lens.sum() + len(lens))
        at = np.arange(len(codes)) + np.repeat(np.arange(len(lens)), lens)
        symbols = np.zeros(n + self.wide, np.uint16)
        symbols[at] = self.table[codes]
        begin = np.zeros(n + 1, bool)
        begin[first] = True
        depth = np.zeros(n + 1, np.int32)  # place within the segment
        depth[: n] = np.arange(n) - np.repeat(first, lens + 1)

        start, number = self._occurrences(symbols, n)
        piece, end = self.use[number].astype(np.int32), start + self.lens[number].astype(np.int32)
        odd = at[symbols[at] == 0].astype(np.int32)  # characters in no piece: an edge of their own
        start, piece, end = np.concatenate([start, odd]), np.concatenate([piece, np.full(len(odd), -1, np.int32)]), np.concatenate([end, odd + 1])
        order = np.argsort(depth[start] + (end - start), kind="stable")  # by the place where they end
        start, piece, end = start[order], piece[order], end[order]
        level = depth[start] + (end - start)
        cuts = np.flatnonzero(np.diff(level, prepend=-1, append=-1))

        last = np.full(n + 1, -2, np.int64)  # last piece of the best path to a place
        back = np.full(n + 1, -1, np.int64)
        for lo, hi in zip(cuts, cuts[1:]):
            s, p, e = start[lo:hi], piece[lo:hi], end[lo:hi]
            before = last[s]
            free = begin[s] | (p == -1) | (before == -1)
            ask = ~free & (before >= 0)
            ok = free.copy()
            if ask.any():
                ok[ask] = self.follows(before[ask], p[ask])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]

        # From the ends back: the paths of all segments at once, one piece a round.
        if (back[first + lens] < 0).any():
            raise ValueError(f"no path through {segments[int(np.flatnonzero(back[first + lens] < 0)[0])]!r}")
        here, taken, who, step = first + lens, [], np.arange(len(lens)), 0
        while len(here):
            taken.append((who, np.full(len(who), step), last[here], back[here]))
            here, step = back[here], step + 1
            open_ = ~begin[here]
            here, who = here[open_], who[open_]
        who, step, ids, place = (np.concatenate(x) for x in zip(*taken)) if taken else (np.zeros(0, int),) * 4
        order = np.lexsort((-step, who))
        who, ids, place = who[order], ids[order], place[order]
        bounds = np.searchsorted(who, np.arange(len(lens) + 1))
        ids32 = ids.astype(np.int32)
        unknown = ids32 == -1
        out, flat, ends = [], ids32.tobytes(), (4 * bounds).tolist()
        has_unknown = (np.add.reduceat(unknown, bounds[:-1]) if len(ids32) else np.zeros(0, int)).tolist()
        for k, s in enumerate(segments):
            if not has_unknown[k]:
                out.append(flat[ends[k] : ends[k + 1]])
            else:
                put: list[int] = []
                for m in range(bounds[k], bounds[k + 1]):
                    put += [self.first_byte + b for b in s[place[m] - first[k]].encode("utf-8", "replace")] if unknown[m] else [int(ids32[m])]
                out.append(np.array(put, np.int32).tobytes())
        return out

    def encode_batch(self, texts: list[str | None], known: "Known") -> list[bytes | None]:
        """Ids of every text, as int32 bytes. known: ids of segments, filled on the way."""
        self.setup()
        known.begin()
        cut = [None if t is None else _SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = known.missing(set().union(*(c for c in cut if c)))
        # Segments with a run of marks in front: the run is set apart, what follows it is a segment of its own.
        runs = {s: len(s.lstrip(MARK)) for s in new if s[1:2] == MARK}
        behind = {s: s[-rest - 1 :] for s, rest in runs.items() if rest}
        fresh = sorted(new.difference(runs) | known.missing(set(behind.values())))
        now, chars = known.now, 0
        some: list[str] = []
        for s in [*fresh, None]:
            if some and (s is None or chars + len(s) > INDEXED):
                now.update(zip(some, self.encode_segments(some)))
                some, chars = [], 0
            if s is not None and len(s) > LONG:
                now[s] = self.encode_long(s)
            elif s is not None:
                some.append(s)
                chars += len(s)
        for s, rest in runs.items():
            now[s] = self.behind_run(len(s) - rest - 1, now[behind[s]]) if rest else self.run_of_marks(len(s))
        return [None if c is None else b"".join(map(now.__getitem__, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        self.setup()
        table = self.bytes_of
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Known:
    """Ids of segments: those met of late, and those met before them until as many new ones have come."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def begin(self) -> None:
        """Before a batch: forget what did not come up again."""
        if len(self.now) > REMEMBERED:
            self.old, self.now = self.now, {}

    def missing(self, segments: set[str]) -> set[str]:
        """Those not known; all others are among ``now`` after it."""
        new = segments.difference(self.now)
        old = self.old
        again = {s: old[s] for s in new if s in old} if old else {}
        self.now.update(again)
        return new.difference(again)


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    """Read a model on the driver and work out the merge tree of every piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    texts = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    order = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in plain}))}
    rank = np.full(n, _NONE, np.int64)
    for i in plain:
        rank[i] = order[-sp.get_score(i)]
    by_text = {texts[i]: int(rank[i]) for i in plain}
    ids = {texts[i]: i for i in plain}
    reached, left, right = np.zeros(n, bool), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for i in plain:
        parts, last = merge(texts[i], by_text)
        if parts == [texts[i]]:
            reached[i] = True
            if last:
                left[i], right[i] = ids[last[0]], ids[last[1]]
    first_byte = next((i for i in range(n) if sp.is_byte(i)), 0)
    return Pieces(texts, rank, reached, left, right, first_byte, sp.unk_id())


#: Texts that a worker cuts into segments at once.
TEXTS_AT_ONCE = 128


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str = MODEL, decoded: str | None = None) -> DataFrame:
    """Add the piece ids of a text column and, if named, their decoding. Other columns stay; those of the names of the results are replaced."""
    model = load(path)
    made = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    kept = [c for c in df.columns if c not in made]
    df = df.select(*[F.col(f"`{c}`") for c in kept], *([F.col(f"`{text}`").alias("__text")] if text not in kept else []))
    place = df.columns.index(text if text in kept else "__text")
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *[F.expr(f"cast(null as {kind})").alias(c) for c, kind in made.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS_AT_ONCE):
                b = whole.slice(i, TEXTS_AT_ONCE)
                got = model.encode_batch(b.column(place).to_pylist(), known)
                offsets = np.cumsum([0, *(len(g or b"") // 4 for g in got)])
                flat = np.frombuffer(b"".join(g or b"" for g in got), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([g is None for g in got]))
                columns = [*b.columns[: len(kept)], lists]
                if decoded:
                    columns.append(pa.array([None if g is None else model.decode(np.frombuffer(g, np.int32)) for g in got], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str = MODEL) -> DataFrame:
    """Add the text of an array of piece ids."""
    model = load(path)

    @F.pandas_udf("string")
    def run(lists):
        return lists.map(lambda x: None if x is None else model.decode(np.asarray(x, np.int64)))

    return df.withColumn(text, run(F.col(f"`{ids}`")))


def digest(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """Per document its ids, their number and whether decoding gives the text back."""
    rows = encode(documents.select("doc_id", "text"), "text", "ids", path, "back")
    same = F.col("back") == F.replace(F.col("text"), F.lit(MARK), F.lit(" "))
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"), "ids", F.coalesce(same, F.col("text").isNull()).alias("round_trip"))

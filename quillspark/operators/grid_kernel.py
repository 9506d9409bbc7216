"""The table cleaner and renderers for one grid at a time, for use inside a Python stage that has the grid at hand.

The relational rules in ``grid`` do the same things one by one over cells as rows; this kernel runs them in their
order on one small table, where each step depends on the columns that the step before has left.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

Grid = list[list[str]]

#: Rules about one cell remember the cells that they have seen: many are blank, signs or said twice.
remembered = lru_cache(maxsize=20_000)

_BLANK = re.compile(r"\s*(?:[—–-]+\s*)?")
_SIGN = re.compile(r"(?:[$£€¥￥]|C\$|A\$|R\$)")
_NUMBER = re.compile(r"\(?-?[\d.,]*\d[\d.,]*\)?%?")
_OPEN_NUMBER = re.compile(r"[$£€¥]?\(?-?[\d.,]*\d[\d.,]*\)?")
_SUFFIX = re.compile(r"%|\)|\)%|\)bp|x|\(\d{1,2}\)|<sup>.*</sup>")
_NOTE = re.compile(r"\(\d{1,2}\)")
_SUP = re.compile(r"\s*(?:<sup\b[^>]*>.*?</sup>\s*)+")
_YEAR = re.compile(r"(?:19|20)\d\d")
_CONTENT = re.compile(r"[^\W_]|[$£€¥☐☒]")
_MONEY = re.compile(r"[$£€¥%]|\(\d[\d,.]*\)?")


@remembered
def blank(cell: str) -> bool:
    return bool(_BLANK.fullmatch(cell.replace("\xa0", " ").replace("&nbsp;", " ")))


@remembered
def plain(cell: str) -> str:
    """A cell without the emphasis around it."""
    return cell.replace("\xa0", " ").replace("&nbsp;", " ").replace("*", "").strip()


@remembered
def is_figure(cell: str) -> bool:
    """A number, with its sign or suffix, that isn't a year."""
    bare = _SIGN.sub("", plain(cell)).strip()
    return bool(_NUMBER.fullmatch(bare)) and not _YEAR.fullmatch(bare)


def columns(grid: Grid) -> list[list[str]]:
    return [list(c) for c in zip(*grid)]


def keep(grid: Grid, kept: list[int]) -> Grid:
    return [[row[c] for c in kept] for row in grid]


def squared(grid: Grid) -> Grid:
    width = max(map(len, grid), default=0)
    return [[*row, *[""] * (width - len(row))] for row in grid]


def is_financial(grid: Grid) -> bool:
    """Figures in several cells beyond the labels; what a spanning cell repeats in its row counts once."""
    cells = [c for row in grid for c in dict.fromkeys(row[1:]) if not blank(c)]
    return bool(cells) and (sum(bool(_MONEY.search(c)) or bool(_NUMBER.fullmatch(plain(c))) for c in cells) >= max(2, len(cells) // 3))


def header_rows(grid: Grid) -> int:
    """Rows before the first one with a figure beyond its label."""
    for r, row in enumerate(grid):
        if any(map(is_figure, row[1:])):
            return r
    return min(1, len(grid))


def drop_repeats(grid: Grid) -> Grid:
    """A column equal to its left neighbour goes."""
    cols = columns(grid)
    return keep(grid, [c for c in range(len(cols)) if c == 0 or cols[c] != cols[c - 1]])


def glue(grid: Grid) -> Grid:
    """Currency signs go to the number on their right, closing signs and footnotes to that on their left, row by row."""
    heads, cols = header_rows(grid), columns(grid)
    # A small number in parentheses is a footnote only in a column of its own, without a heading of its own.
    notes = {c for c in range(1, len(cols)) if all(blank(x) or _SUFFIX.fullmatch(plain(x)) for x in cols[c][heads:]) and all(not x.strip() or x == y for x, y in zip(cols[c][:heads], cols[c - 1][:heads]))}
    out = []
    for row in grid:
        row = list(row)
        for c in range(len(row) - 1):
            if _SIGN.fullmatch(plain(row[c])):
                at = next((k for k in range(c + 1, len(row)) if row[k].strip()), None)
                if at is not None and (_NUMBER.fullmatch(plain(row[at])) or plain(row[at]) in ("—", "-", "–")):
                    row[at], row[c] = plain(row[c]) + row[at].strip(), ""
        for c in range(1, len(row)):
            if _SUFFIX.fullmatch(plain(row[c])) and (c in notes or not _NOTE.fullmatch(plain(row[c]))):
                at = next((k for k in range(c - 1, 0, -1) if row[k].strip()), None)
                if at is not None and _OPEN_NUMBER.fullmatch(plain(row[at])) and not _YEAR.fullmatch(plain(row[at])):
                    row[at], row[c] = row[at].strip() + plain(row[c]), ""
        out.append(row)
    return out


def glue_superscripts(grid: Grid) -> Grid:
    """A column of superscripts only goes, each put behind the cell on its left."""
    cols = columns(grid)
    for c in range(len(cols) - 1, 0, -1):
        if any(map(_SUP.fullmatch, cols[c])) and all(_SUP.fullmatch(x) or blank(x) for x in cols[c]):
            cols[c - 1] = [a.rstrip() + (b.strip() if _SUP.fullmatch(b) else "") for a, b in zip(cols[c - 1], cols[c])]
            del cols[c]
    return [list(r) for r in zip(*cols)]


def merge_headers(grid: Grid, heads: int) -> Grid:
    """Where a column has nothing but a header, and its neighbour has that header or none, the two are one."""
    cols = columns(grid)
    c = 0
    while c < len(cols) - 1:
        for empty, other in ((c, c + 1), (c + 1, c)):
            if other != 0 and all(blank(x) for x in cols[empty][heads:]) and all(x.strip() in ("", y.strip()) or not y.strip() for x, y in zip(cols[empty][:heads], cols[other][:heads])) and empty != 0:
                cols[other][:heads] = [y if y.strip() else x for x, y in zip(cols[empty][:heads], cols[other][:heads])]
                del cols[empty]
                break
        else:
            c += 1
    return [list(r) for r in zip(*cols)]


def drop_subsets(grid: Grid) -> Grid:
    """A column all of whose cells are its neighbour's, which has more, goes."""
    cols = columns(grid)
    gone: set[int] = set()
    for a in range(len(cols)):
        for b in (a - 1, a + 1):
            if 0 <= b < len(cols) and b not in gone:
                mine = [(x.strip(), y.strip()) for x, y in zip(cols[a], cols[b]) if not blank(x)]
                if len(mine) < sum(not blank(y) for y in cols[b]) and all(x == y for x, y in mine):
                    gone.add(a)
    return keep(grid, [c for c in range(len(cols)) if c not in gone or c == 0])


@remembered
def plain_number(cell: str) -> str:
    """Without thousands separators, if it is a number; an open parenthesis is closed."""
    if re.fullmatch(r"\s*\$?\([\d,]+(?:\.\d+)?\s*", cell):
        cell = cell.rstrip() + ")"
    probe = re.sub(r"<[^>]+>|[,$()%\s–—*-]", "", cell)
    return re.sub(r"(?<=\d)[,\xa0 ](?=\d)", "", cell) if probe.replace(".", "", 1).isdigit() else cell


def clean(grid: Grid) -> Grid:
    """The cleaner. Figures are never dropped: a column goes only if it is empty or its cells are elsewhere in the row."""
    grid = [row for row in squared(grid) if not all(blank(c) for c in row)]
    if not grid:
        return []
    grid = glue_superscripts(glue(drop_repeats(grid)))
    grid = merge_headers(grid, header_rows(grid))
    grid = drop_subsets(drop_repeats(grid))
    cols = columns(grid)
    grid = keep(grid, [c for c in range(len(cols)) if c == 0 or any(_CONTENT.search(x) for x in cols[c])])
    heads = header_rows(grid)
    return [[("—" if blank(x) and c and r >= heads else plain_number(x).strip()) for c, x in enumerate(row)] for r, row in enumerate(grid)]


def escaped(cell: str) -> str:
    return re.sub(r"\s*\n\s*", "<br>", cell.strip()).replace("|", "\\|")


def gfm(grid: Grid) -> str:
    grid = squared(grid)
    if not grid:
        return ""
    lines = ["| " + " | ".join(map(escaped, row)) + " |" for row in grid]
    return "\n".join([lines[0], "|" + "---|" * len(grid[0]), *lines[1:]])


class Remembered:
    """gfm(clean(grid)) by the grid's form: grids that differ in their figures only come out alike.

    The cleaner compares cells of one row, and asks of a run of digits only whether it is a year and whether it has up to two digits. It puts cells together
    without two runs becoming one. So runs are numbered row by row, by that class, and put back into the text that a stand-in has given. Grids with several runs in a cell,
    where thousands may be joined, with cells that have other than plain characters, and very large ones are cleaned themselves.
    """

    FORMS, CELLS = 20_000, 2_000
    _RUN, _PLAIN, _SEVERAL = re.compile(r"([0-9]+)"), re.compile(r"[ -~—–£€¥\x1f]*"), re.compile(r"[0-9][^0-9\x1f]+[0-9]")

    def __init__(self):
        self.known: dict = {}

    def __call__(self, grid: Grid) -> str:
        if sum(map(len, grid)) > self.CELLS:
            return gfm(clean(grid))
        key, found = [], []
        for row in grid:
            line = "\x1f".join(row)
            if line.count("\x1f") != len(row) - 1:  # a cell with the mark itself, or a row without cells
                return gfm(clean(grid))
            parts = self._RUN.split(line)
            runs = parts[1::2]
            key.append("0".join(parts[::2]))
            key.append(tuple([(x if (x := runs.index(d)) < i else -1 if (n := len(d)) < 3 else -2 if n == 4 and d[:2] in ("19", "20") else -3) for i, d in enumerate(runs)]))
            found.append(runs)
        key = tuple(key)
        if key not in self.known:
            if len(self.known) >= self.FORMS:
                self.known.clear()
            self.known[key] = self._form(grid, found)
        if (form := self.known[key]) is None:
            return gfm(clean(grid))
        text, places = form
        runs = list(chain.from_iterable(found))
        return text % tuple([runs[i] for i in places])

    def _form(self, grid: Grid, found: list[list[str]]) -> tuple[str, list[int]] | None:
        """The text with %s for each run, and which runs these are; none if the grid has to be cleaned itself."""
        lines = ["\x1f".join(row) for row in grid]
        if not all(map(self._PLAIN.fullmatch, lines)) or any(map(self._SEVERAL.search, lines)) or any(len(runs) > 99 for runs in found):
            return None
        shown, stand_ins, at = [], [], 0
        for line, runs in zip(lines, found):
            names = {d: f"{i:02d}" if len(d) < 3 else f"20{i:02d}" if _YEAR.fullmatch(d) else f"9{i:04d}" for d in runs for i in [runs.index(d)]}
            row = self._RUN.sub(lambda m: names[m[0]], line).split("\x1f")
            if not all(map(blank, row)):
                shown.append({names[d]: at + runs.index(d) for d in runs})
            stand_ins.append(row)
            at += len(runs)
        out = gfm(clean(stand_ins)).split("\n")
        text, places = [], []
        for line, names in zip(out, [*shown[:1], {}, *shown[1:]]):
            text.append(self._RUN.sub("%s", line.replace("%", "%%")))
            places += [names[d] for d in self._RUN.findall(line)]
        return "\n".join(text), places


def mmd(grid: Grid, heads: int = 1) -> str:
    """MultiMarkdown: in header rows, and rows of one text, a text that goes on to the right is one cell over several columns."""
    grid = squared(grid)
    if not grid:
        return ""
    lines = []
    for r, row in enumerate(grid):
        out = "|"
        heading = r < heads or len({x for x in row if x.strip()}) == 1  # one text over the row heads what is below it
        for c, cell in enumerate(row):
            again = heading and c and cell.strip() and cell == row[c - 1]
            out += "|" if again else f" {escaped(cell)} |"
        lines.append(out)
    heads = max(1, min(heads, len(lines)))
    return "\n".join([*lines[:heads], "|" + "---|" * len(grid[0]), *lines[heads:]])

"""Table grids: from the markup of a table to a rectangle of text, and the repairs that find its groups.

A table is small and its repairs depend on one another's order, so one paper is
one call in a worker, and papers run in parallel as one narrow stage. Nothing
here touches Spark but ``cells`` and ``interpret_tables`` in ``tables``.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from html.parser import HTMLParser

from tabsift.functions import patterns as P

LETTERS = string.ascii_uppercase


def squish(x: str) -> str:
    return re.sub(r"\s+", " ", x).strip()


def printable(x: str) -> str:
    return "".join(c if c.isprintable() else " " for c in x)


def has(pattern: str, x: str) -> bool:
    return re.search(pattern, x) is not None


def count(pattern: str, x: str) -> int:
    return sum(1 for _ in re.finditer(pattern, x))


class Stop(Exception):
    """A table that can't be used, and why; ``pvalues`` if it is known whether it has p-values."""

    def __init__(self, reason: str, pvalues: bool | None = None):
        super().__init__(reason)
        self.reason, self.pvalues = reason, pvalues


ONE_COLUMN = "Just one column in table"


@dataclass
class Grid:
    names: list[str]
    rows: list[list[str]]

    @property
    def width(self) -> int:
        return len(self.names)

    def column(self, k: int) -> list[str]:
        return [r[k] for r in self.rows]

    def first(self, k: int = 0) -> list[str]:
        return self.rows[k] if len(self.rows) > k else [""] * self.width

    def keep(self, which: list[bool]) -> None:
        self.names = [n for n, w in zip(self.names, which) if w]
        self.rows = [[x for x, w in zip(r, which) if w] for r in self.rows]

    def apply(self, f) -> None:
        self.rows = [[f(x) for x in r] for r in self.rows]

    def merge(self, k: int, text, name: str) -> None:
        """Column k + 1 into column k."""
        self.rows = [r[:k] + [text(r[k], r[k + 1])] + r[k + 2 :] for r in self.rows]
        self.names = self.names[:k] + [name] + self.names[k + 2 :]

    def need_columns(self) -> None:
        if self.width <= 2:
            raise Stop(ONE_COLUMN)


class _TableParser(HTMLParser):
    """Rows of (text, column span, row span) of the first table; reads what isn't well formed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.depth, self.done, self.cell, self.skip = 0, False, None, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table" and not self.done:
            self.depth += 1
        if not self.depth or self.done:
            return
        if tag in ("tfoot", "script", "style"):
            self.skip += 1
        elif self.skip:
            return
        elif tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            a = dict(attrs)
            span = lambda k: min(max(int(a.get(k) or 1), 1), 1000) if (a.get(k) or "1").strip().isdigit() else 1
            self.cell = ["", span("colspan"), span("rowspan")]
            self.rows[-1].append(self.cell)
        elif tag in ("br", "break") and self.cell is not None:
            self.cell[0] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0
        elif tag in ("tfoot", "script", "style") and self.skip:
            self.skip -= 1
        elif tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.skip:
            self.cell[0] += data


def parse(markup: str) -> list[list[str]]:
    """The first table's cells as a rectangle: spans are filled with their text, short rows with ''."""
    p = _TableParser()
    p.feed(markup)
    p.close()
    out: list[list[str]] = []
    hanging: dict[int, list] = {}
    for row in (r for r in p.rows if r or hanging):
        line: list[str] = []
        queue = list(row)
        while queue or any(k >= len(line) for k in hanging):
            k = len(line)
            if k in hanging:
                line.append(hanging[k][0])
                hanging[k][1] -= 1
                if not hanging[k][1]:
                    del hanging[k]
            elif queue:
                text, across, down = queue.pop(0)
                text = squish(text)
                for i in range(across):
                    if down > 1:
                        hanging[k + i] = [text, down - 1]
                    line.append(text)
            else:
                line.append("")
        out.append(line)
    width = max((len(r) for r in out), default=0)
    return [r + [""] * (width - len(r)) for r in out]


def open_table(wrap: str) -> Grid:
    """The grid of a table wrap, its first row as header."""
    if "<inline-graphic" in wrap:
        raise Stop("Table is graphic")
    cells = parse(wrap)
    if len(cells) < 2:
        raise Stop("Table is graphic")
    if len(cells) == 2:
        raise Stop("Complex format")
    return Grid(cells[0], cells[1:])


def drop_blank_and_repeated(g: Grid) -> None:
    """Rows without text go, and of equal neighbours the upper one."""
    rows = [r for r in g.rows if any(squish(printable(x)) for x in r)]
    g.rows = [r for k, r in enumerate(rows) if k + 1 == len(rows) or r != rows[k + 1]]


def name_columns(g: Grid) -> None:
    """Headings in plain lower case, none empty and none twice."""
    names = []
    for n in g.names:
        n = re.sub(r"(?=\(\d+\))", "n=", n.lower())
        names.append(squish(re.sub(r"[^=|a-z0-9% ]", " ", n)))
    blanks = 0
    for k, n in enumerate(names):
        if not n:
            blanks += 1
            names[k] = f"c{blanks}"
    g.names = names


def unique_names(g: Grid) -> None:
    names = list(g.names)
    if "variable" in names:
        names[names.index("variable")] = "VARIABLES"
    if len(set(names)) < len(names):
        if "variable" in names:
            raise Stop("Difficult layout")
        seen: set[str] = set()
        extra = 0
        for k, n in enumerate(names):
            if n in seen:
                names[k] = f"{LETTERS[extra % 26]}{n}"
                extra += 1
            seen.add(n)
    g.names = names


def reject_follow_up(g: Grid) -> None:
    """A table that holds later measurements too."""
    if any(has(P.FOLLOW_UP, x) for x in [*g.names, *g.first()]):
        raise Stop("Follow-up results in baseline table")


def transpose_if_turned(g: Grid) -> None:
    """Groups in rows."""
    common = any(has(P.COMMON_LABEL, x.lower()) for k in (0, 1) if k < g.width for x in g.column(k))
    sized = any(has(r"n\s?=\s?[0-9]", n) for n in g.names)
    in_heading = any(has(r"\bage\b|\bheight\b|\bweight\b|\bgender\b|sex\b", n.lower()) for n in g.names[1:])
    turned = (len(g.rows) < g.width and not common and not sized) or (in_heading and len(g.rows) < 10)
    if not turned or any(has("sex|age", x) for x in g.column(0)):
        return
    blank = 0
    names = ["label"]
    for x in g.column(0):
        if not x:
            x, blank = LETTERS[blank % 26], blank + 1
        names.append(x)
    g.rows = [[g.names[k], *g.column(k)] for k in range(1, g.width)]
    g.names = names


def sizes_to_heading(g: Grid) -> None:
    """A row of sample sizes becomes part of the headings."""
    labels = [x.lower() for x in g.column(0)]
    hit = [has(P.SAMPLE, x) for x in labels]
    named = next((k for k, x in enumerate(labels) if has(P.SAMPLE_WORDS, x)), None)
    most = len(hit) > 1 and sum(hit[1:]) / (len(hit) - 1) > 0.5
    if named is None and not (hit and hit[0]) and not most:
        return
    k = named if named is not None else 0
    if k >= len(g.rows):
        return
    for c in range(g.width):
        cell = g.rows[k][c]
        use = cell and not has("%|percent", cell) and not has("[a-z]?%|[a-z]?percent", g.names[c])
        g.names[c] = f"{g.names[c]} n={cell}" if use else f"{g.names[c]} "
    del g.rows[k]


def merge_labels(g: Grid) -> bool:
    """A second column of text is part of the label."""
    text = "".join(x.lower() for x in g.column(1)[:-1])
    letters, digits = count("[a-z]", text), count("[0-9]", text)
    if not letters + digits or letters / (letters + digits) <= 0.7:
        return False
    g.merge(0, lambda a, b: a if a == b else f"{a} {b}", "label")
    return True


def flag_median(x: str) -> str:
    form = r"[0-9]\s?\([0-9]{1,2}\.?[0-9]?\s?(to|[-‐-―−]|,)\s?[0-9]{1,2}\.?[0-9]{0,5}\)"
    return x.replace("(", " !!! ") if has(form, x) else x


def merge_brackets(g: Grid) -> None:
    """A column of values followed by a column of bracketed spreads is one."""
    found = [sum(x.count("(") for x in g.column(k)) for k in range(1, g.width)]
    n = max(len(g.rows), 1)
    pairs = [k for k in range(len(found) - 1) if (found[k] / n < 0.05 or found[k] <= 1) and found[k + 1] / n > 0.75]
    for k in reversed(pairs):
        g.merge(k + 1, lambda a, b: f"{a} {b}", f"{g.names[k + 1]} {g.names[k + 2]}")


def mark_percents(g: Grid, footnote: str) -> None:
    """Brackets are percentages where the table has means too, or the footnote speaks of counts."""
    text = " ".join(x for r in g.rows for x in r)
    if (has(P.PLUS_MINUS_PATTERN, text) or has(P.SAYS_PERCENT, footnote)) and "%" not in text and has(r"[0-9] \([0-9]", text):
        g.apply(lambda x: re.sub(r"([0-9]\s\([0-9]{1,3}(?:.[0-9]{1,2})?)\)", r"\1%)", x))


def plain_cells(g: Grid) -> None:
    g.names = [printable(n).lower() for n in g.names]
    g.apply(lambda x: re.sub(r"[^a-z0-9| .·%–\-±/:=!]", "", printable(re.sub(r"[(),]", " (", x.lower()))))


def _either(g: Grid, pattern: str) -> list[bool]:
    """Columns whose heading or first cell matches."""
    return [has(pattern, n) or has(pattern, x) for n, x in zip(g.names, g.first())]


def drop_totals(g: Grid) -> None:
    """Totals and subgroups; the first column always stays."""
    bare = lambda x: squish(re.sub(r"n=|n =|[0-9]", "", x.lower()))
    drop = [has(P.TOTAL, bare(n)) or has(P.TOTAL_PREFIXED, bare(n)) or has(P.TOTAL, bare(x)) for n, x in zip(g.names, g.first())]
    g.keep([k == 0 or not d for k, d in enumerate(drop)])
    g.need_columns()
    g.keep([k == 0 or any(has("[0-9]", x) for x in g.column(k)) or has(P.P_VALUE, g.names[k]) for k in range(g.width)])


def drop_tests(g: Grid) -> str:
    """Test statistics, whose text is returned, and ranges; a table of before and after is rejected."""
    if any(_either(g, P.PRE_POST)):
        raise Stop("Pre-post comparison")
    tests = _either(g, P.TEST_STATISTIC)
    tests[0] = False
    lost = " ".join(x for k, t in enumerate(tests) if t for x in g.column(k))
    g.keep([not t for t in tests])
    ranges = _either(g, P.EXTRA_RANGE)
    g.keep([not t for t in ranges])
    g.need_columns()
    return lost


_PAIRS = [
    (["mean", "m"], ["sd"], False),
    (["mean", "m"], [r"95%\s?c.?i.?"], False),
    (["median"], ["iqr", "inter-quartile range", "range"], False),
    (["n", "number"], ["%", "percent", "percentage"], False),
    (["%", "percent"], ["n", "number"], True),
    (["%", "percent"], ["9.%CI", "9.% CI", "9. % CI"], False),
]


def _pair_patterns(words: list[str], heading: bool) -> str:
    lead = "[a-z]?" if heading else ""
    whole = [rf"\b{lead}{w}\b" for w in words if w != "n"]
    return "|".join(whole + [f"^{lead}{w}$" for w in words] + [f" {lead}{w}$" for w in words])


def merge_neighbours(g: Grid) -> None:
    """A statistic's value and its spread in neighbouring columns, in six kinds; needs two such pairs."""
    for left, right, swap in _PAIRS:
        _merge_pair(g, left, right, swap)
        g.need_columns()


def _merge_pair(g: Grid, left: list[str], right: list[str], swap: bool) -> None:
    def found(words: list[str]) -> list[list[bool]]:
        out = [[has(_pair_patterns(words, h), squish(x)) for x in cells] for h, cells in lines]
        if "%" in words:
            often = [sum(has(r"[0-9]%", x) for x in g.column(k)) / max(len(g.rows), 1) > 0.5 for k in range(g.width)]
            out = [[a or b for a, b in zip(o, often)] for o in out]
        if "n" in words:
            sized = [any(has(r"n\s?=\s?[0-9]", squish(cells[k])) for _, cells in lines) for k in range(g.width)]
            # a heading with a size switches off the second statistic everywhere, the first in its own line only
            for line, o in zip(lines, out):
                source = line if words is left else lines[0]
                if any(has(r"n\s?=\s?[0-9]", squish(x)) for x in source[1]):
                    o[:] = [a and not s for a, s in zip(o, sized)]
        return out

    lines = [(True, g.names), (False, g.first(0)), (False, g.first(1))]
    a, b = found(left), found(right)
    both = []
    for h, cells in lines[:2]:
        lead = "[a-z]?" if h else ""
        form = "|".join(f"{lead}{x}.?.?.{lead}{y}|{lead}{y}.?.?.{lead}{x}" for x in left for y in right)
        both.append([has(form, squish(x)) for x in cells])
    here = [k for k in range(1, g.width) if any(bl[k] and al[k - 1] for al, bl in zip(a, b)) and not any(o[k] for o in both)]
    if len(here) < 2:
        return
    for k in reversed(here):
        name = f"{g.names[k]} {g.names[k - 1]}" if swap else f"{g.names[k - 1]} {g.names[k]}"
        g.merge(k - 1, (lambda x, y: f"{y} {x}") if swap else (lambda x, y: f"{x} {y}"), name)


def merge_rows(g: Grid, first: list[str], second: list[str], published: bool = True) -> None:
    """A row's spread in the row below.

    ``published`` keeps the rule as it was used: a row that is labelled with the
    first statistic takes in the next one, unless the row above is labelled so
    and this one isn't labelled with the second. Without it the next row must be
    labelled with the second.
    """
    one, two = (re.compile("|".join(f"^{w}$" for w in words)) for words in (first, second))
    labels = g.column(0)
    is1, is2 = [bool(one.search(x)) for x in labels], [bool(two.search(x)) for x in labels]
    if published:
        at = [k for k in range(1, len(labels)) if is1[k] and is2[k] == is1[k - 1]]
    else:
        at = [k for k in range(len(labels) - 1) if is1[k] and is2[k + 1]]
    for k in reversed([k for k in at if k + 1 < len(labels)]):
        g.rows[k] = [f"{x} {y}" for x, y in zip(g.rows[k], g.rows[k + 1])]
        del g.rows[k + 1]


def drop_size_columns(g: Grid) -> None:
    """Columns of sample sizes go, their mean into the next heading if no heading has one."""
    sized = [has(r"^n$|^n/n$|^[a-z]n$", squish(n)) or has(r"^n$|^n/n$", squish(x)) for n, x in zip(g.names, g.first())]
    if not any(sized) or g.width <= 2:
        return
    which = [k for k, s in enumerate(sized) if s]
    ok = False
    means: dict[int, str] = {}
    for k in which:
        cells = [x.strip() for x in g.column(k)]
        filled = sum(x not in ("", "n") for x in cells)
        plain = [float(x) for x in cells if re.fullmatch("[0-9]+", x)]
        ok |= filled > 0 and sum(bool(re.fullmatch(r"[0-9]+(/[0-9]+)?", x)) for x in cells) / filled > 0.85
        means[k] = f"n={round(sum(plain) / len(plain))}" if plain else ""
    if not ok:
        return
    if not any(has("n=|n =", n) for n in g.names):
        for k in which:
            if k + 1 < g.width and means[k]:
                g.names[k + 1] = f"{g.names[k + 1]} {means[k]}"
    g.keep([not s for s in sized])


def drop_unwanted_rows(g: Grid) -> None:
    """Rows of ratios and totals go; a label that fills its row is kept once."""
    g.rows = [r for r in g.rows if not has(P.UNWANTED_ROW, r[0]) or has(P.WANTED_RATIO, r[0])]
    g.rows = [[r[0]] + [""] * (g.width - 1) if len(set(r)) == 1 else r for r in g.rows]


def first_data_row(g: Grid) -> int:
    """The first row with more digits than letters and fewer than two sizes; 0 if there is none."""
    for k, r in enumerate(g.rows):
        cells = [x.lower() for x in r[1:]]
        text, digits = (sum(count(p, x) for x in cells) for p in ("[a-z]", "[0-9]"))
        if sum(has("n=|n =|^n$", x) for x in cells) < 2 and digits > text:
            return k
    return 0


def numeric_rows(rows: list[list[str]]) -> list[int]:
    """Rows of which a cell is more than two fifths digits."""
    share = lambda x: count("[0-9]", x) / max(count(r"\S", x), 1)
    return [k for k, r in enumerate(rows) if any(share(squish(x)) > 0.4 for x in r)]

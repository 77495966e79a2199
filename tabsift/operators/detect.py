"""Which statistic a row holds, what its numbers are, and how large the groups are."""

from __future__ import annotations

import re
from collections import Counter
from statistics import median

from tabsift.functions import patterns as P
from tabsift.operators.grid import Grid, Stop, count, has, numeric_rows, squish

#: Of equal scores the first wins.
KINDS = ["percent", "continuous", "numbers", "min_max", "pvals", "median", "ci"]
WEIGHT, FOOT = 2.0, 0.1
_HEADING = {"percent": P.PERCENT, "continuous": P.CONTINUOUS, "numbers": P.NUMBERS, "min_max": P.MIN_MAX, "median": P.MEDIAN, "ci": P.CI}


def cell_flags(x: str) -> dict[str, float]:
    """What a cell's text speaks for."""
    return {
        "percent": float("%" in x),
        "continuous": float(count(P.PLUS_MINUS_PATTERN, x)),
        "numbers": float("/" in x),
        "min_max": float(has("min|max", x)),
        "pvals": float(has("p.value|p =|p=", x)),
        "ci": float(has(r"[0-9]\s?to\s?-?[0-9]|[0-9]\s?,\s?-?[0-9]", x)),
        "median": float(has(P.MEDIAN_CELL, x)),
    }


def _heading_scores(cells: list[str]) -> dict[str, float]:
    cells = [squish(x) for x in cells]
    out = {k: float(sum(count(p, x) for x in cells)) for k, p in _HEADING.items()}
    out["pvals"] = float(sum(has(P.P_VALUE, x) for x in cells))
    out["ci"] *= 5
    return out


def _label_scores(x: str) -> dict[str, float]:
    x = x.replace("min/", "")
    return {
        "percent": 2.0 * count("%|percent", x) + count(P.PERCENT, x),
        "continuous": (2.0 * count("mean", x) + count(P.CONTINUOUS, x)) * WEIGHT,
        "numbers": count(P.NUMBERS, x) * WEIGHT,
        "min_max": count(P.MIN_MAX, x) * WEIGHT,
        "pvals": has(P.P_VALUE, x) * WEIGHT,
        "median": count("median", x) * 2 * WEIGHT + count(P.MEDIAN_WORDS, x) * WEIGHT * 1.1,
        "ci": float(count(P.CI, x)),
    }


def _foot_scores(text: str) -> dict[str, float]:
    if len(text) <= 1:
        return dict.fromkeys(KINDS, 0.0)
    big = 1 / FOOT
    return {
        "percent": count(P.FOOT_PERCENT, text) + big * has(P.SAYS_PERCENT, text),
        "continuous": count(P.FOOT_CONTINUOUS, text) + big * has(P.SAYS_CONTINUOUS, text),
        "numbers": 0.0,
        "min_max": float(count(P.MIN_MAX_WHOLE, text)),
        "pvals": 0.0,
        "median": count(P.MEDIAN_WORDS, text) + big * has(P.SAYS_MEDIAN, text),
        "ci": count(P.CI, text) + big * 1.1 * has("% confidence interval", text),
    }


def detect(rows: list[list[str]], header: list[list[str]], footnote: str, caption: str) -> tuple[list[str | None], set[int]]:
    """(statistic by row, columns of p-values). ``header`` has the heading first; columns count from 0, the label's."""
    width = len(rows[0]) if rows else 0
    heading = [_heading_scores([line[k] for line in header if k < len(line)]) for k in range(width)]
    pcols = {k for k, h in enumerate(heading) if h["pvals"] > 0}
    left = [k for k in range(1, width) if k not in pcols]
    flags = [[cell_flags(r[k]) for k in left] for r in rows]
    by_cell = {left[i] for i in range(len(left)) if rows and sum(f[i]["pvals"] for f in flags) / len(rows) > 0.5}
    shares = {s: sum(h[s] for k, h in enumerate(heading) if k not in pcols and k not in by_cell) / len(KINDS) for s in KINDS}
    foot = _foot_scores(f"{footnote} {caption}".lower())
    out: list[str | None] = []
    for r, f in zip(rows, flags):
        label = _label_scores(r[0])
        score = {s: sum(f[i][s] for i in range(len(left)) if left[i] not in by_cell) + shares[s] + label[s] + FOOT * foot[s] for s in KINDS}
        best = max(KINDS, key=lambda s: score[s])
        out.append(best if score[best] > 0 else (out[-1] if out else None))
    return out, pcols | by_cell


def sections(rows: list[list[str]]) -> list[tuple[int, int, int | None]]:
    """(first row, end, heading row) of the stretches that rows of text part; the first has the table's heading."""
    at = numeric_rows(rows)
    jumps = [(i + 1, b - a) for i, (a, b) in enumerate(zip(at, at[1:])) if b - a > 1]
    if not jumps:
        return [(0, len(rows), None)]
    out: list[tuple[int, int, int | None]] = [(0, jumps[0][0], None)]
    for s, (k, gap) in enumerate(jumps):
        start = k + s + gap - 1
        stop = len(rows) if s + 1 == len(jumps) else jumps[s + 1][0] + (s + 1) + gap - 2
        start, stop = min(start, len(rows)), min(max(stop, start), len(rows))
        if start < stop:
            text_row = not any(has("[0-9]", x) for x in rows[start][1:])
            out.append((start, stop, start if text_row else max(start - 1, 0)))
    return out


def detect_sections(rows: list[list[str]], names: list[str], header: list[list[str]], footnote: str, caption: str) -> tuple[list[str | None], set[int]]:
    """detect() by section; a row without a statistic has the last one above it."""
    kinds: list[str | None] = [None] * len(rows)
    pcols: set[int] = set()
    for start, stop, head in sections(rows):
        lines = [names, *header] if head is None else [[re.sub("n.=|n=", "", n) for n in names], rows[head]]
        found, cols = detect(rows[start:stop], lines, footnote, caption)
        kinds[start:stop] = found
        pcols |= cols
    for k in range(1, len(kinds)):
        kinds[k] = kinds[k] or kinds[k - 1]
    return kinds, pcols


def number(x: str | None) -> float | None:
    return float(x) if x and re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", x) else None


def tokens(x: str) -> dict | None:
    """Up to four numbers of a cell, and the decimals of the first two as printed."""
    parts = squish(re.sub(r"[^-|0-9. ]", " ", x)).split(" ")[:4]
    parts += [None] * (4 - len(parts))
    stats = [number(p) for p in parts]
    if stats[0] is None:
        return None
    dp = [len(p.split(".")[1]) if p and "." in p else 0 for p in parts[:2]]
    return {"stat1": stats[0], "stat2": stats[1], "stat3": stats[2], "stat4": stats[3], "dp1": dp[0], "dp2": dp[1] if parts[1] is not None else None}


def sizes_in(cells: list[str]) -> dict[int, float]:
    """sample sizes by column, from 1, of texts like 'group a (n = 79)'."""
    clean = [squish(re.sub(r"[^a-z|0-9= ]", " ", x.lower())) for x in cells]
    out = {}
    for k, x in enumerate(clean):
        found = re.findall(r"n\s?=?\s?([0-9]{1,7})", x)
        if found:
            out[k + 1] = float(found[-1])
    if not out and clean and clean[0].endswith(" n"):
        out = {k + 1: float(x) for k, x in enumerate(clean) if number(x) is not None}
    return out


def _mode(x: list[float]) -> float:
    n = Counter(x)
    return max(n, key=lambda v: n[v])  # of several the first seen


def _quartile(x: list[float], q: float) -> float:
    x = sorted(x)
    k = (len(x) - 1) * q
    low = int(k)
    return x[low] + (k - low) * (x[min(low + 1, len(x) - 1)] - x[low])


def _spread(x: list[float]) -> float:
    return _quartile(x, 0.75) - _quartile(x, 0.25)


def estimate_sizes(names: list[str], header: list[list[str]], top: list[list[str]], cells: list[dict]) -> dict[int, float]:
    """Sizes by column from the first source that has any: header row, headings, first rows, row labels, numbers, percentages, numbers of one row.

    ``header`` and ``names`` have no label column; ``top`` has.
    """
    hits = [sum(has(P.SAMPLE, squish(x)) for x in r) for r in header]
    if sum(hits):
        found = sizes_in(header[hits.index(max(hits))])
    else:
        found = sizes_in(names)
    if found:
        return found
    sized = [(sum(has(P.SAMPLE, squish(x)) for x in r[1:]), k) for k, r in enumerate(top)]
    sized = [s for s in sized if s[0] >= 2]
    if sized:
        return sizes_in(top[min(sized)[1]][1:])
    for r in top:
        if has(P.SAMPLE, squish(r[0])):
            found = {k + 1: number(re.split(" |/", squish(x))[0]) for k, x in enumerate(r[1:])}
            found = {k: v for k, v in found.items() if v is not None}
            if found:
                return found
            break

    def by_column(rows: list[tuple[int, float]]) -> dict[int, list[float]]:
        out: dict[int, list[float]] = {}
        for k, v in rows:
            out.setdefault(k, []).append(v)
        return out

    sums = by_column([(c["column"], c["stat1"] + c["stat2"]) for c in cells if c["statistic"] == "numbers" and c["stat2"] is not None and c["stat3"] is None])
    found = {k: _mode(v) for k, v in sums.items() if _spread(v) < 1}
    if found:
        return found
    counted = [c for c in cells if c["statistic"] == "percent" and c["dp1"] == 0 and c["stat2"] is not None and c["stat3"] is None]
    if all(c["stat2"] != 0 for c in counted):
        back = by_column([(c["column"], float(round(c["stat1"] * 100 / c["stat2"]))) for c in counted])
        found = {k: float(round(median(v))) for k, v in back.items() if _spread(v) == 0}
        if found:
            return found
    rows: dict[float, list[dict]] = {}
    for c in cells:
        if c["statistic"] == "numbers" and c["dp1"] == 0 and c["stat2"] is not None:
            rows.setdefault(c["row"], []).append(c)
    for r in sorted(rows):
        if len({c["stat1"] + c["stat2"] for c in rows[r]}) == 1:
            return {c["column"]: c["stat1"] + c["stat2"] for c in rows[r]}
    return {}


def _rank(values: list) -> dict:
    return {v: k + 1 for k, v in enumerate(sorted(set(values)))}


def attach_sizes(cells: list[dict], sizes: dict[int, float]) -> list[dict]:
    """Cells with their group's size; sizes that stand at other columns are taken in order, and a row that only repeats them goes."""
    have = {c["column"] for c in cells}
    if any(k not in have for k in sizes):
        order = _rank(list(sizes))
        sizes = {order[k]: v for k, v in sizes.items()}
    out = [c | {"sample_size": sizes[c["column"]]} for c in cells if c["column"] in sizes]
    width = max((c["column"] for c in out), default=0)
    if sum(c["row"] == 1 and c["stat1"] == c["sample_size"] for c in out) == width:
        out = [c for c in out if c["row"] > 1]
    return _renumber(out)


def _renumber(cells: list[dict]) -> list[dict]:
    rows, cols = _rank([c["row"] for c in cells]), _rank([c["column"] for c in cells])
    return sorted((c | {"row": rows[c["row"]], "column": cols[c["column"]]} for c in cells), key=lambda c: (c["row"], c["column"]))


def drop_repeated_columns(cells: list[dict]) -> list[dict]:
    """Up to four columns of which more than three quarters of the cells repeat earlier ones; of those listed the first goes."""
    for _ in range(4):
        seen: set = set()
        repeats: Counter = Counter()
        for c in cells:
            key = (c["row"], c["stat1"], c["stat2"])
            if key in seen:
                repeats[c["column"]] += 1
            seen.add(key)
        height = max((c["row"] for c in cells), default=0)
        if not any(n / height > 0.75 for n in repeats.values()):
            break
        gone = min(repeats)
        order = _rank([c["column"] for c in cells if c["column"] != gone])
        cells = [c | {"column": order[c["column"]]} for c in cells if c["column"] != gone]
    return cells


def merge_mirrors(cells: list[dict]) -> list[dict]:
    """Neighbouring columns that fill each other's gaps in nine tenths of the rows are one."""
    have = {(c["row"], c["column"]) for c in cells}
    height, width = max((c["row"] for c in cells), default=0), max((c["column"] for c in cells), default=0)
    rows = sorted({c["row"] for c in cells})
    merged = False
    for k in range(1, width, 2):
        if height and sum(((r, k) in have) != ((r, k + 1) in have) for r in rows) / height > 0.9:
            cells = [c | {"column": k if c["column"] == k + 1 else c["column"]} for c in cells]
            merged = True
    if merged:
        order = _rank([c["column"] for c in cells])
        cells = [c | {"column": order[c["column"]]} for c in cells]
    return cells

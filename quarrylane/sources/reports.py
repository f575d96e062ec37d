"""Small aggregates as text: fixed-width reports and LaTeX tables. These format on the driver what is already a handful of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a report takes; more is an error, not a cut.
MOST_ROWS = 10_000


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report is for at most {MOST_ROWS} rows")
    return rows


def _cell(v: object, digits: int, missing: str) -> str:
    if v is None:
        return missing
    return f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def fixed_width(df: DataFrame, title: str, digits: int = 4) -> str:
    rows = [[_cell(v, digits, "-") for v in r] for r in _rows(df)]
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), line(df.columns), line(["-" * w for w in widths]), *map(line, rows)]) + "\n"


def latex(df: DataFrame, *, caption: str, label: str, bold: str | None = None, interval: tuple[str, str] | None = None, digits: int = 3) -> str:
    """A table with ``--`` for nulls, the rows bold where column ``bold`` is true, and two columns drawn together as an interval."""
    shown = [c for c in df.columns if c != bold and not (interval and c in interval)]
    body = []
    for r in _rows(df):
        cells = [_cell(r[c], digits, "--").replace("_", r"\_") for c in shown]
        if interval:
            low, high = r[interval[0]], r[interval[1]]
            cells.append("--" if low is None or high is None else f"[{low:.{digits}f}, {high:.{digits}f}]")
        if bold and r[bold]:
            cells = [rf"\textbf{{{c}}}" for c in cells]
        body.append(" & ".join(cells) + r" \\")
    head = [c.replace("_", r"\_") for c in shown] + (["95\\% CI"] if interval else [])
    return "\n".join([r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(head)}}}", r"\hline", " & ".join(head) + r" \\", r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"]) + "\n"

"""Small result tables as markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cell(value: object, form: str | None = None) -> str:
    """Null is blank; numbers follow the form."""
    if value is None:
        return ""
    return format(value, form) if form else str(value)


def to_markdown(df: DataFrame, titles: dict[str, str] | None = None, forms: dict[str, str] | None = None, by: list[str] | None = None, heading: str = "{}") -> str:
    """One table, or one for each value of ``by``, in the frame's order."""
    titles, forms, by = titles or {}, forms or {}, by or []
    columns = [c for c in df.columns if c not in by]
    head = ["| " + " | ".join(titles.get(c, c) for c in columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    lines: list[str] = []
    now: tuple | None = None
    for row in df.toLocalIterator():
        key = tuple(row[c] for c in by)
        if key != now:
            lines += ([""] if now is not None else []) + ([f"## {heading.format(*key)}", ""] if by else []) + head
            now = key
        lines.append("| " + " | ".join(cell(row[c], forms.get(c)) for c in columns) + " |")
    return "\n".join(lines or head) + "\n"


def leakage_cells(summary: DataFrame, kinds: tuple[str, ...] = ("row_random", "hash_grouped", "behaviour_grouped")) -> DataFrame:
    """The summary with each kind's MCC as text with its range, and signed gaps."""
    from pyspark.sql import functions as F

    spans = [F.format_string("%.3f (%.3f to %.3f)", f"mcc_{k}", f"mcc_min_{k}", f"mcc_max_{k}").alias(k) for k in kinds]
    gaps = [F.format_string("%+.3f", g).alias(g) for g in ("row_gap", "identity_gap")]
    return summary.select("unit", "cap", "view", "arch", "seeds", *spans, *gaps)


#: Title, column titles, forms of numbers, and the columns that tables go by, for each kind of result.
LAYOUTS: dict[str, tuple[str, dict[str, str], dict[str, str], list[str]]] = {
    "manifest": ("Files", {"size_bytes": "bytes", "arch": "domain"}, {"size_bytes": ",d", "rows": ",d"}, []),
    "counts": ("Rows in files and as published", {"rows_in_file": "files", "rows_in_paper": "published", "unknown_rows": "difference"}, {"rows_in_file": ",d", "rows_in_paper": ",d", "unknown_rows": "+,d"}, []),
    "duplicates": ("Duplicate entities", {}, {}, ["arch"]),
    "cross-class": ("Signatures in more than one class", {}, {}, ["arch"]),
    "splits": ("Entities by side", {"binaries": "entities"}, {}, ["arch"]),
    "results": ("Scores", {"held_out": "domain", "test_n": "entities"}, {c: ".3f" for c in ("chance", "accuracy", "macro_f1", "mcc", "mcc_half", "auroc", "threshold", "whole")}, ["experiment"]),
    "leakage": ("Splits compared", {"row_random": "by row", "hash_grouped": "by entity", "behaviour_grouped": "by behaviour"}, {}, ["unit", "cap"]),
}


def render(df: DataFrame, layout: str) -> str:
    """A result under its title, in the layout of its kind."""
    title, titles, forms, by = LAYOUTS[layout]
    by = [c for c in by if c in df.columns]
    forms = forms | {c: ".3f" for c, t in df.dtypes if t == "double" and c not in forms}
    shown = df.orderBy(*by) if by and layout != "leakage" else df
    return f"# {title}\n\n" + to_markdown(shown, titles, forms, by, ", ".join(["{}"] * len(by)))

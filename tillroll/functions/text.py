"""Text rules as Spark SQL expressions."""

from __future__ import annotations

from tillroll.functions.numeric import rounded


def title_case(x: str) -> str:
    r"""Capital after every non-letter: ``T-Shirt``, ``Children'S Book``.

    ``initcap`` only looks at spaces, which is enough for a value made of letters
    and spaces; the piecewise form is left to the values that need it.
    """
    return (
        rf"CASE WHEN {x} RLIKE r'[^\p{{L}} ]' THEN array_join(transform("
        rf"regexp_extract_all({x}, r'(\p{{L}}+|\P{{L}}+)', 1), p -> initcap(p)), '') "
        f"ELSE initcap({x}) END"
    )


def month_label(year: str, month: str) -> str:
    return f"concat_ws('-', cast({year} as string), lpad(cast({month} as string), 2, '0'))"


def in_millions(x: str) -> str:
    return f"format_string('$%.1fM', {rounded(f'({x}) / 1000000D', 1)})"


def in_thousands(x: str) -> str:
    return f"format_string('%.1fK', {rounded(f'({x}) / 1000D', 1)})"


def dollars(x: str, digits: int = 0) -> str:
    return f"format_string('$%,.{digits}f', {rounded(x, digits)})"


def percent_text(x: str, digits: int = 1) -> str:
    return f"format_string('%.{digits}f%%', {rounded(x, digits)})"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(index: str, texts: list[str]) -> str:
    """The text at a zero-based position."""
    return f"element_at(array({', '.join(map(quoted, texts))}), {index} + 1)"

"""Comment spans and function spans of TypeScript and JavaScript texts, found independently of each other."""

from __future__ import annotations

from lodestone.functions.code import blanked, comment_runs, declarations, line_starts


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[str, int, int]]]:
    """(comment runs, functions) of a text as (first line, last line, text) and (name, first line, last line); lines count from 0.

    Functions are top-level functions, constants with a function value, and methods of
    top-level classes. Runs are comments that stand alone on adjacent lines.
    """
    text = text.replace("\r\n", "\n")
    code, comments = blanked(text)
    found = [(d.name, d.first, d.last) for d in declarations(code) if d.kind in ("function", "method") and d.form in ("", "const")]
    return comment_runs(text, code, comments, line_starts(text)), found

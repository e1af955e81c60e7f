"""Rows of an answer as text. Answers are a few hundred rows at most."""

from __future__ import annotations

from typing import Any, Mapping

Row = Mapping[str, Any]


def _location(row: Row) -> str | None:
    if row["file_path"] and row["line_start"] is not None:
        return f"{row['file_path']}:{row['line_start']}-{row['line_end']}"
    return None


def _tags(row: Row) -> list[str]:
    return [f"tags={','.join(row['tags'])}"] if row["tags"] else []


def _labelled(row: Row, labels: list[str], body: str) -> str:
    return f"[{row['id']}] ({', '.join(labels)}) {body}".rstrip(" ") if not body else f"[{row['id']}] ({', '.join(labels)}) {body}"


def hit_line(row: Row, with_text: bool = True) -> str:
    """``[id] (score=0.1234, path:start-end) text``; notes show their tags instead of a place."""
    labels = [f"score={row['score']:.4f}"]
    if _location(row) and row["line_end"] is not None:
        labels.append(_location(row))
    if row["kind"] != "code":
        labels += _tags(row)
    return _labelled(row, labels, row["text"] if with_text else "")


def list_line(row: Row, width: int = 200) -> str:
    place = [_location(row)] if _location(row) else []
    text = row["text"]
    units = text.encode("utf-16-le", "surrogatepass")
    if len(units) > 2 * width:
        text = units[: 2 * width].decode("utf-16-le", "ignore") + "…"
    return _labelled(row, [row["created_at"], *place, *_tags(row)], text)


def recall_header(project: str, n: int, tokens: int, max_tokens: int | None, survivors: int) -> str:
    if max_tokens is None:
        return f"# {n} result(s) from project '{project}' (~{tokens} tokens)"
    dropped = survivors - n
    note = f" ({dropped} lower-ranked dropped by budget/dedup)" if dropped > 0 else ""
    return f"# {n} result(s) from project '{project}' using {tokens}/{max_tokens} tokens{note}"

"""The prose of a notebook: sentences and list items of its text cells.

Three layouts are understood: ``json`` (a notebook object, also one that is cut
off), ``percent`` (``# %%`` blocks) and ``markdown`` (fenced code).  Headings,
formulas, tables, images, links, code and outputs are left out; wrapped lines
are joined.
"""

from __future__ import annotations

import json
import re

_KIND = re.compile(r'"cell_type"\s*:\s*"(\w+)"')
_OBJECT = re.compile(r"[\ufeff \t\r\n]*\{")
_LOST_START = re.compile(r'(?!\s*\{)((?:[^"\\]|\\.|"\s*,\s*")*)"\s*\]\s*\}\s*,\s*\{\s*"cell_type"', re.S)
_SOURCE = re.compile(r'"source"\s*:\s*(\[|")')
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("|\Z)', re.S)
_BLANK, _COMMA = re.compile(r"\s*"), re.compile(r"\s*,")
_BLOCK = re.compile(r"(?:\A[^\n]{0,12}?|^[^\S\n]*)# %%[^\n]*$", re.M)
_COMMENT = re.compile(r"^\s*# ?")
_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)")
#: A text may begin with a few stray characters before its first fence or heading.
_STRAY = re.compile(r"\A[^\n`#]{1,12}(?=```|~~~|#{1,6}\s)")
_RULES = re.compile(r"^\s*([-*_=]\s*){3,}$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_HEADING = re.compile(r"^\s{0,3}#{1,6}(\s|$)")
_FORMULA = re.compile(r"\$\$.*?(?:\$\$|\Z)|\\\[.*?(?:\\\]|\Z)|\\begin\{(\w+\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_INLINE = re.compile(r"!\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\([^)]*\)|<https?://[^>\s]*>|https?://\S+|www\.\S+|`[^`]*`|\$[^$\n]+\$|<[^<>\n]{1,200}>")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»')\]]*\s+")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def layout(text: str, stated: str | None) -> str:
    """The layout; ``stated`` decides for a text whose start is cut off or overwritten."""
    if '"cell_type"' in text and (stated == "json" or _OBJECT.match(text) or stated is None and _KIND.search(text) and '"source"' in text):
        return "json"
    if stated in ("json", "percent"):
        return stated
    return "percent" if stated is None and _BLOCK.search(text) else "markdown"


def _unquoted(inner: str) -> str:
    try:
        return json.loads('"' + inner + '"', strict=False)
    except ValueError:  # cut off within an escape
        return re.sub(r"\\.{0,4}$", "", inner)


def _json_cells(text: str) -> list[str]:
    try:
        cells = json.loads(text)["cells"]
        out = []
        for cell in cells:
            if isinstance(cell, dict) and cell.get("cell_type") == "markdown":
                source = cell.get("source") or ""
                out.append(source if isinstance(source, str) else "".join(x for x in source if isinstance(x, str)))
        return out
    except (ValueError, KeyError, TypeError, RecursionError):
        pass
    out = []  # cut off or broken: by the order of its keys
    kinds = list(_KIND.finditer(text))
    if lost := _LOST_START.match(text):  # only a text cell ends right after its source
        out.append("".join(_unquoted(x) for x in re.split(r'"\s*,\s*"', lost[1])))
    for i, kind in enumerate(kinds):
        if kind[1] != "markdown":
            continue
        end = kinds[i + 1].start() if i + 1 < len(kinds) else len(text)
        at = _SOURCE.search(text, kind.end(), end)
        if not at:
            continue
        parts, p = [], at.end() - (at[1] == '"')
        while m := _STRING.match(text, _BLANK.match(text, p).end()):
            parts.append(_unquoted(m[1]))
            more = _COMMA.match(text, m.end())
            if at[1] == '"' or not more:
                break
            p = more.end()
        out.append("".join(parts))
    return out


def _percent_cells(text: str) -> list[str]:
    marks = list(_BLOCK.finditer(text))
    first = marks[0].start() if marks else len(text)
    lines = text[:first].split("\n")[1:]
    out = [text[:first]] if any(x.startswith("# ") for x in lines) and all(x.startswith("#") and not x.startswith("#>") for x in lines if x.strip()) else []
    for i, mark in enumerate(marks):
        if "[markdown]" in mark[0] or "[md]" in mark[0]:
            out.append(text[mark.end() : marks[i + 1].start() if i + 1 < len(marks) else len(text)])
    return ["\n".join(_COMMENT.sub("", line, count=1) for line in body.split("\n")) for body in out]


def text_cells(text: str, stated: str | None = None) -> list[str]:
    """The text cells of a notebook; lines end in a plain newline."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    kind = layout(text, stated)
    cells = _json_cells(text) if kind == "json" else _percent_cells(text) if kind == "percent" else [_STRAY.sub("", text)]
    return [c.replace("\r\n", "\n") for c in cells]


def sentences(cell: str) -> list[str]:
    """Sentences and list items of one text cell."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            out.extend(s for s in (x.strip() for x in _SENTENCE.split(_INLINE.sub(" ", " ".join(held)))) if WORD.search(s))
            held.clear()

    fence = ""
    for line in _FORMULA.sub("\n\n", cell).split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence[:3]) and len(mark[1]) >= len(fence):
                fence = ""
            continue
        if mark:
            close()
            fence = mark[1]
        elif not line.strip() or _HEADING.match(line) or _RULES.match(line) or line.lstrip().startswith(("|", ">|", "#>")) or line.count("|") >= 2:
            close()
        elif item := _ITEM.match(line):
            close()
            held.append(line[item.end() :])
        else:
            held.append(line.strip())
    close()
    return out


def prose(text: str | None, stated: str | None = None) -> list[str]:
    """Sentences and list items of a whole notebook; none for a null or blank text."""
    if not text or not text.strip():
        return []
    return [s for cell in text_cells(text, stated) for s in sentences(cell)]

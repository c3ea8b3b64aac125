"""What the hand-written scanners share: masking of comments and strings, and matching of brackets."""

from __future__ import annotations

import functools
import re

_MASKS = {
    "c": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "ruby": re.compile(r"#[^\n]*|^=begin.*?^=end|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S | re.M),
}


def masked(content: str, style: str) -> str:
    """The text with the inside of comments and strings as spaces; places and line breaks stay."""
    blank = lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in "\"'`" and len(m[0]) > 1 else re.sub(r"[^\n]", " ", m[0])
    return _MASKS[style].sub(blank, content)


class Lines:
    """Line numbers of offsets."""

    def __init__(self, content: str):
        self._starts = [0, *[m.end() for m in re.finditer("\n", content)]]

    def of(self, offset: int) -> int:
        import bisect

        return bisect.bisect_right(self._starts, offset)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """Offset of the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.start()
    return len(text) - 1


@functools.lru_cache(maxsize=2)
def _lines(content: str) -> list[str]:
    """The lines of the file that is being read, cut once for all its symbols."""
    return content.split("\n")


def symbol(name: str, kind: str, start: int, end: int, content: str, signature: str, class_name: str = "", decorators: list[str] | None = None) -> dict:
    lines = _lines(content)
    return {"name": name, "kind": kind, "start_line": start, "end_line": end, "content": "\n".join(lines[start - 1 : end]), "signature": " ".join(signature.split()), "class_name": class_name, "decorators": decorators or []}


def call(name: str, line: int, receiver: str = "", arguments: list[str] | None = None, weak: bool = False) -> dict:
    return {"name": name, "line": line, "receiver": receiver, "arguments": arguments or [], "is_weak_ref": weak}


def bare_arguments(text: str, at: int) -> list[str]:
    """Identifiers that stand alone as arguments of the call whose bracket is at ``at``."""
    inside = text[at + 1 : closing(text, at, "()")]
    flat = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "", inside)
    return [a.strip() for a in flat.split(",") if re.fullmatch(r"\s*[A-Za-z_]\w*\s*", a)]

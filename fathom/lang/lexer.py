"""Tokens of the query language, with their places."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from ..errors import SyntaxProblem

_TOKEN = re.compile(
    r"""(?P<skip>[\s,]+|\#[^\n]*)
    |(?P<block>\"\"\"(?:(?!\"\"\").|\n)*\"\"\")
    |(?P<string>"(?:[^"\\\n]|\\.)*")
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_]\w*)
    |(?P<sign>\.\.\.|&&|\|\||==|!=|>=|<=|[{}()\[\]:!@$=|.?<>+\-*/%])""",
    re.X | re.ASCII,
)


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    column: int
    #: Whether a comma comes before it.
    comma: bool = False

    @property
    def value(self):
        if self.kind == "block":
            return self.text[3:-3]
        if self.kind == "string":
            return json.loads(self.text)
        return float(self.text) if re.search(r"[.eE]", self.text) else int(self.text)


def tokens(text: str) -> list[Token]:
    """All tokens of a text and one that ends it.  Commas separate, as white space does."""
    out: list[Token] = []
    at, line, start, comma = 0, 1, 0, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r}", line, at - start + 1)
        kind, piece = str(m.lastgroup), m[0]
        if kind == "skip":
            comma |= piece[0] != "#" and "," in piece
        else:
            token, comma = Token(kind, piece, line, at - start + 1, comma), False
            if kind == "string":
                try:
                    token.value  # noqa: B018
                except ValueError:
                    raise SyntaxProblem("bad escape in a string", line, at - start + 1) from None
            out.append(token)
        if newlines := piece.count("\n"):
            line += newlines
            start = at + piece.rfind("\n") + 1
        at = m.end()
    out.append(Token("end", "", line, at - start + 1, True))
    return out

"""One reply of a model, put together from its stream of fragments."""

from __future__ import annotations

import re

# A piece that begins with one of these, or is as long as LONG_PIECE, begins a new line.
RESTARTS = (
    "Now I", "Now let", "Wait", "Okay", "Ok,", "Let me", "I need", "You're right", "You are right", "Actually", "Hmm", "Good.", "Sorry", "I made an error", "I see",
)
LONG_PIECE = 48
NO_ARGUMENTS = "{}"
_THOUGHT = re.compile(r"<(think(?:ing)?)>(.*?)</\1>", re.I | re.S)


def without_thoughts(text: str) -> tuple[str, str]:
    """The thoughts that stand in ``think`` or ``thinking`` tags, one by line, and the text without them."""
    if "<" not in text:
        return "", text
    thoughts = [m[2].strip() for m in _THOUGHT.finditer(text)]
    return "\n".join(t for t in thoughts if t), _THOUGHT.sub("", text).strip()


def grown(text: str, piece: str | None) -> str:
    """The text after a piece: a longer snapshot takes its place, a shorter one says nothing new, a restart begins a line, all else goes on."""
    if not piece or text.startswith(piece):
        return text
    if piece.startswith(text):
        return piece
    fresh = len(piece) >= LONG_PIECE or piece.lstrip().startswith(RESTARTS)
    return text + ("\n" if fresh and piece[0] != "\n" else "") + piece


class Reply:
    """The texts, calls and end of a reply so far.

    A fragment has a ``kind``: ``content`` and ``reasoning`` bring a piece of text, ``call`` a piece of the
    arguments (or name, or id) of the call with this ``index`` (null: 0), ``finish`` the reason of the end.
    Any other kind is counted and says nothing.
    """

    def __init__(self, content: str = "", reasoning: str = "", finish: str | None = None, fragments: int = 0, calls: dict | None = None):
        self.content, self.reasoning, self.finish, self.fragments = content, reasoning, finish, fragments
        self.calls: dict[int, tuple[str | None, str, str]] = {} if calls is None else calls

    def add(self, kind: str | None, piece: str | None, index: int | None, call_id: str | None, name: str | None) -> None:
        self.fragments += 1
        if kind == "content":
            self.content = grown(self.content, piece)
        elif kind == "reasoning":
            self.reasoning = grown(self.reasoning, piece)
        elif kind == "finish":
            self.finish = piece or self.finish
        elif kind == "call":
            before = self.calls.get(index or 0, (None, "", ""))
            self.calls[index or 0] = (call_id or before[0], before[1] + (name or ""), before[2] + (piece or ""))

    def row(self) -> dict:
        """The reply as it stands; calls by index, arguments ``{}`` where none came; tagged thoughts leave the content and are the reasoning if no other came."""
        thoughts, content = without_thoughts(self.content)
        calls = [{"index": i, "id": c[0], "name": c[1], "arguments": c[2] or NO_ARGUMENTS} for i, c in sorted(self.calls.items())]
        return {"content": content, "reasoning": self.reasoning.strip() or thoughts, "calls": calls, "finish": self.finish, "fragments": self.fragments}


CALLS = "array<struct<index: int, id: string, name: string, arguments: string>>"
REPLY = f"content string, reasoning string, calls {CALLS}, finish string, fragments long, complete boolean"
FRAGMENT = ["seq", "kind", "piece", "index", "call_id", "name"]

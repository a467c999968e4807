"""Tokens of user-defined syntax: a trie for the longest match, ids that are given back, marks in order, white space."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

BLANKS = " \t\r\n"
#: Escaped white space is text: it stands as one of these signs until the text is taken.
PROTECTED = {" ": "\ue000", "\t": "\ue001", "\n": "\ue002", "\r": "\ue003"}
_BACK = {ord(v): k for k, v in PROTECTED.items()}


class Trie:
    """Tokens by their signs; the longest one that stands at a place is found in as many steps as it has signs."""

    def __init__(self, tokens: Iterable[str] = ()):
        self.root: dict = {}
        for t in tokens:
            self.add(t)

    def add(self, token: str, value=True) -> bool:
        """False if the token is empty or known."""
        if not token or token in self:
            return False
        node = self.root
        for sign in token:
            node = node.setdefault(sign, {})
        node[None] = value
        return True

    def remove(self, token: str) -> bool:
        """Takes a token out, with the branches that only it needed."""
        path, node = [], self.root
        for sign in token:
            if sign not in node:
                return False
            path.append((node, sign))
            node = node[sign]
        if None not in node:
            return False
        del node[None]
        for parent, sign in reversed(path):
            if parent[sign]:
                break
            del parent[sign]
        return True

    def __contains__(self, token: str) -> bool:
        return self.get(token) is not None

    def get(self, token: str):
        node = self.root
        for sign in token:
            node = node.get(sign)
            if node is None:
                return None
        return node.get(None)

    def longest(self, text: str, at: int = 0) -> str:
        """The longest token that stands at a place, "" if none does."""
        node, end = self.root, at
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            if None in node:
                end = k + 1
        return text[at:end]


class Registry:
    """Ids of tokens in use: counted, so that a token stays while anyone needs it; ids of lost tokens are used again."""

    def __init__(self):
        self.trie, self.uses, self.free, self.next = Trie(), {}, [], 0

    def register(self, token: str) -> int | None:
        if not token:
            return None
        known = self.trie.get(token)
        if known is None:
            known = self.free.pop() if self.free else self.next
            self.next = max(self.next, known + 1)
            self.trie.add(token, known)
        self.uses[token] = self.uses.get(token, 0) + 1
        return known

    def unregister(self, token: str) -> bool:
        """True if the token was in use."""
        if token not in self.uses:
            return False
        self.uses[token] -= 1
        if not self.uses[token]:
            del self.uses[token]
            self.free.append(self.trie.get(token))
            self.trie.remove(token)
        return True


@dataclass(frozen=True)
class Mark:
    start: int
    token: str
    special: bool = False

    @property
    def order(self):
        """By place; there special tokens first, then longer ones."""
        return self.start, not self.special, -len(self.token)


def marks(text: str, trie: Trie, guard: Iterable[int] = ()) -> list[Mark]:
    """Every place where a token stands (its longest), in order; guarded places hold text only."""
    guard = set(guard)
    return sorted((Mark(k, t) for k in range(len(text)) if k not in guard and (t := trie.longest(text, k))), key=lambda m: m.order)


def protect(text: str, places: Iterable[int]) -> str:
    """White space at these places is text from here on."""
    wanted = [k for k in places if k < len(text) and text[k] in PROTECTED]
    if not wanted:
        return text
    signs = list(text)
    for k in wanted:
        signs[k] = PROTECTED[signs[k]]
    return "".join(signs)


def take(text: str, mode: str = "collapse") -> str:
    """Text as a field of this white-space mode takes it: preserve, trim, or collapse; protected white space stays."""
    if mode == "trim":
        text = text.strip(BLANKS)
    elif mode != "preserve":
        text = " ".join(text.translate(str.maketrans("\t\r\n", "   ")).split(" "))
        text = " ".join(x for x in text.split(" ") if x)
    return text.translate(_BACK)


def first_word(text: str) -> tuple[str, str]:
    """Text up to the first white space after a word, and the rest."""
    begin = len(text) - len(text.lstrip(BLANKS))
    end = next((k for k in range(begin, len(text)) if text[k] in BLANKS), len(text))
    return text[:end], text[end:]

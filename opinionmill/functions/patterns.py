"""Character classes shared by the text functions, written for Java regex.

``WORD``, ``SPACE`` and ``DIGIT`` are the Unicode meanings of word character,
white space and decimal digit that the cleaning rules are defined with.  Java's
own ``\\w`` and ``\\s`` differ (ASCII only, or with marks added under ``(?U)``).
"""

from __future__ import annotations

from collections.abc import Iterable

WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"

WORD = f"[{WORD_CHARS}]"
SPACE = f"[{SPACE_CHARS}]"
DIGIT = r"\p{Nd}"

_REGEX_SPECIAL = set(r"\.^$|?*+()[]{}-#&~")


def quote(text: str) -> str:
    """Escape ``text`` so that it is matched literally."""
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in text)


def prefix_tree(words: Iterable[str]) -> str:
    """A regex matching any of ``words``, longest first, as a prefix tree.

    A flat alternation is tried branch by branch at every position; the tree
    needs one comparison per shared first character.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [quote(ch) + render(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if "" in node else body

    return render(tree)

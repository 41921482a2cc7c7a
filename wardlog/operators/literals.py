"""Find all literals of a set inside a text column with one regular-expression pass.

``contains`` once per literal costs (literals x text length) per row. Here the literals of a
column become one prefix tree written as a regular expression inside a zero-width look-ahead,
so a single ``regexp_extract_all`` returns, for every start position, the longest literal that
begins there. A shorter literal that begins at the same place is a prefix of the longer one, so
membership of any literal can still be decided exactly from the returned array.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.functions.text import text_array

# Characters from common to rare in request paths and queries (a tuning guess; results do not
# depend on it). Whatever is not listed counts as rarest.
COMMON_TO_RARE = "eaitsnorcldmpuhg0123456789/fby=.&w-vkx_jqz:,+"

# Patterns are cut into several passes beyond this many characters.
MAX_PATTERN_CHARS = 30_000
# Alternatives of one tree node are grouped under look-ahead classes beyond this many.
FANOUT = 6


def _escape(char: str) -> str:
    if char.isascii() and not char.isalnum():
        return f"\\x{ord(char):02x}"
    return char


def _char_class(chars: Iterable[str]) -> str:
    return "[" + "".join(_escape(c) for c in chars) + "]"


def _node_pattern(node: dict) -> str:
    branches = sorted((c, _escape(c) + _node_pattern(n)) for c, n in node.items() if c)
    if not branches:
        return ""
    body = _choice(branches)
    return f"(?:{body})?" if "" in node else body


def _choice(branches: list[tuple[str, str]]) -> str:
    """One alternation; wide ones are split under look-ahead classes so few are tried."""
    if len(branches) == 1:
        return branches[0][1]
    if len(branches) <= FANOUT:
        return "(?:" + "|".join(p for _, p in branches) + ")"
    size = -(-len(branches) // FANOUT)
    groups = [branches[i:i + size] for i in range(0, len(branches), size)]
    return "(?:" + "|".join(
        f"(?={_char_class(c for c, _ in group)}){_choice(group)}" for group in groups) + ")"


def tree_pattern(literals: Iterable[str]) -> str:
    """Regular expression that captures the longest literal starting at each position."""
    literals = list(literals)
    root: dict = {}
    for literal in literals:
        node = root
        for char in literal:
            node = node.setdefault(char, {})
        node[""] = {}
    first = _char_class(sorted(c for c in root if c))
    return f"(?={first})(?=({_node_pattern(root)}))"


def _tail_pattern(node: dict) -> str:
    """Walk the characters after the anchor; at an end, look back over the whole literal."""
    ends = [f"(?<={''.join(map(_escape, literal))})" for literal in node.get("", ())]
    branches = sorted((c, _escape(c) + _tail_pattern(n)) for c, n in node.items() if c)
    choices = ends + ([_choice(branches)] if branches else [])
    return choices[0] if len(choices) == 1 else "(?:" + "|".join(choices) + ")"


def gate_pattern(literals: Iterable[str]) -> str:
    """Regular expression that is found exactly in texts holding at least one literal.

    Every literal is anchored at its rarest character, so at most text positions a single
    character-class test fails and nothing else is tried.
    """
    root: dict = {}
    for literal in literals:
        at = max(range(len(literal)),
                 key=lambda i: (COMMON_TO_RARE.find(literal[i]) % (len(COMMON_TO_RARE) + 1), -i))
        node = root
        for char in literal[at:]:
            node = node.setdefault(char, {})
        node.setdefault("", []).append(literal)
    return f"(?={_char_class(sorted(root))}){_tail_pattern(root)}"


def _passes(literals: list[str]) -> list[list[str]]:
    chunks: list[list[str]] = [[]]
    used = 0
    for literal in sorted(literals):
        cost = 6 * len(literal)
        if chunks[-1] and used + cost > MAX_PATTERN_CHARS:
            chunks.append([])
            used = 0
        chunks[-1].append(literal)
        used += cost
    return chunks


def literal_hits(text: Column, literals: Iterable[str]) -> Column:
    """Array of the literals found in ``text`` (longest per position); empty when none is.

    Most rows of a log hold no literal at all: a cheap gate decides that, and the full search
    runs only behind it.
    """
    found = [F.when(text.rlike(gate_pattern(chunk)),
                    F.regexp_extract_all(text, F.lit(tree_pattern(chunk)), F.lit(1)))
             .otherwise(F.array().cast("array<string>"))
             for chunk in _passes(sorted(set(literals)))]
    return found[0] if len(found) == 1 else F.concat(*found)


def any_hit(hits: Column, wanted: Iterable[str], searched: Iterable[str]) -> Column:
    """True when a wanted literal is among the hits."""
    wanted = tuple(wanted)
    proof = sorted({s for s in searched if s.startswith(wanted)})
    return F.arrays_overlap(hits, text_array(proof))

"""An index of rule patterns by the literals that a match must hold.

Of several hundred patterns a text usually meets a handful.  ``required`` reads from a pattern a set of short literals,
one of which is in every match.  The literals of all patterns are one trie, written as one regular expression: at each place of
a text it finds the longest literal that begins there, and with it every shorter one, which is its beginning.  A pattern is
tried only on texts that hold one of its literals, and one of each further set that its parts call for; a pattern without any is
tried on all.  The index changes no result, as a text without them has no match.

The expression runs once over a text, whatever the number of patterns, and needs no Python and no shuffle.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from re import _constants as K  # the parsed form of the standard library's patterns
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals have so many characters at least; of longer ones the first so many count.
SHORTEST, LONGEST = 3, 24


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    """The set whose shortest literal is longest, then the one with fewest literals."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s), sorted(s))) if sets else None


def _of_sequence(items) -> frozenset[str] | None:
    return _best(_sets(items))


def _sets(items) -> list[frozenset[str]]:
    """What the parts of a sequence call for, each for itself."""
    sets, run = [], ""
    for op, value in items:
        if op is K.LITERAL and 32 <= value < 127:
            run += chr(value).lower()
            continue
        if op is K.AT:  # has no width: what stands around it stays together
            continue
        sets.append(frozenset([run]))
        run = ""
        if op is K.SUBPATTERN:
            sets.append(_of_sequence(value[3]) or frozenset())
        elif op is K.ATOMIC_GROUP:
            sets.append(_of_sequence(value) or frozenset())
        elif op is K.BRANCH:
            each = [_of_sequence(b) for b in value[1]]
            sets.append(frozenset().union(*each) if all(each) else frozenset())
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] >= 1:
            sets.append(_of_sequence(value[2]) or frozenset())
    sets.append(frozenset([run]))
    return [s for s in sets if s and min(map(len, s)) >= SHORTEST]


def required(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case literals, the best first: every match's lower-case form holds one literal of each set."""
    try:
        sets = _sets(_parser.parse(pattern))
    except (re.error, OverflowError, ValueError):  # a form that only the other engine knows
        return []
    best = _best(sets)
    rest = [s for s in dict.fromkeys(sets) if s != best]
    return [frozenset(x[:LONGEST] for x in s) for s in ([best, *rest] if best else [])]


def trie_pattern(literals: list[str]) -> str:
    """A pattern of the longest of the literals at a place."""
    tree: dict = {}
    for literal in literals:
        at = tree
        for c in literal:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(node: dict) -> str:
        branches = []
        for c in sorted(k for k in node if k):
            branches.append((c if c.isalnum() else f"\\x{ord(c):02x}") + written(node[c]))
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if "" in node else body

    return written(tree)


@dataclass
class Index:
    """literal -> places of the patterns that need it, for each kind of text; and those that need none."""

    kinds: dict[str, dict[str, list[int]]]
    always: list[int]
    further: list[list[list[str]]]

    @classmethod
    def of(cls, patterns: list[tuple[str, frozenset[str]]], needs: list[list[frozenset[str]]] | None = None) -> Index:
        """patterns: (pattern, kinds of text that it is tried on); ``needs``: their sets of literals, where known."""
        kinds: dict[str, dict[str, list[int]]] = {}
        always, further = [], []
        for place, (pattern, of) in enumerate(patterns):
            sets = required(pattern) if needs is None else needs[place]
            further.append([sorted(s) for s in sets[1:]] if of else [])
            if not sets or not of:
                always.append(place)
                continue
            for kind in of:
                for literal in sets[0]:
                    kinds.setdefault(kind, {}).setdefault(literal, []).append(place)
        return cls(kinds, always, further)

    def candidates(self, texts: dict[str, Column]) -> Column:
        """Sorted places of the patterns that may match, given the text of each kind."""
        lower = F.lower(F.concat_ws("\n", *[texts[k] for k in self.kinds]))
        more = F.array(*[F.array(*[F.array(*map(F.lit, s)) for s in sets]) if sets else F.expr("cast(array() as array<array<string>>)") for sets in self.further])
        found = [F.array(*map(F.lit, self.always)).cast("array<int>")]
        for kind, places in self.kinds.items():
            literals = sorted(places)
            # What begins at a place with a literal begins with its beginnings, too.
            met = {a: sorted({p for b in literals if a.startswith(b) for p in places[b]}) for a in literals}
            table = F.create_map(*[x for a in literals for x in (F.lit(a), F.array(*map(F.lit, met[a])))])
            hits = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(texts[kind], F.lit(""))), F.lit(f"(?=({trie_pattern(literals)}))"), F.lit(1)))
            found.append(F.flatten(F.transform(hits, functools.partial(F.element_at, table))))
        places = F.array_sort(F.array_distinct(F.concat(*found)))
        if not any(self.further):
            return places
        holds = lambda text, i: F.forall(F.get(more, i), lambda s: F.exists(s, lambda x: F.contains(text, x)))
        # The lower-case text is made once a row.
        return F.transform(F.array(lower), lambda text: F.filter(places, lambda i: holds(text, i)))[0]

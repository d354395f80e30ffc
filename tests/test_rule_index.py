"""The index of rule literals changes no result."""

import random
import re

import pytest

from hirelake.operators import rules
from hirelake.operators.rule_index import Index, required, trie_pattern


@pytest.mark.parametrize(
    ("pattern", "sets"),
    [
        ("(?i)\\bSQL\\b", [{"sql"}]),
        ("(?i)warehouse|nurse", [{"warehouse", "nurse"}]),
        ("soft(?:ware)? engineer", [{" engineer"}, {"soft"}]),
        ("travel up to [0-9]+%", [{"travel up to "}]),
        ("(?:fully |100% )?remote", [{"remote"}]),
        ("(?:ab|cd)+efg", [{"efg"}]),
        ("(?:abc|def)+", [{"abc", "def"}]),
        ("[a-z]+", []),
        ("a|bcd", []),
        ("école des mines", [{"cole des mines"}]),
        ("(unbalanced", []),
    ],
)
def test_required(pattern, sets):
    assert [set(s) for s in required(pattern)] == sets


@pytest.mark.parametrize("seed", range(200))
def test_matches_hold_what_is_required(seed):
    rng = random.Random(seed)

    def made(depth):
        kind = rng.randrange(8 if depth else 3)
        if kind < 3:
            return "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 4)))
        if kind == 3:
            return f"(?:{made(depth - 1)}|{made(depth - 1)})"
        if kind == 4:
            return f"(?:{made(depth - 1)}){rng.choice(['?', '*', '+', '{2}'])}"
        if kind == 5:
            return rng.choice(["[ab]", "\\b", "[^a]?", "\\s*"])
        return made(depth - 1) + made(depth - 1)

    pattern = ("(?i)" if seed % 2 else "") + made(4)
    need = required(pattern)
    for _ in range(300):
        text = "".join(rng.choice("abcdABCD ") for _ in range(rng.randint(0, 30)))
        if re.search(pattern, text):
            assert all(any(x in text.lower() for x in s) for s in need), (pattern, text)


def test_trie_finds_the_longest():
    words = ["soft", "software", "so-so", "ware", "c++ dev"]
    found = [m[1] for m in re.finditer(f"(?=({trie_pattern(words)}))", "software so-so softer c++ dev")]
    assert found == ["software", "ware", "so-so", "soft", "c++ dev"]


TABLE = [
    ("a", "c1", "positive", "", "posting", "(?i)clearance"),
    ("b", "c1", "exclusion", "", "title", "(?i)nurse|cook"),
    ("c", "c2", "context", "g", "posting", "[0-9]{3}"),
    ("d", "c2", "context", "g", "corpus", "(?i)sql (?:server|lite)"),
    ("e", "c3", "title", "", "title", "(?i)\\bcook\\b"),
    ("f", "c4", "positive", "", "fact:place", "remote"),
    ("g", "c5", "positive", "", "corpus", "^$|x{2,}y"),
    ("h", "c6", "positive", "", "posting", "(?i)top secret clear[a-z]+"),
]
ROWS = [
    (1, "Cook", "No clearance here. Clearance is needed, SQL Lite 123", "remote"),
    (2, "Clerk", "no clearance. SQL server", "on site"),
    (3, "", "", None),
    (4, None, None, "remote"),
    (5, "sql server", "123 Top Secret clearance", ""),
    (5, "sql server", "123 Top Secret clearance", ""),
    (6, "Nurse", "Not a top secret clearance; xxy", "remote work"),
]


def test_index_changes_no_result(spark):
    rows = spark.createDataFrame(ROWS, "posting_no long, title string, body string, place string")
    for table in (TABLE, TABLE[:1], TABLE[5:6]):
        one, two = (sorted(map(tuple, rules.match_rules(rows, table, facts=["place"], indexed=x).collect()), key=repr) for x in (False, True))
        assert one == two and (len(one) > 4 or table is not TABLE)
    assert rules.match_rules(rows.where("1 = 0"), TABLE, facts=["place"], indexed=True).count() == 0


def test_candidates_are_few():
    index = Index.of([(f"(?i)\\bword{k}x\\b", frozenset(["posting"])) for k in range(300)])
    assert not index.always and len(index.kinds["posting"]) == 300


def test_credentials(spark):
    catalog = [("cpp", "skill", "C++", None), ("cissp", "security", "CISSP", None), ("sec", "security", "Security+", "(?i)security ?(?:\\+|plus)"), ("go", "skill", "Go", None)]
    rows = spark.createDataFrame([(1, "C++ and Security Plus, CISSPs"), (2, "cissp/go"), (3, ""), (4, None), (5, "ago XC++ security+ (CISSP)")], "posting_no long, body string")
    got = sorted(map(tuple, rules.credential_mentions(rows, catalog).collect()))
    assert got == [(1, "security", "sec", 1), (1, "skill", "cpp", 1), (2, "security", "cissp", 1), (2, "skill", "go", 1), (5, "security", "cissp,sec", 2)]

"""Rule classification: concepts, triage graphs, families, rule life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import once
from hirelake.operators.rule_index import LONGEST, SHORTEST, Index, required

#: A match is negated by one of these within so many characters before it.
NEGATION, LOOK_BACK = "(?i)\\b(?:no|not|without|never|neither|nor|isn't|aren't|don't|doesn't)\\b[^.;]*$", 60
EVIDENCE_CHARS, MOST_TITLE, MOST_BODY = 300, 10_000, 1_000_000


#: Rule tables from so many rows are looked up by the literals of their patterns.
INDEXED = 40


def first_not_negated(text: Column, pattern: str | Column) -> Column:
    """The first match that no negation precedes closely; null if there is none.

    Splitting by the pattern gives what stands before each match, back to the one before.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0)).alias("hit"))
    free = F.filter(zipped, lambda p: p["hit"].isNotNull() & ~F.rtrim(F.right(p["before"], F.lit(LOOK_BACK))).rlike(NEGATION))
    return F.try_element_at(free, F.lit(1))["hit"]


def match_rules(postings: DataFrame, rules: list[tuple], id_col: str = "posting_no", facts: list[str] | None = None, indexed: bool | None = None) -> DataFrame:
    """(id, concept_id, rule_id, evidence) of accepted evidence: the rows of ``matched_rules``."""
    return matched_rules(postings, rules, facts, indexed).select(id_col, F.explode("matched").alias("r")).select(id_col, "r.*")


def matched_rules(postings: DataFrame, rules: list[tuple], facts: list[str] | None = None, indexed: bool | None = None) -> DataFrame:
    """The postings with ``matched``, an array of accepted evidence (concept_id, rule_id, evidence).

    postings: id, title, body; rules: (rule id, concept, kind, context group, scope, pattern).
    Nothing is shuffled: a small rule table is compiled into constant patterns of one projection; of a large one
    (``indexed``, by default from ``INDEXED`` rules) a posting tries the rules that ``rule_index`` names for it.
    An exclusion vetoes its concept; a context group counts when all of its members match;
    positive evidence must not be negated.  A rule of scope ``fact:name`` selects by an extracted fact, a column named in
    ``facts``: its pattern is matched with the fact's text, which is the evidence.
    """
    corpus = F.concat_ws("\n", "title", "body")
    text = {"title": F.col("title"), "posting": F.col("body"), "corpus": corpus} | {f"fact:{f}": F.col(f).cast("string") for f in facts or ()}
    size: dict[tuple, int] = {}
    for _, concept, kind, group, _, _ in rules:
        if kind == "context":
            size[concept, group] = size.get((concept, group), 0) + 1
    large = len(rules) >= INDEXED if indexed is None else indexed
    found = (_looked_up if large else _projected)(rules, text, size)
    hits = once(postings, all=found)
    vetoed = lambda r: F.exists("all", lambda x: (x["concept_id"] == r["concept_id"]) & (x["kind"] == "exclusion"))
    group = lambda r: F.size(F.filter("all", lambda x: (x["kind"] == "context") & (x["concept_id"] == r["concept_id"]) & (x["grp"] == r["grp"])))
    kept = F.filter("all", lambda r: ~vetoed(r) & ((r["kind"] != "context") | (group(r) == r["members"])))
    row = lambda r: F.struct(r["concept_id"].alias("concept_id"), r["rule_id"].alias("rule_id"), F.trim(F.regexp_replace(r["evidence"], "\\s+", " ")).alias("evidence"))
    return once(hits, matched=F.transform(kept, row)).drop("all")


def _projected(rules: list[tuple], text: dict[str, Column], size: dict[tuple, int]) -> Column:
    """Each rule's hit as one column with a constant pattern."""
    found = []
    for rule_id, concept, kind, group, scope, pattern in rules:
        t = text[scope]
        hit = first_not_negated(t, pattern) if kind == "positive" and not scope.startswith("fact:") else F.regexp_extract(t, pattern, 0)
        row = F.struct(F.lit(concept).alias("concept_id"), F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("kind"), F.lit(group).alias("grp"), F.lit(size.get((concept, group), 0)).alias("members"), hit.alias("evidence"))
        found.append(F.when(t.rlike(pattern), row))
    return F.filter(F.array(*found), lambda r: r.isNotNull() & r["evidence"].isNotNull())


#: Which texts a scope's matches lie in; a literal never spans the line break between title and body.
_PARTS = {"title": frozenset(["title"]), "posting": frozenset(["posting"]), "corpus": frozenset(["title", "posting"])}


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _looked_up(rules: list[tuple], text: dict[str, Column], size: dict[tuple, int]) -> Column:
    """The hits of the rules whose literals the posting holds; the rule table is a few constant arrays, each used once."""
    index = Index.of([(r[5], _PARTS.get(r[4], frozenset())) for r in rules])
    used = sorted({r[4] for r in rules})
    patterns = F.array(*[F.lit(r[5]) for r in rules])
    scopes = F.array(*[F.lit(used.index(r[4]) * 2 + (r[2] == "positive" and not r[4].startswith("fact:"))) for r in rules])
    table = F.array(*[F.lit("\x01".join((r[1], r[0], r[2], r[3], str(size.get((r[1], r[3]), 0))))) for r in rules])

    def tried(i: Column, all_texts: Column) -> Column:
        def at(x: Column) -> Column:
            t = F.get(all_texts, F.floor(x["scope"] / 2).cast("int"))
            first = lambda first: F.when((x["scope"] % 2 == 1) & first.isNotNull(), first_not_negated(t, x["pattern"])).otherwise(first)
            return _let(F.get(F.regexp_extract_all(t, x["pattern"], F.lit(0)), 0), first)

        return F.struct(i.alias("rule"), _let(F.struct(F.get(scopes, i).alias("scope"), F.get(patterns, i).alias("pattern")), at).alias("evidence"))

    hits = _let(F.array(*[text[s] for s in used]), lambda all_texts: F.transform(index.candidates({k: text[k] for k in index.kinds}), lambda i: tried(i, all_texts)))
    row = lambda x: _let(F.split(F.get(table, x["rule"]), "\x01"), lambda c: F.struct(F.get(c, 0).alias("concept_id"), F.get(c, 1).alias("rule_id"), F.get(c, 2).alias("kind"), F.get(c, 3).alias("grp"), F.get(c, 4).cast("int").alias("members"), x["evidence"].alias("evidence")))
    return F.transform(F.filter(hits, lambda x: x["evidence"].isNotNull()), row)


def credential_mentions(rows: DataFrame, catalog: list[tuple], id_col: str = "posting_no", text_col: str = "body") -> DataFrame:
    """(id, grp, credentials, mentions) of a catalog (credential, group, alias, own pattern or None).

    An alias is matched as it stands, in any case, between signs that are neither letters nor digits; an own pattern takes its
    place.  Credentials of one group are one row, with the number of aliases that were found.  The catalog is looked up by the literals of
    its patterns.
    """
    quoted = lambda a: "(?i)(?<![\\p{L}\\p{N}])" + "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in a) + "(?![\\p{L}\\p{N}])"
    entries = [(c, g, own or quoted(a), required(own) if own else [frozenset([a.lower()[:LONGEST]])]) for c, g, a, own in catalog]
    index = Index.of([(p, frozenset(["text"])) for _, _, p, _ in entries], [[s for s in need if all(len(x) >= SHORTEST and x.isascii() for x in s)] for _, _, _, need in entries])
    table = F.array(*[F.struct(F.lit(c).alias("credential"), F.lit(g).alias("grp"), F.lit(p).alias("pattern")) for c, g, p, _ in entries])
    text = F.coalesce(F.col(text_col), F.lit(""))
    met = F.filter(F.transform(index.candidates({"text": text}), lambda i: F.get(table, i)), lambda r: F.regexp_like(text, r["pattern"]))
    each = rows.select(id_col, F.explode(met).alias("r")).select(id_col, "r.grp", "r.credential")
    return each.groupBy(id_col, "grp").agg(F.array_join(F.array_sort(F.collect_set("credential")), ",").alias("credentials"), F.count("*").alias("mentions"))


def merge_evidence(matches: DataFrame, id_col: str = "posting_no") -> DataFrame:
    """Per posting and concept the rule ids and distinct evidence in rule order, cut at the limit."""
    per = matches.groupBy(id_col, "concept_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "evidence"))).alias("r"))
    texts = F.aggregate("r", F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x["evidence"])), acc).otherwise(F.concat(acc, F.array(x["evidence"]))))
    joined = F.array_join(texts, "; ")
    cut = F.when(F.length(joined) > EVIDENCE_CHARS, F.concat(F.substring(joined, 1, EVIDENCE_CHARS - 3), F.lit("..."))).otherwise(joined)
    return per.select(id_col, "concept_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["rule_id"])), ",").alias("rule_ids"), cut.alias("evidence"))


def dense_predictions(postings: DataFrame, concepts: DataFrame, matches: DataFrame, id_col: str = "posting_no") -> DataFrame:
    """Every posting with every concept; postings' own matches are folded into one set first."""
    own = matches.groupBy(id_col).agg(F.collect_set("concept_id").alias("found"))
    rows = postings.select(id_col).join(own, id_col, "left")
    each = F.array([F.lit(r.concept_id) for r in concepts.select("concept_id").orderBy("concept_id").collect()])  # the taxonomy is a parameter
    return rows.select(id_col, F.explode(each).alias("concept_id"), F.coalesce("found", F.expr("cast(array() as array<string>)")).alias("found")).select(id_col, "concept_id", F.array_contains("found", F.col("concept_id")).alias("matched"))


def pattern_column(p: dict, title: Column, body: Column) -> Column:
    """A predicate {"scope", "pattern"} and maybe "ignore": some match that isn't ignored."""
    text = {"title": title, "titlePrefix": F.split(title, " - ", 2)[0], "body": body}[p["scope"]]
    if "ignore" in p:
        return F.exists(F.regexp_extract_all(text, F.lit(p["pattern"]), F.lit(0)), lambda m: ~m.rlike(p["ignore"]))
    return text.rlike(p["pattern"])


def resolve(predicates: dict[str, dict], made: dict[str, Column], name: str) -> Column:
    """A predicate {"all", "any", "none"} over others; ``made`` holds those known so far."""
    if name not in made:
        p = predicates[name]
        c = F.lit(True)
        for x in p.get("all", ()):
            c = c & resolve(predicates, made, x)
        if p.get("any"):
            c = c & F.array_contains(F.array(*[resolve(predicates, made, x) for x in p["any"]]), True)
        for x in p.get("none", ()):
            c = c & ~resolve(predicates, made, x)
        made[name] = c
    return made[name]


def triage_decide(rows: DataFrame, predicates: dict[str, dict], rules: list[tuple[str, str, str]], title: str = "title", body: str = "body") -> DataFrame:
    """decision and rule_ids: the first KEEP guard in order wins, else all matching REJECT rules,
    else KEEP; oversized inputs are kept. Each pattern is one column, evaluated once."""
    names = [n for n, p in predicates.items() if "pattern" in p]
    flags = rows.withColumns({f"p_{n}": pattern_column(predicates[n], F.col(title), F.col(body)) for n in names})
    made = {n: F.col(f"`p_{n}`") for n in names}
    get = lambda name: resolve(predicates, made, name)
    big = (F.length(title) > MOST_TITLE) | (F.length(body) > MOST_BODY)
    guard = F.coalesce(*[F.when(get(when), rid) for rid, decision, when in rules if decision == "KEEP"], F.lit(None).cast("string"))
    rejects = F.array_compact(F.array(*[F.when(get(when), rid) for rid, decision, when in rules if decision == "REJECT"]))
    decided = flags.withColumns({"__guard": guard, "__rejects": rejects})
    keep = big | F.col("__guard").isNotNull() | (F.size("__rejects") == 0)
    ids = F.when(big, "input-limit").when(F.col("__guard").isNotNull(), F.col("__guard")).when(F.size("__rejects") == 0, "default-keep").otherwise(F.array_join("__rejects", ","))
    return decided.select(*rows.columns, F.when(keep, "KEEP").otherwise("REJECT").alias("decision"), ids.alias("rule_ids"))


def buckets(text: Column, table: dict[str, str], most: int = 5) -> Column:
    """name:distinct matches of each bucket that has any, joined by |."""
    parts = []
    for name, pattern in table.items():
        hits = F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))), 1, most)
        parts.append(F.when(F.size(hits) > 0, F.concat(F.lit(f"{name}:"), F.array_join(hits, ","))))
    return F.array_join(F.array_compact(F.array(*parts)), "|")


def reconciled(stored: DataFrame, postings: DataFrame, rules: list[tuple], version: str, id_col: str = "posting_no") -> DataFrame:
    """stored: id, version, concepts (sorted). Rows of another version are classified again from their postings (id, title,
    body), the others pass: id, version, concepts, recomputed, repaired (whether the set changed)."""
    old = stored.where(~F.col("version").eqNullSafe(version))
    found = match_rules(postings.join(old.select(id_col), id_col, "left_semi"), rules, id_col).groupBy(id_col).agg(F.array_sort(F.collect_set("concept_id")).alias("now"))
    again = old.join(found, id_col, "left").withColumn("now", F.coalesce("now", F.expr("cast(array() as array<string>)")))
    again = again.select(id_col, F.lit(version).alias("version"), F.col("now").alias("concepts"), F.lit(True).alias("recomputed"), (F.col("now") != F.col("concepts")).alias("repaired"))
    rest = stored.where(F.col("version").eqNullSafe(version)).select(id_col, "version", "concepts", F.lit(False).alias("recomputed"), F.lit(False).alias("repaired"))
    return again.unionByName(rest)


def family_decision(title: Column, body: Column, families: dict[str, tuple[str, str]], variant: dict) -> Column:
    """The families of a variant that reject, joined by commas; empty keeps.

    families: name to (title pattern, body pattern). variant: families (names), body (a family needs its body pattern),
    veto (a pattern of technical duties in the body), noise (a pattern of matches that are none), protect (a title
    pattern that keeps).
    """
    rows = []
    for name in variant["families"]:
        in_title, in_body = families[name]
        hit = title.rlike(in_title) & (body.rlike(in_body) if variant.get("body") else F.lit(True))
        rows.append(F.when(hit, name))
    keep = title.rlike(variant["protect"]) if variant.get("protect") else F.lit(False)
    if variant.get("veto"):
        duties = F.regexp_extract_all(body, F.lit(variant["veto"]), F.lit(0))
        keep = keep | (F.exists(duties, lambda m: ~m.rlike(variant["noise"])) if variant.get("noise") else F.size(duties) > 0)
    return F.when(keep, "").otherwise(F.array_join(F.array_compact(F.array(*rows)), ","))


def triage_status(observations: DataFrame, ruleset: str, by: list[str]) -> DataFrame:
    """observations: decision, has_body, ruleset, at, and the columns ``by``. Counts overall and per slice of each column."""
    each = F.array(F.struct(F.lit("all").alias("slice"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in by])
    d = lambda x: F.col("decision") == x
    g = observations.select("decision", "has_body", "ruleset", "at", F.inline(each)).groupBy("slice", "value")
    n = g.agg(
        F.count("*").alias("n"), F.count_if(d("KEEP")).alias("keep"), F.count_if(d("REJECT")).alias("reject"), F.count_if(d("UNDETERMINED")).alias("undetermined"), F.count_if(~F.col("has_body") & ~d("UNDETERMINED")).alias("title_only"),
        F.count_if("has_body").alias("described"), F.count_if(F.col("ruleset") != ruleset).alias("stale"), F.max("at").alias("latest"),
    )
    decided = F.col("keep") + F.col("reject")
    return n.withColumn("reject_percent", F.round(F.when(decided > 0, 100.0 * F.col("reject") / decided), 6))


def rule_lifecycle(rules: DataFrame, usage: DataFrame, now, review_days: int = 30, delete_days: int = 180) -> DataFrame:
    """rules: rule_id, state, since (date); usage: rule_id, matches, last_match. A rule that was neither changed nor matched
    for ``review_days`` is due for review; one retired for ``delete_days`` is deleted."""
    j = rules.join(usage, "rule_id", "left")
    idle = F.datediff(F.lit(now).cast("date"), F.greatest("since", F.to_date("last_match")))
    age = F.datediff(F.lit(now).cast("date"), "since")
    state = F.when((F.col("state") == "active") & (idle >= review_days), "review-due").when((F.col("state") == "retired") & (age >= delete_days), "deleted").otherwise(F.col("state"))
    return j.select("rule_id", F.coalesce("matches", F.lit(0)).alias("matches"), state.alias("state"))

"""Queries that read extracted facts: fits to profiles, discovery, headroom, compact lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.operators import facts
from hirelake.operators import fit as FIT
from hirelake.operators import rules as R
from hirelake.operators import search as S

from .fixtures import PROFILES_SQL, RULES, postings, profiles
from .q_extract import AUTHORIZED, AWAY_SQL, CLEARED, DEGREED, PAY, REMOTE_SQL, authorizations, clearances, degree_facts, salaries, sentences_of, texts
from .q_rules import MATCHES
from .q_text import BODY
from .registry import query

P = f"pr AS ({PROFILES_SQL})"
_RANK = lambda x, table: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
EDU = f"""CASE WHEN education = 'notSpecified' THEN 'profileNotConfigured' WHEN minimum_level IS NULL THEN 'noneSpecified' WHEN {_RANK('education', FIT.EDUCATION)} >= {_RANK('minimum_level', FIT.EDUCATION)} THEN 'met'
  WHEN requirement = 'preferred' THEN 'preferredOnly' WHEN requirement = 'required' THEN 'requiredGap' ELSE 'statedGap' END"""
CLR = f"""CASE WHEN level IS NULL OR level IN ('noneMentioned', 'none') THEN 'none' WHEN {_RANK('level', FIT.CLEARANCE)} IS NULL THEN 'review' WHEN {_RANK('clearance', FIT.CLEARANCE)} >= {_RANK('level', FIT.CLEARANCE)} THEN 'met'
  WHEN requirement = 'preferred' THEN 'preferredOnly' WHEN requirement IN ('activeRequired', 'mustPossess') THEN 'strictGap' ELSE 'obtainable' END"""
AUT = """CASE WHEN eligibility = 'noneSpecified' AND sponsorship = 'noneSpecified' THEN 'noneSpecified' WHEN (eligibility IN ('usCitizen', 'usCitizenOrPermanentResident') AND NOT citizen AND strength = 'strict') OR (needs_sponsor AND sponsorship = 'notAvailable') THEN 'mismatch'
  WHEN eligibility IN ('usCitizen', 'usCitizenOrPermanentResident') AND NOT citizen THEN 'preferenceGap' WHEN needs_sponsor AND sponsorship = 'available' THEN 'match' WHEN needs_sponsor THEN 'unclear' ELSE 'compatible' END"""
KINDS = f"""deg AS ({DEGREED} SELECT posting_no, minimum_level, requirement FROM degrees), clr AS ({CLEARED} SELECT posting_no, level, requirement FROM cleared), aut AS ({AUTHORIZED} SELECT posting_no, eligibility, sponsorship, strength FROM authorized), {P},
ek AS (SELECT posting_no, {EDU} AS education_kind FROM pr LEFT JOIN deg USING (posting_no)), ck AS (SELECT posting_no, {CLR} AS clearance_kind FROM pr JOIN clr USING (posting_no)), ak AS (SELECT posting_no, {AUT} AS authorization_kind FROM pr JOIN aut USING (posting_no))"""


@query(f"WITH {KINDS} SELECT posting_no, education_kind AS kind, education_kind = 'requiredGap' AS hide FROM ek")
def education_fit(spark, sf):
    p = profiles(spark, sf).select("posting_no", "education").join(degree_facts(spark, sf).select("posting_no", "minimum_level", "requirement"), "posting_no", "left")
    kind = FIT.education_kind(F.col("minimum_level"), F.col("requirement"), F.col("education"))
    return p.select("posting_no", kind.alias("kind"), (kind == "requiredGap").alias("hide"))


@query(f"WITH {KINDS} SELECT posting_no, clearance_kind AS kind, clearance_kind = 'strictGap' AS hide FROM ck")
def clearance_fit(spark, sf):
    p = profiles(spark, sf).select("posting_no", "clearance").join(clearances(spark, sf).select("posting_no", "level", "requirement"), "posting_no")
    kind = FIT.clearance_kind(F.col("level"), F.col("requirement"), F.col("clearance"))
    return p.select("posting_no", kind.alias("kind"), (kind == "strictGap").alias("hide"))


@query(f"WITH {KINDS} SELECT posting_no, authorization_kind AS kind, authorization_kind = 'mismatch' AS hide FROM ak")
def authorization_fit(spark, sf):
    p = profiles(spark, sf).select("posting_no", "citizen", "needs_sponsor").join(authorizations(spark, sf).select("posting_no", "eligibility", "strength", "sponsorship"), "posting_no")
    kind = FIT.authorization_kind(*[F.col(c) for c in ("eligibility", "strength", "sponsorship", "citizen", "needs_sponsor")])
    return p.select("posting_no", kind.alias("kind"), (kind == "mismatch").alias("hide"))


_US = "(" + " OR ".join(f"regexp_matches(primary_location, '{pattern}')" for pattern, *_ in S.SHAPES) + ")"


@query(f"""{BODY}, {KINDS}, sal AS ({PAY} SELECT posting_no, period, maximum FROM salaries), rem AS ({REMOTE_SQL}), awy AS ({AWAY_SQL}), txt AS (SELECT posting_no, primary_location, lower(title || ' ' || body) AS t FROM bodies)
SELECT posting_no FROM txt JOIN pr USING (posting_no) JOIN ek USING (posting_no) JOIN ck USING (posting_no) JOIN ak USING (posting_no) JOIN sal USING (posting_no) JOIN rem USING (posting_no) JOIN awy USING (posting_no)
WHERE (contains(t, 'sql') OR contains(t, 'remote') OR contains(t, 'engineer')) AND NOT contains(t, 'relocation') AND (period <> 'annual' OR maximum IS NULL OR maximum >= desired_pay) AND (is_remote OR {_US})
  AND education_kind <> 'requiredGap' AND clearance_kind <> 'strictGap' AND authorization_kind <> 'mismatch' AND confidence <> 'strong'""")
def discovery_filter(spark, sf):
    """Keywords, place, annual pay, and strict mismatches of each posting with its reader's profile.

    What one look at the text decides comes first; sentences are cut and facts extracted for the rows that are left.
    """
    text, body = F.concat_ws(" ", "title", "body"), F.col("body")
    metadata = F.concat_ws(" ", "title", "primary_location")
    alive = texts(spark, sf).where(S.keyword_match(text, ["SQL", "remote", "engineer"], ["relocation"])).where(S.placed(metadata, F.col("primary_location"), body))
    sentences = F.col("sentences")
    away = facts.away_requirements(F.col("title"), F.col("primary_location"), body, sentences)["confidence"]
    alive = T.once(T.once(alive, sentences=sentences_of(F.col("lines"))), away_confidence=away).where("away_confidence <> 'strong'")
    found = T.once(alive, pay=facts.salary(body, F.col("lines")), clr=facts.clearance(body), aut=facts.work_authorization(sentences), deg=facts.degree_requirements(sentences))
    found = found.select("posting_no", "away_confidence", "pay", "clr", "aut", "deg")
    j = found.join(profiles(spark, sf), "posting_no")
    kinds = {
        "education_kind": FIT.education_kind(F.col("deg.minimum_level"), F.col("deg.requirement"), F.col("education")), "clearance_kind": FIT.clearance_kind(F.col("clr.level"), F.col("clr.requirement"), F.col("clearance")),
        "authorization_kind": FIT.authorization_kind(F.col("aut.eligibility"), F.col("aut.strength"), F.col("aut.sponsorship"), F.col("citizen"), F.col("needs_sponsor")), "period": F.col("pay.period"), "maximum": F.col("pay.maximum"),
    }
    return j.withColumns(kinds).where(S.acceptable()).select("posting_no")


@query(f"WITH sal AS ({PAY} SELECT * FROM salaries), {P}, a AS (SELECT posting_no, least(greatest((desired_pay - minimum) / (maximum - minimum), 0.0), 1.0) AS place FROM sal JOIN pr USING (posting_no) WHERE period = 'annual' AND maximum > minimum) SELECT posting_no, round(place, 6) AS place, place >= 0.75 AS limited FROM a")
def salary_headroom(spark, sf):
    """Where the reader's wish lies in the annual range that a posting states."""
    j = salaries(spark, sf).where("period = 'annual' and maximum > minimum").join(profiles(spark, sf).select("posting_no", "desired_pay"), "posting_no")
    place = S.headroom(F.col("desired_pay"), F.col("minimum"), F.col("maximum"))
    return j.select("posting_no", F.round(place, 6).alias("place"), (place >= 0.75).alias("limited"))


@query(f"""{MATCHES}, sal AS ({PAY} SELECT posting_no, minimum, maximum FROM salaries), clr AS ({CLEARED} SELECT posting_no, level FROM cleared), con AS (SELECT posting_no, string_agg(DISTINCT concept_id, ',' ORDER BY concept_id) AS concepts FROM matches WHERE concept_id <> 'responsibility.team' GROUP BY 1)
SELECT p.posting_no, p.title, CASE WHEN is_available THEN length(body) END AS body_length, CASE WHEN is_available THEN minimum END AS minimum, CASE WHEN is_available THEN maximum END AS maximum, CASE WHEN is_available THEN level END AS clearance,
  CASE WHEN is_available THEN coalesce(concepts, '') END AS concepts FROM postings p JOIN bodies USING (posting_no) JOIN sal USING (posting_no) JOIN clr USING (posting_no) LEFT JOIN con ON con.posting_no = p.posting_no""".replace("SELECT p.posting_no, p.title, CASE WHEN is_available", "SELECT p.posting_no, p.title, CASE WHEN p.is_available").replace("CASE WHEN is_available", "CASE WHEN p.is_available"))
def compact_list(spark, sf):
    """Narrow rows: without a body (the posting is gone) there are no analyses; a retired concept is dropped."""
    has = lambda c: F.when(F.col("is_available"), c)
    p = postings(spark, sf).select("posting_no", "title", "is_available", "html")
    b = T.once(p, body=T.html_to_text(F.col("html")), lines=has(T.html_to_lines(F.col("html")))).drop("html")
    current = F.filter("matched", lambda r: r["concept_id"] != "responsibility.team")
    concepts = F.array_join(F.array_sort(F.array_distinct(F.transform(current, lambda r: r["concept_id"]))), ",")
    m = R.matched_rules(b, RULES).select("posting_no", "title", "is_available", "body", "lines", has(F.length("body").cast("long")).alias("body_length"), has(concepts).alias("concepts"))
    m = T.once(m, pay=has(facts.salary(F.col("body"), F.col("lines"))), clr=has(facts.clearance(F.col("body"))))
    return m.select("posting_no", "title", "body_length", F.col("pay.minimum").alias("minimum"), F.col("pay.maximum").alias("maximum"), F.col("clr.level").alias("clearance"), "concepts")

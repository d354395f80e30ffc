"""Behaviour of single operators on small tables."""

import pytest
from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.operators import clusters, extract, fit, history, identity, metrics, review, rules, search
from hirelake.sources import cache
from hirelake.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_html_forms(spark):
    assert one(spark, T.html_to_text(F.col("h")), h="<p>A &amp; B</p><p>C&nbsp;<b>D</b></p>") == "A & B C D"
    assert one(spark, T.html_to_text(F.col("h")), h=None) == ""
    assert one(spark, T.html_to_lines(F.col("h")), h="<p>A</p><ul><li>B</li><li> </li></ul>") == ["A", "B"]
    assert one(spark, T.visible_text(F.col("h")), h="<script>x()</script><p>A</p>B") == "A\nB"
    assert one(spark, T.clean_provider_html(F.col("h")), h="a<br><br/><br>b<p> </p>c") == "a<br><br>b<br>c"


def test_sentences_and_shingles(spark):
    assert one(spark, T.split_sentences(F.col("t")), t="One. Two! three? Four") == ["One.", "Two! three?", "Four"]
    assert one(spark, T.shingles(F.col("t"), 3), t="a b") == ["a b"]
    assert one(spark, T.shingles(F.col("t"), 3), t="") == []


def test_negation(spark):
    find = lambda t: one(spark, rules.first_not_negated(F.col("t"), "(?i)clearance"), t=t)
    assert find("No clearance is needed") is None
    assert find("No clearance here. Clearance is required") == "Clearance"
    assert find("nothing") is None


def test_triage_graph(spark):
    graph = {"bad": {"scope": "title", "pattern": "cook"}, "good": {"scope": "body", "pattern": "sql [0-9]+", "ignore": "sql 0"}, "both": {"all": ["bad"], "none": ["good"]}}
    rows = spark.createDataFrame([("cook", "sql 0"), ("cook", "sql 0 sql 7"), ("clerk", "")], "title string, body string")
    got = [r.decision for r in rules.triage_decide(rows, graph, [("r", "REJECT", "both")]).collect()]
    assert got == ["REJECT", "KEEP", "KEEP"]


def test_workflow_ignores_what_is_not_allowed(spark):
    e = spark.createDataFrame([(1, 1, "saved"), (1, 2, "closed"), (1, 3, "applied"), (1, 4, "closed"), (2, 1, "closed")], "job_id long, event_id long, to_state string").withColumn("at", F.timestamp_seconds("event_id"))
    got = {r.job_id: (r.state, r.ignored) for r in history.fold_workflow(e).collect()}
    assert got == {1: ("closed", 1), 2: ("normal", 1)}


def test_keywords_and_ages(spark):
    assert one(spark, search.keyword_match(F.col("t"), ["sql"], ["cook"]), t="SQL cook") is False
    assert one(spark, search.keyword_match(F.col("t"), ["sql"], []), t=None) is True
    assert one(spark, search.age_group(F.col("t").cast("int")), t="-3") == "today"


def test_location_shapes(spark):
    labels = {
        "US, MA, Boston": ("MA", "Boston"), "Dallas, TX, United States": ("TX", "Dallas"), "United States-New York-Albany": ("NY", "Albany"), "US-VA-Reston": ("VA", "Reston"),
        "US - CO, Boulder": ("CO", "Boulder"), "Denver, CO": ("CO", "Denver"), "VA - Norfolk": ("VA", "Norfolk"), "Boston, Massachusetts": None, "Remote, US": None, "XX - Nowhere": None, "": None,
    }
    d = spark.createDataFrame([(k,) for k in labels], "label string").select("label", search.us_location(F.col("label")).alias("x"))
    assert {r.label: r.x and tuple(r.x) for r in d.collect()} == labels


def test_order_of_input_does_not_matter(spark):
    rows = spark.createDataFrame([("p", 2, 1, "b"), ("p", 1, 5, "a"), ("q", 1, 1, "c"), (" ", 1, 2, "d")], "external_path string, page long, position long, title string")
    for n in (1, 3):
        assert sorted(r.title for r in identity.merge_listing_pages(rows.repartition(n)).collect()) == ["a", "c"]


def test_near_duplicates_of_empty_and_equal_texts(spark):
    words = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, words), (2, words), (3, words + " end"), (4, None), (5, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.links, r.component_id) for r in identity.near_duplicates(d, 0.8).collect())
    assert got == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 1, 1), (4, 4, 0, 4), (5, 5, 0, 5)]


def test_stretches_of_a_job_compose(spark):
    """One stretch, many stretches, and batch after batch lead to the same states."""
    import random

    rng = random.Random(3)
    rows = [(k % 3, f"2024-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", k, rng.choice(list(history.TRANSITIONS))) for k in range(400)]
    e = spark.createDataFrame(rows, "job_id long, at string, event_id long, to_state string").withColumn("at", F.col("at").cast("timestamp"))
    want = {}
    for job, at, _, to in sorted(rows, key=lambda r: (r[1], r[2])):
        now, applied, closed, ignored = want.get(job, ("normal", None, None, 0))
        if to == now:
            pass
        elif to in history.TRANSITIONS[now]:
            applied = at if to == "applied" else None if to in ("normal", "saved") else applied
            closed = at if to == "closed" else None
            now = to
        else:
            ignored += 1
        want[job] = now, applied, closed, ignored
    plain = lambda df: {r.job_id: (r.state, r.applied_at and str(r.applied_at), r.closed_at and str(r.closed_at), r.ignored) for r in df.collect()}
    assert plain(history.fold_workflow(e)) == want
    states = spark.createDataFrame([], jobs.WORKFLOW)
    for a, b in (("00", "07"), ("07", "12"), ("12", "24")):
        states = history.continued(states, e.where(F.date_format("at", "HH").between(a, f"{int(b) - 1:02d}")))
    assert plain(states) == want


def test_rank_over_many_parts(spark):
    d = spark.range(500).select("id", (F.col("id") * 7919 % 101).alias("v")).repartition(7)
    got = {r.id: r.place for r in identity.ranked(d, ["v", F.desc("id")]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(500), key=lambda k: (k * 7919 % 101, -k)) and min(got.values()) == 1


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 101)], "a long, b long")
    got = {r.node: r.cluster for r in clusters.cluster_components(e).collect()}
    assert set(got[i] for i in range(31)) == {0} and got[101] == 100


def test_zero_division_policies(spark):
    c = spark.createDataFrame([(0, 0, 0, 3)], "tp long, fp long, fn long, tn long")
    assert metrics.scored_counts(c).first().precision is None
    assert metrics.scored_counts(c, zero=True).first().precision == 0.0


def test_publish_once(spark, tmp_path):
    df = spark.range(5).withColumn("secret", F.lit("x"))
    path = f"file://{tmp_path}/out"
    assert cache.publish(df, path, ["id"]).first().n_rows == 5
    assert spark.read.parquet(path).columns == ["id"]
    with pytest.raises(Exception, match="(?i)exist"):
        cache.publish(df, path, ["id"])


def test_labelled_lines_reject_repeats(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "label": "KEEP", "text": "a"}\n{"id": 1, "label": "KEEP", "text": "b"}\n')
    with pytest.raises(ValueError):
        cache.read_labelled_jsonl(spark, f"file://{p}", ["KEEP"])


def test_integrity_reports_what_is_wrong(spark):
    lines = spark.createDataFrame([(1, 0, "A clearance is required or a degree is required; no travel.")], "posting_no long, line_no int, line string")
    o = extract.clauses(lines, "posting_no", {"clearance": "clearance", "degree": "degree", "travel": "travel"})
    rows = {r.domain: r for r in o.collect()}
    assert rows["clearance"].alternatives == [rows["degree"].observation_id] and rows["travel"].alternatives == [] and rows["travel"].polarity == "negated"
    fine = {r.domain: (r.n, r.repeated, r.bad_spans, r.dangling) for r in extract.integrity(o).collect()}
    assert set(fine.values()) == {(1, 0, 0, 0)}
    bad = o.where("domain <> 'degree'").union(o.where("domain = 'travel'")).withColumn("start", F.when(F.col("domain") == "travel", 1).otherwise(F.col("start")))
    got = {r.domain: (r.n, r.repeated, r.bad_spans, r.dangling) for r in extract.integrity(bad).collect()}
    assert got == {"clearance": (1, 0, 0, 1), "travel": (2, 1, 2, 0)}


def test_review_cases_read_tokens_once_and_skip_twins(spark):
    ten, reasons = [f"w{k}" for k in range(10)], ["rule_conflict", "rare_tokens"]
    rows = [(1, "a", ten, reasons), (2, "a", [*ten[:9], "x"], reasons), (3, "a", [*ten[:8], "x", "y"], reasons), (4, "b", [], reasons), (5, "b", ["z"], reasons), (6, "b", ["z"], ["rare_tokens"])]
    cases = spark.createDataFrame(rows, "case_id long, employer string, tokens array<string>, reasons array<string>")
    prior = spark.createDataFrame([(90, ten), (91, ten), (92, ["q"])], "case_id long, tokens array<string>")
    found = review.select_review_cases(cases, prior)
    # 1 is a reviewed one, 2 shares nine of eleven words with it, 3 eight of twelve; 6 has too low a score.
    assert [(r.case_id, r.place) for r in found.orderBy("place").collect()] == [(3, 1), (4, 2), (5, 3)]


def test_contradictions_within_a_posting(spark):
    rows = [(1, "a", "sponsorship", "stated", "notAvailable"), (1, "b", "sponsorship", "required", "available"), (1, "c", "sponsorship", "not-required", ""), (1, "d", "travel", "required", ""), (2, "e", "arrangement", "stated", "remote"), (2, "f", "sponsorship", "stated", "available"), (3, "g", "arrangement", "stated", "remote"), (None, "h", "arrangement", "stated", "remote")]
    o = spark.createDataFrame(rows, "posting_no long, observation_id string, domain string, obligation string, value string")
    declared = spark.createDataFrame([(1, "remote"), (2, "onsite"), (2, "hybrid"), (3, None), (None, "onsite")], "posting_no long, arrangement string")
    got = sorted(tuple(r) for r in extract.contradictions(o, declared, "posting_no").collect())
    assert got == [(1, "obligation", "c", "b"), (1, "opposite-sponsorship", "a", "b"), (2, "provider-arrangement", "e", "provider:hybrid"), (2, "provider-arrangement", "e", "provider:onsite")]


def test_white_space_and_breaks(spark):
    assert one(spark, T.squeeze(F.col("h")), h=" a\t b\n\nc  d e\u00a0f ") == "a b c d e\u00a0f"
    assert one(spark, T.html_to_lines(F.col("h")), h="a<BR\n/>b<br >c<p\nid='x'>d</OL>e<brx>f") == ["a", "b", "c", "d", "e f"]


def test_integrity_of_alternatives_in_other_domains(spark):
    rows = [("a", "x", 1, ["b", "gone"]), ("a", "y", 1, ["c"]), ("b", "y", 1, ["a", "gone", "gone"]), ("b", "y", 9, []), ("c", "z", None, [])]
    o = spark.createDataFrame(rows, "observation_id string, domain string, start int, alternatives array<string>").withColumns({"line": F.lit("hit"), "hit": F.lit("hit")})
    got = {r.domain: (r.n, r.repeated, r.bad_spans, r.dangling) for r in extract.integrity(o).collect()}
    assert got == {"x": (1, 0, 0, 1), "y": (3, 1, 1, 2), "z": (1, 0, 0, 0)}


def test_job_fit_within_a_pair(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    concepts = t([("a", "Technical Domain"), ("b", "Technical Domain"), ("c", "Work Arrangement"), ("d", None)], "concept_id string, dimension string")
    detected = t([(1, "a"), (1, "b"), (1, "c"), (1, "zz"), (2, "a"), (2, "a"), (2, "b"), (3, "d"), (4, "c")], "posting_no long, concept_id string")
    signals = t([(7, "a", "negative"), (7, "b", "ideal"), (7, "c", "positive"), (7, "d", "negative"), (7, "zz", "ideal"), (8, "a", "ideal"), (8, "c", "neutral")], "user_id long, concept_id string, preference string")
    readers = t([(1, 7), (1, 8), (2, 8), (3, 7), (4, 8), (4, 9)], "posting_no long, user_id long")
    over = t([(8, "b"), (8, "b")], "user_id long, concept_id string")
    found = fit.job_fit(detected, signals, concepts, t([("a", "b")], "concept_id string, superseded string"), readers, over)
    # b gives way to a, whatever a reader says of it; a reader without a wish that counts has no row.
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7, 4, 0), (1, 8, 7, 0), (2, 8, 7, 0), (3, 7, 3, 0)]
    assert sorted(tuple(r) for r in fit.job_fit(detected, signals, concepts, t([], "concept_id string, superseded string"), readers, over).collect()) == [(1, 7, 5, 0), (1, 8, 2, 1), (2, 8, 2, 1), (3, 7, 3, 0)]

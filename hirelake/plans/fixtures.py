"""Tables of postings, rules and profiles derived from the star schema in one SQL text, which
Spark and the SQL check both run, so that extraction and scoring jobs have exact answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One posting per order. Fields repeat, are blank or missing for some rows, deliberately.
POSTINGS = """
SELECT o_orderkey AS posting_no,
  lower(replace(c_mktsegment, ' ', '-')) AS company_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'R' || CAST(o_orderkey % 5000 AS VARCHAR(20)) END AS requisition_id,
  '/job/' || CAST(o_orderkey AS VARCHAR(20)) AS external_path,
  CASE o_orderkey % 9 WHEN 0 THEN 'Senior Software Engineer' WHEN 1 THEN 'Field Service Technician' WHEN 2 THEN 'Network Administrator'
    WHEN 3 THEN 'Registered Nurse' WHEN 4 THEN 'Electrical Engineer' WHEN 5 THEN 'Warehouse Associate' WHEN 6 THEN 'Data Analyst'
    WHEN 7 THEN 'Civil Engineer - Bridges' ELSE 'Remote Systems Administrator' END AS title,
  CASE o_custkey % 12 WHEN 0 THEN 'US-TX-Austin' WHEN 1 THEN 'Denver, CO' WHEN 2 THEN 'Remote, US' WHEN 3 THEN 'US, MA, Boston' WHEN 4 THEN 'US-VA-Reston' WHEN 5 THEN 'Dallas, TX, United States' WHEN 6 THEN 'United States-New York-Albany'
    WHEN 7 THEN 'US - CO, Boulder' WHEN 8 THEN 'VA - Norfolk' WHEN 9 THEN 'Boston, Massachusetts' ELSE n_name END AS primary_location,
  n_name AS country,
  '<div><h2>About us</h2><p>We hire for ' || lower(c_mktsegment) || ' in ' || n_name || '.&nbsp;Join a team of ' || CAST(2 + o_orderkey % 40 AS VARCHAR(20)) || ' people.</p><ul><li>'
  || CASE o_orderkey % 5 WHEN 0 THEN 'Pay Range: $' || CAST(50 + o_orderkey % 70 AS VARCHAR(20)) || ',000 - $' || CAST(130 + o_orderkey % 50 AS VARCHAR(20)) || ',000 annually.'
    WHEN 1 THEN 'Pay Range: $' || CAST(20 + o_orderkey % 30 AS VARCHAR(20)) || '.50 - $' || CAST(60 + o_orderkey % 20 AS VARCHAR(20)) || '.00 per hour.'
    WHEN 2 THEN 'Salary: $' || CAST(70 + o_orderkey % 60 AS VARCHAR(20)) || 'k to $' || CAST(140 + o_orderkey % 40 AS VARCHAR(20)) || 'k.' ELSE 'Pay depends on experience &amp; location.' END
  || '</li><li>' || CASE o_orderkey % 4 WHEN 0 THEN 'Travel up to ' || CAST(5 * (o_orderkey % 20) AS VARCHAR(20)) || '% of the time.' WHEN 1 THEN 'No travel is required.' ELSE 'You may work remotely two days a week.' END
  || '</li><li>' || CASE o_orderkey % 7 WHEN 0 THEN 'Active Secret clearance required.' WHEN 1 THEN 'Preferred: Top Secret clearance.' WHEN 2 THEN 'A Top Secret/SCI clearance with polygraph is required.' WHEN 3 THEN 'No clearance is needed.' ELSE 'Background check required.' END
  || '</li><li>' || CASE o_orderkey % 6 WHEN 0 THEN 'Bachelor''s degree in a technical field and ' || CAST(1 + o_orderkey % 9 AS VARCHAR(20)) || ' years of experience required.' WHEN 1 THEN 'Master''s degree preferred.' WHEN 2 THEN 'High school diploma or GED required.' WHEN 3 THEN 'Associate degree or 4 years of experience.' ELSE 'Experience counts more than a degree.' END
  || '</li><li>' || CASE o_orderkey % 8 WHEN 0 THEN 'We are unable to sponsor visas now or in the future.' WHEN 1 THEN 'Visa sponsorship is available.' WHEN 2 THEN 'U.S. citizenship is required.' ELSE 'Knowledge of SQL and Linux is useful.' END
  || '</li></ul><h3>More</h3><ul><li>' || CASE o_orderkey % 11 WHEN 0 THEN 'The salary for this role is $95,000 to $' || CAST(100 + o_orderkey % 40 AS VARCHAR(20)) || ',000 per year.' WHEN 1 THEN 'Pay: USD 88,000 - 99,000 annually.' WHEN 2 THEN 'Compensation range: $30.00 - $45.00.'
    WHEN 3 THEN 'Minimum salary: $61,000. Maximum salary: $83,000.' WHEN 4 THEN 'Pay ranges</li><li>Level one: $40,000 - $50,000 per year</li><li>Level two: $52,000 - $' || CAST(60 + o_orderkey % 30 AS VARCHAR(20)) || ',000 per year' WHEN 5 THEN 'Pay ranges</li><li>Level one: $20 - $30 per hour</li><li>Level two: $45,000 - $50,000 per year'
    WHEN 6 THEN 'Salary depends on the contract.' ELSE 'Good benefits.' END
  || '</li><li>' || CASE o_orderkey % 13 WHEN 0 THEN 'You must report to the office three days a week.' WHEN 1 THEN 'In a previous role you worked on site every day.' WHEN 2 THEN 'Travel of 30-60% to customer sites is expected.' WHEN 3 THEN 'Office visits may be needed.' WHEN 4 THEN 'Office visits are optional.'
    WHEN 5 THEN 'You must live within 50 miles of Denver.' WHEN 6 THEN 'A rotational schedule of 8 weeks on site in Alaska is required.' WHEN 7 THEN 'A deployment of twelve weeks to Germany may be possible.' WHEN 8 THEN 'Candidates must reside in Texas, unless approved.' WHEN 9 THEN 'Applicants must be located in the United States. Frequent travel is part of it.' ELSE 'Team lunch on Fridays.' END
  || '</li><li>' || CASE o_orderkey % 17 WHEN 0 THEN 'Preferred qualifications</li><li>Applicants should be a U.S. citizen.' WHEN 1 THEN 'You must be authorized to work in the United States without sponsorship.' WHEN 2 THEN 'This role is subject to export control rules.' WHEN 3 THEN 'A U.S. citizen or permanent resident is asked for if the contract needs it.'
    WHEN 4 THEN 'Sponsorship is not available, unless you hold another visa.' WHEN 5 THEN 'A bonus of USD 5,000 - CAD 9,000 is paid.' WHEN 6 THEN 'Stipend: EUR 900 - EUR 500 a month.' WHEN 7 THEN 'A clearance is required or a degree is required; travel is not required.' ELSE 'Equal opportunity.' END
  || '</li><li>' || CASE o_orderkey % 19 WHEN 0 THEN 'Preferred qualifications</li><li>Master''s degree in Computer Science and 3 years of experience' WHEN 1 THEN 'Bachelor''s degree in Engineering or Mathematics and 5 years of experience, or a Master''s degree and 2 years of experience.' WHEN 2 THEN 'A doctorate is a plus.' WHEN 3 THEN 'Required qualifications</li><li>High school diploma' ELSE 'Curiosity.' END
  || '</li></ul><p>' || CASE WHEN o_orderkey % 10 = 0 THEN 'Requires a 6 month deployment overseas.' WHEN o_orderkey % 10 = 1 THEN 'Relocation to the site is required.' ELSE 'Apply &lt;today&gt;!' END || '</p></div>' AS html,
  CAST(o_orderdate AS DATE) AS start_date,
  o_orderdate AS cached_at,
  o_orderkey % 7 <> 3 AS is_available,
  o_totalprice AS score_seed
"""
ORDERED = "FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"

#: Concepts and their rules: kind is title, positive, context or exclusion.
CONCEPTS = (
    ("technical.software", "Technical Domain"),
    ("technical.network", "Technical Domain"),
    ("technical.electrical", "Technical Domain"),
    ("role.field-service", "Role Type / Career Direction"),
    ("role.analysis", "Role Type / Career Direction"),
    ("arrangement.remote", "Work Arrangement"),
    ("environment.travel", "Work Environment"),
    ("responsibility.team", "Responsibility Shape"),
)
#: rule id, concept, kind, context group, scope, pattern (RE2 and Java syntax alike)
RULES = (
    ("r01", "technical.software", "title", "", "title", "(?i)software engineer"),
    ("r02", "technical.software", "positive", "", "posting", "(?i)\\bsql\\b"),
    ("r03", "technical.software", "exclusion", "", "title", "(?i)warehouse|nurse"),
    ("r04", "technical.network", "title", "", "title", "(?i)network|systems administrator"),
    ("r05", "technical.network", "positive", "", "posting", "(?i)\\blinux\\b"),
    ("r06", "technical.electrical", "title", "", "title", "(?i)electrical"),
    ("r07", "role.field-service", "title", "", "title", "(?i)field service"),
    ("r08", "role.analysis", "title", "", "title", "(?i)analyst"),
    ("r09", "role.analysis", "context", "g1", "posting", "(?i)experience"),
    ("r10", "role.analysis", "context", "g1", "posting", "(?i)\\bsql\\b"),
    ("r11", "arrangement.remote", "title", "", "title", "(?i)\\bremote\\b"),
    ("r12", "arrangement.remote", "positive", "", "posting", "(?i)work remotely"),
    ("r13", "environment.travel", "positive", "", "posting", "(?i)travel up to [0-9]+%"),
    ("r14", "responsibility.team", "positive", "", "corpus", "(?i)join a team"),
)


def duck_values(rows, columns: str) -> str:
    cell = lambda v: str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by key while rows are narrow: bodies are made in all tasks, and later steps on the key need no exchange."""
    narrow = spark.sql(
        f"SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, c_mktsegment, n_name {ORDERED}", **{n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return spark.sql(POSTINGS + "FROM {narrow}", narrow=narrow)


POSTINGS_SQL = POSTINGS + ORDERED.format(orders="orders", customer="customer", nation="nation")


#: The profile of each posting's reader: the customer of its order.
PROFILES = """
SELECT o_orderkey AS posting_no, c_custkey AS user_id,
  CASE c_custkey % 7 WHEN 0 THEN 'notSpecified' WHEN 1 THEN 'noCredential' WHEN 2 THEN 'highSchool' WHEN 3 THEN 'associate' WHEN 4 THEN 'bachelor' WHEN 5 THEN 'master' ELSE 'doctorate' END AS education,
  CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'secret' WHEN 2 THEN 'topSecret' ELSE 'topSecretSCI' END AS clearance,
  c_custkey % 3 <> 0 AS citizen, c_custkey % 5 = 0 AS needs_sponsor, 60000 + floor(c_acctbal) * 8 AS desired_pay,
  CASE WHEN c_custkey % 9 = 0 THEN 'technical' WHEN c_custkey % 9 = 1 THEN 'arrangement' ELSE '' END AS conflict_group
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
PROFILES_SQL = PROFILES.format(orders="orders", customer="customer")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROFILES, **{n: table(spark, sf_dir, n) for n in ("orders", "customer")})


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONCEPTS, "concept_id string, dimension string")


CONCEPTS_SQL = duck_values(CONCEPTS, "concept_id, dimension")
RULES_SQL = duck_values(RULES, "rule_id, concept_id, kind, context_group, scope, pattern")

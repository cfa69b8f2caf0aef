"""Queries over prose: rule extraction and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import names, text
from specloom.functions.lexicon import PROSE, RFC2119
from specloom.operators import prose, rdf
from specloom.schemas import SEVERITIES
from specloom.session import table


def _case(expression: str, steps: tuple[tuple[str, str], ...], default: str) -> str:
    """A keyword ladder in DuckDB; its ``\\b`` is ASCII, Java's isn't, so boundaries are written out."""
    whens = " ".join(f"WHEN regexp_matches({expression}, '{_boundaries(p)}', 'i') THEN '{n}'" for n, p in steps)
    return f"CASE {whens} ELSE '{default}' END"


def _boundaries(pattern: str) -> str:
    return r"(?:^|[^\pL\pM\pN_])(?:" + pattern[2:-2] + r")(?:[^\pL\pM\pN_]|$)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def rules_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered normative sentences of every document."""
    r = prose.rules(_docs(spark, sf_dir), ["doc_id"], PROSE)
    return r.select("doc_id", "ord", "rule_id", "severity", "phase", "description", F.length("source_text").cast("bigint").alias("source_length"))


_SENTENCE = rf"""
WITH para AS (SELECT doc_id, unnest(p) AS para, generate_subscripts(p, 1) - 1 AS para_ord FROM (SELECT doc_id, string_split_regex(text, '\n+') AS p FROM documents)),
kept AS (SELECT * FROM para WHERE regexp_matches(para, '{_boundaries(PROSE.normative)}', 'i') AND NOT regexp_matches(trim(para, E' \t\n\r\f'), '{PROSE.skip}', 'i')),
sent AS (SELECT doc_id, para_ord, para, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_ord FROM (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(para, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, E' \t\n\r\f')), lambda x: x <> '') AS s FROM kept)),
rule AS (SELECT doc_id, (para_ord * 100000 + sent_ord)::BIGINT AS ord, sentence, para, {_case("' ' || para", PROSE.phases, PROSE.phase_default)} AS phase,
  {_case("sentence", PROSE.severities, PROSE.severity_default)} AS severity,
  trim(regexp_replace(sentence, '`([^`]+)`|\{{[^}}]+\}}|\x5B\x5B[^\x5D]+\x5D\x5D|<<[^>]+>>|xref:[^\x5B]+\x5B([^\x5D]*)\x5D', '\1\2', 'g'), E' \t\n\r\f') AS clean
  FROM sent WHERE regexp_matches(sentence, '{_boundaries(PROSE.normative)}', 'i')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, phase ORDER BY ord) AS n FROM rule WHERE length(clean) >= 20)
"""
_RULES = _SENTENCE + "SELECT doc_id, ord, 'VAL-' || upper(phase[1:4]) || '-' || printf('%04d', n) AS rule_id, severity, phase, left(clean, 500) AS description, length(left(clean, 200)) AS source_length FROM numbered"


def rules_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in all, by phase and by severity."""
    return rdf.rule_counts(prose.rules(_docs(spark, sf_dir), ["doc_id"], PROSE))


def rules_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every phase in display order of severity."""
    r = prose.rules(_docs(spark, sf_dir), ["doc_id"], PROSE).withColumn("ord", F.col("doc_id") * 10_000_000_000 + F.col("ord"))
    return rdf.ordered_rules(r).select("phase", "severity_ord", "severity", "ord", "rule_id")


def phase_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase of every turn of conversation, its role for a section."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role", text.phase(F.col("role"), F.col("text"), PROSE).alias("phase")).agg(F.count("*").alias("n"))


def entity_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P10: entities that sentences about parts name."""
    p = table(spark, sf_dir, "part")
    said = F.concat(F.lit("The `"), F.translate("p_name", " ", "_"), F.lit("` of "), names.camel(F.translate("p_name", " ", "-")), F.lit(" and `"), "p_brand", F.lit("` `a.b` "), names.camel(F.translate("p_name", " ", "-")))
    return p.select("p_partkey", F.array_join(F.slice(text.entity_refs(said), 1, RFC2119.reference_cap), ",").alias("refs"))


_CAMEL = "array_to_string(list_transform(regexp_split_to_array({}, '[-_]'), lambda x: upper(x[1:1]) || lower(x[2:])), '')"
_SAID = f"'The `' || translate(p_name, ' ', '_') || '` of ' || {_CAMEL.format('''translate(p_name, ' ', '-')''')} || ' and `' || p_brand || '` `a.b` ' || {_CAMEL.format('''translate(p_name, ' ', '-')''')}"


def clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup around part names removed in both ways, deprecation marks too."""
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("  see xref:p"), "p_partkey", F.lit("["), "p_name", F.lit("] and `"), "p_brand", F.lit("` <<x>> {a} xref:y[] (deprecated) "), "p_type")
    return p.select("p_partkey", text.clean_markup(raw).alias("clean"), text.link_labels(raw).alias("labels"), text.without_deprecation(raw).alias("current"))


_RAW = "'  see xref:p' || p_partkey || '[' || p_name || '] and `' || p_brand || '` <<x>> {a} xref:y[] (deprecated) ' || p_type"


def _adoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of every nation: sections of market segments, sentences and status tables from its customers."""
    c = table(spark, sf_dir, "customer")
    row = F.concat(F.lit("The "), "c_name", F.lit(" "), F.when(F.col("c_custkey") % 3 == 0, "shall not").when(F.col("c_custkey") % 3 == 1, "must").otherwise("may"), F.lit(" verify the `hash.value` of trust. Other text."))
    para = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("## "), "c_mktsegment")).when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("Codes of "), F.when(F.col("c_custkey") % 2 == 0, "success").otherwise("failure"), F.lit("\n|===\n|Value |Meaning |Usage\n|`"), F.translate("c_name", "#", "."), F.lit("` | "), "c_mktsegment", F.lit(" | xref:a[url]\n|==="))).otherwise(row)
    return c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", para.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))


_ADOC = r"""
adoc AS (SELECT c_nationkey, string_agg(CASE WHEN c_custkey % 5 = 0 THEN '## ' || c_mktsegment
  WHEN c_custkey % 5 = 1 THEN 'Codes of ' || CASE WHEN c_custkey % 2 = 0 THEN 'success' ELSE 'failure' END || E'\n|===\n|Value |Meaning |Usage\n|`' || translate(c_name, '#', '.') || '` | ' || c_mktsegment || E' | xref:a[url]\n|==='
  ELSE 'The ' || c_name || ' ' || CASE c_custkey % 3 WHEN 0 THEN 'shall not' WHEN 1 THEN 'must' ELSE 'may' END || ' verify the `hash.value` of trust. Other text.' END, E'\n\n' ORDER BY c_custkey) AS text FROM customer GROUP BY 1)"""


def sections_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, P12, W2, W3 with S4: rules under the last section heading before them."""
    r = prose.rules(_adoc(spark, sf_dir), ["c_nationkey"])
    return r.groupBy("c_nationkey", "spec_section", "severity", "phase").agg(F.count("*").alias("n"), F.min("rule_id").alias("first_id"), F.sum(F.length("description")).alias("chars"))


_SECTIONS = rf"""
WITH {_ADOC},
para AS (SELECT c_nationkey, unnest(p) AS para, generate_subscripts(p, 1) AS i FROM (SELECT *, string_split(text, E'\n\n') AS p FROM adoc)),
placed AS (SELECT *, CASE WHEN para LIKE '## %' THEN para[4:] END AS title FROM para),
filled AS (SELECT *, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY i), '') AS section FROM placed),
rule AS (SELECT c_nationkey, section, i, replace(split_part(para, '. Other', 1) || '.', '`', '') AS clean, para FROM filled WHERE para LIKE 'The %'),
n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY i) AS k, CASE WHEN clean LIKE '% shall not %' THEN 'shall_not' WHEN clean LIKE '% must %' THEN 'must' ELSE 'may' END AS severity FROM rule)
SELECT c_nationkey, section AS spec_section, severity, 'trust' AS phase, count(*) AS n, 'VAL-TRUS-' || printf('%04d', min(k)) AS first_id, sum(length(clean))::BIGINT AS chars FROM n GROUP BY ALL
"""


def status_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status codes of tables by category."""
    codes = prose.status_codes(_adoc(spark, sf_dir), ["c_nationkey"])
    return codes.groupBy("c_nationkey", "category").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("/", "code", "meaning", "url_usage"))), ",").alias("codes"))


_TABLES = rf"""
WITH {_ADOC},
line AS (SELECT c_nationkey, para, sum(length(para) + 2) OVER (PARTITION BY c_nationkey ORDER BY i) - length(para) - 2 + position('|===' IN para) - 1 AS place, i, text FROM
  (SELECT c_nationkey, text, unnest(p) AS para, generate_subscripts(p, 1) AS i FROM (SELECT *, string_split(text, E'\n\n') AS p FROM adoc))),
near AS (SELECT *, lower(right(left(text, place::BIGINT), 300)) AS ctx FROM line WHERE para LIKE 'Codes of %'),
code AS (SELECT c_nationkey, CASE WHEN regexp_matches(ctx, '\bfailure\b') THEN 'failure' WHEN regexp_matches(ctx, '\binformational\b') THEN 'informational' WHEN regexp_matches(ctx, '\bsuccess\b') THEN 'success' ELSE 'unknown' END AS category,
  regexp_extract(para, '`([^`]+)` \| (.+) \| xref', 1) || '/' || regexp_extract(para, '`([^`]+)` \| (.+) \| xref', 2) || '/url' AS c FROM near)
SELECT c_nationkey, category, count(*) AS n, string_agg(c, ',' ORDER BY c) AS codes FROM code GROUP BY ALL
"""


def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event with the last signup of its user before it."""
    e = table(spark, sf_dir, "events")
    rows = e.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    marks = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("signup_id"))
    return prose.as_of(rows, marks, ["user_id"], "ts", "signup_id", "signup_id").select("event_id", "user_id", "signup_id")


def running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their running offset."""
    return prose.paragraphs(_docs(spark, sf_dir), ["doc_id"], PROSE).select("doc_id", F.col("para_ord").cast("bigint").alias("para_ord"), "offset", F.length("para").cast("bigint").alias("n"))


def assertion_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description of every supplier's document, headed or not."""
    s = table(spark, sf_dir, "supplier")
    body = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("= "), "s_name", F.lit("\n\n== Description\n\nAbout `"), "s_name", F.lit("`\nand more.\n\nRest"))).otherwise(F.concat(F.lit("# T\n\nshort\n\n[x]\n\nA paragraph of over thirty characters, "), "s_name"))
    return s.select("s_suppkey", text.assertion_description(body).alias("about"))


QUERIES = {f.__name__: f for f in (rules_extract, rules_summary, rules_by_phase, phase_infer, entity_refs, clean_markup, sections_rules, status_tables, section_asof, running_offset, assertion_descriptions)}
ORACLES = {
    "rules_extract": _RULES,
    "rules_summary": _SENTENCE + "SELECT phase, severity, count(*) AS n FROM numbered GROUP BY GROUPING SETS ((phase), (severity), ())",
    "rules_by_phase": _SENTENCE + """SELECT phase, SEVERITY_ORD AS severity_ord, severity, doc_id * 10000000000 + ord AS ord, 'VAL-' || upper(phase[1:4]) || '-' || printf('%04d', n) AS rule_id FROM numbered""".replace(
        "SEVERITY_ORD", "CASE severity " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(SEVERITIES)) + " ELSE 99 END"),
    "phase_infer": f"SELECT role, {_case('role || chr(32) || text', PROSE.phases, PROSE.phase_default)} AS phase, count(*) AS n FROM conversations GROUP BY ALL",
    "entity_refs": rf"""SELECT p_partkey, array_to_string(list_concat(list_filter(t, lambda x: x[1:1] = lower(x[1:1]) OR contains(x, '.') OR contains(x, '_')), list_distinct(c)), ',') AS refs FROM (
      SELECT p_partkey, regexp_extract_all(said, '`([[:alpha:]][[:alnum:]_.-]*)`', 1) AS t, regexp_extract_all(said, '\b([[:upper:]][[:lower:]]+(?:[[:upper:]][[:lower:]]+)+)\b', 1) AS c FROM (SELECT p_partkey, {_SAID} AS said FROM part))""",
    "clean_markup": rf"""SELECT p_partkey, trim(regexp_replace(raw, '`([^`]+)`|\{{[^}}]+\}}|\x5B\x5B[^\x5D]+\x5D\x5D|<<[^>]+>>|xref:[^\x5B]+\x5B([^\x5D]*)\x5D', '\1\2', 'g')) AS clean,
      regexp_replace(raw, 'xref:[^\x5B]+\x5B([^\x5D]+)\x5D', '\1', 'g') AS labels, trim(regexp_replace(raw, '\(DEPRECATED\)', '', 'gi')) AS current FROM (SELECT p_partkey, {_RAW} AS raw FROM part)""",
    "sections_rules": _SECTIONS,
    "status_tables": _TABLES,
    "section_asof": """SELECT e.event_id, e.user_id, (SELECT max(x.event_id) FROM events x WHERE x.event_type = 'signup' AND x.user_id = e.user_id AND x.ts = m.ts) AS signup_id
      FROM (SELECT e.event_id, e.user_id, e.ts, (SELECT max(s.ts) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts <= e.ts) AS seen FROM events e WHERE event_type <> 'signup') e
      LEFT JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup') m ON m.user_id = e.user_id AND m.ts = e.seen""",
    "running_offset": r"""SELECT doc_id, (i - 1)::BIGINT AS para_ord, (sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 2)::BIGINT AS "offset", length(p)::BIGINT AS n
      FROM (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\n+') AS p FROM documents))""",
    "assertion_descriptions": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'About ' || s_name || ' and more.' ELSE 'A paragraph of over thirty characters, ' || s_name END AS about FROM supplier",
}

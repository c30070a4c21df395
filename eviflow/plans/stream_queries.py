"""Queries that run the intake streams over the tables as arriving files, and source readers over written files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.operators import review as rv
from eviflow.operators.common import cut
from eviflow.plans import guard_queries as gq
from eviflow.plans import name_queries as nq
from eviflow.plans import text_queries as tq
from eviflow.plans import views as v
from eviflow.plans.registry import Tables, query, work_folder
from eviflow.sources import readers, writers
from eviflow.sources.keyed_table import KeyedTable
from eviflow.streaming.intake import assess_stream, screen_stream, written_findings
from eviflow.streaming.verdicts import current_verdicts, verdict_stream


class StreamedOrders(Tables):
    """The tables of one folder with the orders read as a stream."""

    @property
    def orders(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.sf_dir}/orders.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/orders.parquet*")


@query("stream_crosscheck", v.ctes(v.V_MONEY, tq.MISMATCH, body="SELECT * FROM v_mismatch"))
def stream_crosscheck(t: Tables) -> DataFrame:
    """Orders arrive as a stream of dossiers; every batch is cross-checked and written."""
    out = work_folder(t)
    dossiers = v.money_dossiers(StreamedOrders(t.spark, t.sf_dir)).select("case_id", "text")
    assess_stream(dossiers, tq.AS_OF, f"{out}/result", f"{out}/state").awaitTermination()
    findings = written_findings(t.spark, f"{out}/result")
    keep = ["case_id", "category", "label", "severity", "n_values", "n_distinct", "low_value", "high_value"]
    return findings.filter(F.col("n_values").isNotNull()).select(*keep)


@query("stream_screening", nq.SCREENED)
def stream_screening(t: Tables) -> DataFrame:
    """Parties of the parts screened as they arrive; equals the batch screening."""
    out = work_folder(t)
    schema = t.part.schema

    class Streamed(Tables):
        @property
        def part(self) -> DataFrame:
            return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/part.parquet*")

    cases = nq._parties(Streamed(t.spark, t.sf_dir))
    screen_stream(cases, nq.banned(t), nq._entries(t), f"{out}/result", f"{out}/state").awaitTermination()
    return t.spark.read.parquet(f"{out}/result/risk").select("case_id", "risk")


@query(
    "stream_verdicts",
    v.ctes(
        v.V_MONEY, gq.NATION_HITS,
        """
v_again AS (SELECT *, case_id % 3 = 0 AS again, 4 * declared AS figure FROM v_nation),
v_hit AS (SELECT case_id, 'A1' AS rule_id, 'compiler' AS source FROM v_again WHERE CASE WHEN again THEN figure ELSE top END < lo
  UNION ALL SELECT case_id, 'A2', 'compiler' FROM v_again WHERE CASE WHEN again THEN figure ELSE declared END > hi
  UNION ALL SELECT case_id, 'A3', 'compiler' FROM v_again WHERE revenue IS NOT NULL AND NOT again
  UNION ALL SELECT case_id, 'A4', 'hand' FROM v_again WHERE CASE WHEN again THEN figure ELSE top END < lo),
v_sheet AS (SELECT case_id, ruleset_id, again, unnest(CASE WHEN again THEN ['A1', 'A2', 'A3'] ELSE ['A1', 'A2', 'A3', 'A4'] END) AS rule_id,
  CASE WHEN o_orderstatus = 'O' AND NOT again THEN 'unclear' ELSE 'met' END AS ai FROM v_again JOIN orders ON o_orderkey = case_id)
""",
        body="""
SELECT s.case_id, s.rule_id, s.ruleset_id, CASE WHEN h.case_id IS NULL OR ai <> 'met' THEN ai WHEN s.rule_id <> 'A2' THEN 'not_met' ELSE 'unclear' END AS verdict,
  CASE WHEN h.case_id IS NULL THEN NULL WHEN ai <> 'met' THEN 'confirm' WHEN s.rule_id <> 'A2' THEN 'override' ELSE 'flag' END AS action, h.source
FROM v_sheet s LEFT JOIN v_hit h ON h.case_id = s.case_id AND h.rule_id = s.rule_id
""",
    ),
)
def stream_verdicts(t: Tables) -> DataFrame:
    """Dossiers and verdicts of all orders arrive in two batches; a third of the dossiers comes again, under another fund's name.

    The second upload counts, read by the ruleset of the first; its verdicts replace those before, which are void.
    """
    out = work_folder(t)
    rules, first = gq.nation_rules(t), gq.nation_cases(t)
    state = t.orders.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "unclear").otherwise("met").alias("verdict"))
    asked = F.explode(F.array(*[F.lit(r) for r in ("A1", "A2", "A3", "A4")])).alias("rule_id")
    given = [F.lit("medium").alias("confidence"), F.lit("").alias("note")]
    again = v.money_figures(t).filter("case_id % 3 = 0")
    text = F.concat(F.lit("The total requested budget is $"), F.format_number(F.col("declared") * 4, 0), F.lit(" over two years."))
    uploads = [first.select("case_id", F.lit(1).alias("seq"), "ruleset_id", "text", "directorate"), again.select("case_id", F.lit(3).alias("seq"), F.lit("N0").alias("ruleset_id"), text.alias("text"), "directorate")]
    verdicts = [
        first.join(state, "case_id").select("case_id", F.lit(2).alias("seq"), asked, "verdict", *given),
        again.select("case_id", F.lit(4).alias("seq"), asked, F.lit("met").alias("verdict"), *given).filter("rule_id <> 'A4'"),
    ]
    streams = {}
    for k in (0, 1):
        for name, batches in (("uploads", uploads), ("verdicts", verdicts)):
            batches[k].write.parquet(f"{out}/{name}/batch={k}")
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches[k].schema)
            streams[name] = t.spark.readStream.schema(f"{schema}, batch int").parquet(f"{out}/{name}")
        verdict_stream(streams["uploads"], streams["verdicts"], rules, f"{out}/result", f"{out}/state").awaitTermination()
    found = current_verdicts(t.spark.read.parquet(f"{out}/result"))
    return found.select("case_id", "rule_id", "ruleset_id", "verdict", "action", "source")


@query(
    "verdict_table",
    v.ctes(
        v.V_VERDICTS,
        body="""
SELECT case_id, rule_id, CASE WHEN l_tax >= 0.07 THEN 'met' WHEN l_tax >= 0.05 AND case_id % 97 < 9 THEN 'unclear' ELSE ai_verdict END AS ai_verdict,
  CASE WHEN l_tax >= 0.07 OR (l_tax >= 0.05 AND case_id % 97 < 9) THEN NULL ELSE final_verdict END AS final_verdict FROM v_verdicts
""",
    ),
)
def verdict_table(t: Tables) -> DataFrame:
    """Verdicts kept in a keyed table: loaded, assessed again in two batches of which one comes twice, and read back."""
    # Every merge reads its changes twice, so the latest lines are found once.
    rows = cut(v.verdicts(t).select("case_id", "rule_id", "ai_verdict", "final_verdict", "l_tax"), work_folder(t))
    loaded = rows.select("case_id", "rule_id", "ai_verdict", "final_verdict")
    table = KeyedTable.create(t.spark, f"{work_folder(t)}/verdicts", ["case_id", "rule_id"], loaded.schema, buckets=16)
    table.merge(loaded, "load", lambda current, changes: changes)
    again = rows.filter("l_tax >= 0.05 AND case_id % 97 < 9").select("case_id", "rule_id", F.lit("unclear").alias("ai_verdict"), F.lit(1).alias("seq"))
    for batch in ("first", "first"):
        table.merge(again, batch, writers.upsert_verdicts)
    last = rows.filter("l_tax >= 0.07").select("case_id", "rule_id", F.lit("met").alias("ai_verdict"), F.lit(2).alias("seq"))
    table.merge(last, "second", writers.upsert_verdicts)
    return KeyedTable.open(t.spark, table.path).read()


# --- files ---------------------------------------------------------------------------------------
@query(
    "feedback_files",
    'SELECT conv_id || \'-\' || turn AS "case", role AS rule, text AS applicant_quote FROM conversations',
)
def feedback_files(t: Tables) -> DataFrame:
    """Turns written as feedback lines between broken ones, and read back."""
    path = f"{work_folder(t)}/feedback"
    rows = t.spread("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("case"), F.col("role").alias("rule"), F.col("text").alias("applicant_quote"))
    writers.write_feedback(rows, path)
    rows.select(F.concat(F.lit('{"case": "'), "case", F.lit('", "rule": ')).alias("value")).write.mode("append").text(path)
    return readers.read_feedback(t.spark, path).select("case", "rule", "applicant_quote")


@query(
    "registry_xml",
    """
SELECT '0' || s_suppkey AS abn, CASE WHEN s_acctbal > 5000 THEN s_name ELSE 'Given Second' || s_suppkey || ' Family' END AS name,
  CASE WHEN s_nationkey > 12 THEN 'ACT' ELSE 'CAN' END AS status, 'PRV' AS entity_type, CASE WHEN s_acctbal > 5000 THEN 'NSW' ELSE 'VIC' END AS state, '0800' AS postcode FROM supplier
""",
)
def registry_xml(t: Tables) -> DataFrame:
    """Suppliers written as registry records and read back; the rich ones are main entities, the others persons."""
    path = f"{work_folder(t)}/registry"
    rich = F.col("s_acctbal") > 5000
    address = F.struct(F.struct(F.when(rich, "NSW").otherwise("VIC").alias("State"), F.lit("0800").alias("Postcode")).alias("AddressDetails")).alias("BusinessAddress")
    company = F.struct(F.struct(F.col("s_name").alias("NonIndividualNameText")).alias("NonIndividualName"), address)
    given = F.array(F.lit("Given"), F.concat(F.lit("Second"), "s_suppkey")).alias("GivenName")
    person = F.struct(F.struct(given, F.lit("Family").alias("FamilyName")).alias("IndividualName"), address)
    number = F.struct(F.concat(F.lit("0"), "s_suppkey").alias("_VALUE"), F.when(F.col("s_nationkey") > 12, "ACT").otherwise("CAN").alias("_status"))
    records = t.supplier.select(
        number.alias("ABN"), F.struct(F.lit("PRV").alias("EntityTypeInd")).alias("EntityType"),
        F.when(rich, company).alias("MainEntity"), F.when(~rich, person).alias("LegalEntity"),
    )
    records.write.format("xml").option("rootTag", "Transfer").option("rowTag", "ABR").save(path)
    return readers.read_registry_xml(t.spark, path).drop("ord")


@query("registry_index", "SELECT unnest([CASE WHEN i = 1 THEN 'CUSTOMER' ELSE substr(c_name, 10) END]) AS token, c_name AS name FROM customer, (SELECT unnest([1, 2]) AS i)")
def registry_index(t: Tables) -> DataFrame:
    """Customers indexed as a registry, and the index read back."""
    path = f"{work_folder(t)}/index"
    writers.build_registry_index(nq._registry(t).drop("norm"), path)
    registry, tokens = writers.read_registry_index(t.spark, path)
    return tokens.join(registry.select("ord", "name"), "ord").select("token", "name")


@query(
    "ruleset_files",
    """
SELECT 'F' || p_partkey AS ruleset_id, 'Index ' || p_name AS name, CASE WHEN p_size > 20 THEN 'v' || p_size ELSE '9' END AS version, p_partkey = 0 AS is_default,
  r AS rule_id, CAST(r[2:] AS INTEGER) - 1 AS ord, p_type || r AS quote FROM part, (SELECT unnest(['R1', 'R2']) AS r)
""",
)
def ruleset_files(t: Tables) -> DataFrame:
    """Ruleset documents, one per part, written and read back; names and missing versions come from the index."""
    path = f"{work_folder(t)}/rulesets"
    rid = F.concat(F.lit("F"), "p_partkey")
    rule = [F.struct(F.lit(r).alias("id"), F.lit("qualitative").alias("type"), F.col("p_name").alias("title"), F.concat("p_type", F.lit(r)).alias("quote")) for r in ("R1", "R2")]
    docs = t.spread("part").select(rid.alias("id"), F.when(F.col("p_size") > 20, F.concat(F.lit("v"), "p_size")).alias("version"), F.array(*rule).alias("rules"))
    docs.write.json(path)
    entry = F.struct(rid.alias("id"), F.concat(F.lit("Index "), "p_name").alias("name"), F.lit("AU").alias("region"), F.lit("9").alias("version"))
    index = t.spread("part").select(F.col("p_partkey").alias("ord"), entry.alias("e"), F.lit("F0").alias("_default"))
    rulesets, rules = readers.rulesets_from(t.spark.read.schema(readers.RULESET).json(path), index)
    return rules.join(rulesets.drop("ord"), "ruleset_id").select("ruleset_id", "name", "version", "is_default", "rule_id", "ord", "quote")


@query("approved_rulesets", "SELECT n_name AS ruleset_id FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)")
def approved_rulesets(t: Tables) -> DataFrame:
    """Nations with a rich customer are approved funds, the others drafts."""
    rich = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("rich", F.lit(True))
    sets = t.nation.join(rich, "n_nationkey", "left").select(
        F.col("n_name").alias("ruleset_id"), F.when(F.col("rich").isNull(), "draft").alias("status"), F.lit(True).alias("is_default")
    )
    return readers.select_ruleset(sets, require_approved=True).select("ruleset_id")


def _one_file_each(rows: DataFrame, key: str, path: str) -> str:
    """Rows as JSON documents, one file per value of ``key``, which names the file's folder only."""
    rows.repartition(key).write.partitionBy(key).json(path)
    return path


@query(
    "officer_files",
    "SELECT s_name AS name, CASE WHEN s_acctbal > 5000 THEN 'manager' ELSE 'officer' END AS role, n_name || ' office, part ' || s_suppkey AS affiliations FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def officer_files(t: Tables) -> DataFrame:
    """Suppliers as officers, a register document per nation, written, read back and listed."""
    role = F.when(F.col("s_acctbal") > 5000, "manager")  # the others' role is missing
    of = F.struct(F.col("s_name").alias("name"), role.alias("role"), F.array(F.concat("n_name", F.lit(" office")), F.concat(F.lit("part "), "s_suppkey")).alias("affiliations"))
    officers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.collect_list(of).alias("officers"))
    path = _one_file_each(officers.withColumn("sla_days", F.create_map(F.lit("new"), F.lit(5))), "n_nationkey", f"{work_folder(t)}/officers")
    listed = rv.officer_catalogue(readers.read_officers(t.spark, f"{path}/*")[0])
    return listed.withColumn("affiliations", F.array_join("affiliations", ", "))


@query(
    "label_files",
    """
SELECT 'D' || doc_id AS case_id, r AS rule_id, CASE WHEN CASE r WHEN 'quality' THEN quality ELSE toxic END = 1 THEN 'met' ELSE 'not_met' END AS truth
FROM labels, (SELECT unnest(['quality', 'toxic']) AS r)
""",
)
def label_files(t: Tables) -> DataFrame:
    """Labels as truth documents of a hundred cases, written and read back."""
    verdict = lambda c: F.when(F.col(c) == 1, "met").otherwise("not_met")
    entry = F.struct(F.concat(F.lit("D"), "doc_id").alias("key"), F.create_map(F.lit("quality"), verdict("quality"), F.lit("toxic"), verdict("toxic")).alias("value"))
    docs = t.labels.groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias("labels"))
    path = _one_file_each(docs, "part", f"{work_folder(t)}/labels")
    return readers.read_labels(t.spark, f"{path}/*")[0]


@query(
    "evaluation_files",
    """
SELECT p_brand AS ruleset_id, count(*) FILTER (WHERE p_size > 10) AS target_correct, count(*) AS target_total, count(*) FILTER (WHERE p_size < 3) AS target_false_pass,
  count(DISTINCT p_type) AS control_total FROM part GROUP BY p_brand
""",
)
def evaluation_files(t: Tables) -> DataFrame:
    """An evaluation report per brand, a document each, written and read back."""
    counts = t.part.groupBy("p_brand").agg(
        F.count_if(F.col("p_size") > 10).alias("correct"), F.count("*").alias("total"), F.count_if(F.col("p_size") < 3).alias("false_pass"), F.countDistinct("p_type").alias("types")
    )
    docs = counts.select(F.col("p_brand").alias("ruleset"), F.lit("m").alias("llm"), F.struct("correct", "total", "false_pass").alias("target"), F.struct(F.col("types").alias("total")).alias("control"))
    path = f"{work_folder(t)}/reports"
    _one_file_each(docs.withColumn("of", F.col("ruleset")), "of", path)
    found = readers.read_evals(t.spark, f"{path}/*")
    return found.select("ruleset_id", "target_correct", "target_total", "target_false_pass", "control_total")


@query(
    "tuning_file",
    """
SELECT 'P' || p_partkey AS "case", 'You judge grants.' AS system, '{"verdict":"met","confidence":"high","supporting_fact":1,"note":"' || CASE WHEN p_size > 25 THEN p_type ELSE 'Per the officer''s signed verdict.' END || '"}' AS assistant
FROM part WHERE p_size > 10
""",
)
def tuning_file(t: Tables) -> DataFrame:
    """Parts as feedback written as tuning lines and read back; small ones have no facts and are left out."""
    facts = F.when(F.col("p_size") > 10, F.array("p_name", "p_brand")).otherwise(F.array().cast("array<string>"))
    rows = t.spread("part").select(
        F.concat(F.lit("P"), "p_partkey").alias("case"), F.lit("R1").alias("rule"), F.col("p_name").alias("rule_quote"), facts.alias("facts"),
        F.lit("met").alias("final_verdict"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("officer_reason"),
    )
    path = f"{work_folder(t)}/tuning"
    writers.write_sft(rows, path, "You judge grants.")
    read = t.spark.read.schema("messages array<struct<role:string,content:string>>").json(path)
    said = lambda k: F.col("messages")[k]["content"]
    return read.select(F.regexp_extract(said(1), r"^CASE (\S+) ", 1).alias("case"), said(0).alias("system"), said(2).alias("assistant"))

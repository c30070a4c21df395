"""Readers for rulesets, applications, registers, labels and feedback.

All take a folder or file that every executor can reach and return DataFrames with explicit schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import text as tx

INDEX = "default string, rulesets array<struct<id:string,file:string,name:string,region:string,version:string>>"
RULESET = (
    "id string, name string, region string, version string, source string, status string, approved_by string, "
    "approved_at string, rules array<struct<id:string,type:string,title:string,quote:string>>"
)
MANIFEST = (
    "cases array<struct<id:string,file:string,applicant:string,org:string,directorate:string,scenario:string,"
    "tags:array<string>,ruleset:string,pair:string>>"
)
OFFICERS = (
    "sla_days map<string,int>, officers array<struct<name:string,role:string,affiliations:array<string>,notes:string>>"
)
TRUTH = (
    "verdict_scale array<string>, bias_pairs array<array<string>>, labels map<string,map<string,string>>, "
    "notes map<string,string>"
)
TESTSET = (
    "ruleset string, version string, label_scope string, generator_model string, verifier_model string, "
    "planner_model string, generated_by string, targets array<string>, generated_at string, approved boolean, "
    "approved_by string, approved_at string, reviewers array<string>, n_needs_review int, cases array<struct<id:string,"
    "file:string,target:string,labels:map<string,string>,violation_fact:string,fact_confirmed_by:string,"
    "fact_placement:string,removed_meta_sentences:array<string>,rest_without_fact_votes:array<string>,"
    "guard_agree:boolean,target_label_clear:boolean,weak_labels:array<string>,verifier_disagreement:array<string>,"
    "verifier:map<string,array<string>>,control_rules:array<string>,status:string>>, "
    "skipped array<struct<id:string,reason:string,detail:string>>"
)
EVALUATION = (
    "ruleset string, llm string, label_scope string, labels_generated_at string, labels_approved_at string, "
    "evaluated_at string, provisional boolean, "
    "target struct<correct:bigint,total:bigint,false_pass:bigint,routed_to_officer:bigint>, "
    "control struct<correct:bigint,total:bigint,false_alarm:bigint>, "
    "secondary struct<correct:bigint,total:bigint,false_pass:bigint>, excluded_weak_labels bigint, excluded_rate double, "
    "disputed_cases bigint, errors array<struct<case:string,rule:string,kind:string,pred:string,truth:string,note:string>>"
)
FEEDBACK = (
    "ts string, case string, rule string, rule_quote string, facts array<string>, ai_verdict string, "
    "ai_confidence string, final_verdict string, officer_reason string, applicant_quote string, kind string, "
    "officer string, llm string, ruleset string"
)
REGISTRY = (
    "ABN struct<_VALUE:string,_status:string>, EntityType struct<EntityTypeInd:string>, "
    "MainEntity struct<NonIndividualName:struct<NonIndividualNameText:string>,"
    "IndividualName:struct<GivenName:array<string>,FamilyName:string>,"
    "BusinessAddress:struct<AddressDetails:struct<State:string,Postcode:string>>>, "
    "LegalEntity struct<NonIndividualName:struct<NonIndividualNameText:string>,"
    "IndividualName:struct<GivenName:array<string>,FamilyName:string>,"
    "BusinessAddress:struct<AddressDetails:struct<State:string,Postcode:string>>>"
)


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


# --- rulesets ------------------------------------------------------------------------------------
def read_rulesets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rulesets, rules) of the sets an index file lists; name, version and region fall back to the index."""
    index = spark.read.schema(INDEX).json(f"{folder}/index.json", multiLine=True)
    entries = index.select(
        F.coalesce("default", F.get("rulesets", F.lit(0))["id"]).alias("_default"),
        F.posexplode("rulesets").alias("ord", "e"),
    )
    docs = spark.read.schema(RULESET).json(f"{folder}/*.json", multiLine=True).withColumn("_file", F.url_decode(_file_name()))
    matched = entries.join(docs, F.col("e.file") == F.col("_file"))
    return _ruleset_tables(matched)


def rulesets_from(docs: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same tables from documents and index entries (ord, e, _default) matched by id."""
    return _ruleset_tables(entries.join(docs, F.col("e.id") == F.col("id")))


def _ruleset_tables(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    rulesets = joined.select(
        F.col("id").alias("ruleset_id"),
        F.coalesce("name", "e.name", "id").alias("name"),
        F.coalesce("version", "e.version", F.lit("1")).alias("version"),
        F.coalesce("region", "e.region", F.lit("")).alias("region"),
        "source",
        "status",
        (F.col("id") == F.col("_default")).alias("is_default"),
        "ord",
    )
    rules = joined.select(F.col("id").alias("ruleset_id"), F.posexplode("rules").alias("ord", "r")).select(
        "ruleset_id",
        F.col("r.id").alias("rule_id"),
        "ord",
        F.col("r.type").alias("type"),
        F.col("r.title").alias("title"),
        F.col("r.quote").alias("quote"),
    )
    return rulesets, rules


def select_ruleset(rulesets: DataFrame, ruleset_id: str | None = None, require_approved: bool = False) -> DataFrame:
    """One ruleset (the default when no id is given); drafts are left out when approval is required."""
    chosen = rulesets.filter(F.col("ruleset_id") == ruleset_id) if ruleset_id else rulesets.filter("is_default")
    if require_approved:
        chosen = chosen.filter(F.coalesce("status", F.lit("approved")) == "approved")
    return chosen


# --- applications --------------------------------------------------------------------------------
def read_applications(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows with the text of their file."""
    cases = (
        spark.read.schema(MANIFEST)
        .json(f"{folder}/manifest.json", multiLine=True)
        .select(F.explode("cases").alias("c"))
        .select(F.col("c.id").alias("case_id"), "c.*")
        .drop("id")
        .withColumnRenamed("ruleset", "ruleset_id")
    )
    # The manifest's own path tells how the file system names the folder, so a folder name that occurs twice is no matter.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    root = spark.read.text(f"{folder}/manifest.json", wholetext=True).select(path.alias("path")).first()["path"].removesuffix("manifest.json")
    texts = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.txt")
        .text(folder, wholetext=True)
        .select(F.col("value").alias("text"), F.substring(path, F.lit(len(root) + 1), F.length(path)).alias("file"))
    )
    return cases.join(texts, "file", "left")


def intake_text(df: DataFrame, kind: str = "application", text: str = "text") -> DataFrame:
    """Clean uploaded text (bytes are decoded with replacement), with word count and whether it is long enough."""
    raw = F.col(text)
    if df.schema[text].dataType.typeName() == "binary":
        raw = F.make_valid_utf8(raw.cast("string"))
    clean = tx.trim_space(F.replace(raw, F.lit("\r\n"), F.lit("\n")))
    return (
        df.withColumn(text, clean)
        .withColumn("n_words", tx.word_count(text).cast("bigint"))
        .withColumn("accepted", F.col("n_words") >= fv.MIN_WORDS[kind])
    )


# --- registers -----------------------------------------------------------------------------------
def parse_dmy(col: Column | str) -> Column:
    """Day/month/year date, null when it is none."""
    return F.expr(f"try_to_date(trim({col}), 'd/M/yyyy')") if isinstance(col, str) else F.try_to_date(F.trim(col), "d/M/yyyy")


def banned_from(rows: DataFrame, as_of: str) -> DataFrame:
    """Banned persons from register rows with their published column names and ``ord``."""
    raw = F.coalesce("BD_PER_NAME", F.lit(""))
    last, first = F.substring_index(raw, ",", 1), F.substring(raw, F.locate(",", raw) + 1, F.length(raw))
    turned = F.concat_ws(" ", F.trim(first), F.trim(last))
    variants = F.when(F.contains(raw, F.lit(",")), F.array(raw, turned)).otherwise(F.array(raw))
    ends = F.try_to_date(F.trim("BD_PER_END_DT"), "d/M/yyyy")
    base = rows.withColumn("_v", variants)
    return base.select(
        "ord",
        raw.alias("name"),
        F.array(tx.name_norm(F.get("_v", F.lit(0))), tx.name_norm(F.coalesce(F.get("_v", F.lit(1)), F.get("_v", F.lit(0))))).alias("norms"),
        F.coalesce("BD_PER_TYPE", F.lit("")).alias("type"),
        F.coalesce("BD_PER_DOC_NUM", F.lit("")).alias("doc"),
        F.coalesce("BD_PER_START_DT", F.lit("")).alias("start"),
        F.coalesce("BD_PER_END_DT", F.lit("")).alias("end"),
        (ends.isNull() | (ends >= F.to_date(F.lit(as_of)))).alias("active"),
        F.coalesce("BD_PER_ADD_STATE", F.lit("")).alias("state"),
        F.coalesce("BD_PER_ADD_COUNTRY", F.lit("")).alias("country"),
    )


def read_banned(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Banned-person CSV; a byte-order mark is tolerated, order of the file kept in ``ord``."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return banned_from(rows.withColumn("ord", F.monotonically_increasing_id()), as_of)


SANCTION_COLUMNS = {
    "Reference": "reference",
    "Name of Individual or Entity": "name",
    "Type": "type",
    "Name Type": "kind",
    "Date of Birth": "birth",
    "Citizenship": "citizenship",
    "Committees": "committees",
}


def sanctions_from(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, aliases) of the sanctions list from alias rows (published column names, ``ord``).

    Aliases share a reference up to its trailing letters; the other fields come from the first row that fills them.
    Aliases stay rows ``(ref, ord, name, norm, kind)``, so an entry of any size is spread over tasks.
    """
    flat = rows.select(
        "ord", *[F.trim(F.coalesce(F.col(f"`{src}`").cast("string"), F.lit(""))).alias(dst) for src, dst in SANCTION_COLUMNS.items()]
    )
    flat = flat.withColumn("ref", F.regexp_replace("reference", "[a-z]+$", "")).filter(F.col("ref") != "")
    filled = [
        F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("ord"))), F.lit("")).alias(c)
        for c in ("type", "birth", "citizenship", "committees")
    ]
    entries = flat.groupBy("ref").agg(
        F.count_if(F.col("name") != "").alias("n_aliases"), *filled, F.min("ord").alias("ord")
    )
    aliases = flat.filter(F.col("name") != "").select("ref", "ord", "name", tx.name_norm("name").alias("norm"), "kind")
    return entries, aliases


def read_sanctions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return sanctions_from(rows.withColumn("ord", F.monotonically_increasing_id()))


def registry_from(rows: DataFrame) -> DataFrame:
    """Business registry rows from parsed records; those without number or name are dropped."""
    holder = F.coalesce("MainEntity", "LegalEntity")
    rows = rows.withColumn("h", holder)
    person = F.concat_ws(" ", F.concat_ws(" ", "h.IndividualName.GivenName"), "h.IndividualName.FamilyName")
    name = F.when(
        F.col("h.NonIndividualName").isNotNull(), F.coalesce("h.NonIndividualName.NonIndividualNameText", F.lit(""))
    ).otherwise(F.trim(person))
    address = "h.BusinessAddress.AddressDetails"
    return rows.select(
        F.monotonically_increasing_id().alias("ord"),
        F.trim(F.coalesce("ABN._VALUE", F.lit(""))).alias("abn"),
        name.alias("name"),
        F.coalesce("ABN._status", F.lit("")).alias("status"),
        F.coalesce("EntityType.EntityTypeInd", F.lit("")).alias("entity_type"),
        F.coalesce(f"{address}.State", F.lit("")).alias("state"),
        F.coalesce(f"{address}.Postcode", F.lit("")).alias("postcode"),
    ).filter((F.col("abn") != "") & (F.col("name") != ""))


def read_registry_xml(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "ABR").schema(REGISTRY).load(path)
    return registry_from(rows)


def read_officers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(officers, days allowed per status); credential fields are never read."""
    doc = spark.read.schema(OFFICERS).json(path, multiLine=True)
    officers = doc.select(F.posexplode("officers").alias("ord", "o")).select("ord", "o.*")
    sla = doc.select(F.explode("sla_days").alias("status", "days"))
    return officers, sla


# --- labels, test sets, feedback -----------------------------------------------------------------
def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(truth rows, bias pairs)."""
    doc = spark.read.schema(TRUTH).json(path, multiLine=True)
    truth = doc.select(F.explode("labels").alias("case_id", "m")).select("case_id", F.explode("m").alias("rule_id", "truth"))
    pairs = doc.select(F.explode("bias_pairs").alias("p")).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    return truth, pairs


def read_testsets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(test sets, cases, label rows) of the generated label documents."""
    docs = spark.read.schema(TESTSET).json(path, multiLine=True)
    sets = docs.select(
        F.col("ruleset").alias("ruleset_id"), "version", F.coalesce("label_scope", F.lit("full")).alias("label_scope"),
        F.coalesce("generator_model", "generated_by").alias("generator_model"), "verifier_model", "generated_at",
        "approved", "approved_by", "approved_at", "targets", "reviewers",
    )
    flat = docs.select(F.col("ruleset").alias("ruleset_id"), F.explode("cases").alias("c")).select("ruleset_id", "c.*")
    flat = flat.withColumnRenamed("id", "case_id")
    cases = flat.drop("labels", "weak_labels", "control_rules", "verifier")
    labels = flat.select("ruleset_id", "case_id", F.explode("labels").alias("rule_id", "truth"), "weak_labels", "control_rules")
    labels = labels.select(
        "ruleset_id", "case_id", "rule_id", "truth",
        F.coalesce(F.array_contains("weak_labels", F.col("rule_id")), F.lit(False)).alias("weak"),
        F.coalesce(F.array_contains("control_rules", F.col("rule_id")), F.lit(False)).alias("control"),
    )
    return sets, cases, labels


def read_evals(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation results per ruleset, figures flattened."""
    docs = spark.read.schema(EVALUATION).json(path, multiLine=True)
    return docs.select(
        F.col("ruleset").alias("ruleset_id"), "llm", "label_scope", "labels_generated_at", "labels_approved_at",
        "evaluated_at", "provisional",
        F.col("target.correct").alias("target_correct"), F.col("target.total").alias("target_total"),
        F.col("target.false_pass").alias("target_false_pass"), F.col("control.total").alias("control_total"),
        F.col("control.correct").alias("control_correct"), F.col("control.false_alarm").alias("false_alarm"),
        "excluded_rate",
    )


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback lines; malformed ones are skipped and a missing folder reads as empty."""
    spark_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not spark_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark_path):
        return spark.createDataFrame([], FEEDBACK)
    return spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)

"""Cross-document consistency inside one application.

Documents are rows ``(case_id, doc_ord, doc, body)``; figures are rows ``(case_id, doc_ord, doc, category, value,
source, context)``. Everything up to the figures is row-local; findings need one aggregation on (case, category).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import text as tx
from eviflow.operators import segment as sg
from eviflow.operators.common import computed, first_items

HIGH_CATEGORIES = ["budget_total", "revenue"]


def _tail(col: Column, n: int) -> Column:
    return F.substring(col, F.greatest(F.length(col) - n + 1, F.lit(1)), F.lit(n))


def _figure(category: Column | str, value: Column, source: Column, around: Column) -> Column:
    name = F.lit(category) if isinstance(category, str) else category
    return F.struct(name.alias("category"), value.alias("value"), source.alias("source"), around.alias("around"))


def _with_context(figure: Column) -> Column:
    """A figure or date finding with the text around it collapsed."""
    return figure.withField("context", tx.collapse_space(figure["around"])).dropFields("around")


def prose(body: Column | str) -> Column:
    """Body without its table blocks."""
    return F.regexp_replace(tx._c(body), fv.TABLE_BLOCK, " ")


def table_array(body: Column | str) -> Column:
    """Table blocks of a body as an array of (number, block)."""
    body = tx._c(body)
    return F.arrays_zip(
        F.regexp_extract_all(body, F.lit(fv.TABLE_BLOCK), F.lit(1)).alias("number"),
        F.regexp_extract_all(body, F.lit(fv.TABLE_BLOCK), F.lit(0)).alias("block"),
    )


def money_array(prose_text: Column, doc: Column) -> Column:
    """Labelled amounts of the narrative: total budget or revenue, told by the text before the amount."""
    found = tx.matches(
        prose_text, fv.PROSE_MONEY, {"whole": 0, "figure": 1}, before=fv.MONEY_BEFORE, after=fv.CONTEXT_WIDTH, needle="$"
    )
    labelled = F.transform(
        found,
        lambda m: _figure(
            F.when(F.lower(m["before"]).rlike(fv.BUDGET_BEFORE), "budget_total").when(
                F.lower(m["before"]).rlike(fv.REVENUE_BEFORE), "revenue"
            ),
            tx.parse_money(m["figure"]),
            doc,
            F.concat(_tail(m["before"], fv.CONTEXT_WIDTH), m["whole"], m["after"]),
        ),
    )
    return F.filter(labelled, lambda f: f["category"].isNotNull() & (f["value"] >= fv.MONEY_FLOOR))


def table_total_array(body: Column, doc: Column) -> Column:
    """Last amount of every total row inside a table block."""

    def lines(block: Column) -> Column:
        rows = F.split(block["block"], r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
        return F.transform(
            F.filter(rows, lambda r: r.rlike(fv.TABLE_TOTAL_LINE)),
            lambda r: _figure(
                "budget_total",
                tx.parse_money(F.try_element_at(F.regexp_extract_all(r, F.lit(fv.TABLE_MONEY), F.lit(1)), F.lit(-1))),
                F.concat(doc, F.lit(" · TABLE "), block["number"]),
                r,
            ),
        )

    return F.filter(F.flatten(F.transform(table_array(body), lines)), lambda f: f["value"].isNotNull())


def number_array(body: Column, doc: Column, category: str, pattern: str, needle: str) -> Column:
    """Integer of every match of a pattern, with the text around it; ``needle`` is what every match holds in lower case."""
    found = tx.matches(
        body, pattern, {"whole": 0, "figure": 1}, before=fv.CONTEXT_WIDTH, after=fv.CONTEXT_WIDTH, needle=needle, lower=True
    )
    return F.transform(
        found,
        lambda m: _figure(
            category,
            m["figure"].cast("bigint"),
            doc,
            F.concat(m["before"], m["whole"], m["after"]),
        ),
    )


def figure_array(doc: Column, body: Column) -> Column:
    """Every comparable figure of one document (category, value, source, around); :func:`_with_context` collapses what is
    around it, which only readers of the context need."""
    return F.concat(
        money_array(prose(body), doc),
        table_total_array(body, doc),
        number_array(body, doc, "phd_year", fv.PHD_YEAR, "ph"),
        number_array(body, doc, "pd_pages", fv.PROJECT_PAGES, "project de"),
        number_array(body, doc, "letter_pages", fv.LETTER_PAGES, "etter"),
    )


def extract_values(documents: DataFrame) -> DataFrame:
    """Figures of document rows."""
    found = documents.select("case_id", "doc_ord", "doc", F.inline(figure_array(F.col("doc"), F.col("body"))))
    return found.select("case_id", "doc_ord", "doc", "category", "value", "source", tx.collapse_space("around").alias("context"))


def budget_values(text: Column | str) -> Column:
    """Amounts that count as a total budget in one text."""
    doc = F.lit("x")
    budget = F.filter(money_array(prose(text), doc), lambda f: f["category"] == "budget_total")
    return F.transform(F.concat(budget, table_total_array(tx._c(text), doc)), lambda f: f["value"])


def _date_finding(category: str, label: str, severity: str, value: Column, doc: Column, m: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(label).alias("label"),
        F.lit(severity).alias("severity"),
        value.alias("value"),
        doc.alias("source"),
        F.concat(m["before"], m["whole"], m["after"]).alias("around"),
    )


def future_date_array(doc: Column, body: Column, as_of: str) -> Column:
    """Dates more than one year past ``as_of``."""
    found = tx.matches(
        body, fv.DMY_DATE, {"whole": 0, "year": 3}, before=fv.CONTEXT_WIDTH, after=fv.CONTEXT_WIDTH, needle="/"
    )
    late = F.filter(found, lambda m: m["year"].cast("int") > F.year(F.to_date(F.lit(as_of))) + 1)
    return F.transform(
        late, lambda m: _date_finding("date_future", "Date in the future", "medium", m["whole"], doc, m)
    )


def date_order_array(doc: Column, body: Column, limit: int | None = None) -> Column:
    """Start/end year pairs of a document whose end lies before its start; ``limit`` looks at the first pairs only (one,
    as published)."""
    found = tx.matches(
        body, fv.START_END, {"whole": 0, "first": 1, "second": 2}, before=fv.CONTEXT_WIDTH, after=fv.CONTEXT_WIDTH, needle="tart", lower=True
    )
    wrong = F.filter(first_items(found, limit), lambda m: m["second"].cast("int") < m["first"].cast("int"))
    return F.transform(
        wrong,
        lambda m: _date_finding(
            "date_order", "End date before start date", "high", F.concat(m["first"], F.lit(" → "), m["second"]), doc, m
        ),
    )


def date_findings(documents: DataFrame, as_of: str) -> DataFrame:
    doc, body = F.col("doc"), F.col("body")
    found = documents.select(
        "case_id", F.inline(F.concat(future_date_array(doc, body, as_of), date_order_array(doc, body)))
    )
    return found.select("case_id", "category", "label", "severity", "value", "source", tx.collapse_space("around").alias("context"))


def discrepancies(values: DataFrame) -> DataFrame:
    """One finding per (case, category) whose figures disagree; the figures themselves stay in ``values``."""
    labels = F.create_map(*[F.lit(x) for kv in fv.CATEGORY_LABELS.items() for x in kv])
    spread = (F.col("high_value") - F.col("low_value")) / F.col("high_value")
    per_value = values.groupBy("case_id", "category", "value").agg(F.count("*").alias("n"))
    return (
        per_value.groupBy("case_id", "category")
        .agg(
            F.sum("n").alias("n_values"),
            F.count("*").alias("n_distinct"),
            F.min("value").alias("low_value"),
            F.max("value").alias("high_value"),
        )
        .filter(F.col("n_distinct") > 1)
        .withColumn("label", F.coalesce(labels[F.col("category")], F.col("category")))
        .withColumn(
            "severity",
            F.when(F.col("category").isin(HIGH_CATEGORIES) | (spread > fv.SPREAD_HIGH), "high").otherwise("medium"),
        )
        .select("case_id", "category", "label", "severity", "n_values", "n_distinct", "low_value", "high_value")
    )


def case_risk(cases: DataFrame, documents: DataFrame, values: DataFrame, findings: DataFrame) -> DataFrame:
    """Risk per case with the number of documents, checked figures and findings."""
    docs = documents.groupBy("case_id").agg(F.count("*").alias("n_docs"))
    checked = values.groupBy("case_id").agg(
        F.count("*").alias("n_checked"),
        *[
            F.count_if(F.col("category") == name).alias(f"checked_{name}")
            for name in fv.CATEGORY_LABELS
        ],
    )
    found = findings.groupBy("case_id").agg(
        F.count("*").alias("n_findings"), F.bool_or(F.col("severity") == "high").alias("_high")
    )
    counts = ["n_docs", "n_checked", *[f"checked_{name}" for name in fv.CATEGORY_LABELS], "n_findings"]
    return (
        cases.select("case_id")
        .join(docs, "case_id", "left")
        .join(checked, "case_id", "left")
        .join(found, "case_id", "left")
        .select(
            "case_id",
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
            F.when(F.col("_high"), "mismatch_high")
            .when(F.col("n_findings") > 0, "mismatch")
            .otherwise("consistent")
            .alias("risk"),
        )
    )


def dossier_report(cases: DataFrame, as_of: str) -> DataFrame:
    """One row per dossier ``(case_id, text)``: documents, figures, findings and risk.

    A dossier is one row, so all of it is computed in place without a shuffle.
    """
    finding = (
        "struct<category:string,label:string,severity:string,n_values:bigint,n_distinct:bigint,low_value:bigint,"
        "high_value:bigint,value:string,source:string,context:string>"
    )
    docs = cases.select("case_id", sg.document_array("text").alias("docs"))
    read = computed(
        docs,
        F.size("docs").cast("bigint").alias("n_docs"),
        F.flatten(F.transform("docs", lambda d: figure_array(d["doc"], d["body"]))).alias("figures"),
        F.flatten(
            F.transform(
                "docs",
                lambda d: F.concat(future_date_array(d["doc"], d["body"], as_of), date_order_array(d["doc"], d["body"])),
            )
        ).alias("dates"),
    )

    def of_category(name: str) -> Column:
        return F.transform(F.filter("figures", lambda f: f["category"] == name), lambda f: f["value"])

    listed = computed(read, *[of_category(name).alias(f"_{name}") for name in fv.CATEGORY_LABELS])

    def gap(name: str) -> Column:
        values = F.col(f"_{name}")
        low, high = F.array_min(values), F.array_max(values)
        wide = (high - low) / high > fv.SPREAD_HIGH
        severity = F.lit("high") if name in HIGH_CATEGORIES else F.when(wide, "high").otherwise("medium")
        made = F.struct(
            F.lit(name).alias("category"),
            F.lit(fv.CATEGORY_LABELS[name]).alias("label"),
            severity.alias("severity"),
            F.size(values).cast("bigint").alias("n_values"),
            F.size(F.array_distinct(values)).cast("bigint").alias("n_distinct"),
            low.alias("low_value"),
            high.alias("high_value"),
            F.lit(None).cast("string").alias("value"),
            F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("string").alias("context"),
        )
        return F.when(low != high, made)

    def dated(d: Column) -> Column:
        none = [F.lit(None).cast("bigint").alias(n) for n in ("n_values", "n_distinct", "low_value", "high_value")]
        return F.struct(
            *[d[n].alias(n) for n in ("category", "label", "severity")],
            *none,
            *[d[n].alias(n) for n in ("value", "source")],
            tx.collapse_space(d["around"]).alias("context"),
        )

    findings = F.concat(
        F.transform("dates", dated).cast(f"array<{finding}>"),
        F.array_compact(F.array(*[gap(name) for name in fv.CATEGORY_LABELS])).cast(f"array<{finding}>"),
    )
    full = computed(listed, findings.alias("findings"))
    return full.select(
        "case_id",
        "n_docs",
        F.size("figures").cast("bigint").alias("n_checked"),
        *[F.size(f"_{name}").cast("bigint").alias(f"checked_{name}") for name in fv.CATEGORY_LABELS],
        F.size("findings").cast("bigint").alias("n_findings"),
        F.when(F.exists("findings", lambda f: f["severity"] == "high"), "mismatch_high")
        .when(F.size("findings") > 0, "mismatch")
        .otherwise("consistent")
        .alias("risk"),
        F.transform("figures", _with_context).alias("figures"),
        "findings",
    )


def crosscheck(cases: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(findings, case risk) of whole dossiers ``(case_id, text)``; for dossiers kept as document rows use
    :func:`extract_values`, :func:`discrepancies`, :func:`date_findings` and :func:`case_risk`."""
    report = dossier_report(cases, as_of)
    return report.select("case_id", F.inline("findings")), report.drop("figures", "findings")

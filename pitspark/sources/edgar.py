"""Filings and company facts from the JSON of a public filings service, landed as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions.scalar import filer_cik, iso_moment_ns, ns_of_date

TAXONOMIES = ("us-gaap", "ifrs-full", "dei")
HISTORY = "accessionNumber array<string>, filingDate array<string>, reportDate array<string>, acceptanceDateTime array<string>, form array<string>, items array<string>"
_RECENT = "struct<accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,acceptanceDateTime:array<string>,form:array<string>,items:array<string>>"
SUBMISSIONS = f"filings struct<recent:{_RECENT},files:array<struct<name:string>>>"
FACTS = "facts map<string,map<string,struct<units:map<string,array<struct<accn:string,start:string,end:string,val:double,form:string>>>>>>"


class FilingError(ValueError):
    """Filings or facts contradict themselves."""


def form_wanted(form: Column, forms: Sequence[str]) -> Column:
    """One of the forms, or an amendment of one."""
    return form.isin(*forms) | (form.endswith("/A") & base_form(form).isin(*forms))


def base_form(form: Column) -> Column:
    return F.regexp_replace(form, "/A$", "")


def explode_columns(rows: DataFrame, columns: str, names: Sequence[str]) -> DataFrame:
    """A struct of arrays of one length as rows; arrays of different lengths raise."""
    size = F.size(F.col(f"{columns}.{names[0]}"))
    same = F.lit(True)
    for n in names[1:]:
        same = same & (F.size(F.col(f"{columns}.{n}")) == size)
    zipped = F.arrays_zip(*(F.col(f"{columns}.{n}").alias(n) for n in names))
    checked = F.when(same, zipped).otherwise(F.raise_error(F.lit("the columns of a filing list differ in length")))
    return rows.select("*", F.inline(checked)).drop(columns) if columns in rows.columns else rows.select("*", F.inline(checked))


def with_amendments(filings: DataFrame, *, key: str = "accession", accepted: Sequence[str] = ("accepted_ns",), period: Sequence[str] = ("cik", "period_end")) -> DataFrame:
    """``amends_ref`` of amendments: the last earlier filing of the base form for the same period."""
    amended = F.col("form_type").endswith("/A")
    w = Window.partitionBy(*period, base_form(F.col("form_type"))).orderBy(*accepted).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(~amended, F.col(key)), ignorenulls=True).over(w)
    return filings.withColumn("amends_ref", F.when(amended, before))


def filings(submissions: DataFrame, history: DataFrame | None = None, *, forms: Sequence[str]) -> DataFrame:
    """cik, accession, form_type, period_end, accepted_ns, items, amends_ref. ``submissions``: cik and ``filings`` (SUBMISSIONS);
    ``history``: cik and the fields of a further list, as columns."""
    names = "accessionNumber filingDate reportDate acceptanceDateTime form items".split()
    rows = submissions.select(filer_cik(F.col("cik")).alias("cik"), F.col("filings.recent").alias("columns"))
    if history is not None:
        rows = rows.unionByName(history.select(filer_cik(F.col("cik")).alias("cik"), F.struct(*names).alias("columns")))
    flat = explode_columns(rows, "columns", names).where(form_wanted(F.col("form"), forms))
    items = F.filter(F.transform(F.split(F.coalesce("items", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    period = F.coalesce(F.nullif("reportDate", F.lit("")), F.col("filingDate"))
    out = flat.select("cik", F.col("accessionNumber").alias("accession"), F.col("form").alias("form_type"), F.to_date(period).alias("period_end"), iso_moment_ns(F.col("acceptanceDateTime")).alias("accepted_ns"), items.alias("items"))
    return with_amendments(out.dropDuplicates(["cik", "accession"]), accepted=("accepted_ns", "accession"))


def flatten_facts(rows: DataFrame, facts: str = "facts") -> DataFrame:
    """taxonomy, concept, unit, item of a nested map of facts; other columns stay."""
    keep = [c for c in rows.columns if c != facts]
    by_taxonomy = rows.select(*keep, F.explode(facts).alias("taxonomy", "_concepts"))
    by_concept = by_taxonomy.select(*keep, "taxonomy", F.explode("_concepts").alias("concept", "_body"))
    units = F.col("_body")["units"]
    by_unit = by_concept.select(*keep, "taxonomy", "concept", F.explode(units).alias("unit", "_items"))
    return by_unit.select(*keep, "taxonomy", "concept", "unit", F.explode("_items").alias("item"))


def conflicting(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def facts_with_filings(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Facts whose filing is known."""
    return facts.join(found, "accession")


def facts(rows: DataFrame, found: DataFrame, *, concepts: Sequence[str]) -> DataFrame:
    """cik, accession, concept, unit, start, period_end, period_type, value, accepted_ns of the wanted concepts. ``rows``: cik
    and ``facts`` (FACTS). Exact repeats count once; two values of one fact raise."""
    flat = flatten_facts(rows).where(F.col("taxonomy").isin(*TAXONOMIES) & F.col("concept").isin(*concepts))
    flat = flat.select(filer_cik(F.col("cik")).alias("cik"), F.col("item.accn").alias("accession"), "concept", "unit", F.coalesce("item.start", F.lit("")).alias("start"), F.to_date("item.end").alias("period_end"), F.col("item.val").alias("value"))
    key = ["cik", "accession", "concept", "unit", "start", "period_end"]
    # facts of filings that aren't known don't count, not even as contradictions
    flat = flat.join(found.select("cik", "accession", "accepted_ns"), ["cik", "accession"])
    if bad := conflicting(flat, key, "value").first():
        raise FilingError(f"{bad['concept']} of {bad['accession']} has two values")
    kind = F.when(F.col("start") != "", "duration").otherwise("instant")
    return flat.dropDuplicates(key).withColumn("period_type", kind)


def observations(found: DataFrame, company_facts: DataFrame) -> DataFrame:
    """Both in the shape of an observation, without ids: event time is the period's end, knowledge the acceptance, the
    accession the vintage."""
    filed = found.select(
        F.lit("event.filing").alias("signal_type"), base_form(F.col("form_type")).alias("series_id"), F.col("cik").alias("native_entity"), ns_of_date(F.col("period_end")).alias("event_time_ns"), F.col("accepted_ns").alias("knowledge_time_ns"), F.col("accession").alias("vintage_id"),
        F.to_json(F.struct("accession", "amends_ref", "form_type", "items")).alias("payload"),
    )
    stated = company_facts.select(
        F.lit("fundamental.fact").alias("signal_type"), F.concat_ws("|", "concept", "unit", "start", F.col("period_end").cast("string")).alias("series_id"), F.col("cik").alias("native_entity"), ns_of_date(F.col("period_end")).alias("event_time_ns"), F.col("accepted_ns").alias("knowledge_time_ns"), F.col("accession").alias("vintage_id"),
        F.to_json(F.struct("concept", F.col("period_end").cast("string").alias("period_end"), "period_type", "unit", "value")).alias("payload"),
    )
    return filed.unionByName(stated)

"""Filing records, field dictionaries, mapping state and the review queue."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillstat.functions import fixed
from quillstat.session import broadcast_if_small

FILING_SCHEMA = """stock_code string, stock_abbr string, report_year int, report_period string, report_type string, exchange string,
source string, confidence double,
validation struct<pass:int,total:int,score:int,details:array<struct<check:string,passed:boolean,detail:string,source_tables:array<string>>>>,
unit_info map<string, struct<unit_factor:bigint,unit_raw:string,unit_source_text:string>>,
data map<string, map<string,double>>"""


def _filing_rows(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Every record with the text of those that can't be parsed as ``_broken``; ``source_file`` is the record's own or the name of its file."""
    schema = f"{FILING_SCHEMA}, source_file string, _broken string"
    df = spark.read.schema(schema).options(multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").json(path)
    # Fields that a query doesn't ask for aren't parsed, and what isn't parsed can't be found broken: count the fields of every record.
    fields = reduce(add, [F.col(c).isNotNull().cast("int") for c in df.columns])
    return df.filter(fields >= 0).withColumn("source_file", F.coalesce("source_file", "_metadata.file_name"))


def read_filings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One JSON record per file, or per line without ``multi_line``; summaries are skipped, records that ``broken_filings`` returns left out."""
    rows = _filing_rows(spark, path, multi_line).filter(F.col("_broken").isNull()).drop("_broken")
    return rows.filter(~F.col("source_file").contains("_summary") & (F.col("stock_code").isNotNull() | F.col("stock_abbr").isNotNull()))


def broken_filings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(source_file, reason, content) of the records set aside: ``unreadable`` ones with their text, and those that name no company."""
    rows = _filing_rows(spark, path, multi_line).filter(~F.col("source_file").contains("_summary"))
    nobody = F.col("stock_code").isNull() & F.col("stock_abbr").isNull()
    reason = F.when(F.col("_broken").isNotNull(), "unreadable").when(nobody, "unnamed")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select("source_file", "reason", F.col("_broken").alias("content"))


def explode_facts(filings: DataFrame, catalog: DataFrame, ids: list[str]) -> DataFrame:
    """Nested map → (ids…, table_name, field, value); unknown tables and fields are dropped."""
    tables = filings.select(*ids, F.explode("data").alias("table_name", "_fields"))
    facts = tables.select(*ids, "table_name", F.explode("_fields").alias("field", "value"))
    known = catalog.select("table_name", F.col("column_name").alias("field"))
    return facts.join(broadcast_if_small(known), ["table_name", "field"], "left_semi").select(*ids, "table_name", "field", "value")


def read_field_dictionary(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Dictionary file (tables → columns → en, cn, aliases) → (synonym, field, table_name, label); labels come first."""
    schema = ("tables map<string, struct<table_name_cn:string,description:string,"
              "columns:array<struct<en:string,cn:string,aliases:array<string>>>>>")
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    cols = raw.select(F.explode("tables").alias("table_name", "t")).select("table_name", F.explode("t.columns").alias("c"))
    names = F.concat(F.array("c.cn"), F.coalesce("c.aliases", F.array().cast("array<string>")))
    return cols.select(F.explode(names).alias("synonym"), F.col("c.en").alias("field"), "table_name", F.col("c.cn").alias("label"))


def dictionary_report(dictionary: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Problems of a synonym list: duplicate keys and targets that no field carries."""
    dup = synonyms.groupBy("synonym").agg(F.count_distinct("label").alias("n")).filter("n > 1").select(
        F.lit("duplicate").alias("problem"), F.col("synonym").alias("entry"))
    orphan = synonyms.select("label").distinct().join(dictionary.select("label").distinct(), "label", "left_anti").select(
        F.lit("orphan").alias("problem"), F.col("label").alias("entry"))
    return dup.unionByName(orphan)


def field_dictionary(spark: SparkSession) -> DataFrame:
    """The built-in dictionary (field, table, unit, label)."""
    return spark.createDataFrame(fixed.FIELDS, "field string, table string, unit string, label string")


# state of the label mapping

POOL_SCHEMA = "field string, synonym string"
HISTORY_SCHEMA = "label string, field string, observations long, successes long, total_confidence double"


def mapping_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(synonym pool, mapping history); a missing or unreadable table is empty."""
    def load(name, schema):
        try:
            df = spark.read.parquet(f"{path}/{name}")
            return df.select(*[c.strip().split(" ")[0] for c in schema.split(",")])
        except AnalysisException:
            return spark.createDataFrame([], schema)

    return load("pool", POOL_SCHEMA), load("history", HISTORY_SCHEMA)


def save_mapping_state(pool: DataFrame, history: DataFrame, path: str) -> None:
    pool.write.mode("overwrite").parquet(f"{path}/pool")
    history.write.mode("overwrite").parquet(f"{path}/history")


# review queue

def anomaly_queue(facts: DataFrame, limit: float = 1e8) -> DataFrame:
    """Review rows for checked fields whose value is implausibly large.

    ``facts`` has the keys, table_name, field, value and optionally unit_raw and source_file.
    """
    spark = facts.sparkSession
    checked = spark.createDataFrame(fixed.CHECKED_FIELDS, "table_name string, field string, indicator string")
    optional = [F.col(c) if c in facts.columns else F.lit(None).cast("string").alias(c) for c in ("unit_raw", "source_file")]
    big = facts.filter(F.abs(F.col("value").cast("double")) > limit)
    return big.join(F.broadcast(checked), ["table_name", "field"]).select(
        F.col("stock_abbr").alias("company"), "stock_code", "report_year", F.col("report_period").alias("period"), "indicator", "field",
        "table_name", F.col("value").cast("decimal(20,4)").alias("raw_value"), *optional,
        F.lit("value implausibly large, unit may be wrong").alias("reason"), F.lit("pending").alias("status"))


def apply_review(queue: DataFrame, decisions: DataFrame, reviewed_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue with states set, corrected facts).

    ``decisions`` has (stock_code, report_year, period, table_name, field, unit). The corrected value is
    raw value × factor / 10⁴; the year belongs to the key. Merge the facts with ``merge_facts``.
    """
    keys = ["stock_code", "report_year", "period", "table_name", "field"]
    factors = F.create_map(*[F.lit(x) for pair in fixed.UNIT_FACTORS for x in pair])
    factor = F.try_element_at(factors, F.col("unit"))
    d = decisions.select(*keys, "unit").filter(factor.isNotNull())
    out = queue.join(d, keys, "left")
    approved = F.col("unit").isNotNull() & (F.col("status") == "pending")
    when = reviewed_at if reviewed_at is not None else F.current_timestamp()
    marked = out.withColumns({
        "status": F.when(approved, F.lit("approved")).otherwise(F.col("status")),
        "unit_raw": F.when(approved, F.col("unit")).otherwise(F.col("unit_raw")),
        "reviewed_at": F.when(approved, when),
    }).drop("unit")
    facts = out.filter(approved).select(
        "stock_code", "report_year", F.col("period").alias("report_period"), "table_name", "field",
        (F.col("raw_value").cast("decimal(20,4)") * factor.cast("decimal(10,0)") / F.lit(10000).cast("decimal(6,0)")).cast("decimal(20,4)").alias("value"))
    return marked, facts


# names of filings

def filing_from_name(name: Column) -> Column:
    """Struct (code, company, year, period) from a filing name.

    ``code_yyyymmdd_x``: month → period, annual filings up to April belong to the year before.
    ``name：yyyy年wording``: the longest wording decides.
    """
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    code = F.regexp_extract(base, r"^([^_]*)_", 1)
    stamp = F.regexp_extract(base, r"^[^_]*_(\d{8,})(?:_|$)", 1)
    month = F.substring(stamp, 5, 2).try_cast("int")
    # Month of publication → period.
    by_month = F.when(month.isin(4, 5), "Q1").when(month.isin(6, 7, 8, 9), "H1").when(month.isin(10, 11), "Q3").otherwise("FY")
    # Wording → period, longest first.
    words = [("半年度报告", "H1"), ("一季度报告", "Q1"), ("三季度报告", "Q3"), ("第一季度", "Q1"), ("第三季度", "Q3"), ("中期报告", "H1"), ("年度报告", "FY"),
             ("一季报", "Q1"), ("半年度", "H1"), ("半年报", "H1"), ("三季报", "Q3"), ("年报", "FY"), ("全年", "FY")]
    year = F.substring(stamp, 1, 4).try_cast("int")
    company = F.trim(F.regexp_extract(base, r"^(.+?)[：:]\s*\d{4}年", 1))
    named_year = F.regexp_extract(base, r"^.+?[：:]\s*(\d{4})年.", 1).try_cast("int")
    tail = F.regexp_extract(base, r"^.+?[：:]\s*\d{4}年(.+)$", 1)
    wording = None
    for w, p in words:
        wording = F.when(tail.contains(w), p) if wording is None else wording.when(tail.contains(w), p)
    dated = stamp != ""
    return F.struct(
        F.when(dated, code).alias("code"), F.when(~dated & (company != ""), company).alias("company"),
        F.when(dated, F.when((by_month == "FY") & (month <= 4), year - 1).otherwise(year)).otherwise(named_year).cast("int").alias("year"),
        F.when(dated, by_month).when(named_year.isNotNull(), F.coalesce(wording, F.lit("FY"))).alias("period"))


def stock_code(text: Column) -> Column:
    """First stock code declared in a text."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in fixed.STOCK_CODE_PATTERNS]
    return F.coalesce(*found)

"""Filing pipelines: cells → facts, filing records → statements, pages → statement locations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillstat.functions import fixed
from quillstat.functions.numbers import normalize
from quillstat.operators import mapping, pages, quality
from quillstat.operators.windows import first_rows
from quillstat.session import broadcast_if_small, durable, stored
from quillstat.sources import filings as source
from quillstat.sources import statements as store

FILING = ["stock_code", "stock_abbr", "report_year", "report_period"]


def table_rows(cells: DataFrame, table: list[str], extra: list[str]) -> DataFrame:
    """(table…, row, label, raw, extra…): sparse columns dropped, header rows taken off, split rows merged; the texts of the label and of the target column.
    ``extra`` columns have one value per table.

    The cells of a table meet once: all steps keep them where they are, and shuffle nothing that already lies by the columns of ``table`` or some of them.
    """
    targeted = pages.with_target(pages.with_header(pages.sparse_columns(cells, table), table), table).filter(F.col("row") > F.col("header_to"))
    text, row, col = F.coalesce(F.trim("text"), F.lit("")), F.col("row"), F.col("col")
    read = pages.split_pairs(targeted, table).filter((col == 0) | (col == F.col("target_col")))
    of = lambda rows: F.max(F.when((col == 0) & rows, text))
    rows = read.groupBy(*table, "_to").agg(of(row == F.col("_to")).alias("_a"), of(row > F.col("_to")).alias("_b"), F.max(F.when(col > 0, text)).alias("raw"),
                                           *[F.first(c).alias(c) for c in extra])
    label = F.when(F.col("_a").isNotNull() | F.col("_b").isNotNull(), F.concat_ws("", "_a", "_b"))
    return rows.select(*table, F.col("_to").alias("row"), label.alias("label"), "raw", *extra)


def normalize_filings(cells: DataFrame, dictionary: DataFrame, fields: DataFrame, table: list[str], filing: list[str] = FILING,
                      pool: DataFrame | None = None, history: DataFrame | None = None, digits: bool = True) -> DataFrame:
    """(filing…, table_name, field, value, filled): canonical facts of every filing.

    ``cells`` has the filing keys, the columns of ``table`` (which include table_name), row, col, text and
    unit_factor; ``dictionary`` is (standard, field, table_name) and ``fields`` (field, unit).
    """
    extra = [*[c for c in filing if c not in table], "unit_factor"]
    rows = table_rows(cells, table, extra).filter(F.col("label").isNotNull())
    mapped = mapping.map_fields(rows, dictionary, "label", "table_name", pool, history)
    units = fields.select("field", "unit")
    valued = mapped.filter(F.col("field").isNotNull()).join(broadcast_if_small(units), "field").withColumn(
        "value", normalize(F.col("raw"), F.col("unit_factor"), F.col("unit"), digits=digits))
    best = mapping.best_value_per_field(valued, [*filing, "table_name"])
    return mapping.cross_fill(best.select(*filing, "table_name", "field", "value"), filing)


@dataclass
class LoadResult:
    decisions: DataFrame
    facts: DataFrame
    metadata: DataFrame
    queue: DataFrame


def load_filings(records: DataFrame, catalog: DataFrame, companies: DataFrame) -> LoadResult:
    """Validate filing records and decide what is loaded.

    ``records`` follows the filing schema plus source_file; ``companies`` is (entity, code, pos). Missing codes
    are looked up by name; a filing without key or known fields is rejected. Facts of loaded filings are in 10⁴
    yuan already, so units are kept as metadata and not applied again.
    """
    need = records.select("stock_abbr").filter(F.col("stock_abbr").isNotNull()).distinct()
    # exact names only: a code found by suffix or containment would load facts under another company
    named = need.join(companies, F.replace("stock_abbr", F.lit(" "), F.lit("")) == F.col("entity"))
    codes = first_rows(named, ["stock_abbr"], [F.col("pos"), F.col("code")]).select("stock_abbr", mapping.pad_code(F.col("code")).alias("_code"))
    code = F.when(F.coalesce("stock_code", F.lit("")).isin("", "None"), F.col("_code")).otherwise(F.col("stock_code"))
    keyed = records.join(codes, "stock_abbr", "left").withColumn("stock_code", code).drop("_code")
    ids = ["source_file", *FILING]
    # the exploded facts are read for the rules and for loading
    facts = durable(source.explode_facts(keyed, catalog, ids))
    wide = quality.filing_rows(facts, ids)
    passed, total = quality.rule_counts(wide)
    checked = wide.select(*ids, "n_fields", passed.alias("passed"), total.alias("total"))
    head = keyed.select(*ids, "report_type", "source", "confidence", "unit_info")
    rules = F.bround(F.col("passed") / F.greatest("total", F.lit(1)) * 100)
    p = F.coalesce("confidence", quality.source_score(F.coalesce("source", F.lit("pdfplumber_standard"))).cast("double"))
    scored = _join_null_safe(head, checked, ids).withColumn("conf", quality.confidence(
        p, F.lit(80), quality.volume_score(F.coalesce("n_fields", F.lit(0))), F.coalesce(rules, F.lit(0.0))))
    complete = F.col("stock_code").isNotNull() & (F.col("stock_code") != "") & F.col("report_year").isNotNull() & F.col("report_period").isNotNull()
    outcome = F.when(complete & F.col("n_fields").isNotNull(), quality.decision(F.col("conf"))).otherwise("rejected")
    decisions = durable(scored.withColumn("decision", outcome))
    loaded = decisions.filter("decision <> 'rejected'")
    unit = F.coalesce(*[F.try_element_at("unit_info", F.lit(t)) for t in fixed.TABLE_PRIORITY])
    metadata = loaded.select(
        *FILING, "source_file", F.coalesce(unit.getField("unit_raw"), F.lit("万元")).alias("report_unit"),
        F.coalesce(unit.getField("unit_factor"), F.lit(10000).cast("long")).alias("unit_factor"),
        F.coalesce(unit.getField("unit_source_text"), F.lit("")).alias("unit_source_text"),
        F.col("conf").alias("extract_confidence"), "decision")
    # several files of one key: the last by name is kept, as a keyed upsert would
    metadata = first_rows(metadata, ["stock_code", "report_year", "report_period"], [F.col("source_file").desc()])
    kind = F.when(F.col("report_type") == "summary", "pdf_summary").otherwise("pdf_extracted")
    kept = facts.join(loaded.select(*ids, kind.alias("report_type")), ids)
    kept = first_rows(kept, ["stock_code", "report_year", "report_period", "table_name", "field"], [F.col("source_file").desc()])
    queue = source.anomaly_queue(kept.withColumn("unit_raw", F.lit("万元")))
    return LoadResult(decisions.drop("unit_info"), kept, metadata, queue)


def _join_null_safe(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """Left join on ids that may hold nulls; the file name is never null and stays a hash key."""
    key, *rest = ids
    cond = F.col(f"l.{key}") == F.col(f"r.{key}")
    for c in rest:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    extra = [F.col(f"r.{c}") for c in right.columns if c not in ids]
    return left.alias("l").join(right.alias("r"), cond, "left").select("l.*", *extra)


def merge_into_statements(tables: dict[str, DataFrame], facts: DataFrame) -> dict[str, DataFrame]:
    """Facts → statement tables: insert missing keys, set provided fields, keep the others."""
    keys = ["stock_code", "report_year", "report_period"]
    out = {}
    for name, target in tables.items():
        fields = [c for c in target.columns if c not in (*FILING, "report_type", "unit_raw", "unit_std")]
        mine = facts.filter(F.col("table_name") == name)
        wide = store.pivot_facts(mine, [*keys, "stock_abbr", "report_type"], fields)
        out[name] = store.merge_facts(target, wide.withColumn("unit_std", F.lit("万元")), keys)
    return out


def locate_statements(page_texts: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, table_name, page, method, score): where each statement of a document is.

    Titles with their page spans come first. For statements not found that way the first page that reaches
    the stop score, else the best page, is taken when it reaches the acceptance score; below it the page is
    kept with method ``paragraph`` for reading facts out of running text.
    """
    above, further, minimum = 3, 4, 40
    p = page_texts.select(doc, page, text).filter((F.trim(text) != "") & F.col(doc).isNotNull() & F.col(page).isNotNull())
    # every page is read and dealt once: scores, titles and spans are all found inside its block
    dealt = pages.with_neighbours(pages.titled(p, text), page, max(above, further), further).withColumn("titles", pages.titles_above(doc, page, above))
    scores = pages.page_scores(dealt, [doc, page, "_block", "_mine"], text, "titles", starts=True)
    spans = scores.withColumn("_end", F.col(page) + pages.further_pages(doc, page, minimum, further))
    before = W.partitionBy(doc, "_block", "table_name").orderBy(page).rangeBetween(-further, 0)
    judged = spans.withColumn("_in", F.coalesce(F.max("_end").over(before) >= F.col(page), F.lit(False))).filter("_mine AND (_in OR score > 0)")
    rows = stored(judged.select(doc, "table_name", page, "score", "_in"), "scores")
    located = rows.filter("_in").withColumn("method", F.lit("section"))
    limit = lambda key: F.create_map(*[F.lit(x) for t, pr in fixed.PROFILES.items() for x in (t, pr[key])])[F.col("table_name")]
    order = F.when(F.col("score") >= limit("stop"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col(page).alias("c"))).otherwise(
        F.struct(F.lit(1).alias("a"), (-F.col("score")).alias("b"), F.col(page).alias("c")))
    best = rows.groupBy(doc, "table_name").agg(F.max("_in").alias("_found"), F.min_by(F.struct(F.col(page).alias("page"), "score"), F.when(F.col("score") > 0, order)).alias("_b"))
    best = best.filter("NOT _found").select(doc, "table_name", F.col("_b.page").alias(page), F.col("_b.score").alias("score"))
    fallback = best.withColumn("method", F.when(F.col("score") >= limit("accept"), "score").otherwise("paragraph"))
    cols = [doc, "table_name", page, "score", "method"]
    return located.select(*cols).unionByName(fallback.select(*cols))

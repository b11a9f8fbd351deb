"""The whole job: raw orders in, clean table, reports and findings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators.charts import run_charts
from tillroll.operators.cleaning import CleaningLog, clean, validate
from tillroll.operators.cohorts import possible_ages, run_cohorts
from tillroll.operators.defects import DefectRates, defect_key, inject_defects, shuffle_rows
from tillroll.operators.insights import insights_table, report_lines
from tillroll.operators.pricing import run_pricing
from tillroll.operators.profile import summary_metrics
from tillroll.operators.reports import run_reports
from tillroll.operators.synth import synthetic_orders
from tillroll.sources import files


@dataclass(frozen=True)
class RunOptions:
    first_date: str = "2022-01-01"
    last_date: str = "2024-12-31"
    high_value_segment: str = "Premium"
    high_volume_segment: str = "Regular"
    approx_quantiles: bool = False


def generate_raw(
    spark: SparkSession, rows: int, rates: DefectRates = DefectRates(), shuffled: bool = False
) -> DataFrame:
    """Synthetic orders with defects, as a raw file would hold them."""
    keyed = synthetic_orders(spark, rows).selectExpr("*", f"{defect_key()} AS defect_key")
    raw = inject_defects(keyed, rates=rates)
    return shuffle_rows(raw) if shuffled else raw


def run_analyses(df: DataFrame, options: RunOptions = RunOptions()) -> dict[str, DataFrame]:
    """Every analysis over a written clean table, by name.

    Small jobs run while this is built: the span of months, and the staged counts that several
    passes of an analysis share.  The results themselves are computed when they are used.
    """
    approx = options.approx_quantiles
    return {
        **run_reports(df, options.high_value_segment, options.high_volume_segment, approx),
        **run_charts(df),
        **run_cohorts(df, possible_ages(df)),
        **run_pricing(df, approx),
        "summary_metrics": summary_metrics(df),
    }


def full_run(raw: DataFrame, out: str, options: RunOptions = RunOptions()) -> dict[str, str]:
    """Clean, validate, analyse and write everything below ``out``; name to path.

    The clean table is written before it is analysed: every analysis then prunes columns
    and pushes its status filter into Parquet, and a lost executor costs a re-read.
    """
    spark, written = raw.sparkSession, {}

    def save(name: str, frame: DataFrame) -> DataFrame:
        written[name] = f"{out}/{name}"
        files.write_parquet(frame, written[name])
        return spark.read.schema(frame.schema).parquet(written[name])

    log = CleaningLog()
    table = save("clean", clean(raw, log))
    save("cleaning_metrics", log.metrics(spark, options.first_date, options.last_date))
    save("validation", validate(table, options.first_date, options.last_date))
    saved = {name: save(name, frame) for name, frame in run_analyses(table, options).items()}

    # The rest starts from the small tables just written.
    findings = saved["business_answers"], saved["cohort_insights"], saved["optimal_pricing"]
    written["summary_csv"] = f"{out}/summary_csv"
    metrics = saved["summary_metrics"].orderBy("metric_no")
    files.write_csv(
        metrics.selectExpr("metric AS Metric", "value_str AS Value"), written["summary_csv"]
    )
    written["insights_json"] = f"{out}/insights_json"
    files.write_json(save("insights", insights_table(*findings)), written["insights_json"])
    written["report"] = f"{out}/report"
    files.write_text(report_lines(*findings), written["report"])
    return written

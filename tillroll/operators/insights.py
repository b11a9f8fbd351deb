"""The findings of a run as one table, and as lines of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.functions.numeric import exprs
from tillroll.functions.text import lookup, quoted, title_case
from tillroll.operators.cohorts import cohort_insights
from tillroll.operators.pricing import optimal_pricing
from tillroll.operators.reports import business_answers, display_answers

# The question behind each number, and the parts of the report.
QUESTIONS = [
    "Is the business growing?",
    "Which category drives the most revenue?",
    "Which region performs best?",
    "How do customer segments differ?",
    "Which payment method has highest order value?",
    "Do discounts erode profit margins?",
    "Which category has the highest return rate?",
]
# The order in which a question lists its numbers.
METRICS = [
    *["first_year", "first_revenue", "last_year", "last_revenue", "growth_pct"],
    *["top_category", "top_revenue", "second_category", "top_region", "total_revenue"],
    *["high_value_segment", "high_value_avg_order_value", "high_value_orders", "high_volume_segment"],
    *["high_volume_orders", "top_payment", "avg_order_value", "first_margin", "last_margin"],
    *["worst_category", "return_rate_pct"],
]
PARTS = [
    "Core Business Analysis",
    "Cohort & Retention Insights",
    "Price Optimization Recommendations",
]


def findings(
    df: DataFrame,
    high_value: str = "Premium",
    high_volume: str = "Regular",
    approx: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Business answers, cohort insights and pricing advice over one clean table."""
    return (
        business_answers(df, high_value, high_volume),
        cohort_insights(df),
        optimal_pricing(df, approx),
    )


def insights_table(answers: DataFrame, cohorts: DataFrame, pricing: DataFrame) -> DataFrame:
    """``(part, ord, topic, metric, value_num, value_str)`` over the three findings."""
    answers = answers.selectExpr(
        "1 AS part",
        "question_no AS ord",
        "concat('Q', cast(question_no as string)) AS topic",
        "metric",
        "value_num",
        "value_str",
    )
    cohorts = cohorts.selectExpr(
        "2 AS part",
        "insight_no AS ord",
        "'cohorts' AS topic",
        "insight AS metric",
        "value_num",
        "value_str",
    )
    pricing = pricing.selectExpr(
        "3 AS part",
        "category AS topic",
        "stack(5, "
        "1, 'current_avg_price', current_avg_price, cast(null as string), "
        "2, 'price_elasticity', price_elasticity, cast(null as string), "
        "3, 'optimal_price', optimal_price, cast(null as string), "
        "4, 'potential_revenue_increase', revenue_change_pct, potential_revenue_increase, "
        "5, 'strategy', cast(null as double), strategy) AS (ord, metric, value_num, value_str)",
    )
    return answers.unionByName(cohorts).unionByName(pricing)


def _bullet(name: str, value: str) -> str:
    return f"concat('- **', {name}, ':** ', coalesce({value}, '-'))"


def _title(key: str) -> str:
    return title_case(f"replace({key}, '_', ' ')")


def report_lines(answers: DataFrame, cohorts: DataFrame, pricing: DataFrame) -> DataFrame:
    """The findings as Markdown, ``(line_no, line)``; a few lines per category.

    Numbers stand in the order of ``METRICS``, categories by the gain of their best price.
    """
    question = lookup("question_no - 1", QUESTIONS)
    listed = ", ".join(quoted(m) for m in METRICS)
    place = f"array_position(array({listed}), metric)"
    bullet = _bullet(_title("metric"), "display")
    answers = (
        display_answers(answers)
        .groupBy("question_no")
        .agg(*exprs(bullets=f"transform(sort_array(collect_list(struct({place} AS n, {bullet} AS b))), x -> x.b)"))
        .selectExpr(
            "10 + question_no AS ord",
            "0D AS rank",
            f"concat(array(concat('### ', question_no, '. ', {question})), bullets) AS lines",
        )
    )
    cohorts = cohorts.selectExpr(
        "30 + insight_no AS ord", "0D AS rank", f"array({_bullet(_title('insight'), 'display')}) AS lines"
    )
    facts = [
        ("Current Average Price", "format_string('$%.2f', current_avg_price)"),
        ("Price Elasticity", "format_string('%.2f', price_elasticity)"),
        ("Optimal Price", "format_string('$%.2f', optimal_price)"),
        ("Potential Revenue Increase", "potential_revenue_increase"),
        ("Strategy", "strategy"),
    ]
    bullets = ", ".join(_bullet(f"'{name}'", value) for name, value in facts)
    pricing = pricing.selectExpr(
        "50 AS ord", "0D - revenue_change_pct AS rank", f"array(concat('### ', category), {bullets}) AS lines"
    )
    titles = [(0, "# Business Insights Report")]
    titles += [(n, f"## Part {i}: {p}") for i, (n, p) in enumerate(zip((10, 30, 49), PARTS), 1)]
    cells = ", ".join(f"{n}, 0D, array('{t}')" for n, t in titles)
    headings = pricing.sparkSession.range(1).selectExpr(
        f"stack({len(titles)}, {cells}) AS (ord, rank, lines)"
    )
    return (
        headings.unionByName(answers)
        .unionByName(cohorts)
        .unionByName(pricing)
        .selectExpr("ord", "rank", "lines[0] AS head", "posexplode(lines) AS (pos, line)")
        .selectExpr("struct(ord, rank, head, pos) AS line_no", "line")
    )

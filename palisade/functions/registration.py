"""The library's expressions as SQL functions.

``mask_value(category, value)``, ``classify_column(name)``, ``check_type(classification)`` and ``detect_pii(text)`` become
SQL functions whose bodies are expressions, so they inline into the calling plan and no Python runs.  ``detect_pii`` gives
an array of findings (to explode it, name it in a subquery first: Spark takes no SQL function inside a generator); scans with offsets and contexts belong to
:func:`palisade.plans.scan.scan_pages`.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from palisade.functions.masking import mask_value
from palisade.functions.patterns import SPACE_CHARS, compile_rule
from palisade.functions.text import sql_string
from palisade.operators.classify import check_type, classify_column
from palisade.rules import PII_RULES

_RESULT = "classification string, confidence double, risk_level string, recommendation string, match_method string"


def _body(spark: SparkSession, parameters: str, expression: Column) -> str:
    """SQL text of an expression over the named string parameters."""
    frame = spark.createDataFrame([], parameters).select(expression.alias("x"))
    return frame._jdf.queryExecution().analyzed().expressions().head().child().sql()


def _define(spark, name: str, parameters: str, returns: str, expression: Column | str) -> None:
    body = expression if isinstance(expression, str) else _body(spark, parameters, expression)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def detect_pii_sql(rules: tuple = PII_RULES) -> str:
    """The expression behind ``detect_pii``: hits of all rules in the text, the first of each value, in the order of the rules."""
    spaces = sql_string(SPACE_CHARS)

    def hits(k, rule):
        found = (f"transform(regexp_extract_all(s, {sql_string(compile_rule(rule))}, 0), "
                 f"(h, i) -> named_struct('value', btrim(h, {spaces}), 'rule_order', {k}, 'place', i))")
        return f"if(s RLIKE '\\\\p{{Nd}}', {found}, array())" if (rule.guard or "").startswith("near:") else found

    def attribute(name, quote):
        return f"element_at(array({', '.join(quote(getattr(r, name)) for r in rules)}), f.rule_order + 1)"

    everything = f"array_sort(filter(flatten(array({', '.join(hits(k, r) for k, r in enumerate(rules))})), f -> f.value <> ''))"
    first = _let(everything, "a", "filter(a, (f, i) -> i = 0 OR get(a, i - 1).value <> f.value)")
    ordered = f"array_sort(transform({first}, f -> named_struct('rule_order', f.rule_order, 'place', f.place, 'value', f.value)))"
    named = (f"transform({ordered}, f -> named_struct('category', {attribute('category', sql_string)}, 'value', f.value, "
             f"'risk_level', {attribute('risk', sql_string)}, 'confidence', {attribute('confidence', lambda v: f'{v}D')}))")
    return _let(f"btrim(text, {spaces})", "s", f"CASE WHEN s = '' OR s LIKE '[PAGE%' THEN array() ELSE {named} END")


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL."""
    _define(spark, "mask_value", "category string, value string", "string", mask_value(F.col("category"), F.col("value")))
    _define(spark, "classify_column", "name string", f"struct<{_RESULT.replace(' ', ':').replace(',:', ',')}>",
            classify_column(F.col("name")))
    _define(spark, "check_type", "classification string", "string", check_type(F.col("classification")))
    _define(spark, "detect_pii", "text string",
            "array<struct<category:string,value:string,risk_level:string,confidence:double>>", detect_pii_sql())

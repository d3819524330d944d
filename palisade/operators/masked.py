"""Pages with every detected value masked in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.masking import mask_value
from palisade.functions.text import SPACE_CHARS, let, running_max, strip
from palisade.operators.detect import _meta, locate_matches
from palisade.rules import PII_RULES


def _cut(body: Column, start: Column, end: Column) -> Column:
    """Text between two byte offsets; a binary slice does not walk the text."""
    return F.substring(body, start + 1, F.greatest(end - start, F.lit(0))).cast("string")


def _masked(text: Column, matches: Column, rules: tuple) -> Column:
    """One pass over the hits in order of start, longer ones first.

    A hit inside an earlier one is dropped; of one that sticks out, what sticks out becomes ``*`` for each character.
    """
    lead = F.octet_length(text) - F.octet_length(F.ltrim(text, F.lit(SPACE_CHARS)))
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["first"].alias("first"), (-m["last"]).alias("back"), m["rule_order"].alias("rule_order"), m["raw"].alias("raw"))))

    def pieces(body, hits, reach):
        def piece(h, i):
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
            first, last = h["first"] + lead, lead - h["back"]
            start = F.when(i == 0, F.lit(0)).otherwise(before + lead)
            return F.when((i > 0) & (before >= -h["back"]), "").when(
                (i == 0) | (before <= h["first"]),
                F.concat(_cut(body, start, first), mask_value(_meta(rules, "category", h["rule_order"]), strip(h["raw"])))).otherwise(
                F.repeat(F.lit("*"), F.length(_cut(body, start, last))))

        rest = _cut(body, F.element_at(reach, -1) + lead, F.octet_length(body))
        return F.concat(F.array_join(F.transform(hits, piece), ""), rest)

    def put(hits):
        return let(running_max(F.transform(hits, lambda h: -h["back"])),
                   lambda reach: let(text.cast("binary"), lambda body: pieces(body, hits, reach)))

    return F.when(F.coalesce(F.size(matches), F.lit(0)) <= 0, text).otherwise(let(ordered, put))


def mask_pages(pages: DataFrame, rules: tuple = PII_RULES, text: str = "text", into: str = "masked") -> DataFrame:
    """Adds the page's text with all hits of all rules masked, put together once from the gaps and the masked hits."""
    found = locate_matches(pages, {"_hits": (rules, 1)}, text, byte_offsets=True)
    return found.withColumn(into, _masked(F.col(text), F.col("_hits"), rules)).drop("_hits")

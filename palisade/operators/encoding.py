"""Encoding guard: nine deterministic checks on the unstripped page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.patterns import SPACE, compile_pattern
from palisade.functions.text import let, percent, strip
from palisade.operators.detect import FINDINGS_TYPE, no_findings
from palisade.rules import ALLOWED_NON_ASCII, OCR_RULES, SCRIPTS, STOP_WORDS, UTF8_NAMES


def is_image_only(text: Column) -> Column:
    return strip(text).startswith("[PAGE") & text.contains("Image-only")


def unexpected_chars(text: Column) -> Column:
    """The page's non-ASCII characters outside the allow-list, in order."""
    return F.regexp_replace(text, f"[\\x00-\\x7F{ALLOWED_NON_ASCII}]+", "")


def sample_chars(unexpected: Column, n: int = 8) -> Column:
    return F.slice(F.array_distinct(F.filter(F.split(unexpected, ""), lambda c: c != "")), 1, n)


def scripts(unexpected: Column) -> Column:
    """Scripts with at least three characters.  No allowed character lies in a script range,
    so the short string of unexpected characters is enough to look at."""
    def present(low, high):
        left = F.regexp_replace(unexpected, f"[\\x{{{low:X}}}-\\x{{{high:X}}}]+", "")
        return F.length(unexpected) - F.length(left) >= 3

    return F.array_compact(F.array(*[F.when(present(lo, hi), F.lit(name)) for name, lo, hi in SCRIPTS]))


# Cheap tests that must hold before the costlier pattern can match.
_OCR_GATES = {
    "Isolated chars": compile_pattern(r"\s{3}"),
    "Slashes mid-word": r"[|\\/]{2}",
}


def ocr_issues(text: Column) -> Column:
    """Labels of the corruption patterns found, in table order."""
    tests = []
    for name, pattern, edges in OCR_RULES:
        hit = text.rlike(compile_pattern(pattern, edges=edges))
        if name in _OCR_GATES:
            hit = text.rlike(_OCR_GATES[name]) & hit
        tests.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*tests))


_KNOWN = sorted({w for words in STOP_WORDS.values() for w in words})
# Capitals of every letter that occurs in a stop word: lowering whole pages by
# locale rules costs several times as much.
_UPPER = "".join(sorted({c.upper() for words in STOP_WORDS.values() for w in words for c in w}))


def longer_than(text: Column, n: int) -> Column:
    """Is the stripped text, with every white-space run as one character, longer than ``n``?  Stops reading there."""
    unit = compile_pattern(r"\s") + "++|" + f"[^{SPACE}]"
    return strip(text).rlike(f"^(?:{unit}){{{n + 1}}}")


def detect_language(text: Column) -> Column:
    """Language whose function words occur most often; null when none occurs."""
    words = F.split(F.translate(text, _UPPER, _UPPER.lower()), r"[^\p{L}]+")
    hits = F.filter(words, lambda w: w.isin(_KNOWN))

    def counted(code):
        return lambda found: F.struct(F.size(F.filter(found, lambda w: w.isin(list(STOP_WORDS[code])))).alias("n"),
                                      F.lit(-list(STOP_WORDS).index(code)).alias("place"), F.lit(code).alias("code"))

    best = let(hits, lambda found: F.array_max(F.array(*[counted(code)(found) for code in STOP_WORDS])))
    return F.when(best["n"] > 0, best["code"])


def _flag(order: int, category: str, severity: Column, confidence: float, note: Column) -> Column:
    return F.struct(
        F.lit(order).alias("rule_order"), F.lit(0).alias("start"), F.lit(0).alias("end"),
        F.lit(category).alias("category"), F.lit("").alias("value"), F.lit("").alias("context"),
        F.lit(confidence).alias("confidence"), severity.alias("risk_level"),
        F.lit(None).cast("string").alias("detection_method"), note.alias("note"))


def detect_encoding(pages: DataFrame, rules: dict, text: str = "text", language: Column | None = None,
                    into: str = "encoding") -> DataFrame:
    """Add the array of encoding findings.

    ``language``: a column to trust instead of the stop-word detector.  A page without a text (null) has no findings.
    """
    threshold = rules.get("non_ascii_threshold", 5)
    allowed = list(rules.get("allowed_languages", ["en"]))
    min_confidence = rules.get("min_encoding_confidence", 0.85)
    body, name, conf = F.col(text), F.col("detected_encoding"), F.col("encoding_confidence")
    lang = language if language is not None else detect_language(body)
    parts = pages.withColumns({
        "_image": is_image_only(body),
        "_odd": unexpected_chars(body),
        "_ocr": ocr_issues(body),
        "_lang": F.when(longer_than(body, 80), lang),
    })
    parts = parts.withColumns({"_count": F.length("_odd"), "_scripts": scripts(F.col("_odd"))})
    count, ocr = F.col("_count"), F.col("_ocr")
    listed = "[" + ", ".join(repr(a) for a in allowed) + "]"
    checks = [
        F.when(count > threshold, _flag(
            0, "NON_ASCII_CHARS", F.when(count > 50, "high").otherwise("medium"), 0.97,
            F.concat(count.cast("string"), F.lit(" unexpected non-ASCII characters found")))),
        F.when(F.size("_scripts") > 0, _flag(
            1, "MULTILINGUAL_CONTENT", F.lit("medium"), 0.93,
            F.concat(F.lit("Non-Latin scripts detected: "), F.array_join("_scripts", ", ")))),
        F.when(F.size(ocr) > 0, _flag(
            2, "OCR_CORRUPTION", F.when(F.size(ocr) >= 2, "high").otherwise("medium"), 0.85,
            F.concat(F.lit("OCR corruption patterns: "), F.array_join(F.slice(ocr, 1, 3), ", ")))),
        F.when(conf < min_confidence, _flag(
            3, "LOW_ENCODING_CONFIDENCE", F.when(conf < 0.60, "high").otherwise("medium"), 0.90,
            F.concat(F.lit("chardet detected '"), name, F.lit("' with "), percent(conf), F.lit(" confidence")))),
        F.when((name != "") & ~F.lower(name).isin(*UTF8_NAMES), _flag(
            4, "NON_UTF8_ENCODING", F.lit("high"), 0.88,
            F.concat(F.lit("Expected UTF-8, detected '"), name, F.lit("'")))),
        F.when(F.col("_lang").isNotNull() & ~F.col("_lang").isin(*allowed), _flag(
            5, "NON_ALLOWED_LANGUAGE", F.lit("medium"), 0.80,
            F.concat(F.lit("Language '"), F.col("_lang"), F.lit(f"' detected; allowed: {listed}")))),
    ]
    image = _flag(0, "IMAGE_ONLY_PAGE", F.lit("info"), 1.0,
                  F.lit("No extractable text — OCR required for compliance scan"))
    found = F.when(F.col("_image"), F.array(image)).when(body.isNotNull(), F.array_compact(F.array(*checks))).otherwise(no_findings())
    return parts.withColumn(into, found.cast(FINDINGS_TYPE)).drop("_image", "_odd", "_ocr", "_lang", "_count", "_scripts")



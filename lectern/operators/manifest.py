"""The index of sessions: identifiers, classes and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in the order of precedence: marks in folded titles.
CATEGORIES = [("ASAMBLEA LEGISLATIVA", "assembly"), ("PRESENTACION DE PRESUPUESTO", "budget_presentation"), ("EXPRESIONES EN MINORIA", "expressions_in_minority"), ("PREPARATORIA", "preparatory"), ("HOMENAJE", "homage"), ("INFORMATIVA", "informative"), ("SESION", "legislative_debate"), ("ORDINARIA", "legislative_debate"), ("EXTRAORDINARIA", "legislative_debate")]
TERMS = [("PRORROGA", "extension"), ("EXTRAORDINARIA", "extraordinary"), ("ORDINARIA", "ordinary")]


def _first(title: Column, marks: list[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for mark, value in reversed(marks):
        out = F.when(F.contains(title, F.lit(mark)), value).otherwise(out)
    return out


def category(folded_title: Column) -> Column:
    return _first(folded_title, CATEGORIES, "other")


def term(folded_title: Column, category_: Column) -> Column:
    return F.when(category_.isin("assembly", "budget_presentation"), "unknown").otherwise(_first(folded_title, TERMS, "unknown"))


def event_status(folded_title: Column, has_pdf: Column) -> Column:
    return F.when(F.contains(folded_title, F.lit("NO EFECTUADA")), "not_held").when(F.contains(folded_title, F.lit("FRACASADA")), "failed").when(has_pdf, "held").otherwise("unknown")


def source_record_id(period: Column, day: Column, meeting: Column, folded_title: Column) -> Column:
    """Twenty hexadecimal digits from period, day and meeting, or title where there is no meeting."""
    head = F.concat(F.lit("deputies|period="), period.cast("string"), F.lit("|date="), day.cast("string"))
    tail = F.when(meeting.isNotNull(), F.concat(F.lit("|meeting="), meeting.cast("string"))).otherwise(F.concat(F.lit("|title="), folded_title))
    return F.substring(F.sha2(F.concat(head, tail), 256), 1, 20)


def entry_date(text: Column) -> Column:
    return F.try_to_date(F.regexp_extract(text, r"\((\d{2}/\d{2}/\d{4})\)\s*$", 1), "dd/MM/yyyy")


def without_date(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(text, r"\(\d{2}/\d{2}/\d{4}\)\s*$", ""))


def number_before(text: Column, word: str) -> Column:
    """Number printed before a word, as in ``3ª Reunión``."""
    return F.regexp_extract(text, rf"(?i)(\d+)\s*[ªº°a-z]*\.?\s*{word}", 1).try_cast("long")


def summary(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("sessions"), F.count_distinct("period").alias("periods"), F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"), F.count_if("has_pdf").alias("with_pdf"), F.count_if(F.col("category") == "legislative_debate").alias("debates"))


def select_in_order(selection: DataFrame, manifest: DataFrame, key: str, needed: str) -> DataFrame:
    """Ordered selection with its manifest rows; ``problem`` says what is missing."""
    out = selection.join(manifest.withColumn("_found", F.lit(True)), key, "left")
    problem = F.when(F.col("_found").isNull(), "not in the manifest").when(F.coalesce(F.trim(needed), F.lit("")) == "", f"{needed} is blank")
    return out.withColumn("problem", problem).drop("_found")

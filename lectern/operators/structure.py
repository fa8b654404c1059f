"""Zones and roles of blocks: document-wide anchors and a carried section role, with windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X

#: The formulas and headings of the proceedings, matched on folded text.
CHAIR = r"(?m)^\s*(?:SR|SRA)\.\s+PRESIDENT(?:E|A)\b"
OTHER_SPEAKER = r"(?m)^\s*(?:SR|SRA)\.\s+(?!PRESIDENT(?:E|A)\b)[A-Z]"
OPENINGS = ["QUEDA ABIERTA LA SESION", "SE ABRE LA SESION", "SE DECLARA ABIERTA LA SESION", "DECLARO ABIERTA LA SESION"]
CLOSINGS = ["QUEDA LEVANTADA LA SESION", "SE LEVANTA LA SESION", "SE CIERRA LA SESION", "SE DA POR LEVANTADA LA SESION"]
RESUMPTIONS = ["CONTINUA LA SESION", "SE REANUDA LA SESION"]
INTERMISSION = r"\bSE\s+PASA\s+A\s+CUARTO\s+INTERMEDIO\b"
HOUR = r"(?m)^\s*[-–]?\s*ES\s+LA\s+HORA\b"
DIRECTOR = r"\bDIRECTOR\s+DEL\s+CUERPO\s+DE\s+TAQUIGRAFOS\b"
VOTE = r"(?m)^\s*[-–]?\s*(?:SE\s+PRACTICA|FINALIZADA)\s+LA\s+VOTACION\s+NOMINAL\b|^\s*[-–]?\s*VOTAN\s+POR\s+LA\s+(?:AFIRMATIVA|NEGATIVA)\b|\bCONFORME\s+AL\s+TABLERO\s+ELECTRONICO\b"
ATTENDANCE = r"(?m)^\s*(?:PRESENTES|AUSENTES)(?:,\s+CON\s+(?:AVISO|LICENCIA))?\s*:"
NUMERAL = r"(?:(?:[IVXLCDM]+|[A-Z])\.\s+)?"
APPENDIX_LINE = r"(?:\d+\s+)?APENDICE"
SANCTIONS_LINE = NUMERAL + r"SANCIONES\s+DE\s+LA\s+HONORABLE\s+CAMARA"
VOTES_LINE = NUMERAL + r"ACTAS?\s+DE\s+VOTACIONES?\s+NOMINALES?(?:\s+NUMEROS?.*)?"
INSERTIONS_LINE = NUMERAL + r"INSERCIONES(?:\s+SOLICITADAS|\s+DE\s+LOS.*)?"
SUMMARY_LINE = "SUMARIO"
CHAMBER = "CAMARA DE DIPUTADOS DE LA NACION"

_DOC = "source_record_id"


def _formula(phrases: list[str]) -> str:
    """A pattern for any of some phrases, with any white space between words."""
    return r"\b(?:" + "|".join(p.replace(" ", r"\s+") for p in phrases) + r")\b"


OPENING, CLOSING, RESUMPTION = map(_formula, (OPENINGS, CLOSINGS, RESUMPTIONS))


def running_header(folded: Column) -> Column:
    flat = F.trim(F.regexp_replace(folded, r"\s+", " "))
    named = F.contains(flat, F.lit(CHAMBER))
    in_header = flat.rlike("^[0-9]+$") | named | F.contains(flat, F.lit("REUNION "))
    near_top = (F.col("page_height") > 0) & (F.col("y1") <= F.col("page_height") * 0.18) & named
    return (flat != "") & (F.length(flat) <= 150) & F.when(F.col("region") == "header", in_header).otherwise(near_top)


def running_footer(folded: Column) -> Column:
    return (F.col("region") == "footer") & F.trim(F.regexp_replace(folded, r"\s+", " ")).rlike("^[0-9]+$")


def classify(blocks: DataFrame) -> DataFrame:
    """Add zone, role, inclusion, reason, method and confidence to every block, and which ones the proceedings start, end and are followed at.

    Blocks carry ``source_record_id, page_number, reading_order, region, y1, page_height, text``.
    A document without a chair's word has null zones: see ``without_anchor``.
    """
    order = W.partitionBy(_DOC).orderBy("page_number", "reading_order")
    whole = W.partitionBy(_DOC)
    b = blocks.withColumn("_f", X.fold_lines(F.col("text"))).withColumn("_i", F.row_number().over(order))
    f, i = F.col("_f"), F.col("_i")
    first = lambda test: F.min(F.when(test, i)).over(whole)
    b = b.withColumn("_start", first(f.rlike(CHAIR)))
    later = i >= F.col("_start")
    b = b.withColumn("_close", first(f.rlike(CLOSING) & later)).withColumn("_appendix", first(X.is_folded_label(APPENDIX_LINE, f) & later)).withColumn("_n", F.max(i).over(whole))
    close, appendix = F.col("_close"), F.col("_appendix")
    b = b.withColumn("_post", F.when(close.isNotNull(), close + 1).when(appendix.isNotNull(), appendix).otherwise(F.col("_n") + 1))
    b = b.withColumn("end_method", F.when(close.isNotNull(), "explicit_closing").when(appendix.isNotNull(), "appendix_fallback").otherwise("document_end"))
    before_appendix = later & (i < appendix)
    b = b.withColumn("_pause", F.when(close.isNull() & appendix.isNotNull(), F.max(F.when(f.rlike(INTERMISSION) & before_appendix, i)).over(whole)))
    b = b.withColumn("_resumed", F.max(F.when(f.rlike(RESUMPTION) & (i > F.col("_pause")) & (i < appendix), 1)).over(whole))
    tail = F.when(F.col("_resumed").isNull(), F.col("_pause"))
    zone = F.when(F.col("_start").isNull(), F.lit(None)).when(i < F.col("_start"), "front_matter").when(i < F.col("_post"), "proceedings").otherwise("post_proceedings")
    b = b.withColumn("structural_zone", zone)
    front, body = zone == "front_matter", zone == "proceedings"
    zone_method = F.when(front, "before_first_chair").when(body, F.concat(F.lit("proceedings_"), "end_method")).otherwise(F.concat(F.lit("post_"), "end_method"))
    spoken = f.rlike(OTHER_SPEAKER)
    procedural = ~spoken & (f.rlike(INTERMISSION) | f.rlike(HOUR) | f.rlike(DIRECTOR) | f.rlike(OPENING) | f.rlike(CLOSING))
    line = lambda p: X.is_folded_label(p, f)
    marginal = running_header(f) | running_footer(f)
    post = ~front & ~body
    section = F.when(post & ~marginal & ~line(APPENDIX_LINE), F.when(line(SANCTIONS_LINE), "sanction_text").when(line(VOTES_LINE), "vote_record").when(line(INSERTIONS_LINE), "insertion"))
    b = b.withColumn("_section", F.last(section, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rules: list[tuple[Column, Column, str | Column, float | Column]] = [
        (running_header(f), F.lit("running_header"), "geometric_running_header", 0.99), (running_footer(f), F.lit("running_footer"), "geometric_running_footer", 0.99),
        (front & (F.col("page_number") == 1), F.lit("cover"), "first_page", 0.9), (front & line(SUMMARY_LINE), F.lit("summary"), "summary_heading", 1.0),
        (front & f.rlike(ATTENDANCE), F.lit("attendance"), "attendance_heading", 0.95), (front, F.lit("other"), "front_matter_default", 0.8),
        (body & (F.coalesce(i >= tail, F.lit(False)) | procedural), F.lit("procedural"), "procedural_marker", 0.98), (body & ~spoken & f.rlike(VOTE), F.lit("vote_record"), "vote_record_marker", 0.95),
        (body, F.lit("transcript"), "proceedings_default", 0.9), (line(APPENDIX_LINE), F.lit("procedural"), "appendix_heading", 1.0),
        (line(SANCTIONS_LINE), F.lit("sanction_text"), "sanctions_section_heading", 1.0), (line(VOTES_LINE), F.lit("vote_record"), "vote_section_heading", 1.0), (line(INSERTIONS_LINE), F.lit("insertion"), "insertion_section_heading", 1.0),
        (F.lit(True), F.coalesce("_section", F.lit("other")), "post_section_state", F.when(F.col("_section").isNull(), 0.75).otherwise(0.95)),
    ]
    role, method, sure = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for test, r, m, c in reversed(rules):
        role, method, sure = F.when(test, r).otherwise(role), F.when(test, F.lit(m)).otherwise(method), F.when(test, c if isinstance(c, Column) else F.lit(c)).otherwise(sure)
    end_sure = F.when(close.isNotNull(), 1.0).when(appendix.isNotNull(), 0.95).otherwise(0.8)
    b = b.withColumn("content_role", F.when(F.col("_start").isNotNull(), role)).withColumn("classification_method", F.concat_ws("+", zone_method, method)).withColumn("classification_confidence", F.round(F.least(end_sure, sure), 3))
    included = body & (F.col("content_role") == "transcript")
    marginal_roles = ["running_header", "running_footer", "procedural", "vote_record"]
    reason = F.when(included, F.lit(None)).when(F.col("content_role").isin(*marginal_roles), F.col("content_role")).otherwise(F.col("structural_zone"))
    anchors = {"is_start_anchor": F.col("_start"), "is_end_anchor": F.coalesce(close, appendix), "is_post_start_anchor": F.col("_post")}
    b = b.withColumns({name: F.coalesce(i == at, F.lit(False)) for name, at in anchors.items()})
    return b.withColumn("include_in_discourse", F.coalesce(included, F.lit(False))).withColumn("exclusion_reason", reason).drop(*[c for c in b.columns if c.startswith("_")])


def without_anchor(classified: DataFrame) -> DataFrame:
    """Documents in which no chair speaks, so that nothing can be classified."""
    return classified.groupBy(_DOC).agg(F.count("structural_zone").alias("zoned")).where("zoned = 0").select(_DOC)


def page_roles(classified: DataFrame) -> DataFrame:
    """Zone and role counts of each page as sorted maps, included characters and words, anchors, and whether a page is mixed."""
    keys = [_DOC, "page_number"]

    def counted(column: str, name: str) -> DataFrame:
        n = classified.groupBy(*keys, column).agg(F.count("*").alias("n"))
        return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    text = F.when(F.col("include_in_discourse"), F.col("text"))
    anchors = [F.bool_or(f"is_{a}_anchor").alias(f"contains_{a}_anchor") for a in ("start", "end", "post_start")]
    base = classified.groupBy(*keys).agg(*anchors, F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("included_characters"), F.coalesce(F.sum(F.size(X.words(text))), F.lit(0)).alias("included_words"))
    out = base.join(counted("structural_zone", "zone_counts"), keys).join(counted("content_role", "role_counts"), keys)
    return out.withColumn("has_mixed_zones", F.size("zone_counts") > 1).withColumn("has_mixed_roles", F.size("role_counts") > 1)

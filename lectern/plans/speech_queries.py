"""Layout, zones, speakers and turns; ``conversations`` play the blocks of a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import layout as L
from lectern.operators import speakers as S
from lectern.operators import structure as Z
from lectern.plans.base import query, table

_KIND = "CASE role WHEN 'user' THEN 'marker' WHEN 'assistant' THEN 'gap' ELSE 'reset' END"


@query(f"""WITH e AS (SELECT conv_id, turn, role, {_KIND} AS kind FROM conversations), p AS (SELECT *, sum(CAST(kind = 'reset' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS ep FROM e),
o AS (SELECT *, sum(CAST(kind = 'marker' AS INT)) OVER w AS op, sum(CAST(kind = 'gap' AS INT)) OVER w AS gp FROM p WINDOW w AS (PARTITION BY conv_id, ep ORDER BY turn)),
n AS (SELECT *, CAST(sum(CAST(kind = 'marker' OR (kind = 'gap' AND op = 0 AND gp = 1) AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_index FROM o) SELECT conv_id, turn, kind, turn_index, op > 0 AS is_attributed FROM n WHERE kind <> 'reset'""")
def turn_index(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "marker").when(F.col("role") == "assistant", "gap").otherwise("reset")
    e = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"))
    return S.number_turns(e, "conv_id", ["turn"])


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN 'Sr.' ELSE 'Sra.' END AS title, CASE WHEN turn % 3 = 0 THEN '.-' WHEN turn % 3 = 1 THEN '. –' ELSE ' -' END AS sep, regexp_replace(text, '[.\\-–—]', ',', 'g') AS body FROM conversations), m AS (SELECT *, title || ' ' || role || sep AS marker FROM c)
SELECT conv_id, turn, 0::BIGINT AS start, length(marker) AS "end", role AS raw_label, upper(title) AS normalized_title, marker AS raw_marker, 'block_start' AS position, CASE WHEN sep = ' -' THEN 'explicit_honorific_dash_only' ELSE 'explicit_honorific_dot_dash' END AS detection_method, CASE WHEN sep = ' -' THEN 0.95 ELSE 1.0 END::DOUBLE AS detection_confidence FROM m
UNION ALL SELECT conv_id, turn, length(marker) + length(body) + 2, length(marker) + length(body) + 2 + 18, 'Pérez Gómez', 'SRA.', 'Sra. Pérez Gómez.-', 'embedded', 'explicit_honorific_dot_dash', 1.0::DOUBLE FROM m""")
def speaker_markers(spark, sf_dir):
    """A marker before and one within each text, whose own points and dashes become commas."""
    title, c = F.when(F.col("conv_id") % 2 == 0, "Sr.").otherwise("Sra."), table(spark, sf_dir, "conversations")
    sep = F.when(F.col("turn") % 3 == 0, ".-").when(F.col("turn") % 3 == 1, ". –").otherwise(" -")
    body = F.concat(title, F.lit(" "), "role", sep, F.lit(" "), F.regexp_replace("text", "[.\\-–—]", ","), F.lit("\nSra. Pérez Gómez.- Gracias"))
    m = c.select("conv_id", "turn", F.explode(S.speaker_markers(body)).alias("m"))
    return m.select("conv_id", "turn", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.raw_label", "m.normalized_title", "m.raw_marker", "m.position", "m.detection_method", "m.detection_confidence")


_OFFICES = ["Presidente de la Nación", "Presidenta", "Vicepresidente 1°", "Secretario", "Ministro de Economía", "Secretaria de Energía", "Subsecretario de", "Varios señores diputados", "Jefe de Gabinete", "Pérez"]
_ENDS = ["", ".-", " (Camaño)", " de la Nación", " y voces"]
_LABEL_SQL = "[" + ", ".join(f"'{o}'" for o in _OFFICES) + f"][event_id % {len(_OFFICES)} + 1] || [" + ", ".join(f"'{e}'" for e in _ENDS) + f"][event_id // {len(_OFFICES)} % {len(_ENDS)} + 1]"


@query(rf"""WITH l AS (SELECT event_id, regexp_replace(trim(regexp_replace(upper(strip_accents(replace({_LABEL_SQL}, '°', '°'))), '\s+', ' ', 'g')), '^[ .,:;–—-]+|[ .,:;–—-]+$', '', 'g') AS label FROM events)
SELECT event_id, CASE WHEN label IN ('PRESIDENTE DE LA NACION', 'PRESIDENTA DE LA NACION') THEN 'executive_official' WHEN regexp_matches(label, '\bVICEPRESIDENT[EA]\b|\bPRESIDENT[EA]\b') THEN 'chair' WHEN label IN ('SECRETARIO', 'SECRETARIA') OR regexp_matches(label, '^SECRETARI[OA] *\(') THEN 'chamber_secretary'
 WHEN regexp_matches(label, '\b(JEFE DE GABINETE|MINISTRO|MINISTRA|SUBSECRETARIO|SUBSECRETARIA|SECRETARIO DE|SECRETARIA DE)\b') THEN 'executive_official' WHEN regexp_matches(label, '\b(VARIOS|VARIAS|VOCES|DIPUTADOS|DIPUTADAS)\b') THEN 'collective_or_anonymous' ELSE 'named_or_role_unspecified' END AS family FROM l""")
def speaker_families(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(t) for t in values]), (k % len(values) + 1).cast("int"))
    label = F.concat(pick(_OFFICES, F.col("event_id")), pick(_ENDS, F.floor(F.col("event_id") / len(_OFFICES))))
    e = table(spark, sf_dir, "events").select("event_id", X.label_text(label).alias("label"))
    return e.select("event_id", S.family(F.col("label")).alias("family"))


def _blocks(spark, sf_dir):
    """Blocks with geometry made from their numbers."""
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id") * 31 + F.col("turn") * 17
    x0 = (k % 5 * 90 + 40).cast("double")
    y0 = (k % 29 * 25).cast("double")
    return c.select(F.format_string("s%03d", F.col("conv_id") % 50).alias("source_record_id"), (F.col("conv_id") / 50).cast("int").alias("page_number"), F.col("turn").cast("int").alias("raw_block_number"), x0.alias("x0"), y0.alias("y0"), (x0 + k % 3 * 110 + 60).alias("x1"), (y0 + 20).alias("y1"), "text", F.lit(500.0).alias("width"), F.lit(700.0).alias("height"))


_REGION = "CASE WHEN y1 <= 63 THEN 'header' WHEN y0 >= 651 THEN 'footer' WHEN (x0 < 250 AND 250 < x1 AND x1 - x0 >= 175) OR (abs((x0 + x1) / 2 - 250) <= 15 AND x1 - x0 >= 40) THEN 'body_full' WHEN (x0 + x1) / 2 < 250 THEN 'body_left' ELSE 'body_right' END"
_BOX = "b AS (SELECT printf('s%03d', conv_id % 50) AS source_record_id, CAST(conv_id // 50 AS INTEGER) AS page_number, CAST(turn AS INTEGER) AS raw_block_number, length(text) AS n, (conv_id * 31 + turn * 17) % 5 * 90 + 40.0 AS x0, (conv_id * 31 + turn * 17) % 29 * 25.0 AS y0, (conv_id * 31 + turn * 17) % 3 * 110 + 60 AS w FROM conversations), r AS (SELECT *, x0 + w AS x1, y0 + 20 AS y1 FROM b), g AS (SELECT *, " + _REGION + " AS region FROM r)"


@query(f"WITH {_BOX} SELECT source_record_id, page_number, raw_block_number, region FROM g")
def block_regions(spark, sf_dir):
    return _blocks(spark, sf_dir).select("source_record_id", "page_number", "raw_block_number", L.region().alias("region"))


@query(f"WITH {_BOX} SELECT source_record_id, page_number, CASE WHEN coalesce(sum(n) FILTER (WHERE region = 'body_left'), 0) < 50 OR coalesce(sum(n) FILTER (WHERE region = 'body_right'), 0) < 50 THEN 'single_column' WHEN count_if(region = 'body_full') > 0 THEN 'mixed' ELSE 'two_column' END AS layout FROM g GROUP BY ALL")
def page_layouts(spark, sf_dir):
    return L.page_layout(_blocks(spark, sf_dir).withColumn("region", L.region()))


_ORDERED = f"""{_BOX}, y AS (SELECT source_record_id, page_number, CASE WHEN coalesce(sum(n) FILTER (WHERE region = 'body_left'), 0) < 50 OR coalesce(sum(n) FILTER (WHERE region = 'body_right'), 0) < 50 THEN 'single_column' WHEN count_if(region = 'body_full') > 0 THEN 'mixed' ELSE 'two_column' END AS layout FROM g GROUP BY ALL),
p AS (SELECT *, (y0 + y1) / 2 AS cy FROM g JOIN y USING (source_record_id, page_number)), cut AS (SELECT source_record_id, page_number, list({{'cy': cy, 'k': raw_block_number}} ORDER BY y0, x0, raw_block_number) AS cuts FROM p WHERE region = 'body_full' AND layout <> 'single_column' GROUP BY ALL),
q AS (SELECT p.*, coalesce(cuts, []) AS cuts FROM p LEFT JOIN cut USING (source_record_id, page_number)),
z AS (SELECT *, CASE region WHEN 'header' THEN 0 WHEN 'footer' THEN 2 ELSE 1 END AS zone, CASE WHEN layout = 'single_column' THEN 0 WHEN region = 'body_full' THEN 2 * (list_position(list_transform(cuts, lambda c: c.k), raw_block_number) - 1) + 1 WHEN len(list_filter(cuts, lambda c: c.cy = cy)) > 0 THEN 2 * len(cuts) WHEN len(list_filter(cuts, lambda c: c.cy > cy)) > 0 THEN 2 * (list_position(list_transform(cuts, lambda c: c.cy > cy), true) - 1) ELSE 2 * len(cuts) END AS band,
 CASE WHEN layout <> 'single_column' AND region = 'body_right' THEN 1 ELSE 0 END AS side FROM q)"""


@query(f"WITH {_ORDERED} SELECT source_record_id, page_number, raw_block_number, region, layout, row_number() OVER (PARTITION BY source_record_id, page_number ORDER BY zone, CASE WHEN zone = 1 THEN band ELSE 0 END, side, y0, x0, raw_block_number)::INTEGER AS reading_order FROM z")
def reading_order(spark, sf_dir):
    return L.reading_order(_blocks(spark, sf_dir)).select("source_record_id", "page_number", "raw_block_number", "region", "layout", "reading_order")


_SCRIPT = {0: "HONORABLE CÁMARA", 1: "Sr. Presidente (Pérez).- Queda abierta la sesión.", 7: "- Se practica la votación nominal."}


def _session(spark, sf_dir):
    """A session for each conversation: its first blocks are formulas, the rest its own words."""
    body = F.col("text")
    for turn, text in _SCRIPT.items():
        body = F.when(F.col("turn") == turn, text).otherwise(body)
    c = table(spark, sf_dir, "conversations")
    return c.select(F.format_string("s%06d", "conv_id").alias("source_record_id"), (F.col("turn") / 3 + 1).cast("int").alias("page_number"), F.col("turn").cast("int").alias("reading_order"), F.lit("body_full").alias("region"), F.lit(100.0).alias("y1"), F.lit(700.0).alias("page_height"), body.alias("text"))


_ZONED = r"""b AS (SELECT printf('s%06d', conv_id) AS source_record_id, CAST(turn // 3 + 1 AS INTEGER) AS page_number, CAST(turn AS INTEGER) AS reading_order, CASE turn WHEN 0 THEN 'HONORABLE CÁMARA' WHEN 1 THEN 'Sr. Presidente (Pérez).- Queda abierta la sesión.' WHEN 7 THEN '- Se practica la votación nominal.' ELSE text END AS text FROM conversations),
f AS (SELECT *, upper(strip_accents(text)) AS f, row_number() OVER (PARTITION BY source_record_id ORDER BY page_number, reading_order) AS i FROM b), a AS (SELECT *, min(CASE WHEN regexp_matches(f, '(?m)^\s*SRA?\.\s+PRESIDENT(E|A)\b') THEN i END) OVER (PARTITION BY source_record_id) AS first FROM f),
z AS (SELECT *, CASE WHEN first IS NULL THEN NULL WHEN i < first THEN 'front_matter' ELSE 'proceedings' END AS structural_zone, regexp_matches(f, '(?m)^\s*SRA?\.\s+[A-Z]') AND NOT regexp_matches(f, '(?m)^\s*SRA?\.\s+PRESIDENT(E|A)\b') AS spoken, regexp_matches(f, '\b(QUEDA ABIERTA|SE ABRE|SE DECLARA ABIERTA|DECLARO ABIERTA) LA SESION\b') AS opening, regexp_matches(f, '(?m)^\s*[-–]?\s*(SE PRACTICA|FINALIZADA) LA VOTACION NOMINAL\b') AS vote FROM a),
r AS (SELECT *, CASE WHEN structural_zone IS NULL THEN NULL WHEN structural_zone = 'front_matter' THEN CASE WHEN page_number = 1 THEN 'cover' ELSE 'other' END WHEN opening AND NOT spoken THEN 'procedural' WHEN vote AND NOT spoken THEN 'vote_record' ELSE 'transcript' END AS content_role FROM z),
s AS (SELECT *, coalesce(content_role = 'transcript' AND structural_zone = 'proceedings', false) AS include_in_discourse, CASE WHEN structural_zone IS NULL THEN 'post_document_end+post_section_state' WHEN structural_zone = 'front_matter' THEN 'before_first_chair+' || CASE WHEN content_role = 'cover' THEN 'first_page' ELSE 'front_matter_default' END ELSE 'proceedings_document_end+' || CASE content_role WHEN 'procedural' THEN 'procedural_marker' WHEN 'vote_record' THEN 'vote_record_marker' ELSE 'proceedings_default' END END AS classification_method,
 CASE WHEN structural_zone IS NULL THEN 0.75 ELSE 0.8 END::DOUBLE AS classification_confidence FROM r)"""


@query(f"WITH {_ZONED} SELECT source_record_id, page_number, reading_order, 'body_full' AS region, 'document_end' AS end_method, structural_zone, content_role, classification_method, classification_confidence, include_in_discourse, CASE WHEN include_in_discourse THEN NULL WHEN content_role IN ('procedural', 'vote_record') THEN content_role ELSE structural_zone END AS exclusion_reason FROM s")
def structural_blocks(spark, sf_dir):
    """Sessions of formulas and plain words; closings, appendices and pauses, which they lack, are in the tests of rules."""
    return Z.classify(_session(spark, sf_dir)).drop("text", "y1", "page_height", "is_start_anchor", "is_end_anchor", "is_post_start_anchor")


_MAP = lambda column, name: f"{name} AS (SELECT source_record_id, page_number, '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' AS {name}, count(*) AS {name}_n FROM (SELECT source_record_id, page_number, {column} AS k, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL)"


@query(f"WITH {_ZONED}, c AS (SELECT source_record_id, page_number, CAST(coalesce(sum(length(text)) FILTER (WHERE include_in_discourse), 0) AS BIGINT) AS included_characters, CAST(coalesce(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) FILTER (WHERE include_in_discourse), 0) AS BIGINT) AS included_words, coalesce(bool_or(i = first), false) AS contains_start_anchor, false AS contains_end_anchor, false AS contains_post_start_anchor FROM s GROUP BY ALL), {_MAP('structural_zone', 'zone_counts')}, {_MAP('content_role', 'role_counts')} SELECT source_record_id, page_number, included_characters, included_words, contains_start_anchor, contains_end_anchor, contains_post_start_anchor, zone_counts, role_counts, zone_counts_n > 1 AS has_mixed_zones, role_counts_n > 1 AS has_mixed_roles FROM c JOIN zone_counts USING (source_record_id, page_number) JOIN role_counts USING (source_record_id, page_number) WHERE zone_counts IS NOT NULL")
def page_roles(spark, sf_dir):
    pages = Z.page_roles(Z.classify(_session(spark, sf_dir)))
    return pages.withColumn("zone_counts", F.to_json("zone_counts")).withColumn("role_counts", F.to_json("role_counts"))


@query(f"""WITH {_ZONED}, e AS (SELECT *, sum(CAST(NOT include_in_discourse AND i > first AS INT)) OVER (PARTITION BY source_record_id ORDER BY i) AS breaks, CASE WHEN i = first THEN ' Queda abierta la sesión.' ELSE text END AS piece FROM s WHERE structural_zone = 'proceedings'),
k AS (SELECT *, dense_rank() OVER (PARTITION BY source_record_id ORDER BY breaks) AS turn_index FROM e WHERE (include_in_discourse OR i = first) AND trim(piece) <> '') SELECT source_record_id, turn_index, breaks = 0 AS is_attributed, CASE WHEN breaks = 0 THEN 'Presidente (Pérez)' END AS raw_label, string_agg(piece, chr(10) ORDER BY i) AS text, count(*) AS segment_count FROM k GROUP BY source_record_id, turn_index, breaks""")
def session_turns(spark, sf_dir):
    """The chair's turn up to the vote, and what follows it without a speaker."""
    order = ["page_number", "reading_order", "start"]
    events = S.events(Z.classify(_session(spark, sf_dir)).where("structural_zone = 'proceedings'"))
    numbered = S.number_turns(events, "source_record_id", order)
    return S.turns(numbered, "source_record_id", order, F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))


def _segments(spark, sf_dir):
    """A turn of two segments from each row: its words, then applause and a wrapped note."""
    c = table(spark, sf_dir, "conversations")
    tail = F.lit("(Aplausos.)\n- Ocupa la Presidencia la señora vicepresidenta\nprimera de la Honorable Cámara.\nVéase el texto en el Apéndice.")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", "named_or_role_unspecified").when(F.col("role") == "assistant", "chair").alias("speaker_family"), F.array("text", tail).alias("segments"))


@query()
def content_spans(spark, sf_dir):
    """Sequential rules on lines; tests hold them case by case."""
    from lectern.operators import turncontent

    return turncontent.content_spans(_segments(spark, sf_dir)).drop("text")


@query("SELECT conv_id, turn, 1::BIGINT AS editorial_note_spans, role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '' AS has_speech FROM conversations")
def turn_statistics(spark, sf_dir):
    """All conversations; texts with notes of their own, for which the twin has no words, are held against their rules by tests."""
    from lectern.operators import turncontent

    s = turncontent.content_spans(_segments(spark, sf_dir))
    return turncontent.turn_statistics(s, ["conv_id", "turn"]).select("conv_id", "turn", "editorial_note_spans", "has_speech")


_TAIL = "'(Aplausos.)' || chr(10) || '- Ocupa la Presidencia la señora vicepresidenta' || chr(10) || 'primera de la Honorable Cámara.' || chr(10) || 'Véase el texto en el Apéndice.'"


@query(f"SELECT conv_id, turn, sha256(coalesce(text, '') || {_TAIL}) AS spans_sha256, 0::BIGINT AS gaps FROM conversations")
def lossless_spans(spark, sf_dir):
    """A turn's spans put together again are its text, and each begins where the one before it ends."""
    from lectern.operators import turncontent

    keys = ["conv_id", "turn"]
    spans = turncontent.content_spans(_segments(spark, sf_dir)).select(*keys, "segment", "start", "end", "text")
    whole = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("segment", "start", "text"))).alias("s"))  # a turn's spans
    gaps = turncontent.coverage_gaps(spans, keys).groupBy(*keys).agg(F.count("*").alias("gaps"))
    return whole.join(gaps, keys, "left").select(*keys, F.sha2(F.array_join(F.transform("s", lambda x: x["text"]), ""), 256).alias("spans_sha256"), F.coalesce("gaps", F.lit(0)).alias("gaps"))


@query()
def documentary_boundaries(spark, sf_dir):
    from lectern.operators import turncontent

    t = _segments(spark, sf_dir).select("conv_id", "turn", "speaker_family", F.array_join("segments", "\n").alias("text"))
    return turncontent.boundaries(t).select("conv_id", "turn", F.col("boundary.cue").alias("cue"))

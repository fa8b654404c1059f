"""Speaker markers inside blocks, and turns across blocks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a printed marker looks like.
_TITLE = re.compile(r"(?<!\w)(Sra?\.?)(?=\s)", re.IGNORECASE)
_DOT_DASH = re.compile(r"\.\s*[-–—]")
_DASH = re.compile(r"\s+[-–—](?=\s|$)")
_LABEL = re.compile(r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9 .,'’()/-]+")
REACH, LABEL_CHARACTERS, LABEL_WORDS, WORDS_WITHOUT_POINT = 140, 100, 12, 6

_FIELDS = {"start": T.IntegerType(), "end": T.IntegerType(), "raw_marker": T.StringType(), "raw_title": T.StringType(), "normalized_title": T.StringType(), "raw_label": T.StringType(), "separator": T.StringType(), "separator_kind": T.StringType(), "position": T.StringType(), "is_multiline": T.BooleanType(), "detection_method": T.StringType(), "detection_confidence": T.DoubleType()}
MARKER = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _FIELDS.items()]))


def _visible(x: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", x).split())


def _is_label(label: str, pointed: bool) -> bool:
    words = len(label.split())
    return bool(label) and len(label) <= LABEL_CHARACTERS and words <= (LABEL_WORDS if pointed else WORDS_WITHOUT_POINT) and bool(_LABEL.fullmatch(label)) and any(c.isalpha() for c in label)


def _separators(text: str) -> Iterator[tuple[int, int, str]]:
    dotted = [(*m.span(), "dot_dash") for m in _DOT_DASH.finditer(text)]
    lone = [(*m.span(), "dash_only") for m in _DASH.finditer(text)]
    yield from sorted(dotted + [s for s in lone if not any(s[0] < d[1] and d[0] < s[1] for d in dotted)])


def markers_of(text: str) -> list[dict]:
    """Markers ``Sr./Sra. <label>.-`` of one block: each separator takes the nearest free title whose label is plausible."""
    free = [(m.start(), m.end(), m[1]) for m in _TITLE.finditer(text)]
    found = []
    for at, end, kind in _separators(text):
        near = (t for t in reversed(free) if t[1] <= at <= t[1] + REACH)
        title = next((t for t in near if _is_label(_visible(text[t[1] : at]), t[2].endswith("."))), None)
        if title is None:
            continue
        free.remove(title)
        raw, pointed = text[title[0] : end], title[2].endswith(".")
        found.append({
            "start": title[0], "end": end, "raw_marker": raw, "raw_title": title[2], "normalized_title": "SRA." if title[2].upper().startswith("SRA") else "SR.", "raw_label": _visible(text[title[1] : at]),
            "separator": text[at:end], "separator_kind": kind, "position": "embedded" if text[: title[0]].strip() else "block_start", "is_multiline": "\n" in raw or "\r" in raw,
            "detection_method": f"explicit_honorific_{kind}" + ("" if pointed else "_title_without_period"), "detection_confidence": 1.0 if pointed and kind == "dot_dash" else 0.95,
        })
    return sorted(found, key=lambda m: (m["start"], m["end"]))


@F.pandas_udf(MARKER)
def speaker_markers(x: pd.Series) -> pd.Series:
    return x.map(lambda t: [] if t is None else markers_of(t))


# What folded labels say of a speaker, in order of precedence.
HEADS_OF_STATE = ["PRESIDENTE DE LA NACION", "PRESIDENTA DE LA NACION"]
FAMILIES = [
    ("chair", r"\b(?:VICE)?PRESIDENT[EA]\b"),
    ("chamber_secretary", r"^SECRETARI[OA](?:\s*\(|$)"),
    ("executive_official", r"\b(?:JEFE\s+DE\s+GABINETE|MINISTR[OA]|SUBSECRETARI[OA]|SECRETARI[OA]\s+DE)\b"),
    ("collective_or_anonymous", r"\b(?:VARIOS|VARIAS|VOCES|DIPUTADOS|DIPUTADAS)\b"),
]


def family(label: Column) -> Column:
    """Family of a folded label, by the first rule that fits."""
    out = F.when(label.isin(*HEADS_OF_STATE), "executive_official")
    for name, pattern in FAMILIES:
        out = out.when(label.rlike(pattern), name)
    return out.otherwise("named_or_role_unspecified")


def events(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Markers and the text between them as one ordered stream.

    ``kind`` is ``marker``, ``gap`` (text that is not blank, in a block that counts)
    or ``reset`` (a block that doesn't count and holds no marker).  Running headers
    and footers give nothing.
    """
    b = blocks.where(~F.col("content_role").isin("running_header", "running_footer")).withColumn("_m", speaker_markers(F.col(text)))
    body, n = F.col(text), F.length(text)
    cut = F.array_sort(F.concat(F.array(F.lit(0)), F.flatten(F.transform("_m", lambda m: F.array(m["start"], m["end"]))), F.array(n)))
    gaps = F.transform(F.sequence(F.lit(0), F.size("_m")), lambda k: F.struct(F.element_at(cut, (2 * k + 1).cast("int")).alias("start"), F.element_at(cut, (2 * k + 2).cast("int")).alias("end")))
    label = lambda m: m["raw_label"]
    of_marker = F.transform("_m", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("marker").alias("kind"), label(m).alias("raw_label")))
    filled = F.filter(gaps, lambda g: F.trim(F.regexp_replace(F.substring(body, g["start"] + 1, g["end"] - g["start"]), r"(?U)\s+", " ")) != "")
    of_gap = F.transform(filled, lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("raw_label")))
    off = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("reset").alias("kind"), F.lit(None).cast("string").alias("raw_label")))
    stream = F.when(F.col("include_in_discourse") | (F.size("_m") > 0), F.concat(of_marker, of_gap)).otherwise(off)
    # in a block that doesn't count, text ahead of its first marker belongs to no turn
    stream = F.filter(stream, lambda e: F.col("include_in_discourse") | (e["kind"] != "gap") | (e["start"] > 0))
    return b.select(*[c for c in blocks.columns], F.explode(stream).alias("e")).select(*blocks.columns, "e.*")


def number_turns(stream: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Add ``turn_index`` to events: a marker opens a turn; text without an open turn opens an unattributed one; a reset closes.

    All of it are running sums over one exchange by source.
    """
    by = W.partitionBy(source).orderBy(*order)
    e = stream.withColumn("_ep", F.sum((F.col("kind") == "reset").cast("int")).over(by))
    within = W.partitionBy(source, "_ep").orderBy(*order)
    e = e.withColumn("_open", F.sum((F.col("kind") == "marker").cast("int")).over(within)).withColumn("_gap", F.sum((F.col("kind") == "gap").cast("int")).over(within))
    start = (F.col("kind") == "marker") | ((F.col("kind") == "gap") & (F.col("_open") == 0) & (F.col("_gap") == 1))
    e = e.withColumn("turn_index", F.sum(start.cast("int")).over(by).cast("long"))
    return e.where("kind <> 'reset'").withColumn("is_attributed", F.col("_open") > 0).drop("_ep", "_open", "_gap")


def turns(numbered: DataFrame, source: str, order: list[str], piece: Column) -> DataFrame:
    """One row for each turn: its label and its pieces joined by line breaks."""
    gap = F.when(F.col("kind") == "gap", F.struct(*order, piece.alias("piece")))
    out = numbered.groupBy(source, "turn_index").agg(F.max("is_attributed").alias("is_attributed"), F.max("raw_label").alias("raw_label"), F.array_sort(F.collect_list(gap)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "\n")
    return out.withColumn("text", text).withColumn("segment_count", F.size("p").cast("long")).drop("p")


def inventory(rows: DataFrame, keys: list[str], first: str) -> DataFrame:
    """Speakers with their number of turns and the first one."""
    return rows.groupBy(*keys).agg(F.count("*").alias("turn_count"), F.min(first).alias("first_turn"))

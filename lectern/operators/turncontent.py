"""What a turn consists of: speech, stage directions, editorial notes and inserted documents.

A turn is an array of ordered segments.  An Arrow function partitions it
without loss into spans ``(segment, start, end, kind, method, confidence)``.
Patterns and phrases are fixed values of the proceedings; the rules are a table
of tests on a line, and three passes: the documentary boundary, spans inside
segments, and notes that run on into the next segment.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPOKEN, UNATTRIBUTED, INSERT, STAGE, NOTE = "spoken_text", "unattributed_text", "documentary_insert", "stage_direction", "editorial_note"

# Lengths of the policy.
INSERT_WORDS, LOOK_AHEAD, PROJECT_REACH, PREFIX_WORDS = 200, 6000, 3000, 250
REWIND_LINES, REWIND_CHARACTERS = 18, 1800
WRAP_LINES, WRAP_CHARACTERS, OPEN_LINES = 6, 800, 10
#: Families whose turns may hold a document, and whether only after few words.
FAMILIES = {"chair": False, "chamber_secretary": False, "named_or_role_unspecified": True, "collective_or_anonymous": True}

# Patterns on the printed text.
_I = re.IGNORECASE
ORDER_OF_DAY = re.compile(r"\(\s*ORDEN\s+DEL\s+D[IÍ]A\s+(?:N(?:[.º°]|O)?\s*)?\d[\d.]*(?:\s*(?:Y|,)\s*\d[\d.]*)?\s*\)", _I)
CODED_PROJECT = re.compile(r"\(\s*\d[\d.]*-[A-Z]\.-\d+\s*\)\s*PROYECTO\s+DE\s+(?:LEY|RESOLUCI[ÓO]N|DECLARACI[ÓO]N)\b", _I)
EXPEDIENTE = re.compile(r"(?m)^[ \t]*EXPEDIENTES?\s+\d[\d.]*-[A-Z]\.-\d+\b", _I)
PROJECT_BODY = re.compile(r"\b(?:LA\s+C[AÁ]MARA\s+DE\s+DIPUTADOS\s+DE\s+LA\s+NACI[ÓO]N|EL\s+SENADO\s+Y\s+C[AÁ]MARA\s+DE\s+DIPUTADOS)\b", _I)
FORMAL_BODY = re.compile(
    r"(?im)^[ \t]*(?:(?:I|II|III|IV|V|VI|VII|VIII|IX|X)[ \t]+)?(?:DICTAMEN\b|HONORABLE\s+C[AÁ]MARA\s*:|PROYECTO\s+DE\s+(?:LEY|RESOLUCI[ÓO]N|DECLARACI[ÓO]N)"
    r"|EL\s+SENADO\s+Y\s+C[AÁ]MARA\s+DE\s+DIPUTADOS|LA\s+C[AÁ]MARA\s+DE\s+DIPUTADOS\s+DE\s+LA\s+NACI[ÓO]N|FUNDAMENTOS\b)"
)
OFF_MICROPHONE = re.compile(r"^[ \t]*(?:[-–—]+[ \t]*)+(?:La|El)\s+señor(?:a)?\s+diputad[oa]\b.{0,800}?(?:fuera\s+de\s+micr[óo]fono|no\s+se\s+alcanzan\s+a\s+percibir).{0,400}?[.!?](?=[ \t]*(?:\r?\n|$))", re.I | re.M | re.S)
BRACKETS = re.compile(r"\(([^()]{1,500})\)", re.S)
APPLAUSE = [
    re.compile(r"(?:APLAUSOS?|RISAS?)(?:\s+Y\s+(?:APLAUSOS?|RISAS?|MANIFESTACIONES(?:\s+EN\s+(?:LAS\s+GALERIAS|LAS\s+BANCAS|LA\s+SALA))?))?(?:\s+PROLONGADOS?)?\.?"),
    re.compile(r"APLAUSOS?\.\s+VARIOS\s+SENORES\s+DIPUTADOS\s+(?:HABLAN\s+A\s+LA\s+VEZ|RODEAN\s+Y\s+FELICITAN\s+AL\s+ORADOR)\.?"),
]
SEE = re.compile(r"^[ \t]*(?:\d+[ \t]*[.)]?[ \t]+)?V[EÉ]ASE\b", _I)
SPEAKER = re.compile(r"^[ \t]*Sr(?:a)?\.?(?=\s)", _I)
GOES_ON = re.compile(r"^[\s ]*[a-záéíóúüñ]")
DEPUTY_ACTS = re.compile(r"^(?:LA|EL)\s+SENOR(?:A)?\s+DIPUTAD[OA]\b.*\s+(?:HACE|REALIZA)$")
DEPUTY_OFF = re.compile(r"^(?:LA|EL)\s+SENOR(?:A)?\s+DIPUTAD[OA]\b.*(?:FUERA\s+DE\s+MICROFONO|NO\s+SE\s+ALCANZAN\s+A\s+PERCIBIR)")

# Phrases on folded text, in order of precedence.
AGENDA, RECORD = "formal_agenda_document_bundle", "formal_judicial_electoral_record_bundle"
SIGNALS = [
    *[(AGENDA, p, True) for p in ("ORDEN DEL DIA", "HONORABLE CAMARA:", "HONORABLE CONGRESO:", "PROYECTO DE LEY", "PROYECTO DE RESOLUCION", "PROYECTO DE DECLARACION", "EL SENADO Y CAMARA DE DIPUTADOS", "LA CAMARA DE DIPUTADOS DE LA NACION")],
    *[(AGENDA, p, False) for p in ("DICTAMEN", "FUNDAMENTOS", "INFORME", "ANTECEDENTE", "ANTECEDENTES", "ANEXO", "SALA DE LAS COMISIONES")],
    *[(RECORD, p, True) for p in ("PODER JUDICIAL DE LA NACION", "JUZGADO FEDERAL", "JUNTA ELECTORAL")],
    *[(RECORD, p, False) for p in ("Y VISTOS:", "Y CONSIDERANDO", "RESUELVE:")],
]
SPOKEN_STARTS = ("CORRESPONDE ", "DICE ", "SOLICITO ", "PIDO ", "VOY ", "VAMOS ", "SE VA ", "SE VOTARA ", "TIENE ", "CONTINUA ", "CONTINUE ", "QUEDA ")
NOISE_LINES = {"MANIFESTACIONES", "MANIFESTACIONES.", "MANIFESTACIONES EN LAS BANCAS.", "MANIFESTACIONES EN LA SALA.", "MURMULLOS EN EL RECINTO."}
STAGE_STARTS = ("OCUPA LA PRESIDENCIA ", "MIENTRAS SE PRACTICA LA VOTACION", "MIENTRAS SE REALIZA LA VOTACION", "VARIOS SENORES DIPUTADOS HABLAN A LA VEZ")
DASHED_STARTS = ("LUEGO DE UNOS INSTANTES", "DESPUES DE UNOS INSTANTES", "TRANSCURRIDOS UNOS INSTANTES", "A LA HORA ", "SE PASA A CUARTO INTERMEDIO", "SE DISPONE UN CUARTO INTERMEDIO", "SE REANUDA LA SESION", "SE REANUDA EL ACTO", "SE SUSPENDE LA SESION", "MANIFESTACIONES EN LAS BANCAS", "MANIFESTACIONES EN LA SALA", "MURMULLOS EN EL RECINTO")
OPEN_PRESIDENCY = {"OCUPA LA PRESIDENCIA EL SENOR", "OCUPA LA PRESIDENCIA LA SENORA"}


@lru_cache(1 << 14)
def fold(x: str) -> str:
    """Upper case without accents, white space collapsed; a line is folded for several tests, so the last ones are kept."""
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).split()).upper()


@dataclass(frozen=True)
class Line:
    start: int
    end: int
    text: str

    @property
    def signal(self) -> tuple[str, str, bool] | None:
        """The formal phrase that the line starts with, if it is a whole word or ends in a colon."""
        x = _unnumbered(fold(self.text))
        for s in SIGNALS:
            rest = x[len(s[1]) :]
            if x.startswith(s[1]) and (not rest or s[1].endswith(":") or not (rest[0].isalnum() or rest[0] == "_")):
                return s
        return None

    @property
    def is_printed_formally(self) -> bool:
        return not (_unnumbered(self.text)[:1] or "a").islower()

    @property
    def is_heading(self) -> bool:
        """Whether the line may belong to the head of a formal document."""
        x, f = self.text.strip(), fold(self.text)
        if not f:
            return False
        if ORDER_OF_DAY.fullmatch(x) or CODED_PROJECT.match(x) or re.fullmatch(r"[IVXLCDM]+[.)]?", f) or (self.signal and self.is_printed_formally):
            return True
        capital = any(c.isalpha() for c in x) and not any(c.islower() for c in x)
        return capital and len(x) <= 140 and not set(x) & set(".?!;:") and not f.startswith(SPOKEN_STARTS)

    @property
    def stage(self) -> str | None:
        """``line`` or ``wrapping`` if the line begins a stage direction."""
        x, dashed = _undashed(self.text)
        shown = self.text.strip()
        loud = any(c.isalpha() for c in shown) and shown == shown.upper()
        if x in NOISE_LINES and (dashed or loud):
            return "line"
        open_ = x.startswith(STAGE_STARTS) or DEPUTY_OFF.match(x) or dashed and (DEPUTY_ACTS.fullmatch(x) or x.startswith(DASHED_STARTS))
        return "wrapping" if open_ else None

    @property
    def starts_item(self) -> bool:
        return not self.text.strip() or bool(SPEAKER.match(self.text.strip()) or SEE.match(self.text)) or self.stage is not None

    @property
    def ends_note(self) -> bool:
        return self.text.rstrip().endswith((".", ":", ";", "!", "?", ")"))


def _unnumbered(x: str) -> str:
    return re.sub(r"^(?:[IVXLCDM]+|\d+)[.)]?[ \t]+", "", x.strip())


def _undashed(x: str) -> tuple[str, bool]:
    """Folded line without its dashes and page mark, and whether it had dashes."""
    f = fold(x)
    bare = re.sub(r"^[ \t]*(?:[-–—]+[ \t]*)+", "", f)
    return re.sub(r"^\d+[ \t]*[-–—][ \t]*", "", bare).strip(), bare != f


def lines_of(text: str) -> list[Line]:
    out, at = [], 0
    for raw in text.splitlines(keepends=True):
        shown = raw.rstrip("\r\n")
        out.append(Line(at, at + len(shown), shown))
        at += len(raw)
    return out


# The documentary boundary.


def _head_of_bundle(lines: list[Line], k: int) -> int:
    """Start of the headings right before line ``k``; one blank line between headings is skipped."""
    top = k
    while top and k - top < REWIND_LINES and lines[top].start - lines[top - 1].start <= REWIND_CHARACTERS:
        before = lines[top - 1]
        onward = before.is_heading if before.text.strip() else top > 1 and lines[top - 2].is_heading
        if not onward:
            break
        top -= 1
    return lines[top].start


def _bundle_follows(lines: list[Line], start: int, cue: str) -> bool:
    """Whether two different phrases of a bundle's kind stand near its start."""
    near = (x for x in lines if x.end > start and x.start < start + LOOK_AHEAD and x.is_printed_formally)
    return len({s[1] for s in (x.signal for x in near) if s and s[0] == cue}) >= 2


def boundary(text: str, family: str) -> tuple[int, str, str] | None:
    """Offset, cue and words of the first place where a formal document begins, or none."""
    if family not in FAMILIES:
        return None
    lines = lines_of(text)
    projects = [m.start() for m in CODED_PROJECT.finditer(text)]
    found = [(m.start(), 0, cue, m[0]) for cue, p in (("order_of_day", ORDER_OF_DAY), ("coded_project", CODED_PROJECT)) for m in p.finditer(text)]
    if family == "chamber_secretary":
        found += [(m.start(), 0, "secretary_expediente", m[0]) for m in EXPEDIENTE.finditer(text) if any(m.start() <= p <= m.start() + PROJECT_REACH for p in projects)]
    for k, x in enumerate(lines):
        s = x.signal
        if s and s[2] and x.is_printed_formally:
            found.append((_head_of_bundle(lines, k), 1, s[0], x.text.strip()))
    for start, _, cue, words in sorted(found, key=lambda c: c[:3]):
        rest, near = text[start:], text[start : start + LOOK_AHEAD]
        if FAMILIES[family] and len(text[:start].split()) > PREFIX_WORDS or len(rest.split()) < INSERT_WORDS:
            continue
        body = {"order_of_day": lambda: FORMAL_BODY.search(near), "coded_project": lambda: PROJECT_BODY.search(near), "secretary_expediente": lambda: CODED_PROJECT.search(rest[:PROJECT_REACH]) and PROJECT_BODY.search(near)}.get(cue, lambda: _bundle_follows(lines, start, cue))
        if body():
            return start, cue, words
    return None


# Spans.


@dataclass(frozen=True)
class Span:
    segment: int
    start: int
    end: int
    text: str
    kind: str
    method: str
    confidence: float

    def part(self, a: int, b: int, kind: str | None = None, method: str | None = None, confidence: float | None = None) -> list[Span]:
        if a == b:
            return []
        return [replace(self, start=self.start + a, end=self.start + b, text=self.text[a:b], kind=kind or self.kind, method=method or self.method, confidence=self.confidence if confidence is None else confidence)]


def _wrapped(lines: list[Line], k: int, most: int = WRAP_LINES) -> int:
    """Last line of a note that begins at line ``k``: it runs on until a line ends it or another item begins."""
    last = k
    while last + 1 < len(lines) and last - k + 1 < most and lines[last].end - lines[k].start < WRAP_CHARACTERS and not lines[last].ends_note and not lines[last + 1].starts_item:
        last += 1
    return last


def notes(text: str) -> list[tuple[int, int, str, str, float]]:
    """Stage directions and editorial notes of a text; of overlapping ones the earliest, directions first."""
    found = [(m.start(), m.end(), STAGE, "exact_multiline_outside_microphone_stage_direction", 1.0) for m in OFF_MICROPHONE.finditer(text)]
    found += [(m.start(), m.end(), STAGE, "exact_parenthetical_stage_direction", 1.0) for m in BRACKETS.finditer(text) if any(p.fullmatch(fold(m[1])) for p in APPLAUSE)]
    lines = lines_of(text)
    for k, x in enumerate(lines):
        see, stage = bool(SEE.match(x.text)), x.stage
        if see or stage:
            last = k if stage == "line" and not see else _wrapped(lines, k)
            how = "wrapped_line" if last > k else "line"
            found.append((x.start, lines[last].end, *((NOTE, f"anchored_vease_{how}", 1.0) if see else (STAGE, f"anchored_stage_{how}", 0.95 if last > k else 1.0))))
    taken: list[tuple[int, int, str, str, float]] = []
    for n in sorted(found, key=lambda n: (n[0], n[2] != STAGE, n[1])):
        if not taken or taken[-1][1] <= n[0]:
            taken.append(n)
    return taken


def _refined(span: Span) -> list[Span]:
    if span.kind == INSERT:
        return [span]
    out, at = [], 0
    for a, b, kind, method, sure in notes(span.text):
        out += span.part(at, a) + span.part(a, b, kind, method, sure)
        at = b
    return out + span.part(at, len(span.text))


def _runs_on(span: Span) -> tuple[str, int] | None:
    """How a note goes on in the next span, and for how many lines at most."""
    if span.kind not in (STAGE, NOTE):
        return None
    if span.text.rstrip().endswith("-"):
        return f"cross_segment_hyphenated_{span.kind}", WRAP_LINES
    bare = _undashed(span.text)[0]
    if span.kind == STAGE and (bare in OPEN_PRESIDENCY or DEPUTY_ACTS.fullmatch(bare)):
        return "cross_segment_open_stage_direction", OPEN_LINES
    return None


def _joined(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    todo = list(reversed(spans))
    while todo:
        now = todo.pop()
        out.append(now)
        how = _runs_on(now)
        if how and todo and todo[-1].kind in (SPOKEN, UNATTRIBUTED) and GOES_ON.match(todo[-1].text):
            lines = lines_of(todo[-1].text)
            end = lines[_wrapped(lines, 0, how[1])].end
            if end:
                after = todo.pop()
                out += after.part(0, end, now.kind, how[0], now.confidence) + after.part(end, len(after.text))
    return out


def classify(segments: list[str], family: str | None) -> list[Span]:
    """All spans of a turn; ``family`` is null for an unattributed one.  Segments are joined by line breaks."""
    text = "\n".join(segments)
    cut = boundary(text, family) if family else None
    kind, method = (SPOKEN, "speaker_turn_default") if family else (UNATTRIBUTED, "unattributed_turn")
    spans, at = [], 0
    for k, s in enumerate(segments):
        whole = Span(k, 0, len(s), s, kind, method, 1.0)
        here = len(s) if cut is None else min(max(cut[0] - at, 0), len(s))
        spans += whole.part(0, here) + whole.part(here, len(s), INSERT, "eligible_role_formal_cue_formal_body_minimum_length", 1.0)
        at += len(s) + 1
    return _joined([r for s in spans for r in _refined(s)])


#: Turns whose spans a worker holds as objects at a time.
TURNS = 500

_SPANS = "array<struct<content_span_index:int,segment:int,start:int,end:int,text:string,content_kind:string,include_in_speech:boolean,classification_method:string,classification_confidence:double,word_count:int>>"


def content_spans(turns: DataFrame, segments: str = "segments", family: str = "speaker_family") -> DataFrame:
    """One row for each span of each turn; ``segments`` is an array of texts, of which a null one is empty."""

    @F.pandas_udf(_SPANS)
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(x, f):
            return [{"content_span_index": k, "segment": s.segment, "start": s.start, "end": s.end, "text": s.text, "content_kind": s.kind, "include_in_speech": s.kind == SPOKEN, "classification_method": s.method, "classification_confidence": s.confidence, "word_count": len(s.text.split())} for k, s in enumerate(classify([t or "" for t in x], f), 1)]

        for texts, families in parts:
            for a in range(0, len(texts), TURNS):  # the spans of a whole batch would be held as objects
                some = zip(texts[a : a + TURNS], families[a : a + TURNS])
                yield pd.Series([one(x if x is not None else [], f if isinstance(f, str) else None) for x, f in some])
            pa.default_memory_pool().release_unused()

    kept = [c for c in turns.columns if c != segments]
    return turns.withColumn("_s", F.explode(of(F.col(segments), F.col(family)))).select(*kept, "_s.*")


def turn_statistics(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans and words by kind for each turn."""
    n = lambda k: F.count_if(F.col("content_kind") == k).alias(f"{k}_spans")
    w = lambda k: F.coalesce(F.sum(F.when(F.col("content_kind") == k, F.col("word_count"))), F.lit(0)).alias(f"{k}_words")
    kinds = (SPOKEN, UNATTRIBUTED, INSERT, STAGE, NOTE)
    out = spans.groupBy(*keys).agg(*[n(k) for k in kinds], *[w(k) for k in kinds])
    return out.withColumn("speech_word_count", F.col(f"{SPOKEN}_words")).withColumn("has_speech", F.col("speech_word_count") > 0)


def segment_records(turns: DataFrame, keys: list[str], segments: str = "segments") -> DataFrame:
    """One row for each segment of a turn: its number from 0, text, characters and words; a null one is empty."""
    from lectern.functions import text as X

    each = turns.select(*keys, F.posexplode(segments).alias("segment_index", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    return each.withColumn("character_count", F.length("text")).withColumn("word_count", F.size(X.words(F.col("text"))))


def span_records(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans as they are stored: number, source, bounds, kind, how it was told, and counts of characters and words."""
    how = F.struct(F.col("classification_method").alias("method"), F.col("classification_confidence").alias("confidence"))
    return spans.select(*keys, "content_span_index", F.col("segment").alias("source_segment_index"), "start", "end", "text", "content_kind", "include_in_speech", how.alias("classification"), (F.col("end") - F.col("start")).alias("character_count"), "word_count")


def document_statistics(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of turns rolled up: turns, those without speech, words of speech and of the longest one, and spans by kind."""
    kinds = (SPOKEN, UNATTRIBUTED, INSERT, STAGE, NOTE)
    return turns.groupBy(*keys).agg(
        F.count("*").alias("turn_count"), F.count_if(~F.col("has_speech")).alias("zero_speech_turn_count"), F.sum("speech_word_count").alias("speech_word_count"),
        F.max("speech_word_count").alias("longest_speech"), *[F.sum(f"{k}_spans").alias(f"{k}_spans") for k in kinds],
    )


def coverage_gaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring spans of a segment that leave a gap or overlap."""
    from pyspark.sql import Window as W

    before = F.lag("end").over(W.partitionBy(*keys, "segment").orderBy("start"))
    return spans.withColumn("before", before).where(F.coalesce(F.col("before") != F.col("start"), F.col("start") != 0))


def boundaries(turns: DataFrame, text: str = "text", family: str = "speaker_family") -> DataFrame:
    """Turns with ``boundary``: offset, cue and matched words, or null."""

    @F.pandas_udf("struct<turn_offset:int,cue:string,matched_text:string>")
    def of(texts: pd.Series, families: pd.Series) -> pd.DataFrame:
        got = [boundary(t, f) if isinstance(t, str) and isinstance(f, str) else None for t, f in zip(texts, families)]
        return pd.DataFrame([g or (None, None, None) for g in got], columns=["turn_offset", "cue", "matched_text"]).astype({"turn_offset": "Int32"})

    return turns.withColumn("boundary", of(F.col(text), F.col(family))).withColumn("boundary", F.when(F.col("boundary.cue").isNotNull(), F.col("boundary")))



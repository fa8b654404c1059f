"""Operators without a SQL form, held case by case against their rules."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import clusters, corpus, layout, manifest, nmf, quality, speakers, structure, turncontent
from lectern.sources import readers, sinks
from lectern.streaming import windows


def words(n, prefix="w"):
    return [f"{prefix}{k}" for k in range(n)]


# Chunks.


def test_chunks_prefer_the_best_boundary_of_the_last_quarter():
    text = words(40)
    text[10] += "."  # first half: never chosen
    text[16] += ","
    text[18] += "."
    cut = corpus.chunk_bounds(" ".join(text), 20)
    assert len(" ".join(text)[slice(*cut[0])].split()) == 19  # the sentence, not the clause
    text[18] = "w18"
    assert len(" ".join(text)[slice(*corpus.chunk_bounds(" ".join(text), 20)[0])].split()) == 17


def test_chunks_fall_back_to_the_last_half_then_cut_hard():
    text = words(40)
    text[12] += ","
    text[11] += "."
    joined = " ".join(text)
    assert len(joined[slice(*corpus.chunk_bounds(joined, 20)[0])].split()) == 13  # the latest, whatever its kind
    plain = " ".join(words(40))
    assert len(plain[slice(*corpus.chunk_bounds(plain, 20)[0])].split()) == 20


def test_chunks_prefer_paragraphs_and_keep_outer_space():
    text = "  " + " ".join(words(17)) + "\n\n" + "a. b. c. d. e. f. g. h. i. j. k. l. m."
    bounds = corpus.chunk_bounds(text, 20)
    assert text[slice(*bounds[0])].endswith("\n\n") and bounds[0][0] == 0
    assert corpus.chunk_bounds("", 5) == [] and corpus.chunk_bounds(" \n ", 5) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "c,", "d!)", "\n\n", " ", "  ", "\n"]), max_size=120), st.integers(1, 12))
def test_chunks_rebuild_the_text(parts, most):
    text = " ".join(parts)
    bounds = corpus.chunk_bounds(text, most)
    if text.split():
        assert "".join(text[a:b] for a, b in bounds) == text
        assert all(0 < len(text[a:b].split()) <= most for a, b in bounds)


def test_decisions_and_checks(spark):
    rows = [("s", 1, " ".join(words(24)), "named_or_role_unspecified"), ("s", 2, " ".join(words(25)), "named_or_role_unspecified"), ("s", 3, "", "chair"), ("s", 4, " ".join(words(50)), "chair"), ("s", 5, " ".join(words(50)), None), ("s", 6, " ".join(words(700)), "executive_official")]
    t = spark.createDataFrame(rows, "source string, turn int, text string, speaker_family string").withColumn("word_count", F.size(X.words(F.col("text"))).cast("long"))
    d = corpus.with_decision(t)
    got = {r.turn: r.decision for r in d.collect()}
    assert got == {1: "excluded_below_minimum_words", 2: "retained", 3: "excluded_zero_speech", 4: "excluded_speaker_family", 5: "excluded_speaker_family", 6: "retained"}
    kept = d.where("decision = 'retained'")
    docs = corpus.modeling_documents(kept, "source", "turn")
    assert [r.document_id for r in docs.orderBy("document_id").collect()] == ["s__turn_000002__chunk_001", "s__turn_000006__chunk_001", "s__turn_000006__chunk_002", "s__turn_000006__chunk_003"]
    counts = docs.groupBy("source", "turn").agg(F.count("*").alias("chunk_count"))
    keys = ["source", "turn"]
    assert all(r.holds for r in corpus.export_checks(d, kept.select(*keys, "word_count").join(counts, keys), docs, keys).collect())
    broken = {r.check_name: r.holds for r in corpus.export_checks(d, kept.select(*keys, "word_count").join(counts, keys), docs.where("chunk_index <> 2"), keys).collect()}
    assert not broken["declared_chunk_counts"] and not broken["words_preserved"] and broken["document_ids_unique"]


def test_periods_and_overrides(spark):
    y = spark.createDataFrame([(2007,), (2008,), (2011,), (2012,), (2025,), (2026,)], "y int")
    assert [r.p for r in y.select(corpus.period_of(F.col("y")).alias("p")).collect()] == [None, "2008-2011", "2008-2011", "2012-2015", "2024-2025", None]
    t = spark.createDataFrame([("s", 1, "intro ANCHOR rest ANCHOR", "chair"), ("s", 2, "x", "chair")], "source string, turn int, text string, speaker_family string")
    o = spark.createDataFrame([("s", 1, "retain_from_anchor", "ANCHOR", 2, "named_or_role_unspecified")], "source string, turn int, action string, start_anchor string, expected_anchor_occurrences int, speaker_family string")
    r = {x.turn: x for x in corpus.apply_overrides(t, o, ["source", "turn"]).collect()}
    assert (r[1].text, r[1].discarded_prefix, r[1].speaker_family, r[1].anchor_ok) == ("ANCHOR rest ANCHOR", "intro ", "named_or_role_unspecified", True)
    assert r[2].text == "x" and r[2].discarded_prefix is None
    assert [x.applied_once for x in corpus.override_ledger(o, t, ["source", "turn"]).collect()] == [True]


# Text.


def test_text_functions(spark):
    rows = [(1, "educa­ ción y educa- ción ﬁn  ÁÉ x ß"), (2, None), (3, "")]
    d = spark.createDataFrame(rows, "k int, t string")
    r = {x.k: x for x in d.select("k", X.clean_text(F.col("t")).alias("c"), X.fold_for_matching(F.col("t")).alias("f"), X.collapse(F.col("t")).alias("w"), X.display_text(F.col("t")).alias("v")).collect()}
    assert r[1].c.text.startswith("educación y educación fin") and r[1].c.text.endswith("x ss") and r[1].c.soft_joins == 1 and r[1].c.hyphen_joins == 1
    assert r[1].f.startswith("EDUCA CION Y EDUCA CION FIN AE X") and r[1].w.endswith("ÁÉ x ß") and "fin" in r[1].v
    assert r[2].c.text is None and r[3].c.text == ""
    t = spark.createDataFrame([("año2020 ab ley² señor-x 12",)], "t string")
    assert t.select(X.lexical_tokens(F.col("t")).alias("x")).first().x == ["ley", "señor"]
    assert t.select(X.clusters(F.col("t")).alias("x")).first().x == ["año2020", "ab", "ley", "señor", "x", "12"]
    s = spark.createDataFrame([("a" * 100 + " needle " + "b" * 100,)], "t string").select(X.snippet(F.col("t"), F.lit("needle")).alias("s"), X.excerpt(F.col("t"), 20, "…").alias("e")).first()
    assert s.s.startswith("...") and s.s.endswith("...") and "needle" in s.s and s.e == "a" * 20 + "…"


def test_source_record_id(spark):
    one = spark.createDataFrame([(144, "2026-05-20", 3, "x")], "p int, d string, m int, t string")
    assert one.select(manifest.source_record_id(F.col("p"), F.to_date("d"), F.col("m"), F.col("t")).alias("i")).first().i == "feddd308ec3e03aefead"


# Layout.


def blocks(spark, rows):
    return spark.createDataFrame([("s", 1, n, float(x0), float(y0), float(x1), float(y1), t, 500.0, 700.0) for n, x0, y0, x1, y1, t in rows], "source_record_id string, page_number int, raw_block_number int, x0 double, y0 double, x1 double, y1 double, text string, width double, height double")


def read(df):
    return [r.raw_block_number for r in df.orderBy("reading_order").collect()]


def test_reading_order(spark):
    long = "palabra " * 10
    two = [(0, 40, 100, 230, 120, long), (1, 270, 90, 460, 110, long), (2, 40, 200, 230, 220, long), (3, 270, 190, 460, 210, long)]
    got = layout.reading_order(blocks(spark, two))
    assert read(got) == [0, 2, 1, 3] and got.first().layout == "two_column"
    wide = [*two, (4, 40, 150, 460, 170, "TITLE"), (5, 200, 20, 300, 40, "head"), (6, 200, 660, 300, 680, "12")]
    got = layout.reading_order(blocks(spark, wide))
    assert read(got) == [5, 0, 1, 4, 2, 3, 6]
    assert {r.raw_block_number: r.region for r in got.collect()}[4] == "body_full" and got.first().layout == "mixed"
    level = [*wide, (7, 40, 150, 230, 170, long)]  # its centre is level with the separator's
    assert read(layout.reading_order(blocks(spark, level)))[-2] != 7 and 7 in read(layout.reading_order(blocks(spark, level)))[4:]
    one = [(0, 40, 200, 230, 220, long), (1, 40, 100, 230, 120, long), (2, 270, 90, 300, 110, "x")]
    got = layout.reading_order(blocks(spark, one))
    assert read(got) == [2, 1, 0] and got.first().layout == "single_column"


# Structure and turns.


def session(spark, texts, pages=None):
    return spark.createDataFrame([("s", (pages or [2] * len(texts))[k], k + 1, "body_left", 300.0, 700.0, t) for k, t in enumerate(texts)], "source_record_id string, page_number int, reading_order int, region string, y1 double, page_height double, text string")


def test_zones_and_roles(spark):
    texts = ["CONGRESO", "SUMARIO", "PRESENTES:", "Sr. Presidente (X).- Queda abierta la sesión.", "Sra. Pérez.- Hola", "- Se practica la votación nominal.", "Sr. Presidente.- Queda levantada la sesión.", "I. SANCIONES DE LA HONORABLE CÁMARA", "texto", "INSERCIONES", "más"]
    got = structure.classify(session(spark, texts, [1] + [2] * 10)).orderBy("reading_order").collect()
    assert [r.structural_zone for r in got] == ["front_matter"] * 3 + ["proceedings"] * 4 + ["post_proceedings"] * 4
    assert [r.content_role for r in got] == ["cover", "summary", "attendance", "procedural", "transcript", "vote_record", "procedural", "sanction_text", "sanction_text", "insertion", "insertion"]
    assert [r.include_in_discourse for r in got] == [k == 4 for k in range(11)]
    assert got[4].classification_confidence == 0.9 and got[4].classification_method == "proceedings_explicit_closing+proceedings_default"
    assert got[5].exclusion_reason == "vote_record" and got[8].exclusion_reason == "post_proceedings"


def test_appendix_ends_a_session_without_closing_words(spark):
    texts = ["Sr. Presidente.- Hola", "Sr. X.- uno", "Se pasa a cuarto intermedio", "dos", "3 APÉNDICE", "ACTAS DE VOTACIONES NOMINALES", "y"]
    got = structure.classify(session(spark, texts)).orderBy("reading_order").collect()
    assert [r.content_role for r in got] == ["transcript", "transcript", "procedural", "procedural", "procedural", "vote_record", "vote_record"]
    assert got[0].classification_method.startswith("proceedings_appendix_fallback") and got[0].classification_confidence == 0.9
    assert structure.without_anchor(structure.classify(session(spark, ["nada"]))).count() == 1


def test_markers():
    m = speakers.markers_of("Hola. Sr. Pérez (J. C.).- Sí.\nSra Camaño – No. Sr. x")
    assert [(x["raw_label"], x["normalized_title"], x["detection_confidence"], x["position"]) for x in m] == [("Pérez (J. C.)", "SR.", 1.0, "embedded"), ("Camaño", "SRA.", 0.95, "embedded")]
    assert m[1]["detection_method"] == "explicit_honorific_dash_only_title_without_period"
    assert speakers.markers_of("Sr. " + "x" * 150 + ".-") == [] and speakers.markers_of("Sr. a; b.-") == []
    assert speakers.markers_of("Sr. Uno Sr. Dos.- x")[0]["raw_label"] == "Dos"


def sequential_turns(events):
    out, turn, open_, unattributed = [], 0, False, False
    for kind in events:
        if kind == "reset":
            open_ = unattributed = False
            continue
        if kind == "marker":
            turn, open_, unattributed = turn + 1, True, False
        elif not open_ and not unattributed:
            turn, unattributed = turn + 1, True
        out.append(turn)
    return out


def test_turn_numbers_match_a_sequential_reading(spark):
    r = np.random.default_rng(3)
    rows, want = [], []
    for s in range(20):
        events = r.choice(["marker", "gap", "reset"], 40, p=[0.3, 0.5, 0.2]).tolist()
        rows += [(s, k, e) for k, e in enumerate(events)]
        want += [(s, t) for t in sequential_turns(events)]
    got = speakers.number_turns(spark.createDataFrame(rows, "s int, k int, kind string"), "s", ["k"]).orderBy("s", "k").collect()
    assert [(x.s, x.turn_index) for x in got] == want


def test_turns_of_blocks(spark):
    texts = ["Sr. Presidente (X).- Hola a todos.", "sigue", "- Se practica la votación nominal.", "texto suelto", "Sr. Pérez.- uno Sra. Díaz.- dos"]
    classified = structure.classify(session(spark, texts))
    order = ["page_number", "reading_order", "start"]
    numbered = speakers.number_turns(speakers.events(classified), "source_record_id", order)
    got = speakers.turns(numbered, "source_record_id", order, F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).orderBy("turn_index").collect()
    assert [(r.raw_label, r.text, r.is_attributed) for r in got] == [("Presidente (X)", " Hola a todos.\nsigue", True), (None, "texto suelto", False), ("Pérez", " uno ", True), ("Díaz", " dos", True)]


# Content of turns.


def kinds(segments, family="chair"):
    return [(s.kind, s.text) for s in turncontent.classify(segments, family)]


def test_stage_directions_and_notes():
    assert kinds(["Hola (Aplausos.) sigo"]) == [("spoken_text", "Hola "), ("stage_direction", "(Aplausos.)"), ("spoken_text", " sigo")]
    assert kinds(["Hola (risas y manifestaciones en las bancas) y (comentario)"])[1][0] == "stage_direction"
    got = kinds(["uno\n- Ocupa la Presidencia la señora\nvicepresidenta primera.\ndos"])
    assert got == [("spoken_text", "uno\n"), ("stage_direction", "- Ocupa la Presidencia la señora\nvicepresidenta primera."), ("spoken_text", "\ndos")]
    assert kinds(["Véase el texto en\nel apéndice.\nsigo"])[0] == ("editorial_note", "Véase el texto en\nel apéndice.")
    assert kinds(["MANIFESTACIONES\nsigo"])[0] == ("stage_direction", "MANIFESTACIONES")
    assert kinds(["hubo manifestaciones"]) == [("spoken_text", "hubo manifestaciones")]
    assert kinds(["texto"], None) == [("unattributed_text", "texto")]


def test_notes_run_on_into_the_next_segment():
    got = turncontent.classify(["- Ocupa la Presidencia el señor", "vicepresidente primero, doctor X.\nSigue la sesión"], "chair")
    assert [(s.kind, s.segment, s.text) for s in got] == [("stage_direction", 0, "- Ocupa la Presidencia el señor"), ("stage_direction", 1, "vicepresidente primero, doctor X."), ("spoken_text", 1, "\nSigue la sesión")]
    assert got[1].method == "cross_segment_open_stage_direction"
    assert [s.kind for s in turncontent.classify(["- Ocupa la Presidencia el señor", "Vicepresidente"], "chair")] == ["stage_direction", "spoken_text"]


def test_documentary_boundary():
    body = "La Cámara de Diputados de la Nación resuelve " + " ".join(words(250))
    text = "Por Secretaría se lee. (1234-D.-2010) Proyecto de ley\n" + body
    at, cue, _ = turncontent.boundary(text, "chair")
    assert cue == "coded_project" and text[at:].startswith("(1234")
    assert turncontent.boundary(text, "executive_official") is None
    assert turncontent.boundary("(1234-D.-2010) Proyecto de ley corto", "chair") is None
    assert turncontent.boundary(" ".join(words(260)) + " " + text, "named_or_role_unspecified") is None
    order = "Dice. (Orden del Día N° 12)\nDICTAMEN\n" + " ".join(words(220))
    assert turncontent.boundary(order, "chair")[1] == "order_of_day"
    bundle = "Se lee.\nBUENOS AIRES\nPODER JUDICIAL DE LA NACIÓN\nY VISTOS:\n" + " ".join(words(230))
    at, cue, _ = turncontent.boundary(bundle, "chair")
    assert cue.startswith("formal_judicial") and bundle[at:].startswith("BUENOS AIRES")
    spans = turncontent.classify(text.split("\n"), "chair")
    assert spans[-1].kind == "documentary_insert" and "\n".join(["".join(s.text for s in spans if s.segment == k) for k in (0, 1)]) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["(Aplausos.)", "\n", "- Se suspende la sesión", "Véase ", "texto ", "Ocupa la Presidencia el señor", "-", " "]), max_size=12).map("".join), max_size=4))
def test_spans_lose_nothing(segments):
    spans = turncontent.classify(segments, "chair")
    assert ["".join(s.text for s in spans if s.segment == k) for k in range(len(segments))] == segments


# Quality rules.


def test_overlap_severity_and_rules(spark):
    rows = [("a", 1, "2010-01-01", "2011-01-01", "x"), ("a", 2, "2011-01-01", None, "y"), ("a", 3, "2012-01-01", "2013-01-01", "y"), ("b", 4, "2010-01-01", None, "x")]
    d = spark.createDataFrame(rows, "k string, i int, f string, t string, v string").withColumns({"f": F.to_date("f"), "t": F.to_date("t")})
    assert sorted((r.first_id, r.second_id, r.severity) for r in quality.overlaps(d, ["k"], "f", "t", "i", "v").collect()) == [(1, 2, "error"), (2, 3, "warning")]
    bad = spark.createDataFrame([(1, "", "2020-13-01", "x"), (2, "ok", "", "reviewed")], "line int, name string, day string, status string")
    got = quality.violations(bad, "line", [quality.required("name"), quality.iso_date("day"), quality.member("status", ["reviewed"])])
    assert sorted((r.line, r.column) for r in got.collect()) == [(1, "day"), (1, "name"), (1, "status")]
    assert quality.header_violations(["a"], ["a", "b"], "t") and not quality.header_violations(["a"], ["a"], "t")


# Models.


def test_nmf_finds_planted_topics(spark):
    r = np.random.default_rng(0)
    groups = [[f"{c}{k}" for k in range(8)] for c in "abc"]
    rows = [(d, t, 1, 1, float(r.random() + 0.5)) for d in range(60) for t in r.choice(groups[d % 3], 5, replace=False)]
    w = spark.createDataFrame(rows, "doc_id int, term string, n int, df int, w double")
    sparse, terms = nmf.rows_of(w, w.select("term").distinct())
    model = nmf.fit(sparse, terms, 3, most_iter=40)
    assert all(a >= b - 1e-9 for a, b in zip(model.errors, model.errors[1:])) and (model.h >= 0).all()
    tops = {frozenset(terms[i][0] for i in np.argsort(-h)[:5]) for h in model.h}
    assert tops == {frozenset("a"), frozenset("b"), frozenset("c")}
    again = {x.doc_id: x.w for x in nmf.transform(sparse, model).collect()}
    assert len({int(np.argmax(again[d])) for d in range(0, 60, 3)}) == 1
    with pytest.raises(ValueError):
        nmf.fit(sparse, terms, 1 << 25)


def dense_start(x, k):
    """The same start from a full singular value decomposition."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    h = np.zeros((k, x.shape[1]))
    h[0] = np.sqrt(s[0]) * np.abs(vt[0])
    for c in range(1, k):
        sides = [(np.maximum(a, 0), np.maximum(b, 0)) for a, b in ((u[:, c], vt[c]), (-u[:, c], -vt[c]))]
        a, b = max(sides, key=lambda y: np.linalg.norm(y[0]) * np.linalg.norm(y[1]))
        h[c] = np.sqrt(s[c] * np.linalg.norm(a) * np.linalg.norm(b)) * b / np.linalg.norm(b)
    h[h < 1e-6] = 0
    h[h == 0] = x.mean()
    return h


def test_nmf_start_and_grid(spark):
    r = np.random.default_rng(3)
    x = np.maximum(0, r.normal(size=(40, 12)) + (np.arange(40)[:, None] % 3 == np.arange(12) % 3) * 2)
    w = spark.createDataFrame([(d, f"t{c:02d}", 1, 1, float(x[d, c])) for d in range(40) for c in range(12) if x[d, c] > 0], "doc_id int, term string, n int, df int, w double")
    sparse, terms = nmf.rows_of(w, w.select("term").distinct())
    assert np.abs(nmf.singular_start(sparse, terms, 3, passes=30) - dense_start(x, 3)).max() < 1e-3
    models, record = nmf.grid(sparse, terms, [2, 3], most_iter=200)
    rows = {m.k: m for m in record.collect()}
    assert rows[2].converged and rows[3].converged and rows[3].error < rows[2].error and sorted(models) == [2, 3]
    same = nmf.prevalence_differences(nmf.prevalence(nmf.transform(sparse, models[3])), nmf.prevalence(nmf.transform(sparse.repartition(3), models[3]))).collect()
    assert len(same) == 3 and all(m.within and m.difference < 1e-9 for m in same)
    apart = nmf.prevalence_differences(nmf.prevalence(nmf.transform(sparse, models[3])), nmf.prevalence(nmf.transform(sparse.where("doc_id % 3 = 0"), models[3])))
    assert not all(m.within for m in apart.collect())


def plain_chunks(text, most):
    """The rules of chunks, one window after the other, all words looked at again for each."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    out, begin = [], 0
    while len(words) - begin > most:
        window = range(begin + 1, begin + most + 1)  # a cut before word k

        def kinds(k):
            word = text[slice(*words[k - 1])]
            return {n for n, hit in enumerate((text.count("\n", words[k - 1][1], words[k][0]) > 1, re.search(r"[.!?¡¿…]+[\"')\]}»]*$", word), re.search(r"[,;:][\"')\]}»]*$", word))) if hit}

        quarter, half = window[-max(1, most // 4) :], window[-max(1, most // 2) :]
        best = next((max(k for k in quarter if n in kinds(k)) for n in range(3) if any(n in kinds(k) for k in quarter)), None)
        best = best or max((k for k in half if kinds(k)), default=None) or window[-1]
        out.append(best)
        begin = best
    cuts = [0, *[words[k][0] for k in out], len(text)] if words else []
    return list(zip(cuts, cuts[1:]))


def test_chunks_match_their_rules(spark, sf_dir):
    r = np.random.default_rng(4)
    texts = [x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ["".join(r.choice(["uno ", "dos, ", "tres. ", "cuatro\n\n", "cinco\n", "(seis!) ", "¿siete?» ", "ocho; "], r.integers(1, 90))) for _ in range(60)] + ["", "  ", " uno "]
    for most in (300, 40, 7, 1):
        for t in texts if most >= 40 else texts[-63:]:
            assert corpus.chunk_bounds(t, most) == plain_chunks(t, most)
    got = corpus.chunks(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    want = [(k, n, a, b, len(t[a:b].split()), t[a:b]) for k, t in enumerate(texts) for n, (a, b) in enumerate(plain_chunks(t, 300), 1)]
    assert [(x.doc_id, x.chunk_index, x.start, x.end, x.word_count, x.text) for x in got] == want


def test_density_clusters_and_merging(spark):
    r = np.random.default_rng(1)
    points = [c + r.normal(0, 0.05, 8) for c in np.eye(8)[:3] for _ in range(30)] + list(r.normal(0, 1, (6, 8)) * 3)
    d = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.cluster for x in clusters.density_clusters(d, "vec_id", "embedding", 10, 3).collect()}
    assert [len({got[k] for k in range(a, a + 30)}) for a in (0, 30, 60)] == [1, 1, 1]
    assert len({got[0], got[30], got[60]}) == 3 and -1 not in (got[0], got[30], got[60])
    merged = clusters.merge_topics({-1: np.zeros(2), 0: np.array([1, 0.0]), 1: np.array([1, 0.1]), 2: np.array([0, 1.0])}, {-1: 5, 0: 1, 1: 9, 2: 3}, 3)
    assert merged == {-1: -1, 0: 0, 1: 0, 2: 1}


# Sources and sinks.


def test_strict_readers(spark, tmp_path):
    good, bad, blank = tmp_path / "good.jsonl", tmp_path / "bad.jsonl", tmp_path / "blank.jsonl"
    good.write_text('﻿{"a": 1}\n{"a": 2}\n', encoding="utf-8")
    bad.write_text('{"a": 1}\n[1]\n')
    blank.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.strict_jsonl(spark, str(good), "a long").collect()) == [1, 2]
    for p in (bad, blank):
        with pytest.raises(Exception):
            readers.strict_jsonl(spark, str(p), "a long").collect()
    c = tmp_path / "t.csv"
    c.write_text("﻿id,flag,x\n1,True,nan\n2,yes,1.5\n", encoding="utf-8")
    t = readers.string_csv(spark, str(c), ["id", "flag"])
    got = t.select(readers.typed(F.col("id"), "long").alias("i"), readers.typed(F.col("flag"), "boolean").alias("f"), readers.typed(F.col("x"), "double").alias("x")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, True, None), (2, None, 1.5)]
    with pytest.raises(ValueError):
        readers.string_csv(spark, str(c), ["missing"])


def test_stop_words(spark, tmp_path):
    f = tmp_path / "stop.txt"
    f.write_text("# list\nDE\n\nla\n", encoding="utf-8")
    base = readers.line_set(spark, str(f), X.nfkc_casefold(F.col("term")))
    assert sorted(r.term for r in readers.stop_words(base, ["Señor"], ["ley"], X.nfkc_casefold).collect()) == ["de", "la", "señor"]
    with pytest.raises(ValueError):
        readers.stop_words(base, ["La"], [], X.nfkc_casefold)
    with pytest.raises(ValueError):
        readers.stop_words(base, [], ["la"], X.nfkc_casefold)


def test_html_entries(spark):
    html = """<div id="periodos"><div class="accordion-item"><div class="accordion-header"><button>PERÍODO 144</button></div><div class="accordion-body"><ul>
    <li><a class="pdf-link" onclick="abrirPDF('https://h/v?file=https%3A%2F%2Fh%2Fa.pdf', this)">3ª Reunión - 2ª Sesión ordinaria (20/05/2026)</a></li><li>Sesión no efectuada (01/02/2026)</li></ul></div></div></div>"""
    got = readers.html_entries(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("source_entry_position").collect()
    assert [(r.period, r.pdf_url) for r in got] == [(144, "https://h/a.pdf"), (144, None)]
    d = spark.createDataFrame([(r.title,) for r in got], "t string").select(manifest.entry_date(F.col("t")).cast("string").alias("d"), manifest.number_before(F.col("t"), "Reunión").alias("n"), manifest.without_date(F.col("t")).alias("w")).collect()
    assert [(r.d, r.n) for r in d] == [("2026-05-20", 3), ("2026-02-01", None)] and d[1].w == "Sesión no efectuada"


def test_runs_commit_and_roll_back(spark, tmp_path):
    runs = sinks.Runs(spark, str(tmp_path / "stage"))
    a = spark.range(5)
    first = runs.commit({"a": a}, "v1", {"in": "x"})
    assert runs.read("a").count() == 5 and runs.reusable("v1", {"in": "x"}) and not runs.reusable("v2", {"in": "x"})
    with pytest.raises(FileExistsError):
        runs.commit({"a": a}, "v1")
    with pytest.raises(Exception):
        runs.commit({"a": a, "b": a.select(F.raise_error(F.lit("broken")).alias("x"))}, "v2", force=True)
    assert runs.current() == first
    assert sinks.lineage_problems(first, "v1", {"in": "x"}, {"a": 5}) == [] and len(sinks.lineage_problems(first, "v0", {"in": "y"}, {"a": 4})) == 3
    sinks.write_jsonl(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":"x","b":1}'
    assert sinks.digest(a).first() == sinks.digest(a.repartition(3)).first()


def test_fetch_tries_again():
    import io

    calls, waits = [], []

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return io.BytesIO(b"page")

    assert list(readers.fetch("u", opener, wait=waits.append)) == [b"page"] and waits == [1, 2]


# Streams.


def test_streaming_windows_equal_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    events = windows.read_events(spark, str(tmp_path / "in"), batch.schema)
    stream = windows.tumbling(events, "ts", "1 day", "60 days", ["event_type"], "value")
    q = stream.writeStream.format("memory").queryName("stream_days").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = windows.tumbling(batch, "ts", "1 day", "60 days", ["event_type"], "value")
    assert sorted(map(tuple, spark.table("stream_days").collect())) == sorted(map(tuple, want.collect()))

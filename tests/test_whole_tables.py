"""Registered queries take whole tables: rows that a filter once left out come back, with right values."""

import re
import unicodedata

import numpy as np
import pytest

from lectern.operators import nmf
from lectern.plans import registry, topic_queries


def run(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return registry.QUERIES[name](spark, str(tmp_path)).collect()


def test_density_clusters_of_any_id(spark, tmp_path):
    r = np.random.default_rng(1)
    points = [c + r.normal(0, 0.05, 8) for c in np.eye(8)[:3] for _ in range(150)]
    ids = [k + (10**12 if k % 2 else 0) for k in range(len(points))]
    got = {x.vec_id: x.cluster for x in run(spark, tmp_path, "density_clusters", "embeddings", [(i, [float(x) for x in p]) for i, p in zip(ids, points)], "vec_id long, embedding array<float>")}
    assert sorted(got) == sorted(ids)
    planted = [{got[i] for i in ids[a : a + 150]} - {-1} for a in (0, 150, 300)]
    assert [len(p) for p in planted] == [1, 1, 1] and len(set.union(*planted)) == 3
    assert sum(c == -1 for c in got.values()) < 45


def cleaned(text):
    """The cleaner by hand: joins at soft hyphens, the rest of them gone, then joins at hyphens before white space."""
    if text is None:
        return None, None
    text, soft = re.subn(r"(?<=[^\W\d_])\u00ad\s*(?=[^\W\d_])", "", text)
    text, n = text.replace("\u00ad", ""), 1
    while n:
        text, n = re.subn(r"(?<=[^\W\d_])-\s+(?=[^\W\d_])", "", text)
    return unicodedata.normalize("NFKC", text).casefold(), soft


def test_cleaned_text_of_cut_words(spark, tmp_path):
    r = np.random.default_rng(2)
    parts = ["a", "Ñ", "b", "7", "_", ".", "\u00ad", "\u00ad", "-", "-", " ", "\n", "\u00a0", "\x85", "\x1f", "²", "Ⅷ", "ß", "ﬁ"]
    texts = ["educa\u00ad\nción", "co-\nlegio", "ex- \u00administro", "sin cortes", "", None, *("".join(r.choice(parts, 14)) for _ in range(500))]
    got = run(spark, tmp_path, "cleaned_text", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: (x.cleaned, x.soft_joins) for x in got} == {k: cleaned(t) for k, t in enumerate(texts)}
    assert len(got) == len(texts) and sum(x.soft_joins or 0 for x in got) > 50


#: Texts, the notes in them, and whether anything is left that is speech (every text is followed by one note).
NOTED = [
    ("Hola", 0, True), ("", 0, False), (None, 0, False), (" \n ", 0, False), ("Véase el texto en\nel apéndice.", 1, False), ("Pido la palabra.\nVéase la página 3.\nSigo.\n12. Vease el anexo.", 2, True),
    ("(Aplausos.)", 0, False), ("Gracias. (Risas y aplausos.)", 0, True), ("hubo aplausos y risas", 0, True), ("- no es una nota", 0, True), ("- Se suspende la sesión.", 0, False), ("como véase más abajo", 0, True), ("Véase el texto en el apén-", 1, False),
]


def test_turn_statistics_of_texts_with_notes(spark, tmp_path):
    roles = ["user", "assistant", "system"]
    rows = [(k, j, role, text) for k, (text, _, _) in enumerate(NOTED) for j, role in enumerate(roles)]
    got = run(spark, tmp_path, "turn_statistics", "conversations", rows, "conv_id long, turn long, role string, text string")
    want = {(k, j): (n + 1, speech and role != "system") for k, (_, n, speech) in enumerate(NOTED) for j, role in enumerate(roles)}
    assert {(x.conv_id, x.turn): (x.editorial_note_spans, x.has_speech) for x in got} == want


def test_fragment_slices_of_late_turns(spark, tmp_path):
    rows = [(1, t, "user", "x") for t in (0, 5, 29, 30, 35, 39, 40, 398)]
    got = run(spark, tmp_path, "fragment_slices", "conversations", rows, "conv_id long, turn long, role string, text string")
    ranges = [(0, 10), (10, 12), (12, 40)]
    inside = {t: [min(b, t + 8) - max(a, t) for a, b in ranges if b > t and a < t + 8] for _, t, _, _ in rows}
    assert {x.turn: (x.fragments, x.covered) for x in got} == {t: (len(n), sum(n)) for t, n in inside.items()}


def test_representatives_of_all_topics(spark, sf_dir):
    got = registry.QUERIES["representatives"](spark, sf_dir).collect()
    assert sorted((x.topic, x.rank) for x in got) == [(t, k) for t in range(64) for k in range(1, 6)]


def test_ordered_selection_of_all_items(spark, sf_dir):
    got = {x.o_orderkey for x in registry.QUERIES["ordered_selection"](spark, sf_dir).collect()}
    assert got == {x.l_orderkey for x in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().collect()}


@pytest.mark.parametrize("name", ["nmf_components", "nmf_prevalence"])
def test_factorisations_are_finished(spark, sf_dir, monkeypatch, name):
    fits = []
    monkeypatch.setattr(topic_queries.N, "fit", lambda *a, f=nmf.fit, **k: fits.append(f(*a, **k)) or fits[-1])
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
    assert fits[0].converged and fits[0].errors[-2] - fits[0].errors[-1] <= 1e-4 * fits[0].errors[0]
    monkeypatch.setattr(topic_queries, "MOST_SWEEPS", fits[0].n_iter - 1)
    with pytest.raises(RuntimeError):
        registry.QUERIES[name](spark, sf_dir)

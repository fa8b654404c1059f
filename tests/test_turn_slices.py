from lectern.operators import turncontent


def test_spans_of_slices(spark, monkeypatch):
    """Spans come in their turns' order, whatever number of turns a worker holds at a time."""
    rows = [(k, "chair" if k % 2 else None, [f"Turno {k}." * (k % 3), "(Aplausos.)\nSigo."]) for k in range(23)]
    turns = spark.createDataFrame(rows, "k long, speaker_family string, segments array<string>").coalesce(1)
    whole = turncontent.content_spans(turns).collect()
    monkeypatch.setattr(turncontent, "TURNS", 4)
    assert turncontent.content_spans(turns).collect() == whole
    assert "".join(x.text for x in whole if x.k == 4) == "".join(rows[4][2])

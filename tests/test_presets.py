import __spark_entry__
from kinlink.plans import pipeline


def test_candidates_of_a_trained_preset_are_made_once(spark, sf, monkeypatch):
    calls, real = [], pipeline.candidates
    monkeypatch.setattr(pipeline, "candidates", lambda *a: calls.append(a) or real(*a))
    assert __spark_entry__.queries()["resolve_three_channel"](spark, sf).count() > 0
    assert len(calls) == 1

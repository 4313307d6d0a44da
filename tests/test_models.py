from patchloom.operators.models import JUDGED, judged


def test_judged_answers(spark):
    whole = '```json\n{"groundedness": 4, "completeness": 3.5, "actionability": "2", "precision": 5, "overall": 4, "comment": "fine"}\n```'
    rows = [("a", whole, None), ("b", '{"overall": 1}', None), ("c", "no", None), ("d", None, "TimeoutError: late"), ("e", '{"overall": "high"}', None), ("f", "[1]", None)]
    got = {r.scenario_id: r for r in judged(spark.createDataFrame(rows, "scenario_id string, answer string, error string")).collect()}
    assert [got["a"][c] for c in JUDGED] == [4.0, 3.5, 2.0, 5.0, 4.0] and (got["a"].comment, got["a"].error) == ("fine", None)
    assert [got["b"][c] for c in JUDGED] == [0.0, 0.0, 0.0, 0.0, 1.0] and got["b"].comment == ""
    assert (got["c"].overall, got["c"].error) == (None, "judge output was not valid JSON") and got["d"].error == "TimeoutError: late"
    assert all(got[x].overall is None and got[x].error for x in "def")

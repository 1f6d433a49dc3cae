"""The judge's replies: what is found in them, and what is refused."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundsearch.functions.json_scan import first_object
from groundsearch.operators import evaluation

GOOD = json.dumps({"claims": [{"claim": "a", "verdict": "supported", "citation_valid": True}, {"claim": "b", "verdict": "unsupported"}], "notes": "n {\"x\"} [1]"})


def by_trying(text):
    """Each brace in turn, by Python's own decoder."""
    for i, c in enumerate(text):
        if c == "{":
            try:
                return json.JSONDecoder(parse_constant=lambda _: 1 / 0).raw_decode(text, i)[0]
            except (ValueError, ZeroDivisionError):
                pass
    return None


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='{}[]",:\\a1- \n', max_size=40))
def test_any_text(text):
    assert first_object(text) == by_trying(text)


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=12), st.text(alphabet='{}[]",:x ', max_size=12), st.booleans())
def test_objects_between_other_text(value, around, tight):
    text = around + json.dumps({"v": value}, separators=(",", ":") if tight else None, ensure_ascii=tight) + around
    assert first_object(text) == by_trying(text)


@pytest.mark.parametrize("text", ["{" * 1_000_000, '{"a":' * 200_000, '{"a":[' * 150_000, '{"' + "{" * 900_000, '{"{" ' * 200_000, '{"a":[' + "1," * 400_000, "{ " * 500_000, '"{\\"' * 250_000])
def test_a_long_reply_takes_a_pass(text):
    began = time.time()
    assert first_object(text) is None
    assert time.time() - began < 3
    assert first_object("{" * 1000 + GOOD)["notes"].startswith("n ")


def test_deep_nesting_is_no_crash():
    assert first_object('{"a":' * 200_000 + "1" + "}" * 200_000) is None


CASES = [
    (GOOD, None), (f"Sure:\n\n{GOOD}\n\nDone", None), (f"```json\n{GOOD}\n```", None), ("{this is not json} but this is: " + GOOD, None), ('{"claims": [], "notes": "refusal"}', None),
    ("I cannot grade this answer, sorry.", "no JSON object"), ("", "no JSON object"), (None, "no JSON object"), ('{"verdicts": []}', "no 'claims' list"), ('{"claims": "all"}', "no 'claims' list"), ('{"claims": ["supported"]}', "claims[0] is not an object"),
    ('{"claims": [{"claim": "c", "verdict": "plausible"}]}', "claims[0]: invalid verdict"), ('{"claims": [{"verdict": "supported"}, {"claim": "c"}]}', "claims[1]: invalid verdict"), ('{"claims": [{"claim": "c", "verdict": "supported", "citation_valid": "yes"}]}', "claims[0]: citation_valid is neither true, false nor null"),
    ('{"claims": [{"claim": "c", "verdict": ["supported"]}]}', "claims[0]: invalid verdict"), ('{"verdicts": []} ' + GOOD, "no 'claims' list"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", evaluation.judged(F.col("t")).alias("v"))
    for r in df.select("i", "v.problem", F.col("v").alias("v"), *evaluation.verdict_counts(F.col("v"))).collect():
        want = CASES[r.i][1]
        assert r.problem == want and (r.claims_total is None) == (want is not None)
        if want is None and r.claims_total:
            assert (r.claims_total, r.claims_supported, r.claims_unsupported, r.citation_valid_ratio, r.faithfulness) == (2, 1, 1, 1.0, 0.5)
            assert r.v.notes == 'n {"x"} [1]' and r.v.claims[1].citation_valid is None

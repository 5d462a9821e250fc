"""String similarity against textbook definitions and hand-computed cases."""

import random

from hypothesis import given, settings, strategies as st

from geoverity.functions import similarity as S


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


@settings(max_examples=300)
@given(st.text(alphabet="abcde ", max_size=40), st.text(alphabet="abcde ", max_size=40))
def test_lcs_matches_dp(a, b):
    assert S.lcs_length(a, b) == lcs_dp(a, b)


def test_lcs_long_strings():
    rnd = random.Random(1)
    for _ in range(50):
        a = "".join(rnd.choice("abcxyz") for _ in range(rnd.randint(0, 300)))
        b = "".join(rnd.choice("abcxyz") for _ in range(rnd.randint(0, 300)))
        assert S.lcs_length(a, b) == lcs_dp(a, b)


def test_indel_ratio_values():
    assert S.indel_ratio("", "") == 100.0
    assert S.indel_ratio("abc", "abc") == 100.0
    assert S.indel_ratio("abc", "") == 0.0
    # LCS("bangalore", "bengaluru") = 6 ("bngalr") -> 200*6/18
    assert abs(S.indel_ratio("bangalore", "bengaluru") - 200 * 6 / 18) < 1e-9


def test_token_set_ratio_rules():
    # one side's tokens contained in the other -> 100
    assert S.token_set_ratio("legacy school", "legacy international school") == 100.0
    assert S.token_set_ratio("", "abc") == 0.0
    assert S.token_set_ratio("abc", "abc") == 100.0
    # no common token: plain indel ratio of the sorted token strings
    assert abs(S.token_set_ratio("abc", "abd") - S.indel_ratio("abc", "abd")) < 1e-9
    # sect = "a"; diff_ab = "bcd", diff_ba = "bce": sect lengths 1, ab_len = ba_len = 5
    # ratio(sect+ab, sect+ba) = 100 * (1 - 2/10) = 80; sect vs sect+ab = 100*(1-4/6)
    assert abs(S.token_set_ratio("a bcd", "a bce") - 80.0) < 1e-9


def test_fold():
    assert S.unicode_fold("  Café   Münster ") == "cafe munster"
    assert S.unicode_fold("") == ""
    assert S.fuzzy_similarity("School", "school") == 1.0
    assert S.fuzzy_similarity("", "x") == 0.0


def test_column_helpers(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("Legacy School", "legacy  school"), ("a bcd", "a bce"), ("", "x"),
                                ("Zürich Academy", "zurich academy")], "a string, b string")
    got = [r[0] for r in df.select(S.fuzzy_score("a", "b")).collect()]
    assert got == [1.0, 0.8, 0.0, 1.0]
    r = [x[0] for x in df.select(S.ratio(F.lower("a"), F.lower("b"))).collect()]
    assert abs(r[1] - S.indel_ratio("a bcd", "a bce")) < 1e-9


def test_native_ratio_matches_python(spark):
    rnd = random.Random(5)
    pairs = [("bangalore", "bengaluru"), ("", "x"), ("abc", "abc"), ("a" * 70, "a" * 65 + "b" * 9)]
    for _ in range(60):
        pairs.append(("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 80))),
                      "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 80)))))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(S.ratio_native("a", "b")).collect()]
    for (a, b), g in zip(pairs, got):
        assert abs(g - S.indel_ratio(a, b)) < 1e-9, (a, b, g)

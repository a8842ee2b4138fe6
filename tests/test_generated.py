import pytest
from pyspark.sql import functions as F

from abacora.functions import generated as G


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("Đáp án là: 72 ô tô", "72"), ("the answer is 5huehue", "5"), ("x \\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("3 rồi 1/2 cuối", "1/2"), ("<answer> 9 kg </answer>", "9"), ("nothing", ""), (None, "")],
)
def test_generated_answer(given, wanted):
    assert G.generated_answer(given) == f"{G.ANCHOR} {wanted}".strip()


def test_postprocess():
    assert G.postprocess("Q?\nTa có 3.\nĐáp án là: 3 kg\nĐáp án là: 4", "Q?") == "Ta có 3.\n####đáp án là: 3"
    assert G.postprocess("") == G.ANCHOR and G.postprocess("còn 7 quả", append_number=True) == "còn 7 quả\n####đáp án là: 7"


def test_equation_steps():
    assert G.equation_steps("2 + 3 = 5 và 5 * 2 = 10; 1 + 1 = 3; 2+3=5", 10.0) == ["2+3 = 5", "5*2 = 10"]
    assert G.equation_steps("3 + 4 = 7. Rồi 7 * 2 = 14. Đáp án là: 14", 14.0) == ["3+4 = 7", "7*2 = 14"]
    assert G.equation_steps("1 + 1 = 2; 2 + 2 = 4; 3 + 3 = 6; 4 + 4 = 8; 5 + 5 = 10; 4 * 2 = 8", 8.0, 2) == ["4+4 = 8", "4*2 = 8"]
    assert G.equation_steps("4 * \\frac{6}{8} = 3", None) == ["4*\\frac{6}{8} = 3"]
    assert G.equation_steps(None, None) == []


def test_columns(spark):
    df = spark.createDataFrame([("1 + 1 = 2. Đáp án là: 2", 2.0), (None, None)], "t string, g double")
    rows = df.select(G.clean_generated(F.col("t")).alias("a"), G.postprocess_generation(F.col("t")).alias("p"), G.checked_steps(F.col("t"), F.col("g")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [("####đáp án là: 2", "1 + 1 = 2.\n####đáp án là: 2", ["1+1 = 2"]), (G.ANCHOR, G.ANCHOR, [])]


def test_exact_starts_and_notes_with_any_sign():
    from abacora.functions.generated import answer_value, exact_start
    from abacora.functions.vietnamese import notebook_clean

    starts = {"3\\frac{1}{2} kg": "3\\frac{1}{2}", "\\dfrac{1}{2}": "\\dfrac{1}{2}", "2,5\\sqrt{3} m": "2,5\\sqrt{3}", "-2\\sqrt 3 m": "-2\\sqrt 3", "\\sqrt{5} x": "\\sqrt{5}", "\\sqrt 5": None, "2.5\\frac{1}{2}": None, "-\\frac{1}{2}": None, "12 kg": None}
    assert {k: exact_start(k) for k in starts} == starts
    assert answer_value("12/5 kg") == "12/5" and answer_value("2.5\\frac{1}{2}") == "2.5"
    assert notebook_clean("a\x00b c d") == "a\x00b c d" and notebook_clean("x <<1+1=2>> \x00 1,000") == "x <<1+1=2>> \x00 1000"

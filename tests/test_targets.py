"""Training targets by style: fixtures worked out by hand."""

import pytest

from abacora.operators import targets

ADD = "Lan có 5 quả táo. Mẹ cho thêm 7 quả, nên Lan có 5 + 7 = 12 quả. Đáp án là: 12"
UNKNOWN = "Gọi x là số cần tìm. Ta có 3*x + 2 = 14, suy ra 3*x = 12. Vậy x = 4. Đáp án là: 4"
FRACTION = "Ta có $\\frac{6}{2} = 3$ và 3 + 4 = 7. Đáp án là: 7"
WORDS = "Không có phép tính nào. Đáp án là: nhiều"
RECORDS = [("GSM_Rephrased", ADD), ("GSM_SV", UNKNOWN), ("MATH_AnsAug", FRACTION), ("MATH_AnsAug", WORDS), ("X", None), ("X", "chẳng có gì")]
MISSING = [(None, None, "missing_response"), (None, None, "no_answer")]
LINE = "####đáp án là: "
SAID = "Ta tính theo dữ kiện trong đề bài."


def tagged(body, answer):
    return f"<think>\n{body}\n</think>\n<answer>\n{answer}\n</answer>"


SHORT = [f"Lời giải ngắn:\nLan có 5 + 7 = 12 quả\n{LINE}12", f"Lời giải ngắn:\nTa có 3*x + 2 = 14\nsuy ra 3*x = 12\n{LINE}4", f"Lời giải ngắn:\nTa có \\frac{{6}}{{2}} = 3 và 3 + 4 = 7\n{LINE}7", None]
STUBS = [LINE + a for a in ("12", "4", "7", "nhiều")]
BODIES = ["Lan có 5 quả táo. Mẹ cho thêm 7 quả, nên Lan có 5 + 7 = 12 quả.", "Ta có 3*x + 2 = 14, suy ra 3*x = 12. Vậy x = 4.", "Ta có $\\frac{6}{2} = 3$ và 3 + 4 = 7.", "Không có phép tính nào."]
ANSWERS = ["12", "4", "7", "nhiều"]
PROGRAMS = ["step_1 = 5+7\nanswer = step_1", None, "step_1 = 3+4\nanswer = step_1", None]


def program(head, i):
    return f"{head}{PROGRAMS[i]}\n{STUBS[i]}"


EXPECTED = {
    "original": [(t, "original") for _, t in RECORDS[:4]],
    "standardized": [(f"{t.split(' Đáp')[0]}\n{s}", "standardized") for (_, t), s in zip(RECORDS, STUBS)],
    "short_solution": [(f"{t.split(' Đáp')[0]}\n{s}", "short_solution") for (_, t), s in zip(RECORDS, STUBS)],
    **{style: [(s, "answer_only") for s in STUBS] for style in ("answer_stub", "answer_only", "answer_focused")},
    "equation_focused": [(f"{b}\n{s}", "equation_focused") for b, s in zip(BODIES, STUBS)],
    "fdd_pot": [(program("# Chuong trinh Python ngan gon de tinh dap an\n", 0), "program"), (SHORT[1], "equation_short"), (program("# Chuong trinh Python ngan gon de tinh dap an\n", 2), "program"), (None, None)],
    "fdd_pot_compact": [(program("", 0), "program"), (SHORT[1], "equation_short"), (program("", 2), "program"), (None, None)],
    "original_fdd_pot_restored": [(program("# Chuong trinh tinh ngan gon\n", 0), "program"), (f"{BODIES[1]}\n{STUBS[1]}", "reasoning"), (program("# Chuong trinh tinh ngan gon\n", 2), "program"), (f"{BODIES[3]}\n{STUBS[3]}", "reasoning")],
    "fdd_lite_type_routing": [(SHORT[0], "equation_short"), (SHORT[1], "equation_short"), (SHORT[2], "equation_short"), (STUBS[3], "answer_only")],
    "tagged_short_solution": [(tagged(b, a), "tagged") for b, a in zip(BODIES, ANSWERS)],
    "tagged_equation_focused": [(tagged(b, a), "tagged") for b, a in zip(BODIES, ANSWERS)],
    "tagged_equation_minimal": [(tagged(b, a), "tagged") for b, a in zip(["Lan có 5 + 7 = 12 quả", "suy ra 3*x = 12\nVậy x = 4", "3 + 4 = 7", SAID], ANSWERS)],
    "tagged_answer_only": [(tagged(SAID, a), "tagged") for a in ANSWERS],
    "type_specific_equation_targets": [(SHORT[0], "gsm_equation_short"), (f"Phương trình: Ta có 3*x + 2 = 14\nGiải: suy ra 3*x = 12\nx = 4\n{LINE}4", "sv_fobar_variable_equation"), (SHORT[2], "math_symbolic_equation_short"), (STUBS[3], "math_answer_only")],
}


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RECORDS)], "i int, type string, response_vi string")


@pytest.mark.parametrize("style", sorted(EXPECTED))
def test_every_style(records, style):
    rows = targets.build(records, style).orderBy("i").collect()
    want = [(t, k, None if t else "no_target") for t, k in EXPECTED[style]] + MISSING
    assert [(r["target"], r["target_kind"], r["reject"]) for r in rows] == want


def test_all_styles_have_fixtures():
    assert set(EXPECTED) | {"preprocessed_target"} == set(targets.STYLES)


def test_options(spark, records):
    routed = {r["i"]: (r["target"], r["target_kind"]) for r in targets.build(records, "fdd_lite_type_routing", route=True).collect()}
    assert routed[1] == (STUBS[1], "fdd_lite") and routed[0] == (SHORT[0], "equation_short")
    kept = {r["i"]: (r["target"], r["target_kind"]) for r in targets.build(records, "answer_only", keep_unanswered=True).collect()}
    assert kept[5] == ("chẳng có gì", "unanswered")
    strict = {r["i"]: r["reject"] for r in targets.build(records, "answer_only", numeric_only=True).collect()}
    assert strict[3] == "non_numeric_gold" and strict[0] is None
    given = spark.createDataFrame([(1, "GSM_A", ADD, " ready\r\nmade "), (2, "GSM_A", ADD, None)], "i int, type string, response_vi string, mine string")
    for style in targets.GIVEN:
        out = {r["i"]: (r["target"], r["target_kind"]) for r in targets.build(given, style, given="mine").collect()}
        assert out[1] == ("ready\nmade", "given") and out[2][1] != "given"
    ready = {r["i"]: (r["target"], r["reject"]) for r in targets.build(given, "preprocessed_target", given="mine").collect()}
    assert ready == {1: ("ready\nmade", None), 2: (None, "no_target")}
    with pytest.raises(ValueError, match="unknown"):
        targets.build(records, "nothing")


def test_lines_are_shortened_once_each_and_up_to_a_length(spark):
    from pyspark.sql import functions as F

    long = "một " * 20 + "rồi 12 + 30 = 42 " + "xong " * 12
    texts = [long + ". " + "1 + 1 = 2. 1 + 1 = 2; 2 + 2 = 4", "a" * 200 + " 1 + 1 = 2", "1 + 2 = 3 <b> x. print(3)= 3 + 0", ". ".join(f"{i} + {'1' * 60} = 5" for i in range(9))]
    got = [r["l"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(targets.equation_lines(F.col("t"), 4).alias("l")).collect()]
    assert "12 + 30 = 42" in got[0][0] and len(got[0][0]) <= 55 + 1 + 80 and got[0][1:] == ["1 + 1 = 2", "2 + 2 = 4"]
    assert got[1] == [] and got[2] == []
    assert len(got[3]) == 4 and sum(len(x) + 1 for x in got[3]) - 1 <= 300

"""Programs as answers, and settings."""

import json

import pytest

from abacora.functions import programs
from abacora.sources import settings


@pytest.mark.parametrize(
    "code, result",
    [
        ("x = 3\nprint(x * 4)", "12"), ("answer = 5", "5"), ("answer = 5\nprint('no number')", "5"), ("print(1)\nprint(2, 9)", "9"),
        ("```py\nprint(sqrt(16))\n```\nprint(1)", "4.0"), ("Câu hỏi: a?\nprint(1)\nĐáp án: 2", "1"), ("a = b = 2\nprint(a + b)", "4"), ("print(round(pi, 2))", "3.14"),
        ("print(2 ** 8)", "256"), ("print(2 ** 9)", None), ("n = 2\nprint(2 ** n)", None), ("import os", None), ("print(open('/etc/passwd'))", None), ("x.y = 1", None), ("__a = 1\nprint(1)", None),
        ("print(max(1, 2, key=abs))", None), ("print([1])", None), ("print(1/0)", None), ("print(unknown)", None), ("print('a' * 9)", None), ("", None), (None, None), ("x = 99 ** 8\n" + "x = x * x\n" * 20 + "print(x)", None), ("(" * 900 + "1", None),
        ("print(1)\n" * 24 + "print(2)", "1"), ("while True:\n  print(1)", None), ("print(1)" + " " * 9 + "#" + "a" * 3000, None),
    ],
)
def test_programs(code, result):
    assert programs.result_of(code) == result


@pytest.mark.parametrize(
    "text, code",
    [
        ("1 + 2", "1+2"), ("-3,5", "-3.5"), ("1,000 + 2", "1000+2"), ("1,00 + 2", None), (r"\boxed{\frac{1}{2}}", "(((1)/(2)))"), (r"2\pi(3)", "2*pi*(3)"), (r"\sqrt 9 \cdot 2", "sqrt(9)*2"), (r"\sqrt{2}3", "sqrt(2)*3"),
        (r"\text{m} 5 × 3%", "5*3"), ("2^3", None), ("x + 1", None), ("", None), (None, None), ("(1", None), ("1)", None), (r"\frac{1}", None), ("1 000", "1000"), ("sqrt(4)", "sqrt(4)"),
    ],
)
def test_expressions(text, code):
    assert programs.python_expression(text) == code


def test_settings(spark, tmp_path, monkeypatch):
    s = settings.Settings(spark)
    monkeypatch.setenv("MOST", " none ")
    monkeypatch.setenv("FAST", "Yes")
    monkeypatch.setenv("BLANK", "")
    assert s.limit("MOST", 5) is None and s.flag("FAST", False) and s.whole("BLANK", 3) == 3 and s.number("ABSENT", 0.5) == 0.5 and s.text("BLANK", "d") == "d"
    spark.conf.set("spark.abacora.most", "7")
    try:
        assert s.limit("MOST", 5) == 7
    finally:
        spark.conf.unset("spark.abacora.most")
    assert settings.json_if_there(str(tmp_path / "a.json")) == {}
    (tmp_path / "a.json").write_text(json.dumps({"a": 1}))
    assert settings.json_if_there(str(tmp_path / "a.json")) == {"a": 1}
    assert settings.resolve_folder(None, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        settings.resolve_folder(str(tmp_path / "no"), [str(tmp_path)])

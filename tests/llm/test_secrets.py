"""The assignment lexer."""

from __future__ import annotations

import time

import pytest

from quillframe.llm import secrets


def literals(text):
    return [text[a:b] for a, b, _ in sorted(secrets.literal_spans(text))]


CASES = [
    ("x" * 200 + '_pwd = "Zx91kQpLm2Tr!!"', ["Zx91kQpLm2Tr!!"]),
    ("'pwd' => 'Zx91kQpLm2Tr'", ["Zx91kQpLm2Tr"]),
    (r'db_pwd = "Zx91\"kQpLm2Tr"', [r"Zx91\"kQpLm2Tr"]),
    ('passphrase: "correct Horse battery 9 staple"', ["correct Horse battery 9 staple"]),
    ("<password>Zx91kQpLm2Tr</password>", ["Zx91kQpLm2Tr"]),
    ('<add key="db_password" value="Zx91kQpLm2Tr"/>', []),
    ('<entry key="db_password">Zx91kQpLm2Tr</entry>', ["Zx91kQpLm2Tr"]),
    ('db_pwd = """Zx91kQ\npLm2Tr"""', ["Zx91kQ\npLm2Tr"]),
    ('password: str = "Xk29fjw83kd0"', ["Xk29fjw83kd0"]),
    ('var apiKey string = "Xk29fjw83kd0"', ["Xk29fjw83kd0"]),
    ('config["password"] = "Xk29fjw83kd0"', ["Xk29fjw83kd0"]),
    ('pwd := "Xk29fjw83kd0"', ["Xk29fjw83kd0"]),
    ("DB_PASS_KEY='Xk29fjw83kd0'\nexport MY_SECRET=$DB_PASS_KEY", ["Xk29fjw83kd0"]),
    ("a='Xk29fjw83kd0'\nMY_SECRET=${a}", ["Xk29fjw83kd0"]),
    ('my_secret = "Xk29" + "fjw83kd0QQ"', ["fjw83kd0QQ"]),
    # The order of statements counts.
    ('k1 = "Xk29fjw83kd0"; k1 = "plain12345678"; db_pwd = k1', ["plain12345678"]),
    ('k1 = "Xk29fjw83kd0"; db_pwd = k1; k1 = "plain12345678"', ["Xk29fjw83kd0"]),
    ("db_pwd = $late\nlate = 'Xk29fjw83kd0'", ["Xk29fjw83kd0"]),
    # So do scopes.
    ('k = "Xk29fjw83kd0"\nf() {\n let k = "inner12345678"\n}\ndb_pwd = k', ["Xk29fjw83kd0"]),
    ('def f():\n    k = "inner12345678"\n    db_pwd = k\n', ["inner12345678"]),
    ("# password = 'Xk29fjw83kd0'", ["Xk29fjw83kd0"]),
    ("pwd: Xk29fjw83kd0", ["Xk29fjw83kd0"]),
    # Not secrets.
    ("password: required", []),
    ("if password == 'Xk29fjw83kd0x':", []),
    ("pwd = get_secret('Xk29fjw83kd0')", []),
    ('title = "Xk29fjw83kd0"', []),
    ("The key: don't tell anyone about it.", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_literals(text, want):
    assert literals(text) == want


def test_linear():
    n = 200_000
    for unit in ("a.", "-", "def a ", "key=", 'key="', "key='''", "key=`", "<key a=''", "{", "}", "key=k;", "pwd:a ", "[\"key\"]", "key = $k + "):
        text = "secret " + unit * (n // len(unit))
        start = time.perf_counter()
        secrets.scan(text)
        assert time.perf_counter() - start < 8, unit

"""Rewrites done once for each form of a text: the same as text by text, whatever the literals and numbers."""

import random

from sourceloom.functions import rewrite as rw
from sourceloom.functions import sqltree

DIALECTS = (rw.ORACLE_TO_MYSQL, rw.DB2_TO_MYSQL, rw.MYSQL_TO_ORACLE, rw.CONCATENATION)
PARTS = ["'a'", "'it''s'", "'||, ('", "12", "3.5e7", "5.", ".5", "x1", "$1", "#2", "a$1", "NVL(", "DECODE(", "ADD_MONTHS(", "NOW(", ")", ")", "(", ",", "||", "||", " ", " ", "\n", "+", "*", "-", "--c 1\n", "/* 'x' 2 */"]
PARTS += ["CASE", "WHEN", "END", "SELECT", "FROM", "FETCH FIRST 10 ROWS ONLY", "LIMIT 5 OFFSET 3", "SYSDATE", ":v", ":v.m[1]:i", "::t", '"q 1"', "`n 2`", "'open ", '"open ', "0", "{0}", "%", "٣", ";"]


def test_same_as_text_by_text():
    pick = random.Random(7)
    for dialect in DIALECTS:
        forms = sqltree.Forms(dialect.of_tokens, most=300)
        for _ in range(4000):
            text = "".join(pick.choice(PARTS) + pick.choice(["", " "]) for _ in range(pick.randrange(14)))
            assert forms(text) == dialect.rewritten(text), text


def test_a_form_is_rewritten_once():
    seen = []
    forms = sqltree.Forms(lambda held: seen.append(1) or rw.ORACLE_TO_MYSQL.of_tokens(held))
    made = [forms(f"SELECT NVL(a, '{k}''s') || DECODE(b, {k}, {k + 1}, 2) FROM t WHERE c = 'n{k} || x'") for k in range(1000)]
    assert made[7] == "SELECT CONCAT(IFNULL(a, '7''s'), CASE b WHEN 7 THEN 8 ELSE 2 END) FROM t WHERE c = 'n7 || x'"
    assert len(seen) == 1 and len(set(made)) == 1000


def test_forms_are_bounded():
    forms = sqltree.Forms(rw.CONCATENATION.of_tokens, most=10, size=50)
    for k in range(100):
        assert forms(f"a{k} || b") == f"CONCAT(a{k}, b)"
    assert len(forms.known) <= 10
    forms("a || " + "b" * 100)
    assert all(len(form[0]) <= 50 for form in forms.known)

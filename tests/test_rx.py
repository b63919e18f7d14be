"""The translated dialect gives in Java what it gives in Python's engine with ASCII classes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilgraph.functions import rules
from veilgraph.functions.rx import java

PIECES = ["é", "12", "123456789", "AB", "x", " ", " ", "\n", "-", ".", "@", "S", "1234567", "D", "mail@host.org", "+65 9123 4567", "Jane", "Doe", "$", "1,000", "File No. 0-26071", "(202) 274-2000", "_", "😀", "/", "Wi-Fi 6", "EX-10.1", "é123456789", "9"]


def python_form(pattern, flags):
    space = "[ \\t\\n\\x0b\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out += space[1:-1] if inside else space
            i += 2
        elif two[0] == "\\":
            out += two
            i += 2
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out += two[0]
            i += 1
    return re.compile(out, re.A | (re.I if "i" in flags else 0))


@pytest.mark.parametrize("rule", [*((p, f) for p, f, _ in rules.FLOOR), *((p, f) for _, _, p, f, g in rules.RAILS if g == 0), *((p, "") for p, _ in rules.DENSITY)])
def test_rules_agree(spark, rule):
    pattern, flags = rule
    r = random.Random(pattern)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randrange(1, 30))) for _ in range(300)]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.regexp_extract_all("t", F.lit(java(pattern, flags)), 0).alias("m")).collect()
    rule = python_form(pattern, flags)
    assert {x.i: x.m for x in found} == {i: [m[0] for m in rule.finditer(t)] for i, t in enumerate(texts)}

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.rules import _pattern

#: Pattern, texts that match, texts that don't.
CASES = [
    ("amzn|amazon", ["an amazon x"], ["AMAZON"]),
    ("(?i)amzn", ["AMZN"], ["amz"]),
    ("am(?i)ZN", ["amZN", "amzn"], ["AMzn"]),
    ("(?P<shop>amzn)", ["amzn"], ["am"]),
    ("(?<shop_1>amzn)", ["amzn"], ["am"]),
    (r"^\p{L}+$", ["straße", "abc"], ["ab1", "abc\n"]),
    (r"\pN", ["x٣"], ["x"]),
    (r"\p{Greek}", ["λ"], ["l"]),
    (r"\p{^Greek}", ["l"], ["λ"]),
    (r"\P{Lu}", ["a"], ["A"]),
    (r"\p{Uppercase_Letter}", ["Ä"], ["ä"]),
    (r"^\w+$", ["größe"], ["a b"]),
    (r"^\d$", ["5", "٣"], ["a"]),
    ("(?i)Ä", ["ä"], ["a"]),
    ("a.b", ["a\rb", "a b"], ["a\nb"]),
    ("end$", ["the end"], ["the end\n"]),
    ("(?m)^b$", ["a\nb\nc"], ["a\rb"]),
    ("[[:alpha:]]+9", ["ab9"], ["ä9", "9"]),
    ("[[:^digit:]]", ["a"], ["12"]),
    ("[]a]", ["]"], ["b"]),
    ("[a-z&&[^aeiou]]", ["b"], ["a"]),
    ("^a++$", ["aaa"], ["ab"]),
    ("^(?:ab)+?$", ["abab"], ["aba"]),
    ("x{2,3}y", ["xxy"], ["xy"]),
    (r"\x{41}B", ["AB"], ["ab"]),
    (r"\#\-\.", ["#-."], ["x"]),
    ("(a|b(c))*d", ["abcd"], ["x"]),
]


@pytest.mark.parametrize("pattern,yes,no", CASES)
def test_dialect(spark, pattern, yes, no):
    made = _pattern(pattern)
    assert made is not None
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", F.col("t").rlike(made).alias("m")).collect()
    assert {r.t: r.m for r in rows} == dict.fromkeys(yes, True) | dict.fromkeys(no, False)


@pytest.mark.parametrize("pattern", ["(", ")", "[", "a**b)", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(?>a)", r"(a)\1", r"(?<n>a)\k<n>", r"\Qa\E", r"\p{NoSuch}", "*a", "a{2,1}", r"\G", "[a--b]", "(?#x)a", "\\"])
def test_what_is_no_pattern(spark, pattern):
    assert _pattern(pattern) is None

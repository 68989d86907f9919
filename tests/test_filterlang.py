"""The filter language: values, truths, errors."""

import math

import pytest
from pyspark.sql import functions as F

from spanforge.functions import filterlang as L
from spanforge.functions.sequence import parse_cigar

# (expression, number) over constants
NUMBERS = [
    ("1", 1), ("0x1f", 31), ("1e3", 1000), ("-5", -5), ("+7", 7), ("!7", 0), ("!0", 1), ("!0.5", 1), ("~5", -6), ("2+3*4", 14), ("(2+3)*4", 20), ("7%3", 1), ("-7%3", -1), ("7.9%3.5", 1), ("7/2", 3.5),
    ("4*(2<3)+4", 8), ("1 ^ 0&4 ^ 3", 2), ("6&3|8", 10), ("0 && 3 || 2", 1), ("1 || 0 && 0", 0), ("1<2 == 3>2", 1), ("3 > 2 > 1", 1), ("5 >= 5", 1), ("5 <= 4", 0), ('"abc" < "abd"', 1), ('"a" == "a"', 1), ('"a" != "a"', 0),
    ('"a" == 1', 0), ('"a" != 1', 1), ('"a" < 1', 0), ('"foobar" =~ "o{2}b"', 1), ('"foobar" !~ "^bar"', 1), ('"a1" =~ "^[[:alpha:]][[:digit:]]$"', 1), ('"]" =~ "[]]"', 1), ('"a.b" =~ "a\\.b"', 1), ("length(\"four\")", 4), ('min("bca")', 97), ('max("bca")', 99), ('avg("ac")', 98), ('avg("")', 0),
    ("sqrt(16)", 4), ("pow(2,10)", 1024), ("log(exp(3))", 3), ("default(5, 7)", 5), ('"a\\"b" == "a\\"b"', 1), ("1 + 2 == 3 && 4", 1),
]


def test_numbers(spark):
    none = lambda name: None
    values = [L.compile_value(e, none) for e, _ in NUMBERS]
    row = spark.range(1).select(*[v.num.alias(f"v{k}") for k, v in enumerate(values)]).first()
    for (e, want), got in zip(NUMBERS, row, strict=True):
        assert math.isclose(got, want), (e, got)
    odd = spark.range(1).select(*[L.compile_value(e, none).num.alias(f"v{k}") for k, e in enumerate(("1/0", "-1/0", "0/0", "5%0", 'min("")'))]).first()
    assert odd[0] == math.inf and odd[1] == -math.inf and all(math.isnan(x) for x in odd[2:])


@pytest.mark.parametrize("bad", ["1 +", "(1", "1 2", '"a" + 1', '"a" & 1', '1 =~ "a"', "nosuch", "length (\"a\")", "length(1)", '"a" =~ "[[:nosuch:]]"', "1 &", "@"])
def test_errors(spark, bad):
    with pytest.raises(L.FilterError):
        L.compile_value(bad, lambda name: None)


def test_records(spark):
    tag = "struct<type:string,value:string>"
    df = spark.createDataFrame(
        [("r1", 99, "c1", 9, 60, "5M", {"NM": ("i", "0"), "RG": ("Z", "g")}, "lib"), ("r2", 16, "c2", 99, 0, "2M1D2M", {}, None), ("r3", 4, "*", -1, 0, "*", {"XF": ("f", "2.5")}, None)],
        f"qname string, flag int, rname string, pos long, mapq int, cigar_text string, tags map<string,{tag}>, library string",
    ).withColumn("cigar", parse_cigar(F.col("cigar_text")))

    def names(e):
        return sorted(r[0] for r in L.passing(df, e, L.alignment_symbols(df)).select("qname").collect())

    assert names("[NM]") == ["r1"]
    assert names("[NM] == 0") == ["r1"]
    assert names('[RG] != "g"') == ["r2", "r3"]
    assert names("[XF] > 2") == ["r3"]
    assert names("library") == ["r1", "r2", "r3"]
    assert names('library == "lib"') == ["r1"]
    assert names("flag.paired && !flag.reverse") == ["r1"]
    assert names("pos == 10 || endpos >= 104") == ["r1", "r2"]
    assert names("rlen == 5 && qlen == 4 && ncigar == 3") == ["r2"]
    assert names("mapq >= 30 || flag.unmap") == ["r1", "r3"]

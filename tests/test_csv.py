"""Quoted values against Python's csv module."""

import csv
import io
import random

import pytest

from tessera.sources.files import csv_detect_escape, from_csv

PIECES = ["a", '"', '""', ",", ";", " ", "é", "'", "x y", "1"]


@pytest.mark.parametrize("style", ["doubled", "slashed"])
@pytest.mark.parametrize("separator", [",", ";"])
def test_values_equal_pythons_reader(spark, tmp_path, style, separator):
    rng = random.Random(len(style) + ord(separator))
    rows = [["v" + "".join(rng.choice(PIECES) for _ in range(rng.randrange(5))) + "z" for _ in range(3)] for _ in range(120)]
    how = {"doublequote": True} if style == "doubled" else {"doublequote": False, "escapechar": "\\"}
    out = io.StringIO()
    csv.writer(out, delimiter=separator, lineterminator="\n", quoting=csv.QUOTE_ALL, **how).writerows([["a", "b", "c"], *rows])
    path = tmp_path / "x.csv"
    path.write_text(out.getvalue(), encoding="utf-8")
    assert list(csv.reader(io.StringIO(out.getvalue()), delimiter=separator, **how))[1:] == rows
    assert csv_detect_escape(spark, str(path), separator, '"') == ('"' if style == "doubled" else "\\")
    assert sorted(map(list, from_csv(spark, str(path), separator=separator, enclosure='"').df.collect())) == sorted(rows)


def test_doubled_quotes_empty_values_and_equal_headers(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,name,name\n1,"q ""r"" s, t",""\n2,"""",x\n3,"",""\n')
    f = from_csv(spark, str(path), separator=",", enclosure='"')
    assert f.columns == ["id", "name", "name_2"]
    assert sorted(map(tuple, f.df.collect())) == [("1", 'q "r" s, t', None), ("2", '"', "x"), ("3", None, None)]
    path.write_text('a,b\n"x\\"y","p""q"\n')
    with pytest.raises(ValueError, match="escape"):
        from_csv(spark, str(path), separator=",", enclosure='"')
    assert from_csv(spark, str(path), separator=",", enclosure='"', escape="\\").columns == ["a", "b"]

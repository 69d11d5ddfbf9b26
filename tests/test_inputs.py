"""CSV values beyond the sample that types are inferred from."""

from __future__ import annotations

import pytest
from quernflow.sources import InputFile, read_input


@pytest.fixture
def late(tmp_path):
    rows = [f"{i},{i},{i},2026-01-01,true" for i in range(1000)]
    p = tmp_path / "late.csv"
    p.write_text("\n".join(["i,l,t,d,b", *rows, "3.5,3000000000,abc,2026-01-01T00:00:01,no", "7"]) + "\n")
    return InputFile("v", str(p))


def test_values_after_the_sample_are_kept(spark, late):
    with pytest.warns(UserWarning, match="after the sample"):
        df = read_input(spark, late)
    assert [t for _, t in df.dtypes] == ["double", "bigint", "string", "timestamp", "string"]
    rows = df.collect()
    assert len(rows) == 1002 and (rows[1000].i, rows[1000].l, rows[1000].t, rows[1000].b) == (3.5, 3000000000, "abc", "no")
    assert rows[1000].d.second == 1 and rows[999].d.year == 2026 and tuple(rows[1001]) == (7.0, None, None, None, None)


def test_strict_fails_on_values_after_the_sample(spark, late, tmp_path):
    df = read_input(spark, late, strict=True)
    assert [t for _, t in df.dtypes] == ["int", "int", "int", "date", "boolean"]
    for c in df.columns:
        with pytest.raises(Exception, match="not of type"):
            df.select(c).collect()
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    assert [tuple(r) for r in read_input(spark, InputFile("v", str(tmp_path / "short.csv")), strict=True).collect()] == [(1, 2), (3, None)]


def test_sample_of_long_rows(spark, tmp_path):
    """1,000 whole rows are sampled, although they have more than eight million bytes and long values."""
    p = tmp_path / "long.csv"
    rows = [f"{i},2026-01-01,{'x' * 12_000}" for i in range(990)]
    p.write_text("i,day,s\n" + "\n".join([*rows, f'991,2026-01-02,"{"y\n" * 100_000}"', "2.5,2026-01-03,z"]) + "\n")
    df = read_input(spark, InputFile("v", str(p)), strict=True)
    assert [t for _, t in df.dtypes] == ["double", "date", "string"]
    assert df.where("i = 2.5").count() == 1

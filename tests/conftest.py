import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siltstone.session import local_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test data")
    return str(path)


@pytest.fixture(scope="session")
def duck(tiny):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(tiny).iterdir():
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def same(spark_df, duck_relation) -> None:
    """Equal as bags of rows, columns in any order."""
    got, want = spark_df.toPandas(), duck_relation.df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(df):
        df = df[columns].astype(object)
        return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)

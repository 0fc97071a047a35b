"""Queries must meet the cases they are for: SQL on sf0.01 shows that each branch occurs."""

import duckdb
import pytest

from orderlens.operators import ingest
from orderlens.plans import oracles, registry
from orderlens.sources import tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def rows():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    return lambda name: c.execute(oracles.oracle_sql()[name]).df()


def test_every_branch_occurs(rows):
    regions = rows("in21_region_of_country").region
    assert set(regions.dropna()) == set(ingest.REGIONS.values()) and regions.isna().any()
    broken = rows("in12_broken_rows")
    assert len(broken) == 11 and (broken.violations > 0).all()
    assert set(broken.rule) == {*ingest.MODEL_RULES, *ingest.STOCK_RULES, *ingest.LINE_RULES}
    fits = rows("io1_read_csv").fits
    assert fits.any() and not fits.all()
    chain = rows("st3_upload_chain")
    assert set(",".join(chain.reasons).split(",")) == {"", "amount", "status", "key", "duplicate"} and set(chain.batch_id) == {0, 1}
    assert rows("a17_attribution_channel").channel.nunique() == 5
    assert rows("a20_supplier_delivery").slow_share.between(0.01, 0.99).any()


def test_a_raw_upload_can_be_asked_for_its_bad_rows_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n4,5,6\n7,8\n")
    raw = tables.read_csv(spark, str(tmp_path), ["x", "y"])
    assert raw.where("_bad is not null").count() == 2 and raw.select("_bad").where("_bad is not null").count() == 2 and raw.count() == 4
    assert sorted(r._bad for r in raw.where("_bad is not null").collect()) == ["3", "4,5,6"]


def test_country_codes(spark):
    df = spark.createDataFrame([(f"NATION_{i}",) for i in range(11)], "country string")
    got = [r.c for r in df.select(registry.country_code(df.country).alias("c")).collect()]
    assert sorted(x.strip().upper() for x in got) == sorted([*ingest.REGIONS, "XX"])

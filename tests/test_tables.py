import contextlib
import io

import pytest

from tallyloom.sources import tables


@pytest.fixture(scope="module")
def shop(spark):
    """A database in memory with a catalog and buyers."""
    url = "jdbc:derby:memory:shop;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = connection.createStatement().execute
    run("CREATE TABLE catalog (bid INT, bname VARCHAR(40), bstyle VARCHAR(9), bsize INT, detid INT, isprimary INT, isunused INT)")
    run("INSERT INTO catalog VALUES " + ", ".join(f"({i % 7}, 'NAME {i}', 'IE', {'NULL' if i % 9 == 0 else i}, {i}, {int(i % 4 > 0)}, {int(i % 5 == 0)})" for i in range(1, 101)))
    run("CREATE TABLE buyers (head_id INT, name VARCHAR(40), city VARCHAR(40), is_active INT)")
    run("INSERT INTO buyers VALUES (1, ' A ', 'X ', 0), (2, 'B (CLOSE)', NULL, 1), (3, '  ', 'Y', 0), (NULL, 'D', 'Z', 0)")
    run("CREATE TABLE empties (id INT)")
    connection.close()
    return url


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_catalog_by_jdbc(spark, shop):
    catalog = tables.read_table(spark, shop, "catalog", "detid", 4)
    live = lambda i: i % 4 > 0
    pick = lambda i: live(i) and i % 5 and i % 9
    for rows, wanted in ((tables.catalog_for_matching(catalog), live), (tables.catalog_for_picking(catalog), pick)):
        rows = rows.select("bname", "detid")
        assert sorted(r.detid for r in rows.collect()) == [i for i in range(1, 101) if wanted(i)]
        assert rows.rdd.getNumPartitions() == 4
    told = plan(rows)
    assert all(f"EqualTo({c}," in told for c in ("ISPRIMARY", "ISUNUSED")) and "IsNotNull(BSIZE)" in told
    assert "ReadSchema: struct<BNAME:string,DETID:int>" in told


def test_buyers_by_jdbc(spark, shop):
    """is_active = 0 is live; rows without a key are read, too."""
    buyers = tables.live_buyers(tables.read_table(spark, shop, "buyers", "head_id", 2))
    assert sorted(((r.head_id, r.name, r.city) for r in buyers.collect()), key=str) == [(1, "A", "X"), (None, "D", "Z")]
    assert "EqualTo(IS_ACTIVE,0)" in plan(buyers)
    assert tables.read_table(spark, shop, "empties", "id").count() == 0

"""Queries of the training-data operators over the smallest tables."""

import duckdb
import pytest

from chronopanel.llm import queries as q


def test_found_claims_equal_sql(spark, sf):
    con = duckdb.connect()
    for t in ("membership_records", "membership_sources"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = {tuple(r) for r in con.sql(f"select group_id, field_name, membership_id from ({q.SQL['p1_found']})").fetchall()}
    assert {tuple(r) for r in q.p1_found(spark, sf).collect()} == want != set()


def test_matches_are_exclusive(spark, sf):
    rows = q.p5_found(spark, sf).collect()
    assert rows and len({r["identifier_id"] for r in rows}) == len(rows)
    assert all(r["security_id"] < r["identifier_id"] for r in rows)


def test_every_document_is_packed_within_capacity(spark, sf):
    n = q.document_sizes(spark, sf).count()
    caps = q.capacities(spark, sf)
    out = q.p8_containers(spark, sf)
    assert {r["container_name"]: r["docs"] for r in out.groupBy("container_name").agg({"doc_id": "approx_count_distinct"}).toDF("container_name", "docs").collect()}.keys() == caps.keys()
    for name, cap in caps.items():
        mine = out.where(out.container_name == name)
        assert mine.select("doc_id").distinct().count() == n
        assert mine.groupBy("container_id").sum("tokens").agg({"sum(tokens)": "max"}).first()[0] <= cap


@pytest.mark.parametrize("name", ["p1_survivors", "p1_sources", "p8_report", "p9_mix", "p9_shares", "p10_found", "p10_rates"])
def test_query_gives_rows(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def listings(con, folder, securities, rows):
    """The tables of p5 with securities (id, ticker, cik, name) and rows (id, ticker, cik, isin, notes)."""
    con.execute("create table s (security_id bigint, primary_ticker varchar, cik varchar, name varchar)")
    con.execute("create table k (identifier_id bigint, ticker varchar, cik varchar, isin varchar, notes varchar)")
    con.executemany("insert into s values (?, ?, ?, ?)", securities)
    con.executemany("insert into k values (?, ?, ?, ?, ?)", rows)
    for name, sql in {
        "securities": "from s",
        "known_identifiers_seed": "select *, null::date as valid_from, null::date as valid_to from k",
        "ticker_history": "select security_id, primary_ticker as ticker, date '2010-01-04' as valid_from from s",
        "ticker_snapshots": "select security_id, date '2015-01-05' as snapshot_date, primary_ticker as ticker, 'active' as listing_status, timestamp '2015-01-06' as loaded_at from s",
    }.items():
        con.execute(f"copy ({sql}) to '{folder}/{name}.parquet'")
    return str(folder)


def test_an_isin_of_any_number_of_rows_carries_a_match_on(spark, tmp_path):
    """One row names the company, 300 have only its ISIN; 250 companies' rows have one other ISIN and keep their own matches."""
    securities = [(1, "AAAA", "1234567", "Zyxcor Inc"), (2, "BBBB", "7654321", "Quobble Ltd")]
    securities += [(100 + i, f"T{i:03d}", None, None) for i in range(250)]
    rows = [(10_000, "AAAA", "1234567", "US0378331005", "Zyxcor Inc")]
    rows += [(10_001 + i, None, None, "US0378331005", f"Page {i}.") for i in range(300)]
    rows += [(10_400, None, "7654329", "US0378331005", "Quobble Ltd")]  # speaks for another company
    rows += [(20_000 + i, f"T{i:03d}", None, "US0000000000", None) for i in range(250)]
    rows += [(20_300 + i, None, None, "US0000000000", f"Line {i}.") for i in range(5)]
    d = listings(duckdb.connect(), tmp_path, securities, rows)
    got = {tuple(r) for r in q.p5_found(spark, d).collect()}
    want = {(1, 10_000 + i) for i in range(301)} | {(2, 10_400)} | {(100 + i, 20_000 + i) for i in range(250)}
    assert got == want


def test_a_word_of_more_than_200_rows_still_makes_candidates(spark, tmp_path):
    """A word in 0.2 % of 150,000 rows tells a company from another, though 260 rows have it."""
    con = duckdb.connect()
    rows = [(100_000 + i, None, None, None, f"Zyxcor Inc, clerk {chr(97 + i // 26) * 5}{chr(97 + i % 26) * 5}") for i in range(260)]
    d = listings(con, tmp_path, [(1, "AAAA", None, "Zyxcor Inc")], rows)
    con.execute(f"copy (from s union all select i, 'S' || i, null, null from range(2, 75000) t(i)) to '{tmp_path}/securities.parquet'")
    con.execute(f"copy (select *, null::date as valid_from, null::date as valid_to from (from k union all select 200000 + i, null, null, null, 'Page ' || i from range(75000) t(i))) to '{tmp_path}/known_identifiers_seed.parquet'")
    got = {tuple(r) for r in q.p5_found(spark, d).collect()}
    assert got == {(1, 100_000 + i) for i in range(260)}

"""The operators' SQL against DuckDB on the same tables, in whole or for the columns that SQL can tell."""

import duckdb
import pandas as pd
import pytest

from siftwork.llm import queries

TABLES = "documents pages conversations".split()
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
PARTS = {
    "op3_shards": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, 'rows' AS law FROM documents",
    "op4_media_columns": """SELECT doc_id, n AS n_bytes, greatest(64, (n + 63) // 64 * 64) AS payload_bytes, sha256(coalesce(text, '') || repeat(chr(0), greatest(64, (n + 63) // 64 * 64) - n)) AS payload_sha256, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, strlen(coalesce(text, '')) AS n FROM documents)""",
    "op7_lm_score": r"""WITH d AS (SELECT doc_id, list_append(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), ' end') AS w FROM documents) SELECT doc_id, len(w) AS n_tokens FROM d""",
    "op8_source_mix": f"""WITH RECURSIVE d AS (SELECT doc_id, source, {WORDS} AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
r AS (SELECT 0 AS k, source, source_size, weight, 0.0::DOUBLE AS level FROM s UNION ALL SELECT k + 1, source, source_size, weight,
(1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (2 * source_size <= weight * level) OVER (), 0)) / sum(weight) FILTER (2 * source_size > weight * level) OVER () FROM r WHERE k < 12),
t AS (SELECT source, source_size, least(2 * source_size, weight * level) AS target FROM r WHERE k = 12) SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 4) AS target FROM d JOIN t USING (source)""",
    "op9_byte_bpe": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def rows(frame):
    plain = lambda v: None if v is None or pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else round(v, 4) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_whole(spark, data, duck, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(PARTS))
def test_part(spark, data, duck, name):
    want = duck.execute(PARTS[name]).df()
    got = queries.QUERIES[name](spark, data).toPandas()[list(want.columns)]
    assert len(want) and rows(got) == rows(want)

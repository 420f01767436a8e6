import duckdb
import pyarrow as pa
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, extra=False):
        """Rows from texts or (doc_id, text) pairs; ``extra`` adds columns whose names operators use inside."""
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
        if extra:
            for c in ("bucket", "flags", "cid", "shard", "ids", "toxicity_", "starts"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make


@pytest.fixture(scope="session")
def same_as_sql():
    """Asserts that rows equal those of a DuckDB query over the given documents."""

    def check(rows, sql, texts):
        docs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        con = duckdb.connect()
        con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())}))
        want = con.sql(sql)
        names = sorted(want.columns)
        assert sorted(rows.columns) == names
        key = lambda r: tuple((v is not None, str(v)) for v in r)
        got = sorted((tuple(r[n] for n in names) for r in rows.collect()), key=key)
        expected = sorted((tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall()), key=key)
        assert len(got) == len(expected)
        for a, b in zip(got, expected, strict=True):
            assert a == pytest.approx(b) if any(isinstance(v, float) for v in a) else a == b

    return check

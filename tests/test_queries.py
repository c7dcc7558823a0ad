"""Every registered query of the transcript engine against its SQL, on the smallest tables."""

import duckdb
import pytest

import swaralens.plans  # noqa: F401  registers the queries
from swaralens.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "NULL" if v is None or v != v else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_character_errors_in_any_script(spark, tmp_path):
    """Other letters of one script are errors, by a distance in plain Python."""

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, line = line, [i + 1]
            for j, y in enumerate(b):
                line.append(min(before[j] + (x != y), before[j + 1] + 1, line[j] + 1))
        return line[-1]

    texts = ["नमस्ते दुनिया", "नमस्कार दुनियाँ", "été à Zürich", "ete a Zurich", "घर", "धर", "a😀b", "a😁b\n", "ab"]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {k: round(edits(a, b) / len(a) * 100, 1) for k, (a, b) in enumerate(zip(texts, texts[1:]), 1)}
    got = {r["turn"]: r["cer"] for r in QUERIES["cer_turns"](spark, str(tmp_path)).collect()}
    assert got == want and want[5] == 50.0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {t: c for _, t, c in con.execute(ORACLE_SQL["cer_turns"]).fetchall()} == want


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_queries_without_the_training_data_operators(monkeypatch):
    """Where they cannot be imported, for whatever library is missing, the others stay registered."""
    import sys

    import __spark_entry__ as e

    for name in ("swaralens.llm", "swaralens.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL)

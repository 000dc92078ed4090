"""Every query with an oracle gives DuckDB's rows on the smallest tables, and no oracle is vacuous."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def cases():
    from quizmill.plans.catalogue import SQL

    return sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", cases())
def test_query_against_sql(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    at, bt = [df.columns.index(c) for c in sorted(names)], [names.index(c) for c in sorted(names)]
    assert sorted(tuple(norm(r[i]) for i in at) for r in got) == sorted(tuple(norm(r[i]) for i in bt) for r in want)
    assert want


def test_every_rule_has_hits_and_misses(spark):
    from quizmill.operators import rules
    from quizmill.plans.views import items

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    x = rules.with_reference_ratio(items(spark, "/root/testdata/sf0.01"), None).cache()
    n = x.count()
    by = {r["code"]: r["n"] for r in rules.flags(x, [*rules.stem_rules(), *rules.item_rules(), *rules.analyzer_rules()]).groupBy("code").agg({"item_id": "approx_count_distinct"}).toDF("code", "n").collect()}
    for code in ("alternativas_duplicadas", "placeholder_residual", "vazamento_de_artefato", "dependencia_visual_ausente", "iwf_gabarito_mais_longo", "iwf_comando_negativo", "iwf_termo_absoluto", "iwf_termo_vago", "gabarito_repetido_no_enunciado", "gabarito_ipv4_inconsistente", "comando_da_questao_ausente"):
        assert 0 < by.get(code, 0) < n, code

"""The pN_ queries against SQL, on empty tables, with nulls, and with clashing columns."""

import os

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gleanery.llm import queries as Q

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = Q.queries(), Q.oracle_sql()
COLUMNS = {"p1_found": ["doc_id"], "p2_found": ["doc_id", "line_no"], "p4_found": ["doc_id"], "p5_found": ["doc_id_a", "doc_id_b"], "p6_found": ["doc_id", "line_no"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
#: Names that the operators use inside.
CLASHES = ["site", "key", "rep", "n", "term", "tf", "score", "contributor", "label", "token", "chunk", "at", "leaf", "template", "vector", "grp", "_g", "_r", "_keys", "_w", "band", "lang_", "support", "uses", "block", "main", "line_no", "words_", "df", "size", "position"]


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple("null" if v is None or (isinstance(v, float) and v != v) else repr(round(float(v), 9)) if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), c.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def changed(folder, change):
    for f in os.listdir(DATA):
        pq.write_table(change(pq.read_table(f"{DATA}/{f}")), os.path.join(folder, f))
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_tables(spark, tmp_path, name):
    (tmp_path / "e").mkdir(), (tmp_path / "c").mkdir(), (tmp_path / "z").mkdir()
    nothing = changed(tmp_path / "e", lambda t: t.slice(0, 0))
    assert QUERIES[name](spark, nothing).count() == 0

    def clash(t):
        for c in CLASHES:
            if c not in t.column_names:
                t = t.append_column(c, pa.array(["x"] * len(t)))
        return t

    want = QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert want.columns == COLUMNS[name]
    assert normal(QUERIES[name](spark, changed(tmp_path / "c", clash)).toPandas()) == normal(want.toPandas())

    def nulls(t):
        """Rows of nulls but for the identifier."""
        ids = [c for c in t.column_names if c in ("doc_id", "item_id")]
        blank = pa.table({f.name: t.column(f.name).slice(0, 3) if f.name in ids else pa.nulls(len(t.slice(0, 3)), f.type) for f in t.schema})
        if ids:
            blank = blank.set_column(blank.column_names.index(ids[0]), ids[0], pa.array([10**9 + i for i in range(len(blank))], t.schema.field(ids[0]).type))
        return pa.concat_tables([t, blank.cast(t.schema)])

    assert QUERIES[name](spark, changed(tmp_path / "z", nulls)).count() >= 0

"""Queries next to their SQL, on the given tables and on odd rows."""

import pytest

from checks.compare import connect, difference
from conftest import SF
from wearline.llm import queries

ODD = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e f g h"),
        (8, "A b\x0bc d e f g h"), (9, "Ä b c d"), (10, "ä b c d"), (11, "x y z " * 2000), (12, "x y z " * 3),
        (-13, " ".join(f"w{k}" for k in range(60))), (14, " ".join(f"w{k}" for k in range(58))), (15, "a\u00a0b c d")]),
    "pages": ("page_id long, url string, html string", [
        (1, None), (2, ""), (3, "no host"), (4, "HTTP://Example.NET/en/x?y"), (5, "a://example.net/EN/"), (6, "://net"),
        (7, "http://net:80/"), (8, "http://xnet/"), (9, "http://a.example.com/de/#"), (10, "http://a://b.org/fr/"),
        (11, "http://casino.org/fr/"), (12, "http://my-casino.com"), (13, "http://casinos.com/?://net/"), (14, "http://É.NET")]),
    "conversations": ("conv_id long, turn long, role string, text string", [
        (1, 0, "user", None), (1, 1, "assistant", "\\</turn><says>\\\\"), (2, None, None, "<<turn>"), (2, 0, "assistant", ""),
        (2, 0, "assistant", "\U0001f600 b"), (2, 0, "assistant", "\U0001f600 b"), (3, 5, "assistant", "later"),
        (3, -600, "assistant", "first")]),
}


@pytest.mark.parametrize("name", ["op1_chat", "op3_url_filter", "op8_near_dedup"])
def test_query_equals_its_sql(spark, name, tmp_path):
    query, statement = queries.queries()[name], queries.oracle_sql()[name]
    assert difference(query(spark, SF), connect(SF), statement) == ""
    con = connect(SF)
    for table, (schema, rows) in ODD.items():
        width = schema.count(",") + 1
        df = spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert difference(query(spark, str(tmp_path)), con, statement) == ""

"""Query 1: test cases that are the same case with small changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.near_dups import NearDuplicates
from millrace.llm.registry import query
from millrace.sources.tables import table


def _near(spark: SparkSession, folder: str) -> NearDuplicates:
    return NearDuplicates(table(spark, folder, "test_entries"), "entry_index", ["patch", "code", "patched_code"], k=3, percent=70)


_FIELDS = " UNION ALL ".join(f"SELECT entry_index, list_transform(regexp_extract_all({f}, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM test_entries" for f in ("patch", "code", "patched_code"))


@query(f"""WITH f AS ({_FIELDS}), g AS (SELECT entry_index, w, unnest(range(1, len(w) - 1)) AS i FROM f WHERE len(w) >= 3), s AS (SELECT DISTINCT entry_index, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM g),
  n AS (SELECT entry_index, count(*) AS n FROM s GROUP BY entry_index), c AS (SELECT a.entry_index AS a, b.entry_index AS b, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.entry_index < b.entry_index GROUP BY ALL)
  SELECT a AS entry_index_a, b AS entry_index_b FROM c JOIN n x ON x.entry_index = a JOIN n y ON y.entry_index = b WHERE common * 10 >= (x.n + y.n - common) * 7""")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).pairs().select(F.col("a").alias("entry_index_a"), F.col("b").alias("entry_index_b"))


_LINKED = f"""WITH RECURSIVE f AS ({_FIELDS}), g AS (SELECT entry_index, w, unnest(range(1, len(w) - 1)) AS i FROM f WHERE len(w) >= 3), s AS (SELECT DISTINCT entry_index, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM g),
  n AS (SELECT entry_index, count(*) AS n FROM s GROUP BY entry_index), c AS (SELECT a.entry_index AS a, b.entry_index AS b, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.entry_index < b.entry_index GROUP BY ALL),
  p AS (SELECT a, b, common = x.n AND common = y.n AS same FROM c JOIN n x ON x.entry_index = a JOIN n y ON y.entry_index = b WHERE common * 10 >= (x.n + y.n - common) * 7),
  k AS (SELECT n.entry_index, coalesce(min(p.a), n.entry_index) AS class FROM n LEFT JOIN p ON p.b = n.entry_index AND p.same GROUP BY n.entry_index),
  e AS (SELECT a, b FROM p WHERE NOT same AND a IN (SELECT class FROM k) AND b IN (SELECT class FROM k)), two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r AS (SELECT a, b FROM two UNION SELECT r.a, two.b FROM r JOIN two ON two.a = r.b), root AS (SELECT a AS class, least(a, min(b)) AS root FROM r GROUP BY a), deg AS (SELECT a AS class, count(*) AS links FROM two GROUP BY a)
  SELECT k.entry_index, k.class, coalesce(root.root, k.class) AS "group", coalesce(deg.links, 0) AS links FROM k LEFT JOIN root USING (class) LEFT JOIN deg USING (class)"""


@query(_LINKED)
def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).groups().withColumnRenamed("id", "entry_index")

"""Registered queries: a function of (spark, sf_dir) and, where SQL can say it, the statement it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a ``Tables``; ``sql`` may use the views of ``VIEWS`` as ``{view}``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


#: The provided tables in the shape of the domain; each is a common table expression that a statement may name.
VIEWS = {
    "aln": """SELECT CAST(l_orderkey AS VARCHAR) AS qname, CAST(l_suppkey AS VARCHAR) AS rname, CAST(floor(l_quantity) AS INTEGER) AS a_s,
        l_linenumber AS nm, CAST(o_custkey AS VARCHAR) AS umi, o_orderpriority AS seq, l_shipdate AS start, l_partkey AS part
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "lib": """SELECT l_partkey AS feature, CASE l_returnflag WHEN 'N' THEN 'Input' WHEN 'R' THEN 'IP' ELSE 'Control' END AS condition,
        CAST(year(l_shipdate) AS INTEGER) AS replicate, l_quantity AS quantity, l_linestatus AS status, l_suppkey AS supplier FROM lineitem""",
    "cnt": """SELECT feature, condition, replicate, concat(replicate, CASE condition WHEN 'Input' THEN 'i' WHEN 'IP' THEN 'p' ELSE 'h' END) AS sample,
        count(*) AS count FROM lib GROUP BY 1, 2, 3, 4""",
    "pile": """SELECT l_partkey AS site, l_suppkey % 8 AS pair, CASE l_returnflag WHEN 'R' THEN 'IP' WHEN 'N' THEN 'Input' END AS condition,
        sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS k, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1, 2, 3""",
    "sets": """SELECT DISTINCT o_orderpriority AS set_name, o_custkey AS item FROM orders""",
    "seqs": """SELECT doc_id AS id, source, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents""",
    "vecs": """SELECT label AS grp, feature, avg(v) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS feature FROM embeddings) GROUP BY 1, 2""",
}
_NEEDS = {"cnt": ["lib"]}


def with_views(sql: str) -> str:
    """The statement with the views it names in braces as common table expressions."""
    used: list[str] = []
    for name in VIEWS:
        if "{" + name + "}" in sql:
            used += [v for v in [*_NEEDS.get(name, []), name] if v not in used]
    for name in VIEWS:
        sql = sql.replace("{" + name + "}", name)
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    sql = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql[: len(head)].upper() == head:
            return f"{head}{ctes}, {sql[len(head):]}"
    return f"WITH {ctes} {sql}"


def letters(text: str) -> Column:
    """The letters a to z of a text, lower-cased."""
    from pyspark.sql import functions as F

    return F.regexp_replace(F.lower(text), "[^a-z]+", "")


def bases(letters: Column) -> Column:
    """Letters as bases, one for one: a part of the letters has that part's bases."""
    from pyspark.sql import functions as F

    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])


class Tables:
    """The input tables of a folder, and the views of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def aln(self) -> DataFrame:
        return self.alignments()

    def alignments(self, *more: str, orders: DataFrame | None = None) -> DataFrame:
        """``aln`` with ``more`` columns of its tables, of some ``orders`` only if given.

        A window over ``l_orderkey``, which tells reads apart as ``qname`` does, needs no shuffle after the join.
        """
        from pyspark.sql import functions as F

        rows = self.lineitem.join(self.orders if orders is None else orders, F.col("l_orderkey") == F.col("o_orderkey"))
        text = lambda c: F.col(c).cast("string")
        return rows.select(text("l_orderkey").alias("qname"), text("l_suppkey").alias("rname"), F.floor("l_quantity").cast("int").alias("as"), F.col("l_linenumber").alias("nm"), text("o_custkey").alias("umi"), F.col("o_orderpriority").alias("seq"), F.col("l_shipdate").alias("start"), F.col("l_partkey").alias("part"), *more)

    @property
    def lib(self) -> DataFrame:
        from pyspark.sql import functions as F

        condition = F.when(F.col("l_returnflag") == "N", "Input").when(F.col("l_returnflag") == "R", "IP").otherwise("Control")
        return self.lineitem.select(F.col("l_partkey").alias("feature"), condition.alias("condition"), F.year("l_shipdate").alias("replicate"), F.col("l_quantity").alias("quantity"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("supplier"))

    @property
    def cnt(self) -> DataFrame:
        from pyspark.sql import functions as F

        letter = F.when(F.col("condition") == "Input", "i").when(F.col("condition") == "IP", "p").otherwise("h")
        return self.lib.withColumn("sample", F.concat(F.col("replicate").cast("string"), letter)).groupBy("feature", "condition", "replicate", "sample").agg(F.count("*").alias("count"))

    @property
    def pile(self) -> DataFrame:
        from pyspark.sql import functions as F

        condition = F.when(F.col("l_returnflag") == "R", "IP").when(F.col("l_returnflag") == "N", "Input")
        rows = self.lineitem.where(F.col("l_returnflag").isin("R", "N")).select(F.col("l_partkey").alias("site"), (F.col("l_suppkey") % 8).alias("pair"), condition.alias("condition"), F.col("l_linestatus").alias("s"))
        return rows.groupBy("site", "pair", "condition").agg(F.count_if(F.col("s") == "O").alias("k"), F.count("*").alias("n"))

    @property
    def sets(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.orders.select(F.col("o_orderpriority").alias("set_name"), F.col("o_custkey").alias("item")).distinct()

    @property
    def seqs(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.documents.select(F.col("doc_id").alias("id"), "source", bases(letters("text")).alias("seq"))

    @property
    def vecs(self) -> DataFrame:
        from pyspark.sql import functions as F

        rows = self.embeddings.select(F.col("label").alias("group"), F.posexplode("embedding").alias("feature", "v"))
        return rows.groupBy("group", "feature").agg(F.avg(F.col("v").cast("double")).alias("value"))

"""Sources outside the lake: log search over HTTP, JDBC databases, a committed service catalog, and tables by environment."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Answers after which the same request may succeed, and what a search says of a column it lacks.
TRANSIENT = frozenset([408, 425, 429, 500, 502, 503, 504])
NO_COLUMN = re.compile(r"(?i)(?:no field named|column .* not found|schema error|unknown column)")
#: Days after which a service catalog is stale.
CATALOG_DAYS = 30

Fetch = Callable[[dict], tuple[int, str]]


def search_window(fetch: Fetch, stream: str, columns: list[str], start: datetime, end: datetime, attempts: int = 4, pause: float = 0.2) -> list[dict]:
    """The hits of one window: transient answers are asked for again after growing pauses; an answer that a column is
    missing is asked for once more with all columns, of which those there are taken."""
    query = {"sql": f"select {', '.join(columns)} from {stream}", "start": start.isoformat(), "end": end.isoformat()}
    for k in range(attempts):
        status, body = fetch(query)
        if status == 200:
            return [{c: hit.get(c) for c in columns} for hit in json.loads(body)["hits"]]
        if status == 400 and NO_COLUMN.search(body) and "select *" not in query["sql"]:
            query = query | {"sql": f"select * from {stream}"}
            continue
        if status not in TRANSIENT or k == attempts - 1:
            raise RuntimeError(f"the search failed with {status}: {body[:200]}")
        time.sleep(pause * 2**k)
    raise RuntimeError("the search did not answer")


def http_logs(spark: SparkSession, fetch: Fetch, stream: str, schema: str, start: datetime, end: datetime, step: timedelta) -> DataFrame:
    """The hits of a stream between two times, of that schema (DDL): one request a step, spread over the executors.

    fetch takes a request and gives (status, body); it is sent to the executors and makes the connection there.
    """
    n = max(0, -(-(end - start) // step))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                hits = search_window(fetch, stream, names, start + k * step, min(end, start + (k + 1) * step))
                yield pd.DataFrame(hits, columns=names)

    return spark.range(0, n, 1, max(1, min(n, 64))).mapInPandas(run, schema)


def catalog(spark: SparkSession, path: str, today: date) -> DataFrame:
    """The services of a JSON catalog (one object a line) with their fields, and stale if captured too long ago or never."""
    age = F.datediff(F.lit(today), F.expr("try_to_timestamp(capturedAt)").cast("date"))
    return spark.read.json(path).withColumn("stale", F.coalesce(age > CATALOG_DAYS, F.lit(True)))


def jdbc_options(kind: str, host: str, database: str, user: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> dict[str, str]:
    """Options of spark.read.format("jdbc"): read-only, fetched in pages, split by a numeric key if its bounds are given."""
    url = {"pg": f"jdbc:postgresql://{host}/{database}", "mssql": f"jdbc:sqlserver://{host};databaseName={database};applicationIntent=ReadOnly"}[kind]
    out = {"url": url, "dbtable": table, "user": user, "fetchsize": "10000", "pushDownPredicate": "true"}
    if kind == "pg":
        out["sessionInitStatement"] = "set default_transaction_read_only = on"
    if key and bounds:
        out |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return out


def jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A table of a database; needs its driver on the cluster."""
    return spark.read.format("jdbc").options(**options).load()


def environment_table(spark: SparkSession, roots: dict[str, str], environment: str, name: str) -> DataFrame:
    """A table of an environment whose databases are exported to folders; ValueError for one that is not known."""
    if environment not in roots:
        raise ValueError(f"no such environment: {environment}; known: {', '.join(sorted(roots))}")
    return spark.read.parquet(f"{roots[environment]}/{name}.parquet").withColumn("_environment", F.lit(environment))


def streams(spark: SparkSession, folder: str) -> DataFrame:
    """(stream): the tables of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(x.getPath().getName().removesuffix(".parquet") for x in found if x.getPath().getName().endswith(".parquet"))
    return spark.createDataFrame([(n,) for n in names], "stream string")

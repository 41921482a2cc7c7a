"""Run registered queries and their SQL side by side: python tests/compare.py [folder] [name ...]"""

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, folder):
    """Differences as text, empty when the results agree."""
    frame = query(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    connection = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    expected = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    if got != expected:
        left, right = set(got) - set(expected), set(expected) - set(got)
        return f"{len(got)} against {len(expected)} rows; only here {sorted(left, key=repr)[:3]}; only in SQL {sorted(right, key=repr)[:3]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    oracle = contract.oracle_sql()
    for name, query in contract.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            problem = compare(session, name, query, oracle[name], folder)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - began:6.1f}s {problem or 'ok'}", flush=True)

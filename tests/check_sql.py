"""Run registered queries and the SQL that states them side by side:  python tests/check_sql.py [dir] [name ...]"""

import math
import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, name, fn, statement):
    import duckdb
    started = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - started
    if statement is None:
        return f"rows only ({len(got)})", took, len(got) > 0
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(statement)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", took, False
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        extra, missing = [x for x in a if x not in b][:3], [x for x in b if x not in a][:3]
        return f"DIFFER {len(a)} vs {len(b)}\n   cols {sorted(names)}\n   spark {extra}\n   sql   {missing}", took, False
    return f"match ({len(a)})", took, True


def too_slow(*_):
    raise TimeoutError("query exceeds its time")


def main():
    signal.signal(signal.SIGALRM, too_slow)
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    statements, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and name not in wanted and not any(w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        signal.alarm(int(os.environ.get("CHECK_SECONDS", "60")))
        try:
            note, took, ok = compare(spark, sf_dir, name, fn, statements.get(name))
        except BaseException as error:  # report and go on
            note, took, ok = f"ERROR {type(error).__name__} {str(error)[:1500]}", 0.0, False
        finally:
            signal.alarm(0)
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {took:6.2f}s {note}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()

import os
import subprocess
import sys

import pytest

from helpers import rows_of
from tillcast.schema import LOG_SCHEMA
from tillcast.sources import csv_files, log

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def written(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder / "*.csv")


def test_columns_go_by_each_files_header(spark, tmp_path):
    path = written(
        tmp_path,
        a="price,total,order_id\n1.5,3.0,x\n",
        b="total,order_id,price\n10.5,y,2.1\n",
        c="order_id,price\nz,4\n",
        d="",
        e='"order_id","total","price","note"\n"w, v",7,1,"a ""b"""\n',
    )
    got = log.read_transactions(spark, path)
    assert got.columns == ["order_id", "price", "total"]
    found = {r["order_id"]: (r["price"], r["total"]) for r in got.collect()}
    text = {k: tuple(None if v is None else float(v) for v in vs) for k, vs in found.items()}
    assert text == {"x": (1.5, 3.0), "y": (2.1, 10.5), "z": (4.0, None), "w, v": (1.0, 7.0)}


BAD = "order_id,quantity,price\nx,1,1.5\ny,two,1\n\nz,1\nw,3.0,nan\nv,1.5,2\nu,1,1.00001\ny,two,1\nt,1,2,3\n"


def test_malformed_lines_are_kept_aside(spark, tmp_path):
    path = written(tmp_path, a=BAD, b="price,order_id\n2,s\nabc,r\n")
    got = log.read_transactions(spark, path, malformed="aside")
    assert rows_of(got, "order_id", "quantity") == [("s", None), ("w", 3), ("x", 1)]
    wrong = log.malformed_transactions(spark, path).collect()
    found = sorted((os.path.basename(r["file"]), r["line"], r["reason"], r["record"]) for r in wrong)
    assert found == [
        ("a.csv", 3, "quantity", "y,two,1"),
        ("a.csv", 5, "number of fields", "z,1"),
        ("a.csv", 7, "quantity", "v,1.5,2"),
        ("a.csv", 8, "price", "u,1,1.00001"),
        ("a.csv", 9, "quantity", "y,two,1"),
        ("a.csv", 10, "number of fields", "t,1,2,3"),
        ("b.csv", 3, "price", "abc,r"),
    ]
    with pytest.raises(Exception, match="malformed .* in .*csv"):
        log.read_transactions(spark, path).collect()


def test_line_numbers_across_blocks(spark, tmp_path):
    """A file that is read in many blocks: numbers go on from block to block."""
    rows = [f"o{i},{i}" if i % 97 else f"o{i},bad" for i in range(1, 3000)]
    path = written(tmp_path, a="order_id,quantity\n" + "\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        wrong = log.malformed_transactions(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["line"] for r in wrong) == [i + 1 for i in range(97, 3000, 97)]
    assert all(r["record"] == f"o{r['line'] - 1},bad" for r in wrong)


def test_headers(spark, tmp_path):
    path = written(tmp_path, a="a,b\n1,2\n", b="a,b\n3,4\n", c="b,a\n")
    assert sorted(map(len, csv_files.headers(spark, path).values())) == [1, 2]
    with pytest.raises(ValueError, match="repeated"):
        log.read_transactions(spark, written(tmp_path, z="price,price\n1,2\n"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("")
    assert csv_files.read(spark, str(tmp_path / "empty"), LOG_SCHEMA).count() == 0
    with pytest.raises(ValueError, match="label"):
        log.read_labels(spark, written(tmp_path / "empty", b="customer_id\n1\n"))


def test_compressed_files(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "order_id string, quantity int")
    rows.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "z"))
    assert rows_of(log.read_transactions(spark, str(tmp_path / "z"))) == [("x", 1), ("y", 2)]


def test_local_session_without_a_folder():
    """A plain local master with no setting at all can write intermediate tables."""
    program = (
        "from tillcast.session import get_session, materialise\n"
        "s = get_session(master='local[1]', **{'spark.ui.enabled': 'false'})\n"
        "assert materialise(s.range(3)).count() == materialise(s.range(3)).count() == 3\n"
    )
    done = subprocess.run([sys.executable, "-c", program], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_line_is_parsed_once(spark, tmp_path):
    """However many conditions read its fields."""
    path = written(tmp_path, a="order_id,quantity,price\nx,1,2.5\ny,many,3\n")
    for got in (log.read_transactions(spark, path, "aside"), log.malformed_transactions(spark, path)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_csv(") == 1
        assert got.count() == 1

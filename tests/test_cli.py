"""The command line tools, and rows as an RDD."""

import json

import numpy as np
import pytest

from rowfeed import Field, Schema, cli
from rowfeed.functions.codecs import Tensor
from rowfeed.sinks.writer import stored_schema, write_rows
from rowfeed.sources.scan import Reader, Scan, dataset_rdd

DECLARED = Schema("declared", [Field("id", np.int64), Field("v", np.float64, (), None, True)])


def test_tools(spark, tmp_path, capsys):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    spark.createDataFrame([(i, None if i % 2 else i / 2, "x") for i in range(20)], "id bigint, v double, w string").write.parquet(a)
    assert cli.main(["copy", a, b, "--fields", "id", "v", "--not-null", "v", "--files", "1"]) == 0
    assert spark.read.parquet(b).count() == 10 and spark.read.parquet(b).columns == ["id", "v"]
    assert cli.main(["attach", b, "tests.test_cli:DECLARED"]) == 0
    assert stored_schema(spark, b) == DECLARED
    assert cli.main(["show", b]) == 0 and "v: float64" in capsys.readouterr().out
    assert cli.main(["throughput", b, "--warmup", "5", "--measured", "30"]) == 0
    assert json.loads(capsys.readouterr().out)["samples"] == 30
    with pytest.raises(SystemExit):
        cli.main(["--conf", "no-value", "show", b])


def test_rdd_of_decoded_rows(spark, tmp_path):
    schema = Schema("t", [Field("id", np.int32), Field("m", np.float32, (2, 2), Tensor())])
    write_rows(spark, f"file://{tmp_path}/t", schema, [{"id": i, "m": np.full((2, 2), i, np.float32)} for i in range(9)], files=3)
    got = dataset_rdd(spark, f"file://{tmp_path}/t").map(lambda r: (int(r["id"]), float(r["m"].sum()))).collect()
    assert sorted(got) == [(i, 4.0 * i) for i in range(9)]
    reader = Reader(spark, Scan(f"file://{tmp_path}/t", ["id"]), True)

    assert reader.diagnostics()["plan"]

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import types as T

from rowfeed import Field, Schema
from rowfeed.functions.codecs import PackedTensor, Scalar, Tensor, codec_of, complies, to_matrix
from rowfeed.schema import DecodeError, match_names
from rowfeed.sinks.writer import attach, copy, describe, get_side, load_indexes, store_indexes, stored_schema, write_rows
from rowfeed.sources import generate
from rowfeed.operators.index import NotNullIndex, Single, ValueIndex

TENSORS = Schema("tensors", [
    Field("id", np.int64), Field("name", str, nullable=True), Field("price", "decimal", (), Scalar(T.DecimalType(10, 9))), Field("matrix", np.float32, (3, 2)),
    Field("packed", np.uint16, (None, 2), PackedTensor()), Field("flag", np.bool_), Field("words", str, (None,), nullable=True),
])


def row(i):
    return {"id": i, "name": None if i % 2 else f"n{i}", "price": Decimal(i) / 100, "matrix": np.full((3, 2), i, np.float32), "packed": np.arange(2 * (i + 1), dtype=np.uint16).reshape(-1, 2), "flag": i % 3 == 0, "words": None if i % 5 == 0 else np.array([str(i), str(i + 1)])}


def test_round_trip_through_parquet(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    back = write_rows(spark, path, TENSORS, [row(i) for i in range(20)], row_group_mb=1, files=2)
    schema = Schema.of(back)
    assert schema == TENSORS and stored_schema(spark, path) == TENSORS
    for r in back.collect():
        got, want = schema.decode(r), row(r.id)
        for k, v in want.items():
            assert got[k] is None if v is None else np.array_equal(got[k], v), k


def test_validation():
    with pytest.raises(ValueError, match="missing"):
        TENSORS.encode({"id": 1})
    with pytest.raises(ValueError, match="not in schema"):
        TENSORS.encode(row(1) | {"zz": 1})
    with pytest.raises(ValueError, match="not nullable"):
        TENSORS.encode(row(1) | {"flag": None})
    with pytest.raises(ValueError, match="shape"):
        TENSORS.encode(row(1) | {"matrix": np.zeros((2, 2), np.float32)})
    with pytest.raises(ValueError, match="type float64"):
        TENSORS.encode(row(1) | {"matrix": np.zeros((3, 2))})
    with pytest.raises(TypeError):
        Scalar().encode(Field("x", np.int32), [1])
    with pytest.raises(ValueError, match="no string"):
        Scalar().encode(Field("x", str), 1)


def test_decode_error_names_the_field(spark):
    r = spark.createDataFrame([(bytearray(b"junk"),)], "m binary").first()
    with pytest.raises(DecodeError, match="field m"):
        Schema("s", [Field("m", np.int32, (2,))]).decode(r)


def test_views_and_patterns():
    assert list(TENSORS.view(["p.*", TENSORS.id]).fields) == ["id", "price", "packed"]
    with pytest.warns(UserWarning, match="whole names"):
        assert match_names(["na"], ["name", "other"]) == []
    assert match_names(None, ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        TENSORS.view([Field("zz", np.int8)])


def test_inference(spark, sf):
    s = Schema.of(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert s.embedding.shape == (None,) and s.embedding.dtype == "float32" and s.vec_id.dtype == "int64"
    df = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    with pytest.warns(UserWarning, match="left out"):
        assert not Schema.of(df).fields
    with pytest.raises(ValueError):
        Schema.of(df, strict=True)


def test_shapes_and_codecs_by_name(spark):
    assert complies((3, 4), (None, 4)) and not complies((3,), (None, 4)) and not complies((3, 5), (3, 4))
    assert isinstance(codec_of("ndarray"), Tensor) and isinstance(codec_of("ndarray:deflate"), PackedTensor)
    assert codec_of("scalar:decimal(10,9)").spark_type() == T.DecimalType(10, 9)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 2, 3, 4],)], "v array<int>")
    assert df.select(to_matrix(F.col("v"), 2)).first()[0] == [[1, 2], [3, 4]]
    with pytest.raises(Exception, match="divide"):
        df.select(to_matrix(F.col("v"), 3)).collect()


def test_image():
    f = Field("i", np.uint8, (4, 4, 3), codec_of("image:png:80"))
    x = np.random.default_rng(0).integers(0, 255, (4, 4, 3), dtype=np.uint8)
    assert np.array_equal(f.encoding.decode(f, f.encoding.encode(f, x)), x)


def test_indexes_beside_the_data(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    spark.range(100).selectExpr("id", "id div 10 as tens", "if(id < 30, id, null) as low").repartition(5, "tens").write.parquet(path)
    store_indexes(spark, path, [ValueIndex("tens", "tens"), NotNullIndex("low", "low")])
    from rowfeed.sources.rowgroups import physical

    rows, found = physical(spark, path), load_indexes(spark, path)
    picked = Single("tens", [3]).rows(rows, found)
    assert picked.where("tens = 3").count() == 10 and picked.count() < 100
    assert get_side(spark, path)["indexes"] == ["low", "tens"]
    assert "Index tens: 10 values" in describe(spark, path, values=True)
    with pytest.raises(ValueError, match="no index"):
        Single("zz", [1]).groups(found)
    attach(spark, path, Schema("s", [Field("id", np.int64)]))
    assert get_side(spark, path)["indexes"] == ["low", "tens"] and list(stored_schema(spark, path).fields) == ["id"]


def test_copy(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "id int, v int, w string").write.parquet(a)
    out = copy(spark, a, b, ["id", "v"], ["v"])
    assert [tuple(r) for r in out.collect()] == [(2, 5)]
    with pytest.raises(ValueError, match="no field"):
        copy(spark, a, b, ["zz"])
    assert copy(spark, a, b, overwrite=True, files=1).count() == 2


def test_generated_rows(spark):
    df = generate.frame(spark, Schema("g", [Field("a", np.int32), Field("b", np.float32), Field("c", str), Field("d", np.bool_)]), 50, seed=1)
    assert df.count() == 50 and df.collect() == generate.frame(spark, Schema("g", [Field("a", np.int32), Field("b", np.float32), Field("c", str), Field("d", np.bool_)]), 50, seed=1).collect()
    p = next(generate.endless(TENSORS))
    assert p["matrix"].shape == (3, 2) and p["packed"].shape == (generate.VARIABLE, 2)
    assert next(generate.dummy_batches(4, 8)).shape == (4, 8)

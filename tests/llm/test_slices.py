import pyarrow as pa
from pyspark.sql import functions as F

from isohypse.llm import decontaminate, pii
from isohypse.llm._arrow import _ROWS


def test_whole_batches_are_never_python_objects_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "call +1 (499) 555-6503")], "doc_id long, text string")
    benchmark = docs.select(F.lit("b").alias("item_id"), F.lit("one two three").alias("text"))
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema: taken.append(fn) or self)
    monkeypatch.setattr(pii, "fit", lambda docs: pii.learn([]))
    pii.redact(docs)
    decontaminate.clean(docs, benchmark)
    n = 4 * _ROWS + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["call +1 (499) 555-6503"] * n)], names=["doc_id", "text"])
    for fn in taken:
        out = list(fn(iter([batch])))
        assert [r for b in out for r in b.column(0).to_pylist()] == list(range(n))
        assert max(b.num_rows for b in out) == _ROWS
    assert len(taken) == 2

import os

from wireloom.functions import tables


def test_scratch_tables_come_and_go(spark):
    a, b = tables.written(spark.range(5), "kept"), tables.written(spark.range(7), "dropped")
    assert a.count() == 5 and b.count() == 7 and a.dtypes == spark.range(5).dtypes
    place = lambda t: t.written_to.removeprefix("file:")
    assert os.path.isdir(place(a)) and place(a).startswith(tables.scratch_folder(spark).removeprefix("file:"))
    tables.drop(b, None, spark.range(1))
    assert os.path.isdir(place(a)) and not os.path.exists(place(b))
    c = tables.written(a.where("id > 2"), "next")
    tables.drop(a)
    assert sorted(r.id for r in c.collect()) == [3, 4] and not os.path.exists(place(a))

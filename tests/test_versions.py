"""Tables that are replaced as a whole."""

import pytest

from docloom.operators.store import VersionedStore


def test_a_failed_replacement_changes_nothing(spark, tmp_path):
    table = VersionedStore(spark, f"file://{tmp_path}", "history")
    assert not table.exists()
    rows = spark.range(10).withColumnRenamed("id", "x")
    table.append(rows)
    plain, table._switch = table._switch, lambda n: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.replace(table.all().where("x > 5"))
    table._switch = plain
    assert table.all().count() == 10
    before = table.all()
    table.replace(table.all().where("x > 3"))
    assert sorted(r.x for r in table.all().collect()) == [4, 5, 6, 7, 8, 9]
    assert before.count() == 10  # a reader that began before
    table.append(rows.where("x = 0"))
    table.replace(table.all().where("x < 5"))
    assert sorted(r.x for r in table.all().collect()) == [0, 4]
    table.drop()
    assert not table.exists()

"""Intermediate tables: where they are, and that they go."""

from __future__ import annotations

import os

from gneiss import storage


def test_tables_are_released_but_those_still_read(spark):
    mark = storage.written()
    tables = [storage.materialise(spark.range(n), "t") for n in (3, 4, 5)]
    paths = [x[1].removeprefix("file:").replace("//", "/") for x in storage._written[mark:]]
    storage.release(mark, tables[1])
    assert [os.path.isdir(p) for p in paths] == [False, True, False] and storage.written() == mark + 1
    assert tables[1].count() == 4
    storage.release(mark)
    assert storage.written() == mark and not os.path.isdir(paths[1])


def test_tables_go_when_their_session_has_ended(spark, tmp_path):
    class Ended:
        @property
        def _jvm(self):
            raise ConnectionError

    for path in (f"file://{tmp_path}/a", f"{tmp_path}/b"):
        os.mkdir(path.removeprefix("file://"))
        storage._delete(Ended(), path)
    assert os.listdir(tmp_path) == []

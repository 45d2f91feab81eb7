"""Small hand-made LMS tables for tests."""

from __future__ import annotations

from lectern.session import scratch_path
from lectern.sources import LmsTables
from lectern.sources.schemas import SCHEMAS
from tests.conftest import SMALL


def tables(spark, **given) -> LmsTables:
    """A catalogue whose tables hold the given rows (dicts); others are empty."""

    def load(name: str):
        rows = given.get(name, [])
        schema = SCHEMAS[name]
        data = [tuple(row.get(f.name) for f in schema.fields) for row in rows]
        return spark.createDataFrame(data, schema)

    return LmsTables(spark, load)


def event(i, user, course, at, **more):
    row = {
        "id": i, "userid": user, "courseid": course, "timecreated": at, "contextlevel": 50, "contextinstanceid": course,
        "eventname": r"\core\event\course_viewed", "component": "core", "action": "viewed", "target": "course",
    }
    return {**row, **more}


_STORED = {}


def stored(spark):
    """The small test tables stored once per test run, the way a deployment holds them."""
    if "tables" not in _STORED:
        _STORED["tables"] = LmsTables.from_star(spark, SMALL).store(scratch_path(spark, "lms"))
    return _STORED["tables"]

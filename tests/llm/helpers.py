"""Small tables with the schemas of the test data: those of the other tests."""

from tests.helpers import START, build, puzzle, rows, schema

__all__ = ["START", "build", "puzzle", "rows", "schema"]

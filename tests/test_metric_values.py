"""Fields and boolean sequences, as the survey's T-06 and W-02 count them."""

from gaugeworks.operators import trees
from gaugeworks.sources.trees import nodes

FIELDS = """
class A:
    def a(self):
        self.x = 1
        return self.y.z
    def b(self):
        return self.other(self.w) + self.x
"""


def table(spark, code):
    return nodes(spark.createDataFrame([("f", code)], "path string, contents string"), "python")


def test_what_is_called_is_no_field(spark):
    # x, y, z and w (an argument); other is called
    assert trees.counts(table(spark, FIELDS)).first()["fields"] == 4


def test_a_boolean_operator_counts(spark):
    assert trees.cognitive(table(spark, "def f(a, b):\n    return a and b\n")).first()["complexity"] == 1
    assert trees.cognitive(table(spark, "def f(a, b, c):\n    return a and b and c or a\n")).first()["complexity"] == 2

"""Words of a page are folded when it is made, not at every look for a label."""

from proofsheet.plans import catalog

SF = "/root/testdata/sf0.001"


def folds(spark, name):
    """How often the plan translates letters; the map of accents is named in full each time."""
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("translate(")


def test_names_fold_once(spark):
    assert folds(spark, "found_names") == 1


def test_fields_fold_once(spark):
    assert folds(spark, "fields_with_boxes") == 1

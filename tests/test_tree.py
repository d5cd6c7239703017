import compare
import pytest
from tree_cases import CASES, WANTED


@pytest.mark.parametrize("name", sorted(CASES))
def test_analysis_of_a_tree(spark, sf_dir, name):
    assert compare.rows_of_frame(CASES[name](spark, sf_dir)) == compare.rows_of_sql(compare.connect(sf_dir), WANTED[name])

import os

import pytest
from oracle import compare

from tidegate import catalog

QUERIES = catalog.load()
# Minutes of streaming and fitting that the unit tests cover; FULL_CHECK=1 or check_all.py runs them too.
LONG = {"alert_ttl_state", "stream_alert_flow_join", "stream_decisions", "stream_scoring", "scan_eve_stream", "smote",
        "apply_feature_pipeline"}
NAMES = [n for n in sorted(catalog.ORACLE_SQL) if n not in LONG or os.environ.get("FULL_CHECK")]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    assert compare(spark, name, QUERIES[name], catalog.ORACLE_SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(QUERIES)

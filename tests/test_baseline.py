import baseline
from rowstream.plans import catalogue


def test_loops_give_as_many_rows_as_the_queries(spark, sf_dir, tmp_path):
    path = baseline.capture(sf_dir, str(tmp_path))
    for name in ("position_assign", "schema_asof_join", "message_envelope", "changelog_message", "recovery_dedup", "counts_10s_window"):
        assert len(baseline.QUERIES[name](path)) == catalogue.QUERIES[name](spark, sf_dir).count(), name

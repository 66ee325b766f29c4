
from quarry.plans import registry


def test_registered_index_search_recalls_nine_tenths(spark):
    d = "/root/testdata/sf0.1"
    exact, found = ({(r.query_id, r.chunk_id) for r in q(spark, d).collect()} for q in (registry.vector_top_k, registry.vector_ivf))
    assert len(exact & found) >= 0.9 * len(exact)

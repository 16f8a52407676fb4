"""Transfer queries on copies of the events with shifted keys: the SQL's rows, and no join whose rows grow with the square of the copies."""

import duckdb
import pytest

from tests.compare import rows_of, same
from tidetable.plans import catalog


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """copies(n): a folder with the events of sf0.001, all on one day, n times."""

    def make(n):
        folder = tmp_path_factory.mktemp(f"x{n}")
        duckdb.execute(
            f"COPY (SELECT event_id + i * 100000 AS event_id, TIMESTAMP '2024-01-01' + (ts - date_trunc('day', ts)) AS ts, user_id + i * 100000 AS user_id, event_type, value, props FROM range({n}) t(i), '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)"
        )
        return str(folder)

    return {n: make(n) for n in (4, 8)}


def joined(spark, run):
    """Rows that the joins of all queries run by run() put out, as Spark counts them."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    executions, total = store.executionsList(), 0
    for k in range(before, executions.size()):
        id = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(id), store.planGraph(id).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size()) if "Join" in node.name()):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


@pytest.mark.parametrize("name", ["riskiest_transfers", "transfer_route_pairs", "transfer_proposed", "transfer_stop_summary"])
def test_transfer_query_grows_as_its_input(spark, copies, name):
    con, out = duckdb.connect(), {}
    con.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS FROM '{copies[4]}/events.parquet'")
    same(catalog.QUERIES[name](spark, copies[4]), con, catalog.SQL[name])
    for n, folder in copies.items():
        out[n] = joined(spark, lambda folder=folder: catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    assert 0 < out[8] <= 2.5 * out[4]

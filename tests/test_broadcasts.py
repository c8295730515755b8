"""No join broadcasts the voxels of a table: their number grows with the input, unlike that of boxes or taps."""

import pytest

from lamella import catalog
from tests.conftest import SF


def broadcast_rows(df):
    """Rows of each side that the executed plan has broadcast."""
    df.collect()
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif name == "ReusedExchangeExec":
            nodes.append(node.child())
        else:
            if name == "BroadcastExchangeExec":
                found.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("name", ["center_paste", "label_isolate", "nuclei_per_image", "nucleus_ids", "nucleus_normalize", "nucleus_percentiles", "xy_zoom", "z_place"])
def test_voxels_are_not_broadcast(spark, name):
    """25,570 voxels belong to the 60 nuclei of this size; the taps, the largest constant table, have 896 rows at most."""
    assert max(broadcast_rows(catalog.QUERIES[name](spark, SF)), default=0) < 1000

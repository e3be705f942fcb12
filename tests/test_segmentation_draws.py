"""The registered segmentation queries make every draw of the search."""

import pytest

from fleetlens.plans import queries_models as QM
from fleetlens.plans.registry import QUERIES
from tests.conftest import SF_SMALL


class Drawn(Exception):
    pass


@pytest.mark.parametrize("name", ["m13_segmentation_search", "r3_segmentation_scoring"])
def test_every_draw_of_a_family_is_made(spark, monkeypatch, name):
    def stop(space, n_iter, seed=42):
        raise Drawn(n_iter)

    monkeypatch.setattr(QM.SE, "draw", stop)
    with pytest.raises(Drawn) as seen:
        QUERIES[name](spark, SF_SMALL)
    assert seen.value.args == (QM.SEGMENT_DRAWS,) == (8,)

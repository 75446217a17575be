"""packing_law bounds what its Python workers hold."""

import pytest

from tallyloom.llm import packing, queries


def test_packing_law_takes_small_portions(spark, monkeypatch):
    asked = {}

    def pack(*args, **options):
        asked.update(options)
        raise LookupError

    monkeypatch.setattr(packing, "pack", pack)
    with pytest.raises(LookupError):
        queries.packing_law(spark, "/root/testdata/sf0.001")
    assert asked["remembered"] <= 250_000 and asked["portion"] <= 1 << 21

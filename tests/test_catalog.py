from isochron import queries
from isochron.plans import catalog


def test_every_kind_has_its_query():
    assert len(catalog.ANSWERS) == 32
    assert set(catalog.ANSWERS.values()) <= set(queries.queries())

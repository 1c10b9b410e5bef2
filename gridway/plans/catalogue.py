"""Every query of the engine's own operators, with its SQL."""

from __future__ import annotations

from gridway.plans import competence_queries, crowded_queries, data_queries, geo_queries, import_queries, network_queries, rule_queries, serving_queries, text_queries

QUERIES = {**geo_queries.QUERIES, **rule_queries.QUERIES, **data_queries.QUERIES, **serving_queries.QUERIES, **import_queries.QUERIES, **network_queries.QUERIES, **crowded_queries.QUERIES, **competence_queries.QUERIES, **text_queries.QUERIES}
ORACLES = {**geo_queries.ORACLES, **rule_queries.ORACLES, **data_queries.ORACLES, **serving_queries.ORACLES, **import_queries.ORACLES, **network_queries.ORACLES, **crowded_queries.ORACLES, **competence_queries.ORACLES, **text_queries.ORACLES}

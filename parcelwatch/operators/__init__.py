"""DataFrame operators: enrichment, null policy, weighted joins and shares."""

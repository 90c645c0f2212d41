"""Jobs over whole tables: nodes, links, retrieval, reports, routing, pages."""

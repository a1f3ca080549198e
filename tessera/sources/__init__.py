"""Where triples come from: tables of quads, lifted tables, RDF files, endpoints, fragments."""

"""Left empty on purpose: the queries this engine answers have no event time, windows or state.

Continuously arriving data is indexed and queried batch by batch, as tables of quads."""

"""Dashboard operators: ``operator(t, as_of) -> DataFrame`` over a mapping of tables.

Shape shared by all of them: facts are aggregated by their own key before they meet a
dimension, so a join input has one row per key however unevenly the facts are spread, and
what is shuffled is the map-side combined result. Join strategy is left to the planner,
which broadcasts a side only when its size is known to be small.
"""

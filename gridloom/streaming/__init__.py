"""Extensions that consume streams; no operator of the graph engine needs them."""

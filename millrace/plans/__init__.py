"""Query catalogue and the helpers that cut or shape plans."""

"""Query catalogue and its SQL counterparts."""

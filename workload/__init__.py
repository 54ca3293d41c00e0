"""The registered queries, their SQL counterparts, and the input they share."""

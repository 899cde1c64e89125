"""DataFrame -> DataFrame operators over the mail tables."""
